"""Quarterly series and lag-1 OLS forecasting, grouped by (series, account).

The model is ``current ~ 1 + previous`` on values scaled by 1e13.  Fitting
uses the SQL regression aggregates (``regr_slope``, ``regr_intercept``,
``regr_r2``, ``regr_sxx`` …), which are algebraic: partial aggregates are
merged across tasks, so one series holding a third of all rows is still
combined map-side.  Prediction is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.reference_values import FORECAST_SCALE

SERIES = ["code", "account"]


def scale(c: Column) -> Column:
    return c / F.lit(FORECAST_SCALE)


def inv_scale(c: Column) -> Column:
    """Inverse scaler: ×1e13 and truncate to int64."""
    return (c * F.lit(FORECAST_SCALE)).cast("long")


def apply_scaled(c: Column, model: Callable[[Column], Column],
                 scaler: Callable[[Column], Column] = scale,
                 inv_scaler: Callable[[Column], Column] = inv_scale) -> Column:
    """Scale -> model -> inverse scale, all as native expressions."""
    return inv_scaler(model(scaler(c)))


def period_index(year: Column, quarter: Column) -> Column:
    return year * 4 + F.substring(quarter, 1, 1).cast("int") - 1


def pairs(facts: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, bsns_year, quarter, x=previous scaled, y=current scaled) — consecutive quarters only."""
    w = Window.partitionBy(*keys).orderBy("bsns_year", "quarter")
    f = facts.select(*keys, "bsns_year", "quarter", "value",
                     F.lag("value").over(w).alias("prev_value"),
                     F.lag(period_index(F.col("bsns_year"), F.col("quarter"))).over(w).alias("prev_idx"))
    f = f.filter(F.col("prev_value").isNotNull()
                 & (F.col("prev_idx") == period_index(F.col("bsns_year"), F.col("quarter")) - 1))
    return f.select(*keys, "bsns_year", "quarter", scale(F.col("value")).alias("y"),
                    scale(F.col("prev_value")).alias("x"))


def fit(p: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """OLS per group at full precision: slope, intercept, r2, n, moments (round what is shown, not what predicts)."""
    return p.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_avgx("y", "x").alias("avgx"))


def lagged(facts: DataFrame, lags: int, keys: list[str] = SERIES, current: bool = True) -> DataFrame:
    """(keys, bsns_year, quarter, y, x1..xk): scaled value and the values of the ``lags`` quarters before, none missing.

    With ``current`` false the row of a quarter has the regressors of the quarter after it: x1 is its own value.
    """
    w = Window.partitionBy(*keys).orderBy("bsns_year", "quarter")
    idx = period_index(F.col("bsns_year"), F.col("quarter"))
    back = range(1, lags + 1) if current else range(0, lags)
    f = facts.select(*keys, "bsns_year", "quarter", "value", *[F.lag("value", k).over(w).alias(f"v{k}") for k in back if k],
                     idx.alias("idx"), F.lag(idx, max(back)).over(w).alias("first_idx"))
    f = f.filter(F.col("first_idx") == F.col("idx") - max(back))
    return f.select(*keys, "bsns_year", "quarter", scale(F.col("value")).alias("y"),
                    *[scale(F.col(f"v{k}") if k else F.col("value")).alias(f"x{i + 1}") for i, k in enumerate(back)])


def fit_many(p: DataFrame, xs: list[str], y: str = "y", keys: list[str] = SERIES, tolerance: float = 1e-6) -> DataFrame:
    """OLS y ~ 1 + xs per group: (keys, n, coef array<double>, intercept, r2) by the normal equations.

    The Gram matrix is a handful of means and covariances per group, algebraic aggregates that are merged across tasks;
    the groups' small systems are then solved many at once.  They are solved in correlations, so scales don't
    matter; a group whose correlation matrix has a determinant of ``tolerance`` or less, or no more rows than unknowns, has no
    coefficients.
    """
    k = len(xs)
    pairs_ = [(i, j) for i in range(k) for j in range(i, k)]
    g = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.covar_pop(x, y).alias(f"h{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"g{i}_{j}") for i, j in pairs_])
    schema = T.StructType([*[g.schema[c] for c in keys], *T._parse_datatype_string(
        "n bigint, coef array<double>, intercept double, r2 double").fields])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gram = np.empty((len(pdf), k, k))
            for i, j in pairs_:
                gram[:, i, j] = gram[:, j, i] = pdf[f"g{i}_{j}"].to_numpy(float)
            h = pdf[[f"h{i}" for i in range(k)]].to_numpy(float)
            sd = np.sqrt(np.einsum("nii->ni", gram))
            ok = (sd > 0).all(1) & (pdf["n"].to_numpy() > k + 1)
            d = np.where(sd > 0, sd, 1.0)
            r = gram / d[:, :, None] / d[:, None, :]
            ok &= np.linalg.det(np.where(ok[:, None, None], r, np.eye(k))) > tolerance
            b = np.linalg.solve(np.where(ok[:, None, None], r, np.eye(k)), (h / d)[:, :, None])[:, :, 0] / d
            means = pdf[[f"m{i}" for i in range(k)]].to_numpy(float)
            vy = pdf["vy"].to_numpy(float)
            out = pdf[[*keys, "n"]].copy()
            out["coef"] = [x.tolist() if m else None for x, m in zip(b, ok)]
            a = pdf["my"].to_numpy(float) - (b * means).sum(1)
            out["intercept"] = pd.Series([x if m else None for x, m in zip(a.tolist(), ok)], dtype=object, index=out.index)
            r2 = (b * h).sum(1) / np.where(vy > 0, vy, 1.0)
            out["r2"] = pd.Series([x if m else None for x, m in zip(r2.tolist(), ok & (vy > 0))], dtype=object, index=out.index)
            yield out
    return g.mapInPandas(solve, schema)


def predict_many(intercept: Column, coef: Column, xs: list[Column]) -> Column:
    """(a + b1·x1 + ... + bk·xk) scaled back to int64 money."""
    return inv_scale(reduce(lambda acc, ix: acc + F.get(coef, F.lit(ix[0])) * ix[1], enumerate(xs), intercept))


def predict(x_scaled: Column, intercept: Column, slope: Column) -> Column:
    """(a + b·x) scaled back to int64 money."""
    return inv_scale(intercept + slope * x_scaled)


def summary(coefs: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Closed-form OLS summary: residual std. error, standard errors and t of both coefficients."""
    sse = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    s2 = F.try_divide(sse, (F.col("n") - 2).cast("double"))
    se_b = F.sqrt(F.try_divide(s2, F.col("sxx")))
    se_a = F.sqrt(s2 * (F.lit(1.0) / F.col("n") + F.col("avgx") * F.col("avgx") / F.col("sxx")))
    return coefs.select(*keys, "n", F.round("r2", 6).alias("r2"), F.round(F.sqrt(s2), 9).alias("sigma"),
                        F.round(se_b, 6).alias("se_slope"), F.round(se_a, 9).alias("se_intercept"),
                        F.round(F.try_divide(F.col("slope"), se_b), 4).alias("t_slope"))


def next_period(year: Column, quarter: Column) -> tuple[Column, Column]:
    qn = F.substring(quarter, 1, 1).cast("int")
    ny = F.when(qn == 4, year + 1).otherwise(year)
    nq = F.concat((qn % 4 + 1).cast("string"), F.lit("Q"))
    return ny, nq


# Model registry by name: fit-free prediction functions over scaled columns.
MODELS: dict[str, Callable[..., Column]] = {
    "linear": lambda x, intercept, slope: intercept + slope * x,
}
