"""Forecasting (FC1-FC5) on per-nation quarterly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.fixtures import sql_with
from .registry import query

_PAIRS = {
    "fc_lagged": ("SELECT code, account, bsns_year, quarter, value, "
                  "LAG(value) OVER (PARTITION BY code, account ORDER BY bsns_year, quarter) AS prev_value, "
                  "LAG(bsns_year * 4 + CAST(substr(quarter, 1, 1) AS INTEGER) - 1) OVER "
                  "(PARTITION BY code, account ORDER BY bsns_year, quarter) AS prev_idx FROM fin_nation_fact",
                  ["fin_nation_fact"]),
    "fc_pairs": ("SELECT code, account, bsns_year, quarter, value / 1e13 AS y, prev_value / 1e13 AS x FROM fc_lagged "
                 "WHERE prev_value IS NOT NULL AND prev_idx = bsns_year * 4 + CAST(substr(quarter, 1, 1) AS INTEGER) - 2",
                 ["fc_lagged"]),
    "fc_fit": ("SELECT code, account, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, "
               "regr_r2(y, x) AS r2, regr_count(y, x) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, "
               "regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS avgx FROM fc_pairs GROUP BY code, account", ["fc_pairs"]),
}


#: A prediction is shown to a whole unit of money (1e4 of the facts' units); it is computed at full precision.
_UNITS = "CAST(floor(trunc({}) / 10000.0 + 0.5) AS BIGINT)"


def _units(c):
    return F.floor(c / F.lit(10000.0) + F.lit(0.5)).cast("long")


def _fit(t):
    p = S.pairs(t.fin_nation_fact)
    return p, S.fit(p)


@query("forecast_pairs", sql_with(["fc_pairs"], "SELECT code, account, bsns_year, quarter, y, x FROM fc_pairs",
                                  extra=_PAIRS))
def forecast_pairs(t):
    """FC1/WN1/SC13: (current, previous) training pairs of consecutive quarters, scaled by 1e13."""
    return S.pairs(t.fin_nation_fact).select("code", "account", "bsns_year", "quarter", "y", "x")


@query("forecast_fit", sql_with(["fc_fit"], "SELECT code, account, ROUND(slope, 9) AS slope, ROUND(intercept, 9) AS intercept, ROUND(r2, 6) AS r2, n FROM fc_fit",
                                extra=_PAIRS))
def forecast_fit(t):
    """FC2/AG8: OLS current ~ 1 + previous per (series, account) via regression aggregates."""
    _, c = _fit(t)
    return c.select("code", "account", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("forecast_next", sql_with(["fc_fit", "fin_nation_fact"], f"""
SELECT l.code, l.account,
       CAST(CASE WHEN substr(l.quarter, 1, 1) = '4' THEN l.bsns_year + 1 ELSE l.bsns_year END AS INTEGER) AS next_year,
       CAST((CAST(substr(l.quarter, 1, 1) AS INTEGER) % 4) + 1 AS VARCHAR) || 'Q' AS next_quarter,
       {_UNITS.format('(f.intercept + f.slope * (l.value / 1e13)) * 1e13')} AS predicted
FROM (SELECT code, account, arg_max(bsns_year, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS bsns_year,
             arg_max(quarter, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS quarter,
             arg_max(value, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS value
      FROM fin_nation_fact GROUP BY code, account) l
JOIN fc_fit f ON f.code = l.code AND f.account = l.account
WHERE f.slope IS NOT NULL""", extra=_PAIRS))
def forecast_next(t):
    """FC3/ST7/UD2: next-quarter forecast from the latest actual of each series."""
    _, c = _fit(t)
    f = t.fin_nation_fact
    pk = F.col("bsns_year") * 10 + F.substring("quarter", 1, 1).cast("int")
    last = f.groupBy("code", "account").agg(F.max_by("bsns_year", pk).alias("bsns_year"),
                                            F.max_by("quarter", pk).alias("quarter"),
                                            F.max_by("value", pk).alias("value"))
    j = last.join(c.filter(F.col("slope").isNotNull()), ["code", "account"])
    ny, nq = S.next_period(F.col("bsns_year"), F.col("quarter"))
    model = S.MODELS["linear"]
    return j.select("code", "account", ny.cast("int").alias("next_year"), nq.alias("next_quarter"),
                    _units(S.apply_scaled(F.col("value"), lambda x: model(x, F.col("intercept"), F.col("slope"))))
                    .alias("predicted"))


@query("forecast_backtest", sql_with(["fc_fit", "fc_pairs"], f"""
SELECT p.code, p.account, CAST(p.bsns_year AS VARCHAR) || '-' || p.quarter AS date,
       CAST(trunc(p.y * 1e13) AS BIGINT) AS current,
       {_UNITS.format('(f.intercept + f.slope * p.x) * 1e13')} AS predicted
FROM fc_pairs p JOIN fc_fit f ON f.code = p.code AND f.account = p.account WHERE f.slope IS NOT NULL""", extra=_PAIRS))
def forecast_backtest(t):
    """FC4: in-sample fitted series, actual next to predicted."""
    p, c = _fit(t)
    j = p.join(c.filter(F.col("slope").isNotNull()), ["code", "account"])
    return j.select("code", "account", F.concat_ws("-", F.col("bsns_year").cast("string"), "quarter").alias("date"),
                    S.inv_scale(F.col("y")).alias("current"),
                    _units(S.predict(F.col("x"), F.col("intercept"), F.col("slope"))).alias("predicted"))


@query("forecast_summary", sql_with(["fc_fit"], """
SELECT code, account, n, ROUND(r2, 6) AS r2,
       ROUND(sqrt(CASE WHEN n - 2 = 0 THEN NULL ELSE (syy - sxy * sxy / sxx) / (n - 2) END), 9) AS sigma,
       ROUND(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS se_slope,
       ROUND(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + avgx * avgx / sxx)), 9) AS se_intercept,
       ROUND(slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS t_slope
FROM fc_fit WHERE n > 2""", extra=_PAIRS))
def forecast_summary(t):
    """FC5: model summary (n, R², residual σ, standard errors, t of the slope) in closed form."""
    _, c = _fit(t)
    return S.summary(c.filter(F.col("n") > 2))


# ------------------------------------------------------------------------------- two lags
_TWO = {
    "f2_rows": ("""
SELECT code, account, bsns_year, quarter, value / 1e13 AS y, v1 / 1e13 AS x1, v2 / 1e13 AS x2, value / 1e13 AS z1, v1 / 1e13 AS z2,
  i1 = idx - 1 AS has1, i2 = idx - 2 AS has2 FROM (
  SELECT code, account, bsns_year, quarter, value, LAG(value) OVER w AS v1, LAG(value, 2) OVER w AS v2, idx,
         LAG(idx) OVER w AS i1, LAG(idx, 2) OVER w AS i2
  FROM (SELECT *, bsns_year * 4 + CAST(substr(quarter, 1, 1) AS INTEGER) - 1 AS idx FROM fin_nation_fact) a
  WINDOW w AS (PARTITION BY code, account ORDER BY bsns_year, quarter)) b""", ["fin_nation_fact"]),
    "f2_gram": ("""
SELECT code, account, COUNT(*) AS n, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2, var_pop(y) AS vy, covar_pop(x1, x1) AS s11,
  covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS h1, covar_pop(x2, y) AS h2
FROM f2_rows WHERE has2 GROUP BY code, account""", ["f2_rows"]),
    "f2_fit": ("""
SELECT *, CASE WHEN ok THEN my - b1 * m1 - b2 * m2 END AS b0, CASE WHEN ok THEN (b1 * h1 + b2 * h2) / vy END AS r2 FROM (
  SELECT *, CASE WHEN ok THEN (s22 * h1 - s12 * h2) / (s11 * s22 - s12 * s12) END AS b1,
            CASE WHEN ok THEN (s11 * h2 - s12 * h1) / (s11 * s22 - s12 * s12) END AS b2
  FROM (SELECT *, n > 3 AND s11 > 0 AND s22 > 0 AND 1 - s12 * s12 / (s11 * s22) > 1e-6 AS ok FROM f2_gram) a) b""", ["f2_gram"]),
}


@query("forecast_fit_two_lags", sql_with(["f2_fit"], """
SELECT code, account, n, ROUND(b0, 6) AS intercept, ROUND(b1, 6) AS slope1, ROUND(b2, 6) AS slope2, ROUND(r2, 6) AS r2 FROM f2_fit""",
                                         extra=_TWO))
def forecast_fit_two_lags(t):
    """FC2: OLS with several regressors (the two quarters before): one Gram aggregate per series, then small solves."""
    c = S.fit_many(S.lagged(t.fin_nation_fact, 2), ["x1", "x2"])
    return c.select("code", "account", "n", F.round("intercept", 6).alias("intercept"), F.round(F.get("coef", F.lit(0)), 6).alias("slope1"),
                    F.round(F.get("coef", F.lit(1)), 6).alias("slope2"), F.round("r2", 6).alias("r2"))


@query("forecast_next_two_lags", sql_with(["f2_fit", "f2_rows"], f"""
SELECT f.code, f.account, {_UNITS.format('(f.b0 + f.b1 * l.z1 + f.b2 * l.z2) * 1e13')} AS predicted
FROM f2_fit f JOIN (SELECT code, account, arg_max(z1, p) AS z1, arg_max(z2, p) AS z2 FROM (
  SELECT *, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER) AS p FROM f2_rows WHERE has1) x GROUP BY 1, 2) l
  ON l.code = f.code AND l.account = f.account WHERE f.ok""", extra=_TWO))
def forecast_next_two_lags(t):
    """FC3: the quarter after the latest by the two-lag model, predicted at full precision."""
    f = t.fin_nation_fact
    c = S.fit_many(S.lagged(f, 2), ["x1", "x2"]).filter(F.col("coef").isNotNull())
    pk = F.col("bsns_year") * 10 + F.substring("quarter", 1, 1).cast("int")
    last = S.lagged(f, 2, current=False).groupBy("code", "account").agg(*[F.max_by(x, pk).alias(x) for x in ("x1", "x2")])
    p = S.predict_many(F.col("intercept"), F.col("coef"), [F.col("x1"), F.col("x2")])
    return last.join(c, ["code", "account"]).select("code", "account", _units(p).alias("predicted"))
