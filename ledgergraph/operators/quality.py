"""Data-quality operators: database constraints re-expressed as DataFrame checks.

Every check is an aggregate or an anti/semi join, so it runs distributed and
returns small report tables (one row per check or per violating key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphan_counts(checks: list[tuple[str, DataFrame, DataFrame, list[str], list[str]]]) -> DataFrame:
    """FOREIGN KEY: (check_name, n) = rows of ``child`` with no match in ``parent`` (whose keys may repeat)."""
    out = []
    for name, child, parent, ck, pk in checks:
        p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, ck)])
        n = child.select(*ck).join(p, ck, "left_anti").agg(F.count(F.lit(1)).alias("n"))
        out.append(n.select(F.lit(name).alias("check_name"), "n"))
    return _union(out)


def duplicate_keys(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """UNIQUE: (check_name, key, n) for every key seen more than once (frames carry a ``key`` column)."""
    out = [df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .select(F.lit(name).alias("check_name"), "key", "n") for name, df in checks]
    return _union(out)


def null_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """NOT NULL: (table_name, column_name, n_null); one scan per table."""
    out = []
    for tb, df in tables.items():
        cols = columns[tb]
        agg = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in cols])
        stack = ", ".join(f"'{c}', `{c}`" for c in cols)
        out.append(agg.selectExpr(f"'{tb}' AS table_name", f"stack({len(cols)}, {stack}) AS (column_name, n_null)"))
    return _union(out)


def last_filed(lines: DataFrame, keys: list[str], receipt: str, values: list[str]) -> DataFrame:
    """(keys, receipt, values, n_filed): of lines filed more than once under a key, those of the last receipt.

    Receipts compare as text; under one receipt the greatest values count.  One aggregate, combined before the shuffle, so a
    key may be filed any number of times; null key values are a key.
    """
    last = lines.groupBy(*keys).agg(F.max(F.struct(receipt, *values)).alias("last"), F.count(F.lit(1)).alias("n_filed"))
    return last.select(*keys, f"last.{receipt}", *[f"last.{v}" for v in values], "n_filed")


def cascade_counts(delete_set: DataFrame, children: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """ON DELETE CASCADE preview: rows of each table that a delete of ``delete_set`` would remove."""
    out = [df.join(delete_set, key, "left_semi").agg(F.count(F.lit(1)).alias("n"))
           .select(F.lit(name).alias("table_name"), "n") for name, df in children]
    return _union(out)


def predicate_counts(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Domain checks: (check_name, n) rows violating each predicate; checks that share a frame share one pass of it."""
    frames: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, df, pred in checks:
        frames.setdefault(id(df), (df, []))[1].append((name, pred))
    out = []
    for df, preds in frames.values():
        counts = df.agg(*[F.count_if(p).alias(name) for name, p in preds])
        stack = ", ".join(f"'{name}', `{name}`" for name, _ in preds)
        out.append(counts.selectExpr(f"stack({len(preds)}, {stack}) AS (check_name, n)"))
    return _union(out)


def outside_bigint(amount: Column) -> Column:
    """An amount given as text that is no BIGINT: beyond its range, with a fraction, or no number."""
    return amount.isNotNull() & (~amount.rlike(r"^\s*[+-]?[0-9]+\s*$") | amount.try_cast("bigint").isNull())


def identity_check(values: DataFrame, left: str, right: str, keys: list[str], left_name: str,
                   right_name: str) -> DataFrame:
    """Rows where account ``left`` ≠ account ``right`` for the same key (either may be missing)."""
    a = values.filter(F.col("account") == left).select(*keys, F.col("value").alias(left_name))
    b = values.filter(F.col("account") == right).select(*keys, F.col("value").alias(right_name))
    j = a.join(b, keys, "full_outer")
    diff = F.coalesce(F.col(left_name), F.lit(0)) - F.coalesce(F.col(right_name), F.lit(0))
    return j.select(*keys, left_name, right_name, diff.alias("diff")).filter(F.col("diff") != 0)
