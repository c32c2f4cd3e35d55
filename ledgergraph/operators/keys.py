"""Dense surrogate keys (SERIAL-like ids 1..N) without a single-partition window.

``row_number() OVER (ORDER BY k)`` with no partition runs in one task; here the
rows are range-partitioned and sorted, each row takes its place in its own
partition from ``monotonically_increasing_id`` while it is written, and a tiny
per-partition count table supplies the offsets: one shuffle of the rows.  The
written data fixes the partitioning for both passes, and a lost executor only
recomputes its own partitions.

``append_keys`` keeps such ids in a registry, so that later loads continue the
numbering and a load that is run again adds nothing.
"""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored


def dense_surrogate_key(df: DataFrame, order_cols: list[str], name: str = "id",
                        num_partitions: int | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the place of each row in the order; columns to ``drop`` only order it and are not written."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiebreak = [c for c in df.columns if c not in order_cols]
    ordered = stored(df.repartitionByRange(n, *order_cols)
                     .sortWithinPartitions(*order_cols, *tiebreak)
                     .withColumn("_mid", F.monotonically_increasing_id())  # partition number above 33 bits of row number
                     .drop(*drop))
    local = ordered.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_rn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = local.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded
    return out.select((F.col("_off") + F.col("_rn")).alias(name), *[c for c in df.columns if c not in drop])


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The keys of every load so far (empty before the first)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not any(x.getPath().getName().startswith("load=") for x in fs.listStatus(folder)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/load=*")


def append_keys(df: DataFrame, key_cols: list[str], path: str, name: str = "id") -> DataFrame:
    """Every row of ``df`` with the id of its key, from the registry in ``path``; new keys continue the numbering.

    New keys are those that an anti join does not find; they are numbered in key order behind the largest id so far and
    written as one more load, all of it or nothing (Spark moves a load's files in when the job commits).  A load that is
    run again finds its keys and adds none.  Two loads must not run at once.  Null key values are values.
    """
    spark = df.sparkSession
    kinds = [df.schema[c] for c in key_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + f", `{name}` bigint"
    known = registry(spark, path, schema)

    def same(a: DataFrame, b: DataFrame):
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in key_cols])
    new = df.select(*key_cols)
    new = stored(new.join(known, same(new, known), "left_anti").distinct())
    if not new.isEmpty():
        top = known.agg(F.max(name)).first()[0] or 0
        numbered = dense_surrogate_key(new, key_cols, name).select(*key_cols, (F.col(name) + top).alias(name))
        numbered.write.parquet(f"{path}/load={top + 1:020d}-{uuid.uuid4().hex[:8]}")
        known = registry(spark, path, schema)
    return df.join(known, same(df, known)).select(known[name], *[df[c] for c in df.columns])
