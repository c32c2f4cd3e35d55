"""Small helpers shared by the operators: table access, row packing, size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of characters other than blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side (a few dozen bytes each) up to which a join broadcasts it.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **cols: str | Column) -> DataFrame:
    """The whole row as one struct ``row`` beside the named columns, so that no name of the caller's can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no Arrow batch of whole texts hold more than ``rows`` rows (a session that asks for fewer keeps that)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of a materialised table only where its counted rows are within ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def key_of(c: Column) -> Column:
    """A non-null text key: null and every string get different keys."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def wide_hash(c: Column) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(c), F.xxhash64(c, F.lit("second"))]
