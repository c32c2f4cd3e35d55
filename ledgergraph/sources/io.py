"""Readers and writers: JSON lines of utterances, partitioned parquet round trips,
N-Triples text.  Everything is written under the session's checkpoint folder
(``spark.checkpoint.dir``), never a machine-local path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a bucket, which one task sorts when a table is loaded or joined.
BUCKET_ROWS = 1_000_000
UTTERANCE_READ_SCHEMA = "text string, entities array<array<string>>, intent string"


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lg-{name}-{uuid.uuid4().hex[:12]}"


def roundtrip_partitioned(df: DataFrame, partition_col: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` partitioned by ``partition_col`` and read it back (a sink test)."""
    path = scratch_path(df.sparkSession, "sink")
    df.write.mode("overwrite").partitionBy(partition_col).format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path).select(*df.columns)


def write_utterances_json(df: DataFrame, path: str) -> None:
    """(text, entities array<struct<start,end,tag>>, intent) -> JSON lines with [s, e, "TAG"] arrays."""
    out = df.select("text", F.transform("entities", lambda e: F.array(e.start.cast("string"), e.end.cast("string"),
                                                                       e.tag)).alias("entities"), "intent")
    out.write.mode("overwrite").json(path)


def read_utterances_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose entities are mixed arrays ``[start, end, "TAG"]`` -> typed structs."""
    raw = spark.read.schema(UTTERANCE_READ_SCHEMA).json(path)
    return raw.select("text", F.transform("entities", lambda a: F.struct(
        a[0].cast("int").alias("start"), a[1].cast("int").alias("end"), a[2].alias("tag"))).alias("entities"),
        "intent")


def create_table(spark: SparkSession, name: str, df: DataFrame, bucket_by: str | list[str], buckets: int,
                 partition_by: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS with the frame's columns, bucketed (and partitioned), in the shared folder."""
    by = ", ".join(f"`{c}`" for c in _names(bucket_by))
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    part = f"PARTITIONED BY (`{partition_by}`) " if partition_by else ""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({cols}) USING parquet OPTIONS (compression 'zstd') {part}"
              f"CLUSTERED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")


def _names(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else columns


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets of a table of so many rows: a bucket stays as large as it is when the table grows."""
    return max(least, -(-rows // BUCKET_ROWS))


def load_table(spark: SparkSession, name: str, df: DataFrame, bucket_by: str | list[str], buckets: int) -> DataFrame:
    """Replace the table's rows (of the partitions that ``df`` has, if it is partitioned) and return the table.

    Rows are dealt by the bucket columns first, so that a bucket of a partition is one file.
    """
    mode = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*spark.table(name).columns).repartition(buckets, *_names(bucket_by)).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, was)
    return spark.table(name)
