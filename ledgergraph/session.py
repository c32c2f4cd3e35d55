"""Session helpers: build a local session for tests/bench, and resolve the
checkpoint folder from the session (never a machine-local default on a cluster)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def driver_memory(share: float = 0.4) -> str:
    """Heap of a local session: a share of the machine's memory (or of its container's limit), for Python workers, the
    page cache and Spark's memory outside the heap need the rest."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    for limit in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(limit) as f:
                total = min(total, int(f.read()))
        except (OSError, ValueError):  # no such file, or no limit
            pass
    return f"{max(1024, min(16384, int(total * share) >> 20))}m"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgergraph") -> SparkSession:
    """A local session for tests and the benchmark (not used by the library)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LG_DRIVER_MEMORY") or driver_memory())
    for k, v in TUNING.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is configured and the master is local (tests) a fresh
    scratch folder is made.  Raises RuntimeError on any other master: a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lg-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once under the checkpoint folder, in compressed columns, and read from there.

    Like a reliable checkpoint it cuts the lineage, in a fraction of the room.  Nothing refers to the shuffle files behind
    the rows any more; Spark removes them when the driver collects its garbage, which is asked for here.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lg-stored-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input of fewer partitions than cores over all cores; a large input is left where it lies.

    For work that multiplies rows right after a scan (a small table in one row group is one task otherwise).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
