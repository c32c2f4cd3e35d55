"""Structured Streaming jobs.

* ``filings_dedup``  — landed records kept once per key (``dropDuplicates``, or
  within a watermark that covers the longest replay), appended by ``foreachBatch``.
* ``dialog_state``   — per-conversation turn counter and carried intent kept in
  keyed state (``applyInPandasWithState``), equal to the batch window version.
* ``dialog_turns``   — the same with list state, event-time timers and expiry (``transformWithState``): a turn is
  written once, when those before it have come.
* ``answer_stream``  — questions arriving as a stream, answered per micro-batch
  against the static fact tables (stream–static processing in ``foreachBatch``).
* ``lookup_stream``  — a stream–static join: each record takes its rows of a static table, in one streaming plan with
  an append sink.

All run with ``trigger(availableNow=True)`` so a test drives them to
completion; sinks and checkpoints live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.io import scratch_path


def _run_to_sink(stream: DataFrame, sink: str, batch_fn: Callable[[DataFrame], DataFrame] | None = None,
                 fmt: str = "parquet") -> None:
    spark = stream.sparkSession
    ckpt = scratch_path(spark, "stream-ckpt")

    def write(batch: DataFrame, epoch_id: int) -> None:
        out = batch_fn(batch) if batch_fn else batch
        # idempotent per epoch: a replayed epoch overwrites its own folder
        out.write.mode("overwrite").format(fmt).save(f"{sink}/epoch={epoch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over a table path: a folder of parts, or one Parquet file (its folder, filtered by its name)."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def filings_dedup(spark: SparkSession, path: str, schema: str, keys: list[str], ts: str | None = None,
                  watermark: str | None = None) -> DataFrame:
    """SM1: one row per key.

    Without a watermark every key is remembered and no record is lost, however late.  With ``ts`` and ``watermark``
    (event time as a session-zone timestamp) a key is forgotten that long after its record; choose it longer than any
    replay or delay, as later records are dropped as late.
    """
    s = read_stream(spark, path, schema)
    if ts and watermark:
        s = s.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
        d = s.dropDuplicatesWithinWatermark(keys)
    else:
        d = s.dropDuplicates(keys)
    sink = scratch_path(spark, "stream-dedup")
    _run_to_sink(d, sink)
    return spark.read.parquet(sink).drop("epoch")


DIALOG_OUT = "conv_id long, turn long, role string, turn_no int, carried_intent string"
DIALOG_STATE = "turns array<long>, roles array<string>, intents array<string>"


def _dialog_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = list(zip(*state.get)) if state.exists else []
    for pdf in pdfs:
        for turn, role, text in zip(pdf["turn"], pdf["role"], pdf["text"]):
            said = ("question" if "?" in (text or "") else "statement") if role == "user" else None
            seen.append((None if pd.isna(turn) else int(turn), role, said))
    seen.sort(key=lambda x: (x[0] is None, x[0] or 0))  # null turns last
    turns, roles, intents = (list(c) for c in zip(*seen))
    state.update((turns, roles, intents))
    carried, intent = [], None
    for said in intents:
        intent = said or intent
        carried.append(intent)
    yield pd.DataFrame({"conv_id": pd.Series([key[0]] * len(seen), dtype="Int64"), "turn": pd.Series(turns, dtype="Int64"),
                        "role": roles, "turn_no": range(1, len(seen) + 1), "carried_intent": carried})


def dialog_state(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """SM3: turn counter and last user intent per conversation, in keyed streaming state.

    The state keeps the turns seen (number, role, intent).  A conversation that gets turns in a later micro-batch is
    numbered anew and written whole; what its latest batch wrote counts, so files may arrive in any order.
    The state does not expire: a table of conversations has no event time, and a processing-time timeout keeps an
    availableNow run from ending.
    """
    s = read_stream(spark, path, "conv_id long, turn long, role string, text string", files_per_trigger)
    out = s.groupBy("conv_id").applyInPandasWithState(_dialog_fn, DIALOG_OUT, DIALOG_STATE, "append",
                                                      GroupStateTimeout.NoTimeout)
    sink = scratch_path(spark, "stream-dialog")
    _run_to_sink(out, sink)
    rows = spark.read.parquet(sink)
    last = rows.groupBy(F.col("conv_id").alias("conv")).agg(F.max("epoch").alias("last"))
    return rows.join(last, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("epoch") == F.col("last"))) \
        .drop("epoch", "conv", "last")


class DialogProcessor(StatefulProcessor):
    """Turns of a conversation in turn order, each written once, however they arrive.

    State: the next turn's number and the intent carried so far, and the list of turns that wait for one before them.
    Turns that follow on are written at once and leave the state.  An event-time timer, set anew by later
    turns, ends a conversation ``quiet_ms`` after its last event: what still waits (behind a gap, or without a number)
    is written in order and the state goes.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next bigint, turn_no int, intent string")
        self.held = handle.getListState("held", "turn bigint, role string, intent string")

    def _write(self, key: tuple, rows: list, turn_no: int, intent: str | None) -> tuple[list, str | None]:
        out = []
        for turn, role, said in rows:
            turn_no, intent = turn_no + 1, said or intent
            out.append((key[0], turn, role, turn_no, intent))
        return out, intent

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, turn_no, intent = self.at.get() if self.at.exists() else (0, 0, None)
        waiting = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        before, latest = len(waiting), 0
        for pdf in rows:
            for turn, role, text, ts in zip(pdf["turn"], pdf["role"], pdf["text"], pdf["event_time"]):
                said = ("question" if "?" in (text or "") else "statement") if role == "user" else None
                waiting.append((None if pd.isna(turn) else int(turn), role, said))
                latest = max(latest, int(ts.timestamp() * 1000))
        waiting.sort(key=lambda x: (x[0] is None, x[0] or 0))
        ready = 0
        while ready < len(waiting) and waiting[ready][0] == nxt + ready:
            ready += 1
        out, intent = self._write(key, waiting[:ready], turn_no, intent)
        self.at.update((nxt + ready, turn_no + ready, intent))
        if ready < len(waiting):
            self.held.put(waiting[ready:])
        elif before:
            self.held.clear()
        for old in list(self.handle.listTimers()):
            latest = max(latest, old - self.quiet_ms)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(latest + self.quiet_ms)
        yield _turns(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, turn_no, intent = self.at.get()
        waiting = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        out, _ = self._write(key, waiting, turn_no, intent)
        self.at.clear()
        self.held.clear()
        yield _turns(out)

    def close(self) -> None:
        pass


def _turns(rows: list) -> pd.DataFrame:
    cols = list(zip(*rows)) or [()] * 5
    return pd.DataFrame({"conv_id": pd.array(cols[0], "Int64"), "turn": pd.array(cols[1], "Int64"),
                         "role": pd.Series(cols[2], dtype=object), "turn_no": pd.array(cols[3], "Int32"),
                         "carried_intent": pd.Series(cols[4], dtype=object)})


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dialog_turns(spark: SparkSession, path: str, delay: str = "1 day", quiet_seconds: int = 86400,
                 files_per_trigger: int = 1) -> DataFrame:
    """SM3: (conv_id, turn, role, turn_no, carried_intent), each turn written once, the state bounded by event time.

    ``path``: (conv_id, turn, role, text, event_time).  ``delay`` is how much later than the latest event a record may
    come; a conversation ends ``quiet_seconds`` after its last event.  Files may arrive in any order within that.
    """
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        s = read_stream(spark, path, "conv_id long, turn long, role string, text string, event_time timestamp", files_per_trigger)
        out = s.withWatermark("event_time", delay).groupBy("conv_id").transformWithStateInPandas(
            statefulProcessor=DialogProcessor(quiet_seconds * 1000), outputStructType=DIALOG_OUT, outputMode="Append",
            timeMode="EventTime")
        sink = scratch_path(spark, "stream-turns")
        _run_to_sink(out, sink)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.parquet(sink).drop("epoch")


def answer_stream(spark: SparkSession, path: str, schema: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SM2: a question stream answered per micro-batch against static tables."""
    s = spark.readStream.schema(schema).parquet(path)
    sink = scratch_path(spark, "stream-qa")
    _run_to_sink(s, sink, batch_fn=answer)
    return spark.read.parquet(sink).drop("epoch")


def lookup_plan(stream: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """The streaming plan: every record of the stream with its static rows; one that has none stays, with nulls.

    No state is kept.  Where ``static`` is a table bucketed by ``keys``, a micro-batch is shuffled to the table's buckets and
    the table stays where it is; a table below the session's broadcast threshold is broadcast by its size.
    """
    return stream.join(static, keys, "left")


def lookup_stream(spark: SparkSession, path: str, schema: str, static: DataFrame, keys: list[str],
                  files_per_trigger: int = 1000) -> DataFrame:
    """SM2: the records that land under ``path``, joined with ``static`` by ``keys`` as they come.

    The file sink commits each micro-batch once, so a replayed one adds nothing.
    """
    sink = scratch_path(spark, "stream-lookup")
    q = lookup_plan(read_stream(spark, path, schema, files_per_trigger), static, keys).writeStream.format("parquet") \
        .option("path", sink).option("checkpointLocation", scratch_path(spark, "stream-ckpt")) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)
