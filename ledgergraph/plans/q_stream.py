"""Streaming queries (SM1-SM3), each driven to completion with an availableNow trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..sources import io as IO
from ..sources.fixtures import fin_fact, stored_facts
from ..sources.io import scratch_path
from ..streaming import streams as ST
from .q_eval import _onto
from .q_qa import _questions, _valid, answer_questions, qsql
from .registry import query

_DIALOG_SQL = """
SELECT conv_id, turn, role,
       CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no,
       LAST_VALUE(CASE WHEN role = 'user' THEN CASE WHEN strpos(text, '?') > 0 THEN 'question' ELSE 'statement' END END
                  IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS carried_intent
FROM conversations"""


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_filings_dedup", "SELECT DISTINCT event_id, user_id, event_type, ts FROM events")
def stream_filings_dedup(t):
    """SM1: records landing as a stream with every seventh delivered again later; each event id is kept once."""
    path = scratch_path(t.spark, "landing")
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.write.parquet(path)
    events.filter(F.col("event_id") % 7 == 0).write.mode("append").parquet(path)
    return ST.filings_dedup(t.spark, path, _EVENTS, ["event_id"]).select("event_id", "user_id", "event_type", "ts")


@query("stream_dialog_state", _DIALOG_SQL)
def stream_dialog_state(t):
    """SM3: per-conversation turn state in keyed streaming state; equals the batch window result."""
    out = ST.dialog_state(t.spark, f"{t.sf_dir}/conversations.parquet", 1000)
    return out.select("conv_id", "turn", "role", F.col("turn_no").cast("int").alias("turn_no"), "carried_intent")


@query("stream_dialog_turns", _DIALOG_SQL)
def stream_dialog_turns(t):
    """SM3: turns land out of order over several files and are written once each, in order; state ends by event time."""
    path = scratch_path(t.spark, "turns")
    minute = F.make_interval(mins=F.coalesce("turn", F.lit(0)).cast("int"))
    c = t.conversations.select("conv_id", "turn", "role", "text",
                               (F.timestamp_seconds(F.lit(1_700_000_000)) + minute).alias("event_time"))
    c.repartition(3, F.xxhash64("conv_id", "turn")).write.parquet(path)
    for days in (30, 60):  # records that only move the watermark on, so that every conversation ends
        t.spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string").withColumn(
            "event_time", F.timestamp_seconds(F.lit(1_700_000_000 + days * 86_400))).coalesce(1).write.mode("append").parquet(path)
    out = ST.dialog_turns(t.spark, path).filter(F.col("conv_id").isNotNull())
    return out.select("conv_id", "turn", "role", F.col("turn_no").cast("int").alias("turn_no"), "carried_intent")


@query("stream_qa", qsql(["qa_answers"], "SELECT question_id, intent, target_account, subject_account, year, quarter, "
                                         "answer, baseline, error_code FROM qa_answers"))
def stream_qa(t):
    """SM2: questions arriving as a stream, answered per micro-batch against the static facts."""
    path = scratch_path(t.spark, "questions")
    _questions(t).write.mode("overwrite").parquet(path)
    return ST.answer_stream(t.spark, path, "question_id string, code string, bsns_year int, text string",
                            lambda batch: answer_questions(t, batch))


VALUE_KEYS = ["code", "bsns_year", "quarter", "account"]


def value_table(t, buckets: int | None = None):
    """The evaluated accounts as a catalog table bucketed by what a question names.

    ``buckets`` goes by the number of filings and accounts if it is not given, and then is part of the table's name.  The
    wide facts are dealt by filing once, so that the accounts of a filing are evaluated where it lies.
    """
    e, nodes, coef = _onto(t)
    wide = stored_facts(t)
    name = t.sf_dir
    if buckets is None:
        buckets = IO.buckets_for(wide.count() * nodes.count())
        name += f"#{buckets}"
    facts = fin_fact(t, wide.repartition(buckets, "code", "bsns_year", "quarter"))
    values = EV.shown_values(facts, coef, EV.ratio_definitions(e)).select(*VALUE_KEYS, "value")
    name = f"lg_value_{uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:12]}"
    IO.create_table(t.spark, name, values, VALUE_KEYS, buckets)
    return IO.load_table(t.spark, name, values, VALUE_KEYS, buckets)


@query("stream_static_values", qsql(["qa_answers"], """
SELECT question_id, target_account, year, quarter, answer, error_code FROM qa_answers
WHERE intent = 'PAST.value' AND (error_code IS NULL OR error_code = 'NO_DATA')"""))
def stream_static_values(t):
    """SM2: read questions stream in and meet the bucketed table of evaluated accounts in a stream-static join."""
    path = scratch_path(t.spark, "read-questions")
    asked = _valid(t).filter((F.col("intent") == "PAST.value") & F.col("error_code").isNull())
    asked.select("question_id", "code", F.col("year").alias("bsns_year"), "quarter", F.col("target_account").alias("account")) \
        .write.parquet(path)
    out = ST.lookup_stream(t.spark, path, "question_id string, code string, bsns_year int, quarter string, account string",
                           value_table(t), VALUE_KEYS)
    return out.select("question_id", F.col("account").alias("target_account"), F.col("bsns_year").alias("year"), "quarter",
                      F.col("value").alias("answer"), F.when(F.col("value").isNull(), F.lit("NO_DATA")).alias("error_code"))
