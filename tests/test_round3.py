"""Findings of round 3: tagging in place, sequences as arrays, reachable words, stored loads, buckets by size."""

import pytest
from pyspark.sql import functions as F

from ledgergraph.operators import context as CX
from ledgergraph.operators import nlu as NLU
from ledgergraph.operators import sequence as SQ
from ledgergraph.operators import text as TX
from ledgergraph.plans import q_sources, q_tokens
from ledgergraph.sources import io as IO


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark):
    rows = [("a", "net income of last  year", [(0, 10, "IS"), (14, 24, "TIME")]), ("b", "x sales\té y", [(2, 5, "IS"), (8, 9, "BS")]),
            ("c", "", []), ("d", None, []), ("e", "one two three four", [(4, 18, "BS")]), ("f", "one two", [(0, 3, None)]), ("g", "one", None)]
    return spark.createDataFrame(rows, "doc string, text string, es array<struct<start:int,end:int,tag:string>>")


def test_texts_tagged_in_place_are_tagged_as_by_windows(texts):
    spans = texts.select("doc", F.explode("es").alias("e")).select(
        "doc", F.col("e.start").alias("s_start"), F.col("e.end").alias("s_end"), F.col("e.tag").alias("label"))
    want = TX.spans_to_biluo(TX.tokenize_offsets(texts, "doc", "text"), spans).withColumn("iob", TX.biluo_to_iob(F.col("tag")))
    tagged = TX.tag_texts(texts, "text", "es")
    got = tagged.select("doc", F.explode("tokens").alias("x")).select("doc", "x.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 18 - 2
    assert "Exchange" not in _plan(tagged) and "Window" not in _plan(tagged)
    by_rows = {r["doc"]: list(r["ids"]) for r in NLU.encode_tags(texts.sparkSession, want).collect()}
    assert {r["doc"]: list(r["ids"]) for r in NLU.encode_tags(texts.sparkSession, tagged).collect()} == by_rows


def test_sequences_score_and_decode_as_their_rows(spark, monkeypatch):
    tags = SQ.tag_set()
    rows = [(f"d{i}", p, f"w{(i * 7 + p * 3) % 11}", tags[(i + p * p) % len(tags)]) for i in range(20) for p in range(i % 5 + 1)]
    by_row = spark.createDataFrame(rows, "doc string, pos int, word string, tag string")
    s = F.sort_array(F.collect_list(F.struct("pos", "word", "tag")))
    seq = by_row.groupBy("doc").agg(s.alias("s")).select("doc", F.col("s.word").alias("words"), F.col("s.tag").alias("tags"))
    for f in (SQ.transitions, SQ.emissions):
        assert sorted(map(tuple, f(seq).collect())) == sorted(map(tuple, f(by_row).select(f(seq).columns).collect()))
    tlp, em = SQ.transition_logprob(SQ.transitions(by_row)), SQ.emissions(by_row)
    want = {r["doc"]: r["score"] for r in SQ.score(by_row, tlp, SQ.emission_logprob(em)).collect()}
    assert {r["doc"]: r["score"] for r in SQ.score(seq, tlp, SQ.emission_logprob(em)).collect()} == pytest.approx(want)

    def values(df):
        return {r["doc"]: [r["length"], r["logz"], r["score"], r["best_score"], *r["best"], *r["gold"], *r["posterior"]] for r in df.collect()}
    want = values(SQ.decode(SQ.arrays(by_row, em), tlp))
    for words in (SQ.BROADCAST_WORDS, -1):  # as one table, and joined
        monkeypatch.setattr(SQ, "BROADCAST_WORDS", words)
        got = values(SQ.decode(seq, tlp, em))
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_questions_are_tagged_without_dealing_tokens(spark, tables):
    before = _plan(q_tokens.corpus_once(tables)).count("Exchange hashpartitioning")
    for f in (q_tokens.encode_labels, q_tokens.label_map_invert):
        assert _plan(f(tables)).count("Exchange hashpartitioning") <= before


def test_only_reachable_words_are_joined(spark):
    own = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(100, 500)]
    docs = spark.createDataFrame([(f"x{w} y{w} z{w}. one two",) for w in own], "text string")
    table = CX.neighbours(docs, k=2)
    t = CX.reachable(table, 4)
    assert t.count() <= 2 * (1 + 2 + 4 + 8) < table.count()
    slots = spark.createDataFrame([(f"q{i}#{p}", "gross profit", "IS", 5, p) for i in range(5) for p in range(5)],
                                  "id string, name string, tag string, length int, position int")
    assert all(len(r["text"].split()) == 6 for r in CX.fill(slots, table).collect())
    plan = CX.fill(slots, table)._jdf.queryExecution().toString()
    assert plan.count("BroadcastHashJoin") >= 4 and "SortMergeJoin" not in plan


def test_only_asked_splits_are_scored(spark):
    rows = [(f"q{i}", f"w{i % 3} x{i}", "ab"[i % 2], ("train", "valid", "test")[i % 3]) for i in range(30)]
    s = spark.createDataFrame(rows, "question_id string, text string, intent string, split string")
    every = NLU.intent_posteriors(s, (1.0, 2.0)).filter("split = 'valid'")
    some = NLU.intent_posteriors(s, (1.0, 2.0), splits=("valid",))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) and some.count() == 20


def test_buckets_grow_with_the_facts(spark, tables, monkeypatch):
    assert IO.buckets_for(10) == 8 and IO.buckets_for(100 * IO.BUCKET_ROWS) == 100
    want = sorted(map(tuple, q_sources.catalog_facts_join(tables).collect()))
    monkeypatch.setattr(IO, "BUCKET_ROWS", 1000)
    f, c = q_sources.catalog_tables(tables)
    n = IO.buckets_for(tables.orders.count() * 9)
    assert n > 8 and f"out of {n}" in _plan(f.groupBy("code").count()) and f.count() == tables.fin_fact.count()
    assert sorted(map(tuple, q_sources.catalog_facts_join(tables).collect())) == want


def test_loads_read_stored_facts(spark, tables):
    out = q_sources.facts_append_ids(tables)
    assert "fin_fact_wide_stored" in tables.memo and "lineitem" not in _plan(out) and out.count() == tables.fin_fact.count()
