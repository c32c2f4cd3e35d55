"""Findings of round 4."""

import pytest
from pyspark.sql import functions as F

from ledgergraph.llm import decontam
from ledgergraph.operators import external as EX
from ledgergraph.operators import nlu as NLU
from ledgergraph.operators.keys import dense_surrogate_key
from ledgergraph.plans import q_stream, q_tokens, q_variants
from ledgergraph.session import stored
from ledgergraph.sources import io as IO


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_variant_questions_are_put_in_their_templates(tables):
    rows = q_variants.variant_questions(tables).collect()
    assert len(rows) == tables.fin_filing.count() and {r["kind"] for r in rows} == set(q_variants.KINDS)
    assert all("{}" not in r["text"] and "%s" not in r["text"] and " by ?" not in r["text"] for r in rows)
    assert all(r["text"].startswith("what is the ") == (r["kind"] in ("misspelt", "two_accounts")) for r in rows)
    out = q_variants.qa_validate_variants(tables).collect()
    assert len(out) == len(rows) and all(r["error_code"] for r in out)
    n = sum(r["kind"] == "misspelt" for r in rows)
    assert q_variants.account_name_unknown(tables).count() == q_variants.account_name_nearest(tables).count() == n


def test_matches_in_their_rows_are_those_of_exploded_rows(spark):
    texts = ["If  revenue rises 10%, what is the gross profit last year?", "cost of sales ratio, cost of sales. 7 percent", None, "", "x y",
             "how is the revenue in the last year? 3%\n", "net income net income next quarter this year falls"]
    df = spark.createDataFrame([(f"q{i}", t, "a") for i, t in enumerate(texts)], "doc string, text string, intent string")
    m = NLU.longest_matches(NLU.match_rows(df, "doc", "text"))
    tagged = NLU.with_matches(df, "text")
    plan = _plan(tagged)
    assert "MapInArrow" in plan and "lambda" not in plan and "Exchange" not in plan  # once nested lambdas, run word by word
    assert _rows(NLU.longest_matches(tagged).select(m.columns)) == _rows(m) and m.count() > 10
    assert _rows(NLU.slots(tagged)) == _rows(NLU.slots(m))
    q = df.withColumnRenamed("doc", "question_id")
    assert _rows(NLU.rule_intent(tagged.withColumnRenamed("doc", "question_id"))) == _rows(NLU.rule_intent(q, m))


def test_questions_are_tagged_once_and_not_stored(tables):
    for f in (q_tokens.gazetteer_tag, q_tokens.entities_to_slots, q_tokens.tags_last_wins, q_tokens.account_name_resolve, q_tokens.intent_rules):
        t = type(tables)(tables.spark, tables.sf_dir)
        assert _plan(f(t)).count("MapInArrow") == 1 and not {"corpusFalse", "all_matches"} & set(t.memo)


def test_a_hit_takes_no_whole_document_and_parts_are_held_one_by_one(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " * 40 + " ".join(words[10:30])), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(words[i:i + 14])) for i in range(40)], "item_id long, text string")
    whole = decontam.overlaps(docs, bench, doc_id=F.col("doc_id"))
    joins = [x for x in whole._jdf.queryExecution().optimizedPlan().toString().split("Join Inner") if "beside" in x or "item_start" in x]
    assert len(joins) >= 2 and "slice(w#" in joins[1]  # between the two joins: once the document's words themselves
    parts = decontam.overlaps(docs, bench, part_rows=200, doc_id=F.col("doc_id"))
    assert _plan(whole).count("BroadcastExchange") == 2 and "BroadcastExchange" not in _plan(parts)
    assert _rows(parts) == _rows(whole) and whole.filter("doc_id = 1").count() == 40 and whole.filter("doc_id = 2").count() >= 7


def _files(df):
    return [f.replace("file:", "") for f in df.inputFiles()]


def test_stored_rows_are_compressed_columns_of_the_shared_folder(spark, tables):
    df = spark.createDataFrame([(1, "a", [1.5, None]), (None, None, None), (1, "a", [1.5, None])], "k long, s string, x array<double>")
    out = stored(df)
    assert _rows(out) == _rows(df) and out.schema == df.schema and all(f.endswith("zstd.parquet") for f in _files(out))
    empty = stored(df.filter("false"))
    assert empty.count() == 0 and empty.schema == df.schema
    ids = dense_surrogate_key(df, ["k"], "id")
    assert sorted(r["id"] for r in ids.collect()) == [1, 2, 3] and "Scan parquet" in _plan(ids)
    facts = tables.derived("round4_facts", lambda: tables.fin_fact_wide, checkpoint=True)
    assert _files(facts) and "ExistingRDD" not in _plan(facts) and facts.count() == tables.fin_filing.count()


def test_buckets_of_the_value_table_grow_with_its_rows(spark, tables, monkeypatch):
    want = _rows(q_stream.value_table(tables))
    monkeypatch.setattr(IO, "BUCKET_ROWS", 5000)
    table = q_stream.value_table(tables)
    assert _rows(table) == want
    n = int(_plan(table.groupBy(*q_stream.VALUE_KEYS).count()).split("out of ")[1].split(")")[0].split(",")[0])
    assert n > 8 and all("zstd" in f for f in _files(table))


def test_tasks_that_align_external_texts_grow_with_the_texts(spark, monkeypatch):
    ext = spark.createDataFrame([(f"d{i}", "Ab cd Ef", ["Ab", "cd", "Ef"], ["O", "O", "B-MISC"]) for i in range(300)],
                                "id string, text string, tokens array<string>, tags array<string>")
    want = _rows(EX.merge(ext))
    monkeypatch.setattr(EX, "TASK_CHARS", 40)  # 2,400 characters
    got = EX.merge(ext)
    assert _rows(got) == want and len(want) == 300 and all("misaligned" not in r for r in want)
    plan = _plan(EX.merge(ext))
    assert ", 60)" in plan and plan.count("Window [") == 1  # the steps before are stages of their own: once all in one
