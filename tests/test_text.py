"""Token offsets, BILUO round trips, piece projection, gazetteer longest match, keys and splits."""

from pyspark.sql import functions as F

from ledgergraph.operators import nlu as NLU
from ledgergraph.operators import text as TX
from ledgergraph.operators.keys import dense_surrogate_key


def test_token_offsets_slice_back(spark):
    df = spark.createDataFrame([(1, "  what is  the\tcost of sales?"), (2, "x")], "d long, t string")
    tok = TX.tokenize_offsets(df, "d", "t")
    j = tok.join(df.withColumnRenamed("d", "doc"), "doc")
    bad = j.filter(F.expr("substring(t, start + 1, `end` - start)") != F.col("token")).count()
    assert bad == 0 and tok.filter("doc = 1").count() == 6


def test_biluo_roundtrip(spark):
    df = spark.createDataFrame([("q", "what is the cost of sales in the last year")], "doc string, t string")
    tok = TX.tokenize_offsets(df, "doc", "t")
    spans = spark.createDataFrame([("q", 12, 25, "IS"), ("q", 33, 42, "TIME")],
                                  "doc string, s_start int, s_end int, label string")
    b = TX.spans_to_biluo(tok, spans)
    tags = [r["tag"] for r in b.orderBy("pos").collect()]
    assert tags == ["O", "O", "O", "B-IS", "I-IS", "L-IS", "O", "O", "B-TIME", "L-TIME"]
    back = sorted((r["start"], r["end"], r["label"]) for r in TX.tags_to_spans(b).collect())
    assert back == [(12, 25, "IS"), (33, 42, "TIME")]
    iob = TX.iob_to_biluo(b.withColumn("iob", TX.biluo_to_iob(F.col("tag"))))
    assert iob.filter(F.col("biluo") != F.col("tag")).count() == 0


def test_piece_projection(spark):
    df = spark.createDataFrame([("q", "administrative x")], "doc string, t string")
    tok = TX.tokenize_offsets(df, "doc", "t")
    spans = spark.createDataFrame([("q", 0, 14, "IS")], "doc string, s_start int, s_end int, label string")
    b = TX.spans_to_biluo(tok, spans)
    p = TX.project_tags(TX.align(b, TX.word_pieces(b))).orderBy("p_start").collect()
    assert [r["piece_tag"] for r in p if r["pos"] == 0] == ["B-IS", "I-IS", "I-IS", "L-IS"]


def test_gazetteer_longest_match(spark):
    df = spark.createDataFrame([("q", "what is the cost of sales ratio if revenue rose by 12 % in the next quarter")],
                               "doc string, t string")
    m = NLU.longest_matches(NLU.match_rows(df, "doc", "t"))
    got = sorted((r["phrase"], r["tag"]) for r in m.collect())
    assert got == [("12 %", "PERCENT"), ("cost of sales ratio", "IS"), ("next quarter", "TIME"), ("revenue", "IS"),
                   ("rose", "APPLY")]


def test_gazetteer_reads_typed_questions(spark):
    df = spark.createDataFrame([("a", "What is the Revenue in the last year."),
                                ("b", "What will be the effect to Gross Profit if the revenue rises by 10% in the next quarter?")],
                               "doc string, t string")
    got = {}
    for r in NLU.longest_matches(NLU.match_rows(df, "doc", "t")).collect():
        got.setdefault(r["doc"], set()).add((r["phrase"], r["tag"]))
    assert {("revenue", "IS"), ("last year", "TIME")} <= got["a"]
    assert {("gross profit", "IS"), ("revenue", "IS"), ("rise", "APPLY"), ("10 %", "PERCENT"), ("next quarter", "TIME")} <= got["b"]


def test_dense_key_and_split(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"),
                                     F.when(F.col("id") < 700, "a").otherwise("b").alias("g"))
    d = dense_surrogate_key(df, ["k"], "sid")
    ids = sorted(r["sid"] for r in d.collect())
    assert ids == list(range(1, 1001))
    s = TX.stratified_split(df, "g", "k", test=0.05, valid=0.1)
    c = {(r["g"], r["split"]): r["count"] for r in s.groupBy("g", "split").count().collect()}
    assert c[("a", "test")] == 35 and c[("a", "valid")] == 67 and c[("b", "test")] == 15 and c[("b", "valid")] == 29


def test_a_text_is_tagged_in_its_own_row(spark):
    from ledgergraph.operators import nlu as NLU
    text = "If  revenue rises 10%, what is the gross profit last year?"
    rows = [("d", text), ("d", "Inventories, inventories."), ("e", None), ("f", ""), (None, "5 percent")]
    df = spark.createDataFrame(rows, "doc string, t string")
    m = NLU.match_rows(df, "doc", "t")
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()  # windows by id once took a shuffle
    got = {(r["doc"], r["start"], r["end"], r["tag"], r["phrase"]) for r in NLU.match_rows(df, "doc", "t").collect()}
    low = text.lower()

    def at(doc, words, tag, phrase=None):
        i = low.index(words)
        return doc, i, i + len(words), tag, phrase or words
    assert got == {at("d", "revenue", "IS"), at("d", "10%", "PERCENT", "10 %"), at("d", "gross profit", "IS"), at("d", "profit", "IS"),
                   at("d", "last year", "TIME"), at("d", "rises", "APPLY", "rise" if "rise" in dict(NLU.gazetteer_rows()) else "rises"),
                   ("d", 0, 11, "BS", "inventories"), ("d", 13, 24, "BS", "inventories"), (None, 0, 9, "PERCENT", "5 percent")}
    slots = NLU.question_slots_rows(df, "doc", "t", keep=[]).collect()
    assert sorted(len(r["acc_arr"]) for r in slots) == [0, 0, 0, 2, 2]  # rows of one id keep their own


def test_answers_of_one_intent_are_those_of_all(spark, tables):
    from ledgergraph.plans import q_qa as Q
    every, past = Q._answers(tables), Q._answers(tables, "PAST.value")
    cols = every.columns
    assert sorted(map(str, past.collect())) == sorted(map(str, every.filter("intent = 'PAST.value'").select(*cols).collect()))
    plan = past._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the wide rows; no sums by question, and no forecasts
