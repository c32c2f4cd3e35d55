"""Context utterances, external corpus merge, interval joins and names outside the dictionary."""

import random

from pyspark.sql import functions as F

from ledgergraph.operators import context as CX
from ledgergraph.operators import external as EX
from ledgergraph.operators import intervals as IV
from ledgergraph.operators import nlu as NLU
from ledgergraph.operators import text as TX
from ledgergraph.operators.corpus import account_rows


def _slots(spark):
    rows = [(f"q{i}#{p}", "gross profit", "IS", n, p) for i in range(20) for n in range(1, 6) for p in range(n)]
    return spark.createDataFrame([(f"{r[0]}-{r[3]}", *r[1:]) for r in rows], "id string, name string, tag string, length int, position int")


def test_context_words_are_neighbours_and_the_span_is_the_account(spark):
    docs = spark.createDataFrame([("The cat sat. The dog sat!\nA cat ran",), (None,), ("",), ("... 12",)], "text string")
    n = {(r["side"], r["word"]): [(c["upto"], c["cand"]) for c in r["cands"]] for r in CX.neighbours(docs).collect()}
    assert n["f", "<s>"] == [(2, "the"), (3, "a")] and n["f", "the"] == [(1, "cat"), (2, "dog")]
    assert n["b", "sat"] == [(1, "cat"), (2, "dog")] and n["b", "</s>"] == [(2, "sat"), (3, "ran")] and ("f", "sat") not in n
    out = CX.fill(_slots(spark), CX.neighbours(docs)).collect()
    first = {w for _, w in n["f", "<s>"]}
    for r in out:
        words = r["text"].split(" ")
        assert r["text"][r["start"]:r["end"]] == "gross profit" and r["intent"] == "None" and len(words) == r["length"] + 1
        assert r["marked_text"].replace("[E]", "").replace("[/E]", "") == r["text"]
        right = r["text"][r["end"]:].split()
        assert len(right) == r["length"] - 1 - r["position"] and (not right or right[0] in first)
        for a, b in zip(right, right[1:]):
            assert b in ({w for _, w in n["f", a]} if ("f", a) in n else first)
        left = r["text"][:r["start"]].split()
        assert not left or left[-1] in {"sat", "ran"}
    assert len({r["text"] for r in out}) > 20
    again = CX.fill(_slots(spark).repartition(5), CX.neighbours(docs)).collect()
    assert sorted((r["id"], r["text"]) for r in again) == sorted((r["id"], r["text"]) for r in out)
    other = CX.fill(_slots(spark), CX.neighbours(docs), seed=7).collect()
    assert sorted((r["id"], r["text"]) for r in other) != sorted((r["id"], r["text"]) for r in out)


def test_context_without_words_and_with_a_joined_table(spark, monkeypatch):
    none = CX.fill(_slots(spark), CX.neighbours(spark.createDataFrame([], "text string"))).collect()
    assert {r["text"] for r in none} == {"gross profit"}
    docs = spark.createDataFrame([("one two three. two one three four",)], "text string")
    a = sorted(map(tuple, CX.fill(_slots(spark), CX.neighbours(docs)).collect()))
    monkeypatch.setattr(CX, "BROADCAST_WORDS", -1)
    assert a == sorted(map(tuple, CX.fill(_slots(spark), CX.neighbours(docs)).collect()))


def test_external_merge_by_reason(spark):
    rows = [("ok", "Mr. Smith  paid 12,5 to New York.", ["Mr", ".", "Smith", "paid", "12", ",", "5", "to", "New", "York", "."],
             ["O", "O", "B-PER", "O", "B-NUM", "O", "I-NUM", "O", "B-LOC", "I-LOC", "O"]),
            ("cut", "the New-York office", ["the", "New", "-", "York", "office"], ["O", "B-LOC", "O", "O", "O"]),
            ("none", "nothing here", ["nothing", "here"], ["O", "O"]),
            ("text", "a (b) c", ["a", "-LRB-", "b", "-RRB-", "c"], ["O", "O", "B-X", "O", "O"]),
            ("tags", "a b", ["a", "b"], ["O"]), ("empty", "", [], []),
            ("two", "ab cd", ["a", "b", "cd"], ["B-X", "B-Y", "O"]), ("finer", "ab cd", ["ab cd"], ["B-X"])]
    out = {r["id"]: r for r in EX.merge(spark.createDataFrame(rows, "id string, text string, tokens array<string>, tags array<string>")).collect()}
    assert {k: r["reason"] for k, r in out.items()} == {
        "ok": None, "cut": "misaligned", "none": "no_entity", "text": "text_mismatch", "tags": "tag_count",
        "empty": "no_entity", "two": "misaligned", "finer": None}
    text = out["ok"]["text"]
    assert [(text[e["start"]:e["end"]], e["tag"]) for e in out["ok"]["entities"]] == [
        ("smith", "PER"), ("12,5", "NUM"), ("new york", "LOC")]
    assert [(e["start"], e["end"], e["tag"]) for e in out["finer"]["entities"]] == [(0, 5, "X")]


def test_misaligned_spans_are_marked(spark):
    df = spark.createDataFrame([("q", "what is the cost of sales in " + "x" * 700 + " the last year")], "doc string, t string")
    tok = TX.tokenize_offsets(df, "doc", "t")
    spans = spark.createDataFrame([("q", 12, 23, "IS"), ("q", 24, 30, "BS"), ("q", 40, 50, "TIME"), ("q", 734, 743, "TIME")],
                                  "doc string, s_start int, s_end int, label string")
    for block in (4, 256, 10_000):
        got = [(r["token"][:5], r["tag"]) for r in TX.spans_to_biluo(tok, spans, block).orderBy("pos").collect()]
        assert got == [("what", "O"), ("is", "O"), ("the", "O"), ("cost", "-"), ("of", "-"), ("sales", "-"), ("in", "-"),
                       ("xxxxx", "-"), ("the", "O"), ("last", "B-TIME"), ("year", "L-TIME")]
        assert TX.misaligned(TX.spans_to_biluo(tok, spans, block)).collect()[0]["tokens"] == 5


def test_interval_joins_against_brute_force(spark):
    rnd = random.Random(4)

    def some(n):
        out = set()
        for _ in range(n):
            a = rnd.randint(0, 400)
            out.add((rnd.choice("ab"), a, a + rnd.choice([1, 2, 5, 40, 300])))
        return sorted(out)
    x, y = some(60), some(60)
    want_o = sorted((d, a, b, c, e) for d, a, b in x for k, c, e in y if d == k and a < e and c < b)
    want_c = sorted((d, a, b, c, e) for d, a, b in x for k, c, e in y if d == k and a >= c and b <= e)
    for block in (1, 16, 1000):
        o = IV.overlapping(spark.createDataFrame(x, "doc string, a_start int, a_end int"),
                           spark.createDataFrame(y, "doc string, b_start int, b_end int"), block)
        assert sorted((r["doc"], r["a_start"], r["a_end"], r["b_start"], r["b_end"]) for r in o.collect()) == want_o
        c = IV.containing(spark.createDataFrame(x, "doc string, start int, end int"),
                          spark.createDataFrame(y, "doc string, s_start int, s_end int"), block)
        assert sorted((r["doc"], r["start"], r["end"], r["s_start"], r["s_end"]) for r in c.collect()) == want_c


def test_names_one_edit_away(spark):
    texts = {"less": "what is the gros profit in the last year?", "more": "what is the reevenue in the last year?",
             "other": "what is the cost of sakes ratio in the last year?", "exact": "what is the cost of sales in the last year?",
             "plural": "what are the revenues in the last year?", "two": "what is the gros profitt in the last year?"}
    df = spark.createDataFrame(list(texts.items()), "doc string, t string")
    m = NLU.longest_matches(NLU.match_rows(df, "doc", "t", near=True)).filter("tag IN ('IS', 'BS')")
    got = {}
    for r in m.collect():
        got.setdefault(r["doc"], set()).add(r["phrase"])
    assert got == {"less": {"gros profit"}, "more": {"reevenue"}, "other": {"cost of sakes ratio"}, "exact": {"cost of sales"},
                   "plural": {"revenue"}, "two": {"profitt"}}


def test_near_index_is_a_deletion_neighbourhood():
    index = NLU.near_index()
    assert ("evenue", "revenue", "IS") in index and ("revenue", "revenue", "IS") in index
    assert len(index) < 2000  # of the ontology's size


def test_phrases_whose_deletions_are_listed_are_few_and_lose_no_name(spark):
    rnd = random.Random(5)
    names = sorted({r[2] for r in account_rows() if len(r[2]) >= NLU.NEAR_MIN})
    typed = set(names)
    for n in names:
        for _ in range(12):
            i, x = rnd.randrange(len(n) + 1), rnd.choice("aeilnrst ")
            typed |= {n[:i] + n[i + 1:], n[:i] + x + n[i:], n[:i] + x + n[i + 1:], x + n[:i] + n[i + 2:], n[:i]}
    every = spark.createDataFrame([(x,) for x in sorted(typed)], "phrase string").withColumn("pass", NLU.may_be_near(F.col("phrase")))
    one = every.crossJoin(spark.createDataFrame([(n,) for n in names], "name string")).filter(F.levenshtein("phrase", "name") == 1)
    assert one.count() > 300
    assert one.filter(~F.col("pass")).count() == 0
    text = "what is the gros profit in the last year and what is the cost of sales ratio of the current assets in this year?"
    g = NLU.ngrams(spark.createDataFrame([("d", text)], "doc string, t string"), "doc", "t", [])
    got = [r["phrase"] for r in g.filter(NLU.may_be_near(F.col("phrase"))).collect()]
    assert "gros profit" in got and len(got) <= 5 < g.count() / 20


def test_words_of_a_line_are_extracted_once(spark):
    docs = spark.createDataFrame([(1, "We met Anna Maria Lopez and 3 Others\n\n  \nNew 12 York"), (2, None), (3, "x")], "doc_id long, text string")
    ext = EX.from_documents(docs)
    assert {r["id"]: list(zip(r["tokens"], r["tags"], strict=True)) for r in ext.collect()} == {
        "1:0": [("We", "O"), ("met", "O"), ("Anna", "B-MISC"), ("Maria", "I-MISC"), ("Lopez", "I-MISC"), ("and", "O"), ("3", "B-NUM"),
                ("Others", "B-MISC")], "1:3": [("New", "O"), ("12", "B-NUM"), ("York", "B-MISC")], "3:0": [("x", "O")]}
    plan = EX.merge(ext)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "get(regexp_extract_all" not in plan


def test_tags_of_spans_need_no_join_and_equal_brute_force(spark):
    rnd = random.Random(6)
    toks, spans, want = [], [], {}
    for d in map(str, range(25)):
        at, own = 0, []
        for pos in range(rnd.randint(1, 30)):
            n = rnd.randint(1, 6)
            toks.append((d, pos, "w", at, at + n))
            at += n + rnd.randint(0, 2)
        a = 0
        while (a := a + rnd.randint(0, 9)) < at:
            z = a + rnd.randint(1, 12)
            own.append((d, a, z, "X"))
            a = z
        spans += own
        mine = [x for x in toks if x[0] == d]
        first = {x[1]: next((s for s in own if x[3] < s[2] and s[1] < x[4]), None) for x in mine}
        for x in mine:
            s = first[x[1]]
            group = [y for y in mine if s and first[y[1]] == s]
            fits = s and group[0][3] == s[1] and group[-1][4] == s[2]
            want[d, x[1]] = "O" if not s else "-" if not fits else ("U" if len(group) == 1 else "B" if x is group[0]
                                                                     else "L" if x is group[-1] else "I") + "-X"
    out = TX.spans_to_biluo(spark.createDataFrame(toks, "doc string, pos int, token string, start int, end int"),
                            spark.createDataFrame(spans, "doc string, s_start int, s_end int, label string"))
    assert {(r["doc"], r["pos"]): r["tag"] for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
