"""Line dedup (op2), chat formatting (op3), decontamination (op8): DataFrame functions only."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgergraph.llm import chat, decontam, linededup, queries
from .edge import LONG, PROSE, edge_docs, empty_docs, row, SCHEMA

SF = "/root/testdata/sf0.001"


def _no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions")), plan


def brute_lines(rows, ratio=0.1, min_pages=10):
    """rows: (id, source, text) -> [(id, cleaned)]."""
    pages, has = defaultdict(set), defaultdict(set)
    for _, s, t in rows:
        if t is not None:
            pages[s].add(t)
            for line in t.split("\n"):
                has[s, line.strip(" ")].add(t)
    bad = {k for k, v in has.items() if k[1] and len(v) >= min_pages and len(v) > ratio * len(pages[k[0]])}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad)
             if any((s, x.strip(" ")) in bad for x in t.split("\n")) else t) for i, s, t in rows]


def test_lines_against_brute_force(spark):
    rnd = random.Random(3)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "Share this page"]
    data = []
    for i in range(400):
        s = rnd.choice(["hot"] * 6 + ["b", "c", None, ""])
        t = "\n".join([*rnd.choices(lines[:40], weights=[1 / (k + 1) ** 2 for k in range(40)], k=rnd.randint(0, 6)),
                       f"own {i}", *(["Share this page "] if rnd.random() < .3 and s == "hot" else [])])
        data.append((i, s, None if i % 50 == 0 else t))
    data += [(1000 + i, "hot", "only in a copied page") for i in range(300)]  # one page, however often stored
    data += [(2000, "tiny", "Share this page")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("row", F.lit(1)).withColumn(
        "bad", F.lit("x"))
    out = linededup.clean(df)
    got = sorted((r.doc_id, r.cleaned) for r in out.select("row.doc_id", "cleaned").collect())
    assert got == sorted(brute_lines(data))
    assert dict(got)[1000] == "only in a copied page"
    _no_python(out)


def test_lines_salted_join_is_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = linededup.clean(df, ratio=0.02, min_pages=3).select("row.doc_id", "cleaned", "n_dropped")
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", -1)
    b = linededup.clean(df, ratio=0.02, min_pages=3).select("row.doc_id", "cleaned", "n_dropped")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.filter("n_dropped > 0").count() > 0


def test_lines_edge_rows(spark):
    out = linededup.cleaned_documents(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns and out.count() == edge_docs(spark).count()
    assert out.exceptAll(edge_docs(spark)).count() == 0  # nothing is boilerplate there
    assert linededup.cleaned_documents(empty_docs(spark)).count() == 0
    pages = spark.createDataFrame([row(i, f"Menu\ntext number {i}") for i in range(30)] + [row(99, "Menu")], SCHEMA)
    left = {r.doc_id: (r.text, r.n_chars) for r in linededup.cleaned_documents(pages).collect()}
    assert left[3] == ("text number 3", 13) and 99 not in left


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\s \\p \\", "<\\p|", "a\nb\r\n", "", "<", "<<|", "é日本\U0001f600",
         "[IN\\pST]", "<|end|>", "\\" * 5 + "<s>", None]


def _brute_chat(rows):
    out = {}
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, ts in conv.items():
        ts.sort()
        flat = "".join(f"{r}\n{t}\n" for _, _, r, t in ts)
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|end|>"]), rnd.choice(NASTY))
            for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (-1, 0, "assistant", "a"), (-1, 0, "assistant", "a"),
             (-2, 5, "user", LONG), (-2, 6, "assistant", LONG), (-3, None, "user", "no turn"), (-3, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("segs", F.lit(1)).withColumn("formatted", F.lit("f"))
    ex = chat.examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(ex).collect()}
    assert got == _brute_chat(rows)
    _no_python(chat.digests(ex))
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_chat_examples_train_one_reply_each(spark):
    rows = [(1, 0, "user", "q<s>"), (1, 1, "assistant", "r\\1"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 4, "user", "bye")]
    ex = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(ex.withColumn("back", chat.read_back(F.col("formatted"))).collect(), key=lambda r: r.n_turns)
    assert [r.n_turns for r in got] == [2, 4, 5] and got[2].loss_start is None
    for r in got:
        assert [(b.role, b.text) for b in r.back] == [(x[2], x[3]) for x in rows[:r.n_turns]]
    spans = [r.formatted[r.loss_start:r.loss_start + r.loss_chars] for r in got[:2]]
    assert spans == ["r\\s1", "r2"]


def test_op3_has_the_extra_conversation(spark):
    r = queries.op3_prefix_examples(spark, SF).filter("conv_id = -7").collect()
    said = "</s>[INST] ok [/INST]"
    assert len(r) == 1 and r[0].n_turns == 2 and r[0].loss_chars == len(said)
    assert r[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def _words(t):
    import re
    return re.sub(r"[^\w]|_", " ", (t or "").lower()).split()


def brute_overlap(doc, item, least=10):
    """Best score of any way to lay the two word lists on each other, every offset tried."""
    best = 0
    for off in range(-len(item) + 1, len(doc)):
        now = 0
        for i in range(max(0, -off), min(len(item), len(doc) - off)):
            now = max(0, now + (1 if doc[off + i] == item[i] else -2))
            best = max(best, now)
    return best


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choices(vocab, k=n))) for k, n in enumerate([40, 30, 25, 15, 8, 6, 3])]
    items += [(7, None), (8, ""), (None, "null ids match as well when their words are all found in the text here today")]
    docs = []
    for i in range(150):
        w = rnd.choices(vocab, k=rnd.randint(0, 80))
        if i % 3 == 0:
            p = items[rnd.randrange(6)][1].split()
            p = [rnd.choice(vocab) if rnd.random() < 0.06 else x for x in p]  # substitutions
            at = rnd.randint(0, len(w))
            w[at:at] = p
        docs.append((i, " ".join(w).title() + "!"))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, "Null ids match, as well: when their words "
             "are ALL found in the text here today.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit(1)).withColumn("w", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    out = decontam.overlaps(df, bench, doc_id=F.col("doc_id"))
    _no_python(out)
    got = {(r.doc_id, r.item_id): r.score for r in out.collect()}
    want = {}
    for d, t in docs:
        for k, x in items:
            n = len(_words(x))
            if n >= decontam.MIN_WORDS:
                s = brute_overlap(_words(t), _words(x))
                if s >= min(10, n):
                    want[d, k] = s
    found = {k for k in got}
    assert found <= set(want) and all(got[k] == want[k] for k in found)
    missed = set(want) - found
    strong = {k for k in missed if want[k] >= 16 or want[k] == len(_words(dict(items)[k[1]]))}
    assert not strong and len(missed) <= 0.1 * len(want)
    split = decontam.overlaps(df, bench, part_rows=20, doc_id=F.col("doc_id"))
    assert {(r.doc_id, r.item_id): r.score for r in split.collect()} == got
    kept = decontam.clean_documents(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_decontamination_edge_rows(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    docs = edge_docs(spark)
    kept = decontam.clean_documents(docs, bench)
    ids = Counter(r.doc_id for r in kept.collect())
    assert not {1, 7, 8, 10} & set(ids) and ids[12] == 2 and ids[None] == 1 and ids[6] == 1
    assert decontam.clean_documents(docs, bench.limit(0)).count() == docs.count()
    assert decontam.clean_documents(empty_docs(spark), bench).count() == 0
