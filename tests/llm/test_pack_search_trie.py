"""Packing (op11), ranked search (op12) and prefix trie (op13) against brute force, SQL and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgergraph.llm import lexsearch, packing, prefixtrie, queries
from .edge import LONG, PROSE, SCHEMA, edge_docs, empty_docs, row

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------------- packing
ODD = ["", None, " ", "don't WON'T I'll", "<|endoftext|>x<|startoftext|> y", "İstanbul İI ΣΑΣ Σ", "á ́b ée",
       "a b c\u0085d\x1ce\x0bf", "100%,.!?- 3.14 x-y (z) ''s", "日本語のテキスト 한글 ก็", "\U0001f600\U0001f600 ok",
       "w" * 300 + " " + "é" * 100, "tab\tline\r\nend\n\n", "ǅ ﬁ ß ẞ", "a.b... c,,,", "x*** y### -- \"q\"", LONG]


def _plain(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_the_tokenizers_ids(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pieces(df, ids=True).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(texts):
        want, ps = _plain(t), sorted(got[i], key=lambda r: r.piece)
        assert [x for p in ps for x in p.ids] == want, t
        assert [p.piece for p in ps] == list(range(len(ps))) and [p.start for p in ps] == list(range(0, len(want), 2048))
        assert all(p.length == len(p.ids) <= 2048 for p in ps) and all(p.length == 2048 for p in ps[:-1])
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in ps)


def test_word_cache_can_overflow(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    import public_tokenizers
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"abc{i}x, def{j}" for j in range(6)) for i in range(30)] + [t or "" for t in ODD[:-1]]
    for t in texts:
        assert w.texts([t.encode()])[0].tolist() == _plain(t)[:-1]
    got, counts = w.texts([t.encode() for t in texts])
    assert got.tolist() == [x for t in texts for x in _plain(t)[:-1]] and counts.tolist() == [len(_plain(t)) - 1 for t in texts]


def _slow_best_fit(costs, capacity, weights, rule):
    bins, out = [], []
    for c in costs:
        best = None
        for j, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, c)):
                after = [(x - y) / k for x, y, k in zip(left, c, capacity)]
                score = (sum(w * a * a for w, a in zip(weights, after)) if rule == "norm" else
                         -sum(w * x * y / k / k for w, x, y, k in zip(weights, left, c, capacity)))
                if best is None or score < best[0] - 1e-12:
                    best = score, j
        if best is None:
            bins.append(list(capacity))
            best = 0, len(bins) - 1
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], c)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(2048, 2048, 2048 ** 2), (2048, 3, 2_000_000), (512, 4, 100_000)])
def test_best_fit_against_brute_force(rule, caps):
    rnd = random.Random(5)
    for _ in range(3):
        size = sorted((rnd.randint(1, math.isqrt(caps[2]) if caps[2] < caps[0] ** 2 else caps[0]) for _ in range(700)), reverse=True)
        size = [min(s, caps[0]) for s in size]
        costs = np.array([(s, 1, s * s) for s in size], float)
        w = (1.0, 0.05, 0.05)
        assert packing.best_fit(costs, np.array(caps, float), np.array(w), rule).tolist() == _slow_best_fit(costs, caps, w, rule)


def _check_packed(rows, max_tokens, max_documents, max_attention):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        upto = 0
        for offset, length in sorted(s):
            assert offset == upto
            upto += length
        assert upto <= max_tokens and len(s) <= max_documents and sum(n * n for _, n in s) <= max_attention
    return len(by)


@pytest.mark.parametrize("caps", [(2048, 2048, 2048 ** 2), (1024, 4, 400_000)])
def test_pack_keeps_every_capacity_in_rounds_of_blocks(spark, caps):
    parts = packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), max_tokens=caps[0], max_attention=caps[2], ids=True).cache()
    packed = packing.pack(parts, max_tokens=caps[0], max_documents=caps[1], max_attention=caps[2], block_rows=40)
    rows = packed.select("row.*", "sequence_id", "offset").collect()
    n = _check_packed(rows, *caps)
    assert Counter((r.doc_id, r.piece) for r in rows) == Counter((r.doc_id, r.piece) for r in parts.collect())
    if caps[1] > 100:
        assert n <= 1.03 * math.ceil(sum(r.length for r in rows) / caps[0]) + 1
    for s in packing.sequences(packed).limit(5).collect():
        own = sorted((r.offset, r.ids) for r in rows if r.sequence_id == s.sequence_id)
        assert s.ids == [x for _, ids in own for x in ids] and s.n_documents == len(own)
    parts.unpersist()


def test_pack_near_the_least_number(spark):
    rows = queries.op11_vector_best_fit(spark, "/root/testdata/sf0.01").collect()
    n = _check_packed(rows, 2048, 2048, 2048 ** 2)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_pack_edge_rows(spark):
    docs = edge_docs(spark)
    rows = packing.pack(packing.pieces(docs)).select("row.*", "sequence_id", "offset").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert [(r.length, r.piece) for r in rows if r.doc_id == 2] == [(1, 0)] == [(r.length, r.piece) for r in rows if r.doc_id == 3]
    assert len([r for r in rows if r.doc_id == 12]) == 2 and max(r.piece for r in rows if r.doc_id == 6) > 10
    _check_packed(rows, 2048, 2048, 2048 ** 2)
    assert packing.pack(packing.pieces(empty_docs(spark))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packing.pieces(docs), max_tokens=100)


# -------------------------------------------------------------------------------------------------- search
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=20):
    """docs: [(id, text)], items: [(id, text)] -> [(item, rank, doc, score)]."""
    got = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    got = [(i, c) for i, c in got if c]
    n_docs, total = len(got), sum(sum(c.values()) for _, c in got)
    df = Counter(t for _, c in got for t in c)
    out = []
    for item, text in items:
        q = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in got:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in q.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def _key(rows):
    return sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))


@pytest.mark.parametrize("tokens, docs_a_shard, window, items_a_block", [(300, 7, 3, 2), (5000, 64, 16, 100), (10 ** 6, 10 ** 6, 8192, 256)])
def test_search_against_brute_force(spark, monkeypatch, tokens, docs_a_shard, window, items_a_block):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(120)] + ["É", "ß", "日本", "Straße"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(
        rnd.choice([str, str.upper])(w) for w in rnd.choices(vocab, weights, k=n))
    docs = [(i, text(rnd.choice([1, 3, 20, 60]))) for i in range(400)] + [(None, text(30)), (7, text(30)), (500, None), (501, "--")]
    docs += [(600 + i, "w1 w2 w3 tie") for i in range(40)]
    items = [(i, text(rnd.randint(1, 25))) for i in range(7)] + [(3, "w1 w1 w1 w2"), (50, "tie w3"), (51, ""), (52, None), (53, "absent"),
                                                                  (None, "w5 w9")]
    monkeypatch.setattr(lexsearch.Shard.top, "__defaults__", (window,))
    index = lexsearch.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")),
                            shard_tokens=tokens, shard_docs=docs_a_shard)
    got = lexsearch.search(index, spark.createDataFrame(items, "item_id long, text string"), item_block=items_a_block)
    assert _key(map(tuple, got.collect())) == _key(brute_search(docs, items))


def test_search_skips_blocks(spark):
    """With many documents that can't reach the score to beat, blocks of common terms stay packed."""
    docs = [(i, "rare other rare common") for i in range(30)] + [(100 + i, "common " + f"own{i} filler " * 40) for i in range(6000)]
    index = lexsearch.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    n_docs, n_terms = lexsearch.statistics(index)
    words = lexsearch.terms_of(["rare common"])[0].tolist()
    pdf = index.filter(F.col("term").isNull() | F.col("term").isin(words)).withColumn("docs", F.col("term").isNull()) \
        .withColumn("term", F.coalesce("term", F.lit(0))).toPandas()
    shard = lexsearch.Shard(pdf, n_docs, n_terms)
    doc, score = shard.top([(words[0], 5000), (words[1], 1)], 20, 512)
    assert len(doc) == 20 and sorted(shard.doc_id[doc]) == list(range(20))
    common = shard.at[words[1]]
    assert len([b for i, b in shard.unpacked if i == common]) < len(shard.list_of(common)[0]) / 4


def test_search_long_text_and_edge_rows(spark):
    long = " ".join(f"t{i % 5000}" for i in range(700_000)) + " needle"
    docs = spark.createDataFrame([row(1, long), row(2, "needle here"), row(3, "x" * 1_500_000 + " needle")], SCHEMA)
    items = spark.createDataFrame([(1, "needle t17"), (2, "nothing")], "item_id long, text string")
    got = [tuple(r) for r in lexsearch.search(lexsearch.build(docs), items).collect()]
    want = brute_search([(1, long), (2, "needle here"), (3, "x" * 1_500_000 + " needle")], [(1, "needle t17"), (2, "nothing")])
    assert sorted(got) == want
    assert lexsearch.search(lexsearch.build(edge_docs(spark)), items).count() == 0
    assert lexsearch.search(lexsearch.build(empty_docs(spark)), items).count() == 0
    assert lexsearch.search(lexsearch.build(docs), items.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------------- trie
def brute_trie(rows, group=20):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in conv.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, ts in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = conv.get(c - int(math.fmod(c, group)), [])
        new = base[:h] + ts[h:]
        for d in range(len(new) + 1):
            nodes[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    total = {}
    kids = defaultdict(list)
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(total[k][0] for k in kids[p]) or 1
        saved = (len(nodes[p]) - 1) * words + sum(total[k][1] for k in kids[p])
        total[p] = leaves, saved
        if p:
            kids[p[:-1]].append(p)
    return [(min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), *total[p],
             hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, cs in nodes.items()]


def _conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-45, 260), 1000, 1001, 2019]:
        if rnd.random() < .15:
            continue  # some groups have no first conversation
        n = rnd.choice([1, 1, 2, 3, 5, 9])
        for k in range(n):
            text = rnd.choice(["hello there", "yes", "no  it is", None, "", "long " * 30, f"own {c}"]) if rnd.random() < .8 else "common turn"
            rows.append((c, None if k == 0 and rnd.random() < .2 else k, rnd.choice(["user", "assistant", None]), text))
    rows += [(300, k, "user", f"turn {k % 3}") for k in range(400)] + [(301, k, "user", f"turn {k % 3}") for k in range(400)]
    rows += [(400 + i, k, "user", "copy") for i in range(150) for k in range(4)]  # a large group of copies
    rows += [(5, 1, "user", "yes"), (5, 1, "user", "yes"), (6, 1, "a", "z"), (6, 1, "a", "b"), (None, 0, "user", "lost")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_convs, queue", [(4, 3), (40, 10 ** 6), (10 ** 6, 5)])
def test_trie_against_brute_force(spark, shard_convs, queue):
    rows = _conversations(shard_convs)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k1", F.lit(1)) \
        .withColumn("words", F.lit("x")).repartition(7)
    got = [tuple(r) for r in prefixtrie.trie(df, shard_convs=shard_convs, queue=queue).collect()]
    assert _key(got) == _key(brute_trie(rows))


def test_trie_ends_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "END_ROWS", 8)
    rows = [(c, k, "user", "same") for c in range(300) for k in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _key(map(tuple, prefixtrie.trie(df).collect())) == _key(brute_trie(rows))


def test_trie_edge_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.trie(spark.createDataFrame([], schema)).count() == 0
    one = [(7, None, None, None)]
    assert _key(map(tuple, prefixtrie.trie(spark.createDataFrame(one, schema)).collect())) == _key(brute_trie(one))
    long = [(40, 0, "user", LONG), (41, 0, "user", LONG), (42, 1, "user", PROSE)]
    assert _key(map(tuple, prefixtrie.trie(spark.createDataFrame(long, schema)).collect())) == _key(brute_trie(long))


def test_spilling_queue_keeps_order():
    rnd = random.Random(2)
    keys = [(rnd.randint(0, 50), rnd.randint(0, 3)) for _ in range(2000)]
    q = prefixtrie.SpillingQueue(16)
    for i, k in enumerate(keys):
        q.push(k, (i,))
    assert q.spills > 50
    out = [(k, sorted(x[0] for x in q.pop_all(k))) for k in sorted(set(keys))]
    assert out == [(k, [i for i, x in enumerate(keys) if x == k]) for k in sorted(set(keys))]


def test_sql_of_search_and_trie(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("op12_block_max_search", "op13_time_forward_trie"):
        cur = con.execute(queries.ORACLES[name])
        df = queries.QUERIES[name](spark, SF)
        assert [x[0] for x in cur.description] == df.columns
        assert _key(map(tuple, df.collect())) == _key(cur.fetchall())
