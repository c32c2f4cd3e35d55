"""Language identification (op4), mixing (op5), quality classifier (op6), quality rules (op7)."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgergraph.llm import langid, mixing, quality, queries, rules
from .edge import LONG, PROSE, edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


# --- op4 ---------------------------------------------------------------------------------------------------------

def _brute_phrases(train, seq):
    """Greedy parse of ``seq`` into longest substrings of any training string."""
    n, i = 0, 0
    while i < len(seq):
        k = 0
        while i + k < len(seq) and any(seq[i:i + k + 1] in t for t in train):
            k += 1
        i += max(k, 1)
        n += 1
    return n


def test_parse_is_the_longest_match_parse():
    rnd = random.Random(2)
    for _ in range(40):
        samples = [(lang, "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 30)))) for lang in "xy" for _ in range(3)]
        samples += [("x", "abcabc"), ("y", "cba")]
        model = langid.learn(samples)
        texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 60))) for _ in range(12)]
        segment = rnd.choice([7, 1024])
        got = langid.parse(model, [langid.encode(model.classes, t) if t else np.zeros(0, np.uint8) for t in texts], segment)
        for col, t in enumerate(texts):
            s = bytes(langid.encode(model.classes, t)) if t else b""
            for k, lang in enumerate(model.langs):
                train = [bytes(langid.encode(model.classes, x)) for g, x in samples if g == lang]
                assert got[k, col] == sum(_brute_phrases(train, s[a:a + segment]) for a in range(0, len(s), segment))


def test_language_of_held_out_documents(spark):
    out = queries.op4_cross_parsing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_edge_rows(spark):
    out = {r.doc_id: r for r in langid.identify(edge_docs(spark)).collect()}
    for d in (2, 3, 4, 11):
        assert (out[d].lang_pred, out[d].score) == ("und", 0.0)
    assert out[1].lang_pred == "en" and out[None].held_out is False and out[6].lang_pred == "en"
    assert langid.identify(empty_docs(spark)).count() == 0
    none = langid.identify(edge_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("lang_pred <> 'und' or score <> 0").count() == 0


def test_language_does_not_learn_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(langid.bucket() == 0, F.lit("zz")).otherwise(F.col("lang")))
    assert langid.sample(docs) == langid.sample(spoilt)


# --- op5 ---------------------------------------------------------------------------------------------------------

def _brute_targets(sizes, weights):
    left, out, open_ = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while True:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            return out
        for i in over:
            out[i] = Fraction(3 * sizes[i])
            left -= out[i]
            open_.remove(i)


def test_targets():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.choice([0, 1, 5, 100, 10_000]) for _ in range(rnd.randint(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert got == _brute_targets(sizes, weights)
        assert sum(got) == sum(sizes) and all(g <= 3 * s for g, s in zip(got, sizes))


def test_cube_flight_keeps_both_totals():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 500):
        size = np.exp(rnd.normal(5, 1.5, n)).round()
        if n == 10:
            size[:] = 7  # both constraints agree
        pi = rnd.random(n)
        out = mixing.cube_flight(pi, np.stack([np.ones(n), size], 1), rnd)
        assert ((out > 0) & (out < 1)).sum() <= 2 and (out >= 0).all() and (out <= 1).all()
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3 * max(1, size.sum())


def test_cube_flight_takes_each_unit_with_its_chance():
    size = np.array([1.0, 2, 3, 4, 5, 6, 7, 8])
    pi = np.array([.2, .5, .7, .4, .9, .3, .6, .5])
    runs = [mixing.cube_flight(pi, np.stack([np.ones(8), size], 1), np.random.default_rng(k)) for k in range(3000)]
    assert np.abs(np.mean(runs, 0) - pi).max() < 0.04


@pytest.mark.parametrize("block_rows", [4000, 16])
def test_mix_meets_targets(spark, block_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mixed_documents(docs, block_rows=block_rows).select("row.*", "size", "source_size", "target", "taken").toPandas()
    assert len(out) == docs.count()
    sizes = out.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (sizes == out["size"]).all() and (out.taken <= 3 * out["size"]).all()
    assert (out.taken[out["size"] > 0] % out["size"][out["size"] > 0] == 0).all()
    per = out.groupby("source").agg(words=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    names = sorted(per.index)
    goal = mixing.targets([int(per.words[s]) for s in names], [1 + i % 3 for i in range(len(names))])
    for s, g in zip(names, goal):
        assert abs(per.target[s] - float(g)) < 1e-6 * max(1, g)
        assert abs(per.taken[s] - per.target[s]) <= 0.05 * per.target[s]
    again = mixing.mixed_documents(docs, block_rows=block_rows).select("row.doc_id", "taken").toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(out.doc_id, out.taken))


def test_mix_edge_rows(spark):
    out = mixing.mixed_documents(edge_docs(spark)).select("row.doc_id", "row.size", "taken", F.col("size").alias("words")).collect()
    assert len(out) == 14
    assert all(r.size == 2 and r.taken <= 3 * r.words for r in out)
    twins = [r.taken for r in out if r.doc_id == 12]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert {r.words for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0
    nothing = edge_docs(spark).withColumn("text", F.lit(None).cast("string"))
    assert mixing.mixed_documents(nothing).agg(F.sum("taken")).first()[0] == 0


# --- op6 ---------------------------------------------------------------------------------------------------------

def test_label_model_recovers_accuracies():
    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.8
    accuracy = np.linspace(0.65, 0.95, len(quality.LABELLERS))
    right = rnd.random((len(truth), len(accuracy))) < accuracy
    vote = np.where(right == truth[:, None], 1, -1) * (rnd.random(right.shape) < 0.8)
    pattern, count = np.unique(vote, axis=0, return_counts=True)
    model = quality.fit_labels(pattern, count.astype(float))
    assert abs(model.prior - 0.8) < 0.05
    speaks_good = model.p_good[:, 2] / (model.p_good[:, 0] + model.p_good[:, 2])
    assert np.abs(speaks_good - accuracy).max() < 0.06


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_weak_label_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.score.between(0, 1)).all()
    assert got.kept[got.quality == 1].mean() > 0.97 and got.kept[got.quality == 0].mean() < 0.12


def test_quality_edge_rows(spark):
    out = quality.classify(edge_docs(spark)).select("row.doc_id", "row.score", "score", "kept").toDF("id", "own", "s", "kept")
    rows = out.collect()
    assert len(rows) == 14 and all(r.own == 0.5 for r in rows)
    assert all(not r.kept and r.s == 0 for r in rows if r.id in (2, 3, 4))
    same = [r.s for r in rows if r.id in (1, 7, 8)]
    assert len(set(same)) == 1
    assert quality.classify(empty_docs(spark)).count() == 0


# --- op7 ---------------------------------------------------------------------------------------------------------

def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    hit = {i + o for i, t in enumerate(tri) if n[t] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(lines), sum(c.isupper() for c in text or ""), sum(c.isalpha() for c in text or ""),
            sum(a == b for a, b in zip(words, words[1:])))


def test_measures_against_brute_force():
    rnd = random.Random(6)
    texts = [None, "", " ", "\n\n", "a", LONG, PROSE, "a b a b a b", "x\x0by\x0cz\xa0q\x1cr", "Ünï ΣΩ 日本 𝔄𝔅 ǅ"]
    texts += ["".join(rnd.choice("ab \n#*Ü\t") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    for t in texts:
        assert rules.measure_text(t) == _brute(t), repr(t)


def test_ledger_policies_and_ablation(spark):
    led = queries.op7_rule_ledger(spark, SF).cache()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = led.collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = _brute(docs[r.doc_id])
        assert tuple(r[m] for m in rules.MEASURES) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
        assert r.kept == (r.failed_bits == 0)
    for r in rules.ablation(led).collect():
        one = 1 << r.bit
        assert r.n_failed == sum(bool(x.failed_bits & one) for x in rows)
        assert r.n_only_this == sum(x.failed_bits == one for x in rows)
        assert r.n_kept_without == sum(x.failed_bits & ~one == 0 for x in rows)


def test_ledger_edge_rows(spark):
    led = rules.ledger(edge_docs(spark).withColumn("n_words", F.lit(-1)))
    rows = {r.doc_id: r for r in led.collect()}
    assert led.count() == 14 and rows[2].n_words == 0 and rows[2].failed_bits & 1 and rows[6].n_words == 120_000
    assert rows[1].row == "r" and rows[6].failed_bits == 0
    assert rules.ledger(empty_docs(spark)).count() == 0
