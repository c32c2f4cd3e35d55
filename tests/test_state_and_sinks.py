"""Catalog tables, appended ids, dialog turns in streaming state, and the sequence recursions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgergraph.operators import dialog as DL
from ledgergraph.operators import keys as KY
from ledgergraph.operators import metrics as M
from ledgergraph.operators import sequence as SQ
from ledgergraph.plans import q_sources as QS
from ledgergraph.sources import io as IO
from ledgergraph.streaming import streams as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_exchange(spark, tables):
    for _ in range(2):  # creating and loading again changes nothing
        f, c = QS.catalog_tables(tables, 4)
        assert f.count() == tables.fin_fact.count() and c.count() == tables.fin_company.count()
    j = f.hint("merge").join(c, "code").groupBy("code", "name").agg(F.sum("value").alias("s"))
    assert "Exchange" not in _plan(j) and "SortMergeJoin" in _plan(j)
    assert "Exchange" in _plan(tables.fin_fact.hint("merge").join(tables.fin_company, "code"))
    year = tables.fin_fact.agg(F.max("bsns_year")).first()[0]
    assert f"PartitionFilters: [isnotnull(bsns_year" in _plan(f.filter(F.col("bsns_year") == year))
    one = tables.fin_fact.filter(F.col("bsns_year") == year)
    IO.load_table(spark, f"lg_fact_{QS.uuid.uuid5(QS.uuid.NAMESPACE_URL, tables.sf_dir).hex[:12]}", one, "code", 4)
    assert f.count() == tables.fin_fact.count()  # only that year's partition is replaced


def test_appended_ids(spark):
    def load(rows):
        df = spark.createDataFrame(rows, "a string, b int, x double")
        return {(r["a"], r["b"], r["x"]): r["id"] for r in KY.append_keys(df, ["a", "b"], path, "id").collect()}
    path = IO.scratch_path(spark, "registry-test")
    first = [("m", 1, 0.5), ("c", 2, 1.5), (None, 3, 2.5), ("c", None, 3.5), ("c", 2, 4.5)]
    a = load(first)
    assert sorted(set(a.values())) == [1, 2, 3, 4] and a["c", 2, 1.5] == a["c", 2, 4.5]
    assert load(first) == a
    b = load([("a", 9, 0.0), ("m", 1, 7.0), ("z", 9, 0.0)])
    assert b == {("a", 9, 0.0): 5, ("m", 1, 7.0): a["m", 1, 0.5], ("z", 9, 0.0): 6}
    assert load(first) == a and load([]) == {}
    assert KY.registry(spark, path, "a string, b int, id bigint").count() == 6


@pytest.mark.parametrize("seed", [0, 1])
def test_dialog_turns_for_any_file_order(spark, seed):
    rnd = random.Random(seed)
    rows = [(c, k, rnd.choice(["user", "assistant"]), rnd.choice(["ok", "why?", None])) for c in range(12) for k in range(rnd.randint(1, 9))]
    rows = [r for r in rows if not (r[0] == 3 and r[1] == 2)] + [(4, None, "user", "when?")]  # a gap, a turn without a number
    want = {(r["conv_id"], r["turn"]): (r["turn_no"], r["carried_intent"]) for r in DL.turn_state(
        spark.createDataFrame([x for x in rows if x[1] is not None], "conv_id long, turn long, role string, text string")).collect()}
    rnd.shuffle(rows)
    path = IO.scratch_path(spark, "turns-test")
    for part in [rows[i::3] for i in range(3)] + [[(None, None, None, None)]]:
        at = 1_700_000_000 + (90 * 86_400 if part[0][0] is None else 0)
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").withColumn(
            "event_time", F.timestamp_seconds(F.lit(at) + F.coalesce("turn", F.lit(0)))).coalesce(1).write.mode("append").parquet(path)
    out = [r for r in ST.dialog_turns(spark, path).collect() if r["conv_id"] is not None]
    assert len(out) == len(rows)  # each turn once
    got = {(r["conv_id"], r["turn"]): (r["turn_no"], r["carried_intent"]) for r in out if r["turn"] is not None}
    assert got == want
    last = next(r for r in out if r["turn"] is None)
    assert last["conv_id"] == 4 and last["carried_intent"] == "question" and last["turn_no"] == 1 + len([r for r in rows if r[0] == 4 and r[1] is not None])


def test_recursions_against_every_path():
    rnd = np.random.default_rng(1)
    k = 3
    start, end, trans = rnd.normal(size=k), rnd.normal(size=k), rnd.normal(size=(k, k))
    seqs = [rnd.normal(size=(n, k)) for n in (4, 1, 6, 2, 4)]
    golds = [rnd.integers(0, k, len(s)) for s in seqs]
    for s, g, (logz, own, best, path, post) in zip(seqs, golds, SQ.recursions(seqs, golds, start, trans, end)):
        def score(p):
            return start[p[0]] + sum(s[t, p[t]] for t in range(len(p))) + sum(trans[a, b] for a, b in zip(p, p[1:])) + end[p[-1]]
        every = {p: score(p) for p in itertools.product(range(k), repeat=len(s))}
        z = math.log(sum(math.exp(v) for v in every.values()))
        assert math.isclose(logz, z) and math.isclose(own, every[tuple(g)]) and math.isclose(best, max(every.values()))
        assert math.isclose(every[tuple(path)], best)
        for t in range(len(s)):
            assert math.isclose(post[t], sum(math.exp(v - z) for p, v in every.items() if p[t] == g[t]))


def test_decode_in_small_groups_is_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    tags = SQ.tag_set()
    rows = [(f"d{i}", p, f"w{rnd.randint(0, 30)}", rnd.choice(tags)) for i in range(60) for p in range(rnd.choice([1, 3, 40]))]
    rows += [("long", p, f"w{p % 31}", tags[p % 3]) for p in range(3000)]
    seq = spark.createDataFrame(rows, "doc string, pos int, word string, tag string")
    tlp = SQ.transition_logprob(SQ.transitions(seq))

    def run():
        return {r["doc"]: (r["length"], r["logz"], r["score"], r["best"]) for r in SQ.decode(SQ.arrays(seq, SQ.emissions(seq)), tlp).collect()}
    a = run()
    monkeypatch.setattr(SQ, "CELLS", 50)
    monkeypatch.setattr(SQ, "BROADCAST_WORDS", -1)
    b = run()
    assert a.keys() == b.keys() and len(a) == 61 and a["long"][0] == 3000
    for d in a:
        assert a[d][0] == b[d][0] and a[d][3] == b[d][3] and np.allclose(a[d][1:3], b[d][1:3])
    s = {r["doc"]: r["score"] for r in SQ.score(seq, tlp, SQ.emission_logprob(SQ.emissions(seq))).collect()}
    assert all(math.isclose(s[d], a[d][2], abs_tol=1e-4) for d in a)  # the same score as by joins


def test_metrics_of_a_small_confusion(spark):
    s = spark.createDataFrame([("tag", "test", a, b, p) for a, b, p in
                               [("x", "x", .9), ("x", "y", .2), ("y", "y", .8), ("y", "y", .7), ("z", "x", .1)]],
                              "head string, split string, label string, pred string, p_label double")
    c = M.confusion(s)
    pad = M.padding(spark.createDataFrame([("test", i, n) for i, n in enumerate([3, 1, 2, 5])], "split string, place long, length long"), 2)
    acc = {r["include_padding"]: (r["accuracy"], r["n"]) for r in M.accuracy(c, pad).collect()}
    assert acc == {False: (0.6, 5), True: (0.8, 10)}  # 3-1 and 5-2 positions are padded
    f = {r["scope"]: (r["precision"], r["recall"], r["f1"]) for r in M.f1_scores(c).collect()}
    assert f["x"] == (0.5, 0.5, 0.5) and f["y"] == (0.666667, 1.0, 0.8) and f["z"] == (None, 0.0, 0.0) and f["micro"] == (0.6, 0.6, 0.6)
    assert f["macro"] == (0.388889, 0.5, 0.433333)
    want = sum(.75 * (1 - p) ** 3 * -math.log(p) for p in (.9, .2, .8, .7, .1)) / 5
    assert math.isclose(M.focal_loss(s).first()["focal_loss"], want, abs_tol=1e-6)
