"""Closure and heights without depth limits; cycles raise."""

import pytest

from ledgergraph.operators import graph as G
from ledgergraph.session import ensure_checkpoint_dir


def _edges(spark, pairs):
    return spark.createDataFrame([(c, p, "partOf") for c, p in pairs], "child string, parent string, role string")


def test_long_chain_is_whole(spark):
    n = 30
    e = _edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(n)])
    assert G.closure(e).count() == n * (n + 1) // 2
    got = G.closure(e, above=spark.createDataFrame([(f"n{n}",)], "node string")).collect()
    assert len(got) == n and max(r.max_depth for r in got) == n
    h = {r.node: r.height for r in G.node_heights(e).collect()}
    assert h[f"n{n}"] == n and h["n0"] == 0


def test_seeds_cut_the_closure(spark):
    e = _edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "d"), ("d", "e")])
    full = {tuple(r) for r in G.closure(e).collect()}
    for seeds, kw, place in ((["d"], "above", 0), (["a", "x"], "below", 1)):
        some = {tuple(r) for r in G.closure(e, **{kw: spark.createDataFrame([(s,) for s in seeds], "node string")}).collect()}
        assert some == {r for r in full if r[place] in seeds}
    assert ("d", "a", 2, 2, 2, 2) in full


def test_cycles_raise(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")])
    with pytest.raises(ValueError):
        G.closure(e)
    with pytest.raises(ValueError):
        G.node_heights(_edges(spark, [("a", "b"), ("b", "a"), ("x", "a")]))


def test_empty_edges(spark):
    e = spark.createDataFrame([], "child string, parent string, role string")
    assert G.closure(e).count() == 0 and G.node_heights(e).count() == 0


def test_shared_folder_is_required_off_local(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
