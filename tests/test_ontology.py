"""Golden counts of the account ontology (numbers re-typed from the modelled system's data files)."""

from pyspark.sql import functions as F

from ledgergraph.operators import evaluate as EV
from ledgergraph.operators import graph as G
from ledgergraph.sources import ontology as O
from ledgergraph.sources import reference_values as RV


def test_triples_are_404_distinct(spark):
    t = O.triples(spark)
    assert t.count() == 404
    assert t.distinct().count() == 404
    by_p = {r["p"]: r["count"] for r in t.groupBy("p").count().collect()}
    assert by_p["rdf:type"] == 58 and by_p["rdfs:label"] == 44
    assert by_p["acc:partOf"] == 43 and by_p["acc:hasPart"] == 43
    assert by_p["acc:numerator"] == 14 and by_p["acc:denominator"] == 9
    assert by_p["acc:Account_Property"] == 39


def _subset_edges(spark, knowledge):
    nodes = RV.KNOWLEDGE_SUBSETS[knowledge]
    e = O.edges(spark)
    return e.filter(F.col("child").isin(nodes) & F.col("parent").isin(nodes))


def test_subset_counts(spark):
    bs, is_ = _subset_edges(spark, "BS"), _subset_edges(spark, "IS")
    assert bs.count() == 39 and is_.count() == 25
    assert G.subtree_nodes(bs).count() == 28 and G.subtree_nodes(is_).count() == 17
    skip = ["CalendarOneYear"]
    assert G.role_dictionary(bs, skip).count() == 14
    assert G.role_dictionary(is_, skip).count() == 11


def test_closure_counts_with_and_without_multiplicity(spark):
    for k, (mult, dist) in {"BS": (79, 75), "IS": (97, 75)}.items():
        e = _subset_edges(spark, k).filter((F.col("child") != "CalendarOneYear") & (F.col("parent") != "CalendarOneYear"))
        c = G.closure(e)
        assert c.agg(F.sum("n_paths")).first()[0] == mult
        assert c.count() == dist


def test_compiled_closure_equals_spark_closure(spark):
    pe = EV.partof_edges(O.edges(spark), O.nodes(spark))
    a = G.closure(pe, weight=F.col("child_sign")).select("ancestor", "descendant", "n_paths", "weight",
                                                                         "min_depth", "max_depth")
    b = O.partof_closure_df(spark)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # iterative (checkpointed) mode gives the same pairs
    c = G.closure(pe, weight=F.col("child_sign")).select("ancestor", "descendant", "n_paths", "weight")
    assert sorted(map(tuple, c.collect())) == sorted((r[0], r[1], r[2], r[3]) for r in b.collect())


def test_heights_and_signs(spark):
    pe = EV.partof_edges(O.edges(spark), O.nodes(spark))
    h = {r["node"]: r["height"] for r in G.node_heights(pe).collect()}
    assert h["GrossProfit"] == 1 and h["OperatingIncome"] == 2 and h["ProfitBeforeTax"] == 3
    assert h["Profit"] == 4 and h["IncomeStatement"] == 5 and max(h.values()) < 8
    coef = {(r["ancestor"], r["leaf"]): r["coef"] for r in O.coef_df(spark).collect()}
    assert coef[("GrossProfit", "Revenue")] == 1 and coef[("GrossProfit", "CostOfSales")] == -1
    assert coef[("Profit", "IncomeTaxExpense")] == -1 and coef[("Profit", "CostOfSales")] == -1


def test_ratio_definitions(spark):
    d = {r["account"]: (r["num"], r["den"], r["scale"]) for r in EV.ratio_definitions(O.edges(spark)).collect()}
    assert d["CostOfSalesRatio"] == ("CostOfSales", "Revenue", 1.0)
    assert d["InventoriesTurnoverPeriod"] == ("Inventories", "Revenue", 365.0)
    assert d["IncomeTaxRatio"] == ("IncomeTaxExpense", "ProfitBeforeTax", 1.0)
    assert len(d) == 9


def test_master_decode(spark):
    m = {r["acc"]: r for r in O.decode_master(O.master_raw(spark)).collect()}
    assert len(m) == 43
    assert (m["CurrentAssets"]["statement"], m["CurrentAssets"]["kind"], m["CurrentAssets"]["level"]) == ("BS", "Value", 3)
    assert m["Ratios"]["statement"] == "FS"


def test_iri_local_name(spark):
    df = spark.createDataFrame([("http://x/acc#Revenue",), ("no-hash",), ("a#b#c",)], "u string")
    out = [r[0] for r in df.select(G.iri_local_name(F.col("u"))).collect()]
    assert out == ["Revenue", None, None]
