"""Plans that read the order lines once, and the checks, subsets, edge ends and lookups on small tables."""

from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgergraph.operators import evaluate as EV
from ledgergraph.operators import graph as G
from ledgergraph.operators import quality as DQ
from ledgergraph.plans import q_relational, q_stream
from ledgergraph.sources import io as IO
from ledgergraph.sources.fixtures import Tables, fin_raw
from ledgergraph.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def scans(df, table):
    return sum(f"/{table}.parquet]" in line for line in plan(df).splitlines() if line.startswith("Location"))


def test_order_lines_are_read_once(spark):
    q = E.queries()
    for name in ("statement_view_is", "statement_view_bs", "bs_lines", "is_or_cis_fallback", "period_label_to_quarter",
                 "map_accounts_left", "triples_distinct", "corpus_past"):
        assert scans(q[name](spark, SF), "lineitem") == 1, name
    for name in ("fk_orphans", "domain_violations"):  # facts are stored first; what is left reads lines for line_order only
        assert scans(q[name](spark, SF), "lineitem") == (name == "fk_orphans"), name
    assert scans(q["node_properties_pivot"](spark, SF), "lineitem") == 0


def test_statement_view_is_the_join_with_filings(spark):
    t = Tables(spark, SF)
    for statement, years in (("IS", (1996, 2000)), ("BS", (1992, 1992)), ("IS", (1800, 1801))):
        got = q_relational._statement_view(t, statement, years)
        f = t.fin_fact.filter((F.col("statement") == statement) & F.col("bsns_year").between(*years))
        want = f.join(t.fin_company, "code").join(t.fin_filing.select("code", "rpid"), ["code", "rpid"]).select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    orders = next(p for p in plan(got).split("\n\n") if "/orders.parquet]" in p)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "LessThan(o_orderdate" in orders  # the years reach the scan


def test_years_reach_the_lines_by_a_runtime_filter(spark):
    t = Tables(spark, SF)
    conf = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        text = plan(q_relational._statement_view(t, "IS"), "extended")
        assert "might_contain" in text.split("== Optimized Logical Plan ==")[1]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_raw_lines_are_facts_and_one_unmapped_line(spark):
    t = Tables(spark, SF)
    raw = fin_raw(t).filter("sj_div = 'BS'")
    assert raw.count() == t.fin_fact.filter("statement = 'BS'").count()
    other = fin_raw(t).filter(F.col("account_nm") == "기타영업외수익")
    one = t.fin_company.select(F.col("code").alias("corp"), F.expr("CASE sector WHEN 'AUTOMOBILE' THEN 2 ELSE 1 END").alias("n"))
    want = t.fin_fact.filter("account = 'Revenue'").select(F.col("code").alias("corp")).join(one, "corp").agg(F.sum("n")).first()[0]
    assert other.count() == want


def test_corpus_for_one_pass_is_not_stored(spark):
    q = E.queries()
    for name in ("marker_strip", "entity_filter_hof", "ordinal_to_quarter"):
        assert scans(q[name](spark, SF), "orders") == 1, name  # a stored corpus would have no scan of its sources


def test_predicates_of_a_frame_share_one_pass(spark):
    a = spark.createDataFrame([("x", "1"), ("yy", None), (None, "9223372036854775807"), ("zzz", "9223372036854775808"),
                               ("", "1.5"), ("", "much"), ("", " -9223372036854775808 "), ("", "")], "name string, amount string")
    b = a.limit(0)
    out = DQ.predicate_counts([("long", a, F.length("name") > 1), ("none", b, F.length("name") > 1),
                               ("amount", a, DQ.outside_bigint(F.col("amount"))), ("null", a, F.col("name").isNull())])
    assert {r["check_name"]: r["n"] for r in out.collect()} == {"long": 2, "none": 0, "amount": 4, "null": 1}


def test_orphans_with_repeated_parents_and_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    assert DQ.orphan_counts([("c", child, parent, ["k"], ["id"])]).first()["n"] == 2


def test_cube_totals_pass_bigint(spark):
    f = spark.createDataFrame([("IS", 1999, "1Q", 2 ** 62)] * 6 + [("BS", 1999, "1Q", -1)],
                              "statement string, bsns_year int, quarter string, value long")
    rows = q_relational.facts_rollup_cube(SimpleNamespace(fin_fact=f)).collect()
    got = {(r["statement"], r["grouping_id"]): int(r["total"]) for r in rows if r["bsns_year"] and r["quarter"]}
    assert got == {("IS", 0): 6 * 2 ** 62, ("BS", 0): -1, (None, 4): 6 * 2 ** 62 - 1}
    assert next(int(r["total"]) for r in rows if r["grouping_id"] == 7) == 6 * 2 ** 62 - 1


EDGE = "child string, parent string, role string"


def test_end_attributes_of_hot_and_cold_nodes(spark):
    rows = [(f"c{i}", "hub", "partOf") for i in range(60)] + [(f"c{i}", f"p{i % 7}", "partOf") for i in range(30)]
    rows += [("c1", None, "partOf"), ("c2", "unknown", "partOf"), ("c2", "unknown", "partOf")]
    e = spark.createDataFrame(rows, EDGE)
    attrs = spark.createDataFrame([("hub", "Hub", 1)] + [(f"p{i}", f"P{i}", 2) for i in range(7)] + [("far", "Far", 3)],
                                  "node string, label string, grp int")
    want = sorted((c, p or "", r, {"hub": "Hub"}.get(p, (p or "").upper() if p and p[0] == "p" else None) or "") for c, p, r in rows)
    for hot in (1, 2, 20, 10_000):  # none is hot, only the hub, several, all
        got = G.end_attributes(e, attrs, "parent", "to", hot)
        assert got.columns == ["child", "parent", "role", "to_label", "to_grp"]
        assert sorted((r["child"], r["parent"] or "", r["role"], r["to_label"] or "") for r in got.collect()) == want, hot
    assert G.end_attributes(e.limit(0), attrs, "parent", "to").isEmpty()


def test_subset_edges_need_both_ends(spark):
    e = spark.createDataFrame([("a", "b", "partOf"), ("b", "c", "partOf"), ("c", "d", "partOf")], EDGE)
    s = spark.createDataFrame([("K", "a"), ("K", "b"), ("L", "b"), ("L", "c"), ("L", "a"), ("M", "d")], "knowledge string, node string")
    got = sorted((r["knowledge"], r["child"], r["parent"]) for r in G.subset_edges(e, s).collect())
    assert got == [("K", "a", "b"), ("L", "a", "b"), ("L", "b", "c")]


def test_inverse_subsets_turn_the_edges(spark):
    q = E.queries()
    fwd = {(r["knowledge"] + "R", r["parent"], r["child"]) for r in q["graph_subset_edges"](spark, SF).collect()}
    inv = q["graph_subset_inverse_edges"](spark, SF).collect()
    assert fwd == {(r["knowledge"], r["child"], r["parent"]) for r in inv} and {r["role"] for r in inv} == {"hasPart"}


def test_lookup_stream_over_files_and_without_a_row(spark):
    path = IO.scratch_path(spark, "lookup-test")
    schema = "q string, code string, account string"
    for part in ([("1", "a", "x"), ("2", "a", "none")], [("3", None, "x"), ("4", "b", "x")], [("5", "a", "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    static = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)], "code string, account string, value double")
    out = ST.lookup_stream(spark, path, schema, static, ["code", "account"], 1)
    assert sorted((r["q"], r["value"]) for r in out.collect()) == [("1", 1.0), ("2", None), ("3", None), ("4", 2.0), ("5", 1.0)]


def test_lookup_plan_leaves_the_bucketed_table_where_it_is(spark):
    t = Tables(spark, SF)
    values = q_stream.value_table(t)
    assert values.groupBy(*q_stream.VALUE_KEYS).count().filter("count > 1").isEmpty()
    asked = values.select(*q_stream.VALUE_KEYS).limit(10)
    text = plan(ST.lookup_plan(asked, values.hint("merge"), q_stream.VALUE_KEYS), "simple")
    assert "Bucketed: true" in text and "SortMergeJoin" in text
    assert text.count("Exchange hashpartitioning") == 1, text  # the asked rows are dealt to the table's buckets


def test_shown_values_against_their_parts(spark):
    t = Tables(spark, SF)
    from ledgergraph.plans.q_eval import _onto
    e, _, coef = _onto(t)
    v = EV.shown_values(t.fin_fact, coef, EV.ratio_definitions(e))
    wide = v.groupBy("code", "bsns_year", "quarter").pivot("account", ["Revenue", "CostOfSales", "GrossProfit", "CostOfSalesRatio"]).agg(F.first("value"))
    rows = wide.filter("Revenue IS NOT NULL AND CostOfSales IS NOT NULL").collect()
    assert rows
    for r in rows:
        assert r["GrossProfit"] == r["Revenue"] - r["CostOfSales"]
        assert abs(r["CostOfSalesRatio"] - r["CostOfSales"] / r["Revenue"]) < 1e-6
