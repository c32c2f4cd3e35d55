"""Rollup, completeness, ratios, turnover and what-if on hand-made facts."""

from pyspark.sql import functions as F

from ledgergraph.operators import evaluate as EV
from ledgergraph.sources import ontology as O

K = ["code", "bsns_year", "quarter"]


def _facts(spark, rows):
    return spark.createDataFrame([("c1", 2020, "1Q", a, v) for a, v in rows],
                                 "code string, bsns_year int, quarter string, account string, value long")


def test_rollup_and_completeness(spark):
    f = _facts(spark, [("Revenue", 1000), ("CostOfSales", 600), ("SellingGeneralAdministrativeExpenses", 100),
                       ("FinanceIncome", 50), ("FinancialExpenses", 20), ("IncomeTaxExpense", 30)])
    r = {x["account"]: x["value"] for x in EV.rollup(f, O.coef_df(spark)).collect()}
    assert r["GrossProfit"] == 400
    assert r["OperatingIncome"] == 300
    assert r["ProfitBeforeTax"] == 330
    assert r["Profit"] == 300
    assert "CurrentAssets" not in r  # all-or-nothing: BS leaves missing
    part = {x["account"]: (x["value"], x["n_present"], x["need"])
            for x in EV.rollup(_facts(spark, [("Revenue", 1000)]), O.coef_df(spark), complete_only=False).collect()}
    assert part["GrossProfit"] == (1000, 1, 2)


def test_missing_leaf_gives_no_row(spark):
    f = _facts(spark, [("Revenue", 1000)])
    r = [x["account"] for x in EV.rollup(f, O.coef_df(spark)).collect()]
    assert "GrossProfit" not in r


def test_ratio_and_turnover(spark):
    f = _facts(spark, [("Revenue", 1000), ("CostOfSales", 250), ("Inventories", 500)])
    defs = EV.ratio_definitions(O.edges(spark))
    vals = f.select(*K, "account", F.col("value").cast("double").alias("value"))
    r = {x["account"]: x["value"] for x in EV.ratios(vals, defs).collect()}
    assert r["CostOfSalesRatio"] == 0.25
    assert r["InventoriesTurnoverPeriod"] == 182.5


def test_linearity_and_whatif_identity(spark):
    rows = [("Revenue", 1000), ("CostOfSales", 600)]
    coef = O.coef_df(spark)
    a = {x["account"]: x["value"] for x in EV.rollup(_facts(spark, rows), coef).collect()}
    b = {x["account"]: x["value"] for x in EV.rollup(_facts(spark, [(k, 3 * v) for k, v in rows]), coef).collect()}
    assert all(b[k] == 3 * a[k] for k in a)
    sc = spark.createDataFrame([("s0", "GrossProfit", "Revenue", 0), ("s1", "GrossProfit", "Revenue", 10),
                                ("s2", "GrossProfit", "CostOfSales", -5)],
                               "scenario_id string, target string, subject string, pct int")
    w = {x["scenario_id"]: x for x in EV.whatif(_facts(spark, rows), coef, sc).collect()}
    assert w["s0"]["scenario_value"] == 400.0 and w["s0"]["delta"] == 0.0
    assert w["s1"]["scenario_value"] == 500.0
    assert w["s2"]["scenario_value"] == 430.0


def test_whatif_internal_subject(spark):
    rows = [("Revenue", 1000), ("CostOfSales", 600), ("SellingGeneralAdministrativeExpenses", 100)]
    coef = O.coef_df(spark)
    sc = spark.createDataFrame([("s", "OperatingIncome", "GrossProfit", 50)],
                               "scenario_id string, target string, subject string, pct int")
    sl = coef.select(F.col("ancestor").alias("subject"), "leaf")
    w = EV.whatif(_facts(spark, rows), coef, sc, subject_leaves=sl).first()
    assert w["baseline"] == 300 and w["scenario_value"] == 500.0  # GP 400 -> 600, minus SG&A 100


def test_whatif_leaf_ratio_and_turnover_targets(spark):
    rows = [("Revenue", 1000), ("CostOfSales", 600), ("Inventories", 50), ("SellingGeneralAdministrativeExpenses", 100)]
    plan = spark.createDataFrame(O.target_plan_rows(), "target_account string, mode string, unit string, node string, "
                                                       "role string, weight double, scale double")
    sc = spark.createDataFrame([(f"{a}|{b}", a, b, 25) for a, b in (
        ("Revenue", "Revenue"), ("GrossProfit", "CostOfSales"), ("CostOfSalesRatio", "Revenue"),
        ("CostOfSalesRatio", "CostOfSales"), ("InventoriesTurnoverPeriod", "Inventories"), ("NetIncome", "Revenue"))],
        "scenario_id string, target string, subject string, pct int")
    w = {x["target"] + "|" + x["subject"]: (x["baseline"], x["scenario_value"], x["delta"], x["pct_change"])
         for x in EV.whatif(_facts(spark, rows), O.coef_df(spark), sc, plan=plan).collect()}
    assert w == {"Revenue|Revenue": (1000.0, 1250.0, 250.0, 25.0),
                 "GrossProfit|CostOfSales": (400.0, 250.0, -150.0, -37.5),
                 "CostOfSalesRatio|Revenue": (0.6, 0.48, -0.12, -20.0),
                 "CostOfSalesRatio|CostOfSales": (0.6, 0.75, 0.15, 25.0),
                 "InventoriesTurnoverPeriod|Inventories": (18.25, 22.8125, 4.5625, 25.0)}


def test_whatif_by_row_is_whatif_by_joins(spark, tables):
    plan = spark.createDataFrame(O.target_plan_rows(), "target_account string, mode string, unit string, node string, "
                                                       "role string, weight double, scale double")
    pairs = [("NetIncome", "Revenue"), ("GrossProfit", "GrossProfit"), ("CostOfSalesRatio", "CostOfSales"),
             ("InventoriesTurnoverPeriod", "Inventories"), ("SellingGeneralAdministrativeRatio", "Revenue"),
             ("Revenue", "Inventories"), ("OperatingIncome", "GrossProfit")]
    sc = spark.createDataFrame([(f"{a}|{b}|{p}", a, b, p) for a, b in pairs for p in (10, -100, 0)],
                               "scenario_id string, target string, subject string, pct int")
    coef = O.coef_df(spark)
    sl = coef.select(F.col("ancestor").alias("subject"), "leaf")
    for leaves in (None, sl):
        a, b = [f(tables.fin_fact, coef, sc, subject_leaves=leaves, plan=plan) for f in (EV.whatif, EV.whatif_by_joins)]
        assert a.dtypes == b.dtypes and a.count() > 0
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_whatif_shuffles_facts_by_key_only(spark, tables):
    sc = spark.createDataFrame([("s", "GrossProfit", "Revenue", 5)], "scenario_id string, target string, subject string, pct int")
    w = EV.whatif(tables.fin_fact, O.coef_df(spark), sc)
    plan = w._jdf.queryExecution().executedPlan().toString()
    before = tables.fin_fact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == before.count("Exchange hashpartitioning")


def test_ratios_by_row_are_ratios_by_joins(spark, tables, monkeypatch):
    coef, defs = O.coef_df(spark), EV.ratio_definitions(O.edges(spark))
    for sums in (False, True):
        a = EV.known_ratios(tables.fin_fact, coef, defs, sums=sums)
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(a) == shuffles(tables.fin_fact)
        monkeypatch.setattr(EV, "PLAN_ROWS", 0)
        b = EV.known_ratios(tables.fin_fact, coef, defs, sums=sums)
        monkeypatch.setattr(EV, "PLAN_ROWS", 20_000)
        r = [df.withColumn("value", F.round("value", 6)) for df in (a, b)]
        assert r[0].count() > 0 and r[0].exceptAll(r[1]).count() == 0 and r[1].exceptAll(r[0]).count() == 0


def test_whatif_calls_no_lambda_for_a_row(spark, tables):
    plan = spark.createDataFrame(O.target_plan_rows(), "target_account string, mode string, unit string, node string, "
                                                       "role string, weight double, scale double")
    sc = spark.createDataFrame([("s", "CostOfSalesRatio", "Revenue", 5)], "scenario_id string, target string, subject string, pct int")
    w = EV.whatif(tables.fin_fact, O.coef_df(spark), sc, plan=plan)
    per_row = w._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    assert "scenario_value" in per_row and "lambda" not in per_row


def test_whatif_shares_of_totals(spark):
    """Totals of several ratios, unmoved ratios in them, zero denominators, nulls as pct and scenarios that come twice."""
    plan = spark.createDataFrame(
        [("T", "ratio", "a", "x", "num", 2.0, 365.0), ("T", "ratio", "a", "y", "den", 2.0, 365.0),
         ("T", "ratio", "b", "z", "num", -1.0, 1.0), ("T", "ratio", "b", "y", "den", -1.0, 1.0)],
        "target_account string, mode string, unit string, node string, role string, weight double, scale double")
    sc = spark.createDataFrame([("x", "T", "x", 100), ("z", "T", "z", -50), ("y", "T", "y", -100), ("n", "T", "x", None),
                                ("v", "z", "z", 3), ("v", "z", "z", 3), ("0", "T", "x", 0), ("o", "T", "v", 7)],
                               "scenario_id string, target string, subject string, pct int")
    coef = spark.createDataFrame([], "ancestor string, leaf string, coef long")
    f = _facts(spark, [("x", 3), ("y", 4), ("z", 10)])
    w = EV.whatif(f, coef, sc, plan=plan)
    base = 2 * 365 * 0.75 - 2.5
    assert sorted((r["scenario_id"], r["baseline"], r["scenario_value"], r["delta"]) for r in w.collect()) == sorted([
        ("x", base, base + 547.5, 547.5), ("z", base, base + 1.25, 1.25), ("0", base, base, 0.0), ("o", base, base, 0.0),
        ("v", 10.0, 10.3, 0.3), ("v", 10.0, 10.3, 0.3)])


def test_round6_is_round(spark):
    x = spark.range(200_000).select(F.explode(F.array(
        (F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.rand(2) * 24 - 12), (F.col("id") - 100_000) / 2e6,
        (F.col("id") * 7919 + 0.5) / 1e6, (F.col("id") + 0.4995) / 1e6, (F.col("id") + 999_999_900_000) / 1e6)).alias("x"))
    x = x.unionByName(spark.sql("SELECT explode(array(double('NaN'), double('Infinity'), -0.0D, NULL, -1e-9D, 1e300D)) AS x"))
    assert x.filter(~EV.round6(F.col("x")).eqNullSafe(F.round("x", 6) + F.lit(0.0))).count() == 0
