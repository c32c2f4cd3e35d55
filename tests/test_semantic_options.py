"""Options of the semantics: last filing of a line, whole years, availability of reports."""

import datetime as dt

from pyspark.sql import functions as F

from ledgergraph.operators import dialog as DL
from ledgergraph.operators import evaluate as EV
from ledgergraph.operators import quality as DQ


def test_last_filed_ties_nulls_and_empty(spark):
    rows = [("a", "x", "1", "10"), ("a", "x", "1-2", "9"), ("a", "x", "1-3", None), ("b", "x", "7", "5"), ("b", "x", "7", "6"),
            (None, "x", "1", "1"), (None, "x", "2", "2"), ("c", None, None, "3")]
    df = spark.createDataFrame(rows, "corp string, account string, receipt string, amount string")
    got = {(r["corp"], r["account"]): (r["receipt"], r["amount"], r["n_filed"])
           for r in DQ.last_filed(df, ["corp", "account"], "receipt", ["amount"]).collect()}
    assert got == {("a", "x"): ("1-3", None, 3), ("b", "x"): ("7", "6", 2), (None, "x"): ("2", "2", 2), ("c", None): (None, "3", 1)}
    assert DQ.last_filed(df.limit(0), ["corp"], "receipt", ["amount"]).isEmpty()


def test_a_year_sums_income_and_closes_balances(spark):
    f = spark.createDataFrame([("a", 1999, "1Q", "IS", "Revenue", 5), ("a", 1999, "3Q", "IS", "Revenue", 7),
                               ("a", 1999, "1Q", "BS", "Inventories", 100), ("a", 1999, "2Q", "BS", "Inventories", 40),
                               ("a", 2000, "4Q", "BS", "Inventories", 1)],
                              "code string, bsns_year int, quarter string, statement string, account string, value long")
    got = {(r["bsns_year"], r["account"]): (r["quarter"], r["value"]) for r in EV.yearly_facts(f).collect()}
    assert got == {(1999, "Revenue"): ("ALL", 12), (1999, "Inventories"): ("ALL", 40), (2000, "Inventories"): ("ALL", 1)}


def test_availability(spark):
    rows = [(dt.date(2020, m, 15), "last year", "PAST", None) for m in (1, 3, 4)] + [(dt.date(2020, 4, 15), "next year", "FUTURE", None)]
    df = spark.createDataFrame(rows, "as_of date, phrase string, yd string, qd string")

    def years(availability):
        out = DL.resolve_time(df, "phrase", "as_of", "yd", "qd", availability).collect()
        return {(r["as_of"].month, r["phrase"]): (r["t_year"], r["t_warning"] is not None) for r in out}
    assert years("reference") == {(1, "last year"): (2018, True), (3, "last year"): (2019, False), (4, "last year"): (2018, True),
                                  (4, "next year"): (2021, False)}
    assert years("intended") == {(1, "last year"): (2019, False), (3, "last year"): (2019, False), (4, "last year"): (2019, False),
                                 (4, "next year"): (2021, False)}


def test_whole_year_is_the_quarters_together(spark, tables):
    import __spark_entry__ as E
    out = E.queries()["qa_whole_year"](spark, tables.sf_dir)
    rows = out.filter("intent = 'PAST.value' AND target_account = 'Revenue' AND quarter = 'ALL' AND baseline IS NOT NULL") \
        .select("question_id", "year", "baseline").collect()
    assert rows
    total = {(r["code"], r["bsns_year"]): r["v"] for r in tables.fin_fact.filter("account = 'Revenue'").groupBy("code", "bsns_year")
             .agg(F.sum("value").alias("v")).collect()}
    for r in rows:
        assert r["baseline"] == total[r["question_id"].split("-")[0], r["year"]]
