"""Relational operators over the fixture views: statement views, point lookups,
data-quality checks, windows, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import quality as DQ
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import (account_columns, fin_fact, fin_fact_wide, fin_filing, fin_raw, sql_with, stored_facts,
                                wide_to_long)
from . import sqlviews  # noqa: F401
from .q_eval import _onto
from .registry import query

K = ["code", "bsns_year", "quarter"]
YEAR_FROM, YEAR_TO = 1996, 2000


def _statement_view(t, statement, years=(YEAR_FROM, YEAR_TO)):
    # a filing is a row of the wide facts, so facts need no second read of the lines to meet their filing
    f = wide_to_long(fin_fact_wide(t, years), K, statement)
    return f.join(t.fin_company, "code").select("code", "name", "bsns_year", "quarter", "account", "value")


def _statement_view_sql(statement):
    return sql_with(["fin_fact", "fin_company", "fin_filing"], f"""
SELECT f.code, c.name, f.bsns_year, f.quarter, f.account, f.value
FROM fin_fact f JOIN fin_company c ON c.code = f.code JOIN fin_filing fs ON fs.code = f.code AND fs.rpid = f.rpid
WHERE f.statement = '{statement}' AND f.bsns_year BETWEEN {YEAR_FROM} AND {YEAR_TO}""")


@query("statement_view_is", _statement_view_sql("IS"))
def statement_view_is(t):
    """JN1/PF5: income statement view = facts ⋈ company ⋈ filing, years as parameters."""
    return _statement_view(t, "IS")


@query("statement_view_bs", _statement_view_sql("BS"))
def statement_view_bs(t):
    """JN1/PF5: balance sheet view."""
    return _statement_view(t, "BS")


@query("point_lookup", sql_with(["fin_fact"],
       "SELECT code, value FROM fin_fact WHERE bsns_year = 1997 AND quarter = '2Q' AND account = 'Revenue'"))
def point_lookup(t):
    """PF4: (year, quarter, account) equality predicate for every company."""
    f = account_columns(t, "Revenue").filter((F.col("bsns_year") == 1997) & (F.col("quarter") == "2Q"))
    return f.filter(F.col("Revenue").isNotNull()).select("code", F.col("Revenue").alias("value"))


@query("scalar_cross_join", sql_with(["fin_fact"], """
SELECT a.code, a.bsns_year, a.quarter, a.value AS revenue, b.value AS cost_of_sales
FROM fin_fact a JOIN fin_fact b ON a.code = b.code AND a.bsns_year = b.bsns_year AND a.quarter = b.quarter
WHERE a.account = 'Revenue' AND b.account = 'CostOfSales'"""))
def scalar_cross_join(t):
    """JN3: two accounts side by side per period (one aggregate instead of two frames joined ON 1=1)."""
    # both are sums of the same filing's lines: one aggregate has them side by side, with no join left to do
    f = account_columns(t, "Revenue", "CostOfSales").filter("Revenue IS NOT NULL AND CostOfSales IS NOT NULL")
    return f.select(*K, F.col("Revenue").alias("revenue"), F.col("CostOfSales").alias("cost_of_sales"))


@query("accounts_without_structural", sql_with(["fin_rollup"],
       "SELECT code, bsns_year, quarter, account, value FROM fin_rollup WHERE n_present = need AND account NOT IN ("
       + ", ".join(f"'{a}'" for a in RV.STRUCTURAL_ACCOUNTS) + ")"))
def accounts_without_structural(t):
    """PF7/SO5: evaluated accounts minus the structural exception list."""
    _, _, coef = _onto(t)
    r = EV.rollup(t.fin_fact, coef)
    return r.filter(~F.col("account").isin(RV.STRUCTURAL_ACCOUNTS)).select(*K, "account", "value")


@query("fk_orphans", sql_with(["fin_fact", "fin_company", "fin_filing"], """
SELECT 'fact_company' AS check_name, COUNT(*) AS n FROM fin_fact f WHERE NOT EXISTS (SELECT 1 FROM fin_company c WHERE c.code = f.code)
UNION ALL SELECT 'fact_filing', COUNT(*) FROM fin_fact f WHERE NOT EXISTS (SELECT 1 FROM fin_filing s WHERE s.code = f.code AND s.rpid = f.rpid)
UNION ALL SELECT 'filing_company', COUNT(*) FROM fin_filing s WHERE NOT EXISTS (SELECT 1 FROM fin_company c WHERE c.code = s.code)
UNION ALL SELECT 'order_customer', COUNT(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'line_order', COUNT(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"""))
def fk_orphans(t):
    """DQ1: foreign keys as left-anti orphan counts."""
    wide = stored_facts(t)
    facts, filings = fin_fact(t, wide), fin_filing(t, wide)
    return DQ.orphan_counts([
        ("fact_company", facts, t.fin_company, ["code"], ["code"]),
        ("fact_filing", facts, filings, ["code", "rpid"], ["code", "rpid"]),
        ("filing_company", filings, t.fin_company, ["code"], ["code"]),
        ("order_customer", t.orders, t.customer, ["o_custkey"], ["c_custkey"]),
        ("line_order", t.lineitem, t.orders, ["l_orderkey"], ["o_orderkey"]),
    ])


@query("unique_violations", sql_with(["fin_company", "fin_filing"], """
SELECT 'company_code' AS check_name, code AS key, COUNT(*) AS n FROM fin_company GROUP BY code HAVING COUNT(*) > 1
UNION ALL SELECT 'filing_rpid', rpid, COUNT(*) FROM fin_filing GROUP BY rpid HAVING COUNT(*) > 1
UNION ALL SELECT 'line_order_linenumber', CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), COUNT(*)
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""))
def unique_violations(t):
    """DQ2: UNIQUE constraints as grouped counts > 1 (the line key is not unique in the data)."""
    li = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                       F.col("l_linenumber").cast("string")).alias("key"))
    return DQ.duplicate_keys([
        ("company_code", t.fin_company.select(F.col("code").alias("key"))),
        ("filing_rpid", t.fin_filing.select(F.col("rpid").alias("key"))),
        ("line_order_linenumber", li),
    ])


_NOT_NULL = {
    "customer": ["c_custkey", "c_name", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
    "lineitem": ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"],
}


@query("null_violations", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null FROM {tb}"
    for tb, cols in _NOT_NULL.items() for c in cols))
def null_violations(t):
    """DQ3: NOT NULL on business columns — one pass per table, one sum per column."""
    return DQ.null_counts({tb: t.table(tb) for tb in _NOT_NULL}, _NOT_NULL)


@query("cascade_delete_preview", sql_with(["fin_company", "fin_filing", "fin_fact"], """
SELECT 'company' AS table_name, COUNT(*) AS n FROM fin_company WHERE sector = 'HOUSEHOLD'
UNION ALL SELECT 'filing', COUNT(*) FROM fin_filing WHERE code IN (SELECT code FROM fin_company WHERE sector = 'HOUSEHOLD')
UNION ALL SELECT 'fact', COUNT(*) FROM fin_fact WHERE code IN (SELECT code FROM fin_company WHERE sector = 'HOUSEHOLD')"""))
def cascade_delete_preview(t):
    """DQ4: what an ON DELETE CASCADE of one sector would remove (semi joins on the delete set)."""
    gone = t.fin_company.filter(F.col("sector") == "HOUSEHOLD").select("code")
    return DQ.cascade_counts(gone, [("company", t.fin_company), ("filing", t.fin_filing), ("fact", t.fin_fact)], "code")


@query("domain_violations", sql_with(["fin_company", "fin_filing", "fin_fact", "fin_raw"], """
SELECT 'code_len_10' AS check_name, COUNT(*) AS n FROM fin_company WHERE length(code) > 10
UNION ALL SELECT 'name_len_18', COUNT(*) FROM fin_company WHERE length(name) > 18
UNION ALL SELECT 'rpid_len_30', COUNT(*) FROM fin_filing WHERE length(rpid) > 30
UNION ALL SELECT 'rpid_len_12', COUNT(*) FROM fin_filing WHERE length(rpid) > 12
UNION ALL SELECT 'account_len_255', COUNT(*) FROM fin_fact WHERE length(account) > 255
UNION ALL SELECT 'value_negative', COUNT(*) FROM fin_fact WHERE value < 0
UNION ALL SELECT 'amount_bigint', COUNT(*) FROM fin_raw WHERE thstrm_amount IS NOT NULL AND TRY_CAST(thstrm_amount AS BIGINT) IS NULL
UNION ALL SELECT 'amount_1e7_bigint', COUNT(*) FROM fin_raw WHERE thstrm_amount IS NOT NULL AND TRY_CAST(thstrm_amount || '0000000' AS BIGINT) IS NULL"""))
def domain_violations(t):
    """DQ5: length limits, value domain and BIGINT range as counts, one pass per table.

    Amounts are checked as filed and with seven more digits, where large ones leave BIGINT.
    """
    wide = stored_facts(t)
    company, filing, fact, raw = t.fin_company, fin_filing(t, wide), fin_fact(t, wide), fin_raw(t, wide)
    return DQ.predicate_counts([
        ("code_len_10", company, F.length("code") > 10),
        ("name_len_18", company, F.length("name") > 18),
        ("rpid_len_30", filing, F.length("rpid") > 30),
        ("rpid_len_12", filing, F.length("rpid") > 12),
        ("account_len_255", fact, F.length("account") > 255),
        ("value_negative", fact, F.col("value") < 0),
        ("amount_bigint", raw, DQ.outside_bigint(F.col("thstrm_amount"))),
        ("amount_1e7_bigint", raw, DQ.outside_bigint(F.concat("thstrm_amount", F.lit("0000000")))),
    ])


@query("balance_check", sql_with(["fin_rollup"], """
SELECT COALESCE(a.code, l.code) AS code, COALESCE(a.bsns_year, l.bsns_year) AS bsns_year,
       COALESCE(a.quarter, l.quarter) AS quarter, a.value AS assets, l.value AS liabilities_equities,
       COALESCE(a.value, 0) - COALESCE(l.value, 0) AS diff
FROM (SELECT * FROM fin_rollup WHERE account = 'AssetsAbstract') a
FULL OUTER JOIN (SELECT * FROM fin_rollup WHERE account = 'LiabilitiesAndEquities') l
  ON a.code = l.code AND a.bsns_year = l.bsns_year AND a.quarter = l.quarter
WHERE COALESCE(a.value, 0) - COALESCE(l.value, 0) <> 0"""))
def balance_check(t):
    """DQ6: accounting identity Assets = Liabilities + Equities on (partial) rollups; rows that break it."""
    _, _, coef = _onto(t)
    r = EV.rollup(t.fin_fact, coef, complete_only=False)
    return DQ.identity_check(r, "AssetsAbstract", "LiabilitiesAndEquities", K, "assets", "liabilities_equities")


@query("rollup_vs_stored", sql_with(["fin_rollup", "fin_fact_wide"], """
SELECT r.code, r.bsns_year, r.quarter, r.value AS recomputed, s.stored, r.value - s.stored AS diff
FROM (SELECT * FROM fin_rollup WHERE account = 'GrossProfit' AND n_present = need) r
JOIN (SELECT code, bsns_year, quarter, Revenue - CostOfSales AS stored FROM fin_fact_wide
      WHERE Revenue IS NOT NULL AND CostOfSales IS NOT NULL) s
  ON s.code = r.code AND s.bsns_year = r.bsns_year AND s.quarter = r.quarter"""))
def rollup_vs_stored(t):
    """DQ7: a stored subtotal (gross profit kept on the filing) against the recomputed rollup."""
    _, _, coef = _onto(t)
    r = EV.rollup(t.fin_fact, coef).filter(F.col("account") == "GrossProfit").select(*K, F.col("value").alias("recomputed"))
    s = t.fin_fact_wide.filter(F.col("Revenue").isNotNull() & F.col("CostOfSales").isNotNull()).select(
        *K, (F.col("Revenue") - F.col("CostOfSales")).alias("stored"))
    return r.join(s, K).select(*K, "recomputed", "stored", (F.col("recomputed") - F.col("stored")).alias("diff"))


@query("series_lag", sql_with(["fin_nation_fact"], """
SELECT code, account, bsns_year, quarter, value AS current,
       LAG(value) OVER (PARTITION BY code, account ORDER BY bsns_year, quarter) AS previous
FROM fin_nation_fact"""))
def series_lag(t):
    """WN1: previous-quarter value per (series, account)."""
    w = Window.partitionBy("code", "account").orderBy("bsns_year", "quarter")
    f = t.fin_nation_fact
    return f.select("code", "account", "bsns_year", "quarter", F.col("value").alias("current"),
                    F.lag("value").over(w).alias("previous"))


@query("dialog_turn_state", """
SELECT conv_id, turn, role,
       ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no,
       LAST_VALUE(CASE WHEN role = 'user' THEN CASE WHEN strpos(text, '?') > 0 THEN 'question' ELSE 'statement' END END
                  IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS carried_intent
FROM conversations""")
def dialog_turn_state(t):
    """WN5: per-conversation turn counter and the last user intent carried forward."""
    from ..operators import dialog as DL
    return DL.turn_state(t.conversations)


@query("accounts_by_level", sql_with(["fin_fact", "onto_nodes"], """
SELECT f.code, f.bsns_year, f.quarter, f.account, n.level, f.value
FROM fin_fact f JOIN onto_nodes n ON n.acc = f.account ORDER BY n.level, f.account, f.code, f.bsns_year, f.quarter"""))
def accounts_by_level(t):
    """ST1: facts ordered by account level (global sort = range partitioning, no single task)."""
    n = O.nodes(t.spark).select(F.col("acc").alias("account"), "level")
    return t.fin_fact.join(F.broadcast(n), "account").select(*K, "account", "level", "value") \
        .orderBy("level", "account", "code", "bsns_year", "quarter")


_H = "(((doc_id % 1000003) * 7919 + 13) % 1000003)"


@query("sample_one_per_key", f"""
SELECT source, doc_id FROM (
  SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS rn FROM documents) x
WHERE rn = 1""")
def sample_one_per_key(t):
    """ST6: deterministic pseudo-random pick of one row per key (min of an integer hash; an aggregate, so skew-safe)."""
    d = t.documents.select("source", "doc_id")
    h = F.expr(_H)
    return d.groupBy("source").agg(F.min(F.struct(h.alias("h"), F.col("doc_id"))).alias("m")).select(
        "source", F.col("m.doc_id").alias("doc_id"))


@query("latest_period", sql_with(["fin_fact"], """
SELECT code, arg_max(bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER), bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS period_key,
       arg_max(value, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS value
FROM fin_fact WHERE account = 'Revenue' GROUP BY code"""))
def latest_period(t):
    """ST7: the latest period per company (max_by, an aggregate rather than a sort)."""
    f = account_columns(t, "Revenue").filter("Revenue IS NOT NULL").withColumnRenamed("Revenue", "value")
    pk = F.col("bsns_year") * 10 + F.substring("quarter", 1, 1).cast("int")
    return f.groupBy("code").agg(F.max(pk).alias("period_key"), F.max_by("value", pk).alias("value"))


@query("master_vs_graph_diff", sql_with(["fin_fact", "onto_nodes"], """
SELECT 'fact_not_in_graph' AS side, account AS acc FROM (SELECT DISTINCT account FROM fin_fact) f
WHERE account NOT IN (SELECT acc FROM onto_nodes)
UNION ALL
SELECT 'graph_not_in_facts', acc FROM onto_nodes WHERE acc NOT IN (SELECT DISTINCT account FROM fin_fact)"""))
def master_vs_graph_diff(t):
    """SO5: symmetric difference of the accounts in the facts and in the ontology."""
    fa = t.fin_fact.select(F.col("account").alias("acc")).distinct()
    n = O.nodes(t.spark).select("acc")
    a = fa.join(F.broadcast(n), "acc", "left_anti").select(F.lit("fact_not_in_graph").alias("side"), "acc")
    b = n.join(fa, "acc", "left_anti").select(F.lit("graph_not_in_facts").alias("side"), "acc")
    return a.unionByName(b)


@query("facts_rollup_cube", sql_with(["fin_fact"], """
SELECT statement, bsns_year, quarter, CAST(SUM(value) AS DECIMAL(38, 0)) AS total, COUNT(*) AS n,
       CAST(GROUPING(statement) * 4 + GROUPING(bsns_year) * 2 + GROUPING(quarter) AS INTEGER) AS grouping_id
FROM fin_fact GROUP BY CUBE (statement, bsns_year, quarter)"""))
def facts_rollup_cube(t):
    """Statement × year × quarter totals with every subtotal (one CUBE aggregate); totals of all companies pass BIGINT."""
    f = t.fin_fact.withColumn("value", F.col("value").cast("decimal(19, 0)"))
    return f.cube("statement", "bsns_year", "quarter").agg(
        F.sum("value").cast("decimal(38, 0)").alias("total"), F.count(F.lit(1)).alias("n"),
        F.grouping_id("statement", "bsns_year", "quarter").cast("int").alias("grouping_id"))
