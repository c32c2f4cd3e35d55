"""Sources, sinks and raw filing line handling (SRC*, SNK*, PF1-PF3, JN2, SC1, AG2-AG3)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import keys as KY
from ..operators import quality as DQ
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources import io as IO
from ..sources.fixtures import LEAF_ACCOUNTS, fin_fact, sql_with, stored_facts, term_label
from .registry import query

FILING = ["corp", "bsns_year", "reprt_code"]


@query("bs_lines", sql_with(["fin_raw"],
       "SELECT rcept_no, corp, bsns_year, reprt_code, account_nm, thstrm_amount FROM fin_raw WHERE sj_div = 'BS'"))
def bs_lines(t):
    """PF1: balance-sheet lines (filter + projection, pruned at the scan)."""
    return t.fin_raw.filter(F.col("sj_div") == "BS").select("rcept_no", "corp", "bsns_year", "reprt_code",
                                                           "account_nm", "thstrm_amount")


@query("is_or_cis_fallback", sql_with(["fin_raw"], """
SELECT rcept_no, corp, bsns_year, reprt_code, sj_div, account_nm, thstrm_amount FROM (
  SELECT r.*, MAX(CASE WHEN sj_div = 'IS' THEN 1 ELSE 0 END) OVER (PARTITION BY corp, bsns_year, reprt_code) AS has_is
  FROM fin_raw r WHERE sj_div IN ('IS', 'CIS')) x
WHERE sj_div = CASE WHEN has_is = 1 THEN 'IS' ELSE 'CIS' END"""))
def is_or_cis_fallback(t):
    """PF2: income statement routing — IS lines when the filing has any, else CIS lines."""
    r = t.fin_raw.filter(F.col("sj_div").isin("IS", "CIS"))
    w = Window.partitionBy(*FILING)
    r = r.withColumn("has_is", F.max(F.when(F.col("sj_div") == "IS", 1).otherwise(0)).over(w))
    return r.filter(F.col("sj_div") == F.when(F.col("has_is") == 1, "IS").otherwise("CIS")).select(
        "rcept_no", "corp", "bsns_year", "reprt_code", "sj_div", "account_nm", "thstrm_amount")


@query("filing_has_is", sql_with(["fin_raw"],
       "SELECT corp, bsns_year, reprt_code, bool_or(sj_div = 'IS') AS has_is FROM fin_raw GROUP BY 1, 2, 3"))
def filing_has_is(t):
    """AG2: any/exists aggregate per filing."""
    return t.fin_raw.groupBy(*FILING).agg(F.bool_or(F.col("sj_div") == "IS").alias("has_is"))


@query("filing_header", sql_with(["fin_raw"],
       "SELECT corp, bsns_year, reprt_code, MIN(rcept_no) AS rcept_no, COUNT(*) AS n_lines FROM fin_raw GROUP BY 1, 2, 3"))
def filing_header(t):
    """AG3: one header per filing — deterministic first receipt number."""
    return t.fin_raw.groupBy(*FILING).agg(F.min("rcept_no").alias("rcept_no"), F.count(F.lit(1)).alias("n_lines"))


def _labels_sql() -> str:
    rows = []
    for code, word, q in RV.REPORT_CODES:
        rows.append(f"SELECT y.bsns_year, '{code}' AS reprt_code, y.base || '{word}' AS label, '{q}' AS quarter FROM y")
        if code != "11011":
            rows.append(f"SELECT y.bsns_year, '{code}', y.base || '{word}{RV.PERIOD_LABEL_END}', '{q}' FROM y")
    return " UNION ALL ".join(rows)


@query("period_label_to_quarter", sql_with(["fin_raw"], f"""
SELECT r.rcept_no, r.sj_div, r.account_nm, r.thstrm_nm, lb.quarter
FROM fin_raw r LEFT JOIN (
  WITH y AS (SELECT DISTINCT bsns_year, '{RV.PERIOD_LABEL_PREFIX}' || CAST({RV.TERM_BASE_NUMBER} + (bsns_year - {RV.TERM_BASE_YEAR}) AS VARCHAR) || '{RV.PERIOD_LABEL_SUFFIX}' AS base FROM fin_raw)
  {_labels_sql()}) lb
ON lb.bsns_year = r.bsns_year AND lb.reprt_code = r.reprt_code AND lb.label = r.thstrm_nm"""))
def period_label_to_quarter(t):
    """SC1: period label -> quarter per report code, an expression over the filing's own year (NULL on no match)."""
    label, quarter = F.col("thstrm_nm"), None
    for code, word, q in RV.REPORT_CODES:
        full = F.concat(term_label(F.col("bsns_year")), F.lit(word))
        fits = (label == full) if code == "11011" else label.isin(full, F.concat(full, F.lit(RV.PERIOD_LABEL_END)))
        quarter = (F if quarter is None else quarter).when((F.col("reprt_code") == code) & fits, F.lit(q))
    return t.fin_raw.select("rcept_no", "sj_div", "account_nm", "thstrm_nm", quarter.alias("quarter"))


def _name_map(t):
    m = O.master_raw(t.spark).select(F.col("name_local").alias("account_nm"), F.col("acc"),
                                     F.monotonically_increasing_id().alias("pos"))
    # duplicate names: the last one wins (dictionary assignment order)
    w = Window.partitionBy("account_nm").orderBy(F.desc("pos"))
    return m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("account_nm", "acc")


@query("map_accounts_left", sql_with(["fin_raw", "onto_master"],
       "SELECT r.rcept_no, r.sj_div, r.account_nm, m.acc FROM fin_raw r LEFT JOIN onto_master m ON m.name_local = r.account_nm"))
def map_accounts_left(t):
    """JN2: local account name -> account id, NULL on miss (broadcast dictionary join)."""
    r = t.fin_raw.select("rcept_no", "sj_div", "account_nm")
    return r.join(F.broadcast(_name_map(t)), "account_nm", "left").select("rcept_no", "sj_div", "account_nm", "acc")


@query("map_accounts_inner", sql_with(["fin_raw", "onto_master"],
       "SELECT r.rcept_no, r.sj_div, m.acc AS account, CAST(r.thstrm_amount AS BIGINT) AS value "
       "FROM fin_raw r JOIN onto_master m ON m.name_local = r.account_nm"))
def map_accounts_inner(t):
    """PF3: drop lines whose account did not map (inner join), typed amounts."""
    r = t.fin_raw
    j = r.join(F.broadcast(_name_map(t)), "account_nm")
    return j.select("rcept_no", "sj_div", F.col("acc").alias("account"),
                    F.col("thstrm_amount").cast("bigint").alias("value"))


@query("union_statements", sql_with(["fin_raw"],
       "SELECT rcept_no, sj_div, account_nm, thstrm_amount FROM fin_raw WHERE sj_div = 'BS' "
       "UNION ALL SELECT rcept_no, sj_div, account_nm, thstrm_amount FROM fin_raw WHERE sj_div IN ('IS', 'CIS')"))
def union_statements(t):
    """SO1: concatenate statement frames by name (unionByName)."""
    r = t.fin_raw.select("rcept_no", "sj_div", "account_nm", "thstrm_amount")
    return r.filter(F.col("sj_div") == "BS").unionByName(r.filter(F.col("sj_div").isin("IS", "CIS")))


@query("filing_grid_coverage", sql_with(["fin_filing"], """
SELECT CAST(c.c_custkey AS VARCHAR) AS code, g.bsns_year, g.quarter, (f.code IS NOT NULL) AS landed
FROM customer c
JOIN (SELECT DISTINCT bsns_year, quarter FROM fin_filing) g ON TRUE
LEFT JOIN fin_filing f ON f.code = CAST(c.c_custkey AS VARCHAR) AND f.bsns_year = g.bsns_year AND f.quarter = g.quarter"""))
def filing_grid_coverage(t):
    """SRC7: request grid (company × period) against the filings that landed; missing ones flagged.

    The period list is bounded (years × 4), so it is collected into an array
    literal-free ``explode`` per company rather than a cross join.
    """
    periods = t.fin_filing.select("bsns_year", "quarter").distinct()
    parr = periods.agg(F.array_sort(F.collect_list(F.struct("bsns_year", "quarter"))).alias("p"))
    comp = t.customer.select(F.col("c_custkey").cast("string").alias("code"))
    grid = comp.join(F.broadcast(parr), how="inner").select("code", F.explode("p").alias("p")).select(
        "code", "p.bsns_year", "p.quarter")
    f = t.fin_filing.select("code", "bsns_year", "quarter", F.lit(True).alias("landed"))
    return grid.join(f, ["code", "bsns_year", "quarter"], "left").select(
        "code", "bsns_year", "quarter", F.coalesce("landed", F.lit(False)).alias("landed"))


@query("listing_clean", """
SELECT CAST(c_custkey AS VARCHAR) AS code, COALESCE(c_name, '') AS name, c_mktsegment AS sector
FROM customer WHERE c_mktsegment IS NOT NULL""")
def listing_clean(t):
    """SRC8: keep listings with a sector, fill the remaining nulls with ''."""
    c = t.customer.filter(F.col("c_mktsegment").isNotNull())
    return c.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("sector")).fillna("", subset=["name"])


@query("scan_account_master", sql_with(["fin_fact", "onto_master"], """
SELECT f.code, f.bsns_year, f.quarter, f.account, m.name_eng, split_part(m.grp, '-', 1) AS statement,
       split_part(m.grp, '-', 2) AS kind, CAST(split_part(m.grp, '-', 3) AS INTEGER) AS level, f.value
FROM fin_fact f JOIN onto_master m ON m.acc = f.account"""))
def scan_account_master(t):
    """SRC1: decode the master's group code (statement-kind-level) and attach it to the facts."""
    m = O.decode_master(O.master_raw(t.spark))
    f = t.fin_fact
    return f.join(F.broadcast(m), f.account == m.acc).select(
        "code", "bsns_year", "quarter", "account", "name_eng", m.statement, "kind", "level", "value")


@query("scan_series", sql_with(["fin_nation_fact"],
       "SELECT code, CAST(bsns_year AS VARCHAR) || '-' || quarter AS date, value AS actual "
       "FROM fin_nation_fact WHERE account = 'Revenue'"))
def scan_series(t):
    """SRC4: quarterly series indexed by 'YYYY-nQ' with the value renamed to ``actual``."""
    f = t.fin_nation_wide.filter(F.col("Revenue").isNotNull())
    return f.select("code", F.concat_ws("-", F.col("bsns_year").cast("string"), "quarter").alias("date"),
                    F.col("Revenue").alias("actual"))


@query("company_insert_ids", """
SELECT ROW_NUMBER() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS c_id, CAST(c_custkey AS VARCHAR) AS code,
       c_name AS name, c_mktsegment AS sector FROM customer""")
def company_insert_ids(t):
    """SNK2/WN2: dense surrogate ids 1..N in natural-key order, without a single-partition window."""
    return KY.dense_surrogate_key(t.fin_company, ["code"], "c_id").select("c_id", "code", "name", "sector")


@query("facts_surrogate_key", sql_with(["fin_fact"], """
SELECT ROW_NUMBER() OVER (ORDER BY code, bsns_year, quarter, account) AS fact_id, code, rpid, bsns_year, quarter,
       account, value FROM fin_fact"""))
def facts_surrogate_key(t):
    """SNK3/WN2: dense surrogate key over the facts (range-partitioned sort + per-partition offsets)."""
    f = t.fin_fact.select("code", "rpid", "bsns_year", "quarter", "account", "value")
    return KY.dense_surrogate_key(f, ["code", "bsns_year", "quarter", "account"], "fact_id")


@query("sink_roundtrip_facts", sql_with(["fin_fact"], "SELECT * FROM fin_fact"))
def sink_roundtrip_facts(t):
    """SNK1/SNK3: write the facts partitioned by year into the shared folder and read them back."""
    return IO.roundtrip_partitioned(t.fin_fact, "bsns_year")


def catalog_tables(t, buckets: int | None = None):
    """(facts, companies) as catalog tables bucketed by company; facts also partitioned by year.  Loading again is the same.

    ``buckets`` goes by the number of facts if it is not given, and then is part of the tables' name: tables that grew are
    dealt anew.  An order adds at most one filing, which bounds the facts without a pass over them.
    """
    name = t.sf_dir
    if buckets is None:
        buckets = IO.buckets_for(t.orders.count() * len(LEAF_ACCOUNTS))
        name += f"#{buckets}"
    key = uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:12]
    out = []
    for name, df, part in (("fact", t.fin_fact, "bsns_year"), ("company", t.fin_company, None)):
        table = f"lg_{name}_{key}"
        IO.create_table(t.spark, table, df, "code", buckets, part)
        out.append(IO.load_table(t.spark, table, df, "code", buckets))
    return tuple(out)


@query("catalog_facts_join", sql_with(["fin_fact", "fin_company"], """
SELECT f.code, c.name, c.sector, COUNT(*) AS n_facts, CAST(SUM(f.value) AS BIGINT) AS total FROM fin_fact f
JOIN fin_company c ON c.code = f.code GROUP BY f.code, c.name, c.sector"""))
def catalog_facts_join(t):
    """SNK1: facts and companies as bucketed catalog tables; their join and the aggregate by company need no exchange."""
    f, c = catalog_tables(t)
    j = f.hint("merge").join(c, "code")
    return j.groupBy("code", "name", "sector").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("value").alias("total"))


def _in_loads(t, df, first, keys, name):
    """A first load of a part, a second of everything, and the second again; ids as the registry has them."""
    path = IO.scratch_path(t.spark, "registry")
    KY.append_keys(df.filter(first), keys, path, name)
    KY.append_keys(df, keys, path, name)
    return KY.append_keys(df, keys, path, name)


@query("company_append_ids", sql_with(["fin_company"], """
SELECT ROW_NUMBER() OVER (ORDER BY CASE WHEN sector < 'F' THEN 0 ELSE 1 END, code) AS c_id, code, name, sector FROM fin_company"""))
def company_append_ids(t):
    """SNK2: companies loaded in two batches and once more: the second continues the numbering, the repeat adds nothing."""
    return _in_loads(t, t.fin_company, F.col("sector") < "F", ["code"], "c_id").select("c_id", "code", "name", "sector")


@query("facts_append_ids", sql_with(["fin_fact"], """
SELECT ROW_NUMBER() OVER (ORDER BY CASE WHEN bsns_year <= 1995 THEN 0 ELSE 1 END, code, bsns_year, quarter, account) AS fact_id,
       code, bsns_year, quarter, account, value FROM fin_fact"""))
def facts_append_ids(t):
    """SNK3: facts loaded up to a year, then all, then again; the ids are those of the loads in order."""
    f = fin_fact(t, stored_facts(t)).select("code", "bsns_year", "quarter", "account", "value")  # read by every load
    out = _in_loads(t, f, F.col("bsns_year") <= 1995, ["code", "bsns_year", "quarter", "account"], "fact_id")
    return out.select("fact_id", "code", "bsns_year", "quarter", "account", "value")


@query("exists_flag", sql_with(["fin_fact"], """
SELECT 'fin_fact' AS name, COUNT(*) > 0 AS present FROM fin_fact
UNION ALL SELECT 'lineitem', COUNT(*) > 0 FROM lineitem"""))
def exists_flag(t):
    """AG5: existence of rows of a named object; one row is enough, so a plain table ends with its first row."""
    def one(name, df):
        return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("present")).select(F.lit(name).alias("name"), "present")
    return one("fin_fact", t.fin_fact).unionByName(one("lineitem", t.lineitem))


_AMENDED_SQL = """
SELECT rcept_no, corp, bsns_year, reprt_code, sj_div, account_nm, thstrm_amount FROM fin_raw
UNION ALL SELECT rcept_no || '-2', corp, bsns_year, reprt_code, sj_div, account_nm, CAST(CAST(thstrm_amount AS BIGINT) - 5 AS VARCHAR)
FROM fin_raw WHERE sj_div <> 'BS' AND CAST(corp AS BIGINT) % 3 = 0
UNION ALL SELECT rcept_no || '-3', corp, bsns_year, reprt_code, sj_div, account_nm, CAST(CAST(thstrm_amount AS BIGINT) + 7 AS VARCHAR)
FROM fin_raw WHERE sj_div <> 'IS' AND CAST(corp AS BIGINT) % 6 = 0"""


@query("facts_last_filing", sql_with(["fin_raw"], f"""
SELECT corp, bsns_year, reprt_code, sj_div, account_nm, rcept_no, thstrm_amount, n_filed FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY corp, bsns_year, reprt_code, sj_div, account_nm
                               ORDER BY rcept_no DESC, thstrm_amount DESC) AS r,
         COUNT(*) OVER (PARTITION BY corp, bsns_year, reprt_code, sj_div, account_nm) AS n_filed FROM ({_AMENDED_SQL}) a) x
WHERE r = 1"""))
def facts_last_filing(t):
    """Q8/DQ2: filings amended once or twice, in part; each line as last filed, with how often it was."""
    raw, corp = t.fin_raw, F.col("corp").cast("bigint")

    def amended(n, where, change):
        return raw.filter(where).withColumns({"rcept_no": F.concat("rcept_no", F.lit(f"-{n}")), "thstrm_amount": (
            F.col("thstrm_amount").cast("bigint") + change).cast("string")})
    lines = raw.unionByName(amended(2, (F.col("sj_div") != "BS") & (corp % 3 == 0), -5)) \
        .unionByName(amended(3, (F.col("sj_div") != "IS") & (corp % 6 == 0), 7))
    return DQ.last_filed(lines, [*FILING, "sj_div", "account_nm"], "rcept_no", ["thstrm_amount"])
