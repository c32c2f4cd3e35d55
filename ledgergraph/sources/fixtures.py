"""Driver tables and the financial fixture views derived from them.

The driver's TPC-H-like tables carry no statements, so company statements are
derived: a company is a customer, a filing is (customer, year, quarter) and
each leaf account is a conditional sum over its order lines.  All money is
BIGINT in 1e-4 units so that sums are exact and independent of order.

Each view exists twice: a Spark builder (used by the library) and SQL text
(used only by the DuckDB oracles), kept side by side so they stay in step.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# (account, statement) of the derived leaf accounts, in output order.
LEAF_ACCOUNTS = [
    ("Revenue", "IS"),
    ("CostOfSales", "IS"),
    ("SellingGeneralAdministrativeExpenses", "IS"),
    ("FinanceIncome", "IS"),
    ("FinancialExpenses", "IS"),
    ("IncomeTaxExpense", "IS"),
    ("TradeAndOtherCurrentReceivables", "BS"),
    ("Inventories", "BS"),
    ("AdvancesCustomers", "BS"),
]


class Tables:
    """Lazy accessors for the driver's parquet tables under ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self.memo: dict[str, DataFrame] = {}

    def derived(self, name: str, build, checkpoint: bool = False) -> DataFrame:
        """Memoise a derived DataFrame so one query plan reuses the same subtree.

        ``checkpoint=True`` materialises it into ``spark.checkpoint.dir`` (``session.stored``):
        the lineage (and the plan later stages analyse) is cut, and a lost
        executor recomputes from what is stored instead of from the sources.
        """
        if name not in self.memo:
            from ..session import stored
            df = build()
            self.memo[name] = stored(df) if checkpoint else df
        return self.memo[name]

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    # -- derived views (memoised per Tables object so one plan reuses them) --
    @cached_property
    def fin_company(self) -> DataFrame:
        return fin_company(self)

    @cached_property
    def fin_fact_wide(self) -> DataFrame:
        return fin_fact_wide(self)

    @cached_property
    def fin_fact(self) -> DataFrame:
        return fin_fact(self)

    @cached_property
    def fin_filing(self) -> DataFrame:
        return fin_filing(self)

    @cached_property
    def fin_nation_wide(self) -> DataFrame:
        return fin_nation_wide(self)

    @cached_property
    def fin_nation_fact(self) -> DataFrame:
        return fin_nation_fact(self)

    @cached_property
    def fin_raw(self) -> DataFrame:
        return fin_raw(self)


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def period_cols(ts: Column) -> tuple[Column, Column]:
    return F.year(ts).cast("int"), F.concat(F.quarter(ts).cast("string"), F.lit("Q"))


def rpid_col(code: Column, year: Column, quarter: Column) -> Column:
    return F.concat_ws("-", code, year.cast("string"), quarter)


def fin_company(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("sector"))


def line_amounts(t: Tables) -> DataFrame:
    """Per order line: the nine leaf contributions (BIGINT, unit 1e-4)."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                           "l_returnflag", "l_linestatus")
    part = t.part.select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey)
    p = cents(F.col("l_extendedprice"))
    d = cents(F.col("l_discount"))
    tx = cents(F.col("l_tax"))
    q = F.round(F.col("l_quantity")).cast("bigint")
    cost = q * cents(F.col("p_retailprice")) * 100
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return j.select(
        "l_orderkey",
        (p * 100).alias("Revenue"),
        cost.alias("CostOfSales"),
        (p * d).alias("SellingGeneralAdministrativeExpenses"),
        F.when(flag == "A", p * tx).alias("FinanceIncome"),
        F.when(flag == "R", p * tx).alias("FinancialExpenses"),
        (p * tx).alias("IncomeTaxExpense"),
        F.when(status == "O", p * 100).alias("TradeAndOtherCurrentReceivables"),
        F.when(flag == "N", cost).alias("Inventories"),
        F.when(status == "F", p * 100).alias("AdvancesCustomers"),
    )


def _sum_leaves() -> list[Column]:
    return [F.sum(a).alias(a) for a, _ in LEAF_ACCOUNTS]


def fin_fact_wide(t: Tables, years: tuple[int, int] | None = None) -> DataFrame:
    """(code, bsns_year, quarter, <nine leaf sums>) — one row per filing.

    Lines are summed per order first: the partial aggregate is hash-partitioned
    on the order key, so the join with ``orders`` shuffles only ``orders`` and
    the big side crosses the network once as partial sums (≈4 lines/order).
    ``years`` (first and last) is a range of order dates at the scan of ``orders``;
    over a large ``lineitem`` Spark then adds its runtime filter on the order key.
    """
    per_order = line_amounts(t).groupBy("l_orderkey").agg(*_sum_leaves())
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    if years:
        first, end = (F.lit(f"{y}-01-01").cast(o.schema["o_orderdate"].dataType) for y in (years[0], years[1] + 1))
        o = o.filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))
    year, quarter = period_cols(F.col("o_orderdate"))
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_custkey").cast("string").alias("code"), year.alias("bsns_year"),
                      quarter.alias("quarter"))
            .agg(*_sum_leaves()))


def wide_to_long(wide: DataFrame, keys: list[str], statement: str | None = None) -> DataFrame:
    """One row per account that has a value; of one ``statement`` only, the other sums are never computed."""
    accounts = [(a, s) for a, s in LEAF_ACCOUNTS if statement in (None, s)]
    stack = ", ".join(f"'{a}', '{s}', `{a}`" for a, s in accounts)
    long = wide.selectExpr(*keys, f"stack({len(accounts)}, {stack}) AS (account, statement, value)")
    return long.filter(F.col("value").isNotNull())


def fin_fact(t: Tables, wide: DataFrame | None = None) -> DataFrame:
    long = wide_to_long(t.fin_fact_wide if wide is None else wide, ["code", "bsns_year", "quarter"])
    return long.select("code", rpid_col(F.col("code"), F.col("bsns_year"), F.col("quarter")).alias("rpid"),
                       "bsns_year", "quarter", "statement", "account", "value")


def stored_facts(t: Tables) -> DataFrame:
    """The wide facts written once, for checks that read facts and filings several times."""
    return t.derived("fin_fact_wide_stored", lambda: t.fin_fact_wide, checkpoint=True)


def account_columns(t: Tables, *accounts: str) -> DataFrame:
    """(code, bsns_year, quarter, <the asked leaf sums>): the other sums are never computed, nor what only they read."""
    return t.fin_fact_wide.select("code", "bsns_year", "quarter", *accounts)


def fin_filing(t: Tables, wide: DataFrame | None = None) -> DataFrame:
    w = t.fin_fact_wide if wide is None else wide
    return w.select("code", rpid_col(F.col("code"), F.col("bsns_year"), F.col("quarter")).alias("rpid"),
                    "bsns_year", "quarter")


def fin_nation_wide(t: Tables) -> DataFrame:
    """Leaf sums per customer nation: a dense quarterly series (25 codes)."""
    cust = t.customer.select(F.col("c_custkey").cast("string").alias("code"), "c_nationkey")
    j = t.fin_fact_wide.join(cust, "code")
    wide = (j.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"), "bsns_year", "quarter")
            .agg(*_sum_leaves()))
    return wide


def fin_nation_fact(t: Tables) -> DataFrame:
    long = wide_to_long(t.fin_nation_wide, ["code", "bsns_year", "quarter"])
    return long.select("code", "bsns_year", "quarter", "statement", "account", "value")


def big_edges(t: Tables) -> DataFrame:
    """A data-sized DAG (child, parent, role) for closure/rollup at scale.

    order -> customer -> nation -> region -> WORLD; supplier -> nation;
    part -> brand -> PARTS and part -> type -> PARTS (a diamond: two paths).
    """
    o = t.orders.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("child"),
                        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("parent"))
    c = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child"),
                          F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"))
    s = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("child"),
                          F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("parent"))
    n = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"),
                        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"),
                        F.lit("WORLD").alias("parent"))
    p = t.part.select("p_partkey", "p_brand", "p_type")
    pb = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("child"),
                  F.concat(F.lit("B:"), F.col("p_brand")).alias("parent"))
    pt = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("child"),
                  F.concat(F.lit("T:"), F.col("p_type")).alias("parent"))
    b = p.select(F.concat(F.lit("B:"), F.col("p_brand")).alias("child"), F.lit("PARTS").alias("parent")).distinct()
    ty = p.select(F.concat(F.lit("T:"), F.col("p_type")).alias("child"), F.lit("PARTS").alias("parent")).distinct()
    out = o
    for x in (c, s, n, r, pb, pt, b, ty):
        out = out.unionByName(x)
    return out.withColumn("role", F.lit("partOf"))


# ---------------------------------------------------------------------------
# SQL text of the same views (DuckDB oracles).  ``sql_with(names, body)``
# prepends the CTEs a body needs, in dependency order.
# ---------------------------------------------------------------------------

def _c(x: str) -> str:
    return f"CAST(ROUND({x} * 100) AS BIGINT)"


_LINE_AMOUNTS = f"""
SELECT l.l_orderkey,
       {_c('l.l_extendedprice')} * 100 AS Revenue,
       CAST(ROUND(l.l_quantity) AS BIGINT) * {_c('p.p_retailprice')} * 100 AS CostOfSales,
       {_c('l.l_extendedprice')} * {_c('l.l_discount')} AS SellingGeneralAdministrativeExpenses,
       CASE WHEN l.l_returnflag = 'A' THEN {_c('l.l_extendedprice')} * {_c('l.l_tax')} END AS FinanceIncome,
       CASE WHEN l.l_returnflag = 'R' THEN {_c('l.l_extendedprice')} * {_c('l.l_tax')} END AS FinancialExpenses,
       {_c('l.l_extendedprice')} * {_c('l.l_tax')} AS IncomeTaxExpense,
       CASE WHEN l.l_linestatus = 'O' THEN {_c('l.l_extendedprice')} * 100 END AS TradeAndOtherCurrentReceivables,
       CASE WHEN l.l_returnflag = 'N' THEN CAST(ROUND(l.l_quantity) AS BIGINT) * {_c('p.p_retailprice')} * 100 END AS Inventories,
       CASE WHEN l.l_linestatus = 'F' THEN {_c('l.l_extendedprice')} * 100 END AS AdvancesCustomers
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

_SUMS = ", ".join(f"CAST(SUM({a}) AS BIGINT) AS {a}" for a, _ in LEAF_ACCOUNTS)

_FACT_WIDE = f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS code, CAST(year(o.o_orderdate) AS INTEGER) AS bsns_year,
       CAST(quarter(o.o_orderdate) AS VARCHAR) || 'Q' AS quarter, {_SUMS}
FROM fin_line_amounts a JOIN orders o ON a.l_orderkey = o.o_orderkey
GROUP BY 1, 2, 3
"""


def _long(src: str, with_rpid: bool) -> str:
    parts = []
    for a, s in LEAF_ACCOUNTS:
        rp = "code || '-' || CAST(bsns_year AS VARCHAR) || '-' || quarter AS rpid, " if with_rpid else ""
        parts.append(f"SELECT code, {rp}bsns_year, quarter, '{s}' AS statement, '{a}' AS account, {a} AS value "
                     f"FROM {src} WHERE {a} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


_NATION_WIDE = f"""
SELECT 'N' || CAST(c.c_nationkey AS VARCHAR) AS code, w.bsns_year, w.quarter,
       {", ".join(f"CAST(SUM(w.{a}) AS BIGINT) AS {a}" for a, _ in LEAF_ACCOUNTS)}
FROM fin_fact_wide w JOIN customer c ON w.code = CAST(c.c_custkey AS VARCHAR)
GROUP BY 1, 2, 3
"""

_BIG_EDGES = """
SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS child, 'C' || CAST(o_custkey AS VARCHAR) AS parent, 'partOf' AS role FROM orders
UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR), 'partOf' FROM customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 'partOf' FROM supplier
UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'partOf' FROM nation
UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'WORLD', 'partOf' FROM region
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), 'B:' || p_brand, 'partOf' FROM part
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), 'T:' || p_type, 'partOf' FROM part
UNION ALL SELECT DISTINCT 'B:' || p_brand, 'PARTS', 'partOf' FROM part
UNION ALL SELECT DISTINCT 'T:' || p_type, 'PARTS', 'partOf' FROM part
"""


def _ontology_cte(name: str) -> str:
    from . import ontology as O
    return {"onto_edges": O.edges_sql, "onto_nodes": O.nodes_sql, "onto_master": O.master_sql,
            "onto_lexicon": O.lexicon_sql}[name]()


SQL_VIEWS: dict[str, tuple[str, list[str]]] = {
    "fin_company": ("SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS sector FROM customer", []),
    "fin_line_amounts": (_LINE_AMOUNTS, []),
    "fin_fact_wide": (_FACT_WIDE, ["fin_line_amounts"]),
    "fin_fact": (_long("fin_fact_wide", True), ["fin_fact_wide"]),
    "fin_filing": ("SELECT code, code || '-' || CAST(bsns_year AS VARCHAR) || '-' || quarter AS rpid, bsns_year, quarter "
                   "FROM fin_fact_wide", ["fin_fact_wide"]),
    "fin_nation_wide": (_NATION_WIDE, ["fin_fact_wide"]),
    "fin_nation_fact": (_long("fin_nation_wide", False), ["fin_nation_wide"]),
    "big_edges": (_BIG_EDGES, []),
    "onto_edges": ("", []),
    "onto_nodes": ("", []),
    "onto_master": ("", []),
    "onto_lexicon": ("", []),
}


def _resolve(names: list[str], extra: dict[str, tuple[str, list[str]]]) -> list[tuple[str, str]]:
    views = {**SQL_VIEWS, **extra}
    out: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        body, deps = views[n]
        for d in deps:
            visit(d)
        out.append((n, body if body else _ontology_cte(n)))

    for n in list(names) + list(extra):
        visit(n)
    return out


def sql_with(names: list[str], body: str, extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """Prefix ``body`` with ``WITH`` CTEs for ``names`` (and their dependencies)."""
    ctes = _resolve(names, extra or {})
    if not ctes:
        return body
    once = ("fin_fact_wide", "fin_fact", "fin_rollup", "fin_ratio")  # views that a query names several times
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({b})" for n, b in ctes) \
        + "\n" + body


# ---------------------------------------------------------------------------
# fin_raw: facts back-projected to raw filing lines (report code, period
# label, statement code, local account name, amount as text).  Companies in
# the BUILDING segment file a comprehensive statement (CIS) only, AUTOMOBILE
# files both IS and CIS, others IS only; every filing also carries one line
# whose account name maps to nothing.
# ---------------------------------------------------------------------------
UNMAPPED_ACCOUNT_NAME = "기타영업외수익"


def _report_code(quarter: Column) -> Column:
    from . import reference_values as RV
    expr = None
    for code, _, q in RV.REPORT_CODES:
        expr = F.when(quarter == q, F.lit(code)) if expr is None else expr.when(quarter == q, F.lit(code))
    return expr


def _label_word(reprt: Column) -> Column:
    from . import reference_values as RV
    expr = None
    for code, word, _ in RV.REPORT_CODES:
        expr = F.when(reprt == code, F.lit(word)) if expr is None else expr.when(reprt == code, F.lit(word))
    return expr


def term_label(year: Column) -> Column:
    from . import reference_values as RV
    term = F.lit(RV.TERM_BASE_NUMBER) + (year - F.lit(RV.TERM_BASE_YEAR))
    return F.concat(F.lit(RV.PERIOD_LABEL_PREFIX), term.cast("string"), F.lit(RV.PERIOD_LABEL_SUFFIX))


def fin_raw(t: Tables, wide: DataFrame | None = None) -> DataFrame:
    """Raw filing lines; a filing's leaves and its unmapped line come from its one wide row, so facts are read once."""
    from . import ontology as O
    from . import reference_values as RV
    names = O.master_raw(t.spark).select(F.col("acc").alias("account"), F.col("name_local").alias("name_local"))
    seg = t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_mktsegment").alias("seg"))
    stack = ", ".join(f"'{a}', '{s}', `{a}`" for a, s in LEAF_ACCOUNTS)
    f = (t.fin_fact_wide if wide is None else wide).selectExpr(
        "code", "bsns_year", "quarter",
        f"stack({len(LEAF_ACCOUNTS) + 1}, {stack}, CAST(NULL AS STRING), 'IS', CAST(floor(Revenue / 100) AS BIGINT)) "
        "AS (account, statement, value)").filter(F.col("value").isNotNull())
    lines = f.join(F.broadcast(names), "account", "left").withColumn(
        "account_nm", F.when(F.col("account").isNull(), F.lit(UNMAPPED_ACCOUNT_NAME)).otherwise(F.col("name_local")))
    j = lines.join(seg, "code").withColumn("sj_div", F.explode(F.array(F.lit("BS"), F.lit("IS"), F.lit("CIS"))))
    keep = (((F.col("statement") == "BS") & (F.col("sj_div") == "BS"))
            | ((F.col("statement") == "IS") & (((F.col("sj_div") == "IS") & (F.col("seg") != "BUILDING"))
                                               | ((F.col("sj_div") == "CIS") & F.col("seg").isin("BUILDING", "AUTOMOBILE")))))
    j = j.filter(keep)
    reprt = _report_code(F.col("quarter"))
    base = F.concat(term_label(F.col("bsns_year")), _label_word(reprt))
    label = F.when((F.col("sj_div") == "BS") & (reprt != "11011"), F.concat(base, F.lit(RV.PERIOD_LABEL_END))).otherwise(base)
    rcept = F.concat(F.col("bsns_year").cast("string"), F.lit("0"), F.substring("quarter", 1, 1), F.when(F.length("code") < 12, F.lpad("code", 12, "0")).otherwise(F.col("code")))
    return j.select(rcept.alias("rcept_no"), F.col("code").alias("corp"), "bsns_year", reprt.alias("reprt_code"),
                    "sj_div", label.alias("thstrm_nm"), "account_nm", F.col("value").cast("string").alias("thstrm_amount"))


def _raw_sql() -> str:
    from . import reference_values as RV
    rep = " ".join(f"WHEN '{q}' THEN '{c}'" for c, _, q in RV.REPORT_CODES)
    word = " ".join(f"WHEN '{c}' THEN '{w}'" for c, w, _ in RV.REPORT_CODES)
    return f"""
SELECT CAST(x.bsns_year AS VARCHAR) || '0' || substr(x.quarter, 1, 1) || CASE WHEN length(x.code) < 12 THEN lpad(x.code, 12, '0') ELSE x.code END AS rcept_no,
       x.code AS corp, x.bsns_year, x.reprt_code, x.sj_div,
       CASE WHEN x.sj_div = 'BS' AND x.reprt_code <> '11011'
            THEN x.base || '{RV.PERIOD_LABEL_END}' ELSE x.base END AS thstrm_nm,
       x.account_nm, CAST(x.value AS VARCHAR) AS thstrm_amount
FROM (
  SELECT l.*, s.sj_div, CASE l.quarter {rep} END AS reprt_code,
         '{RV.PERIOD_LABEL_PREFIX}' || CAST({RV.TERM_BASE_NUMBER} + (l.bsns_year - {RV.TERM_BASE_YEAR}) AS VARCHAR)
           || '{RV.PERIOD_LABEL_SUFFIX}' || CASE CASE l.quarter {rep} END {word} END AS base
  FROM (
    SELECT f.code, f.bsns_year, f.quarter, f.statement, f.value, m.name_local AS account_nm
    FROM fin_fact f LEFT JOIN onto_master m ON m.acc = f.account
    UNION ALL
    SELECT code, bsns_year, quarter, 'IS', CAST(floor(Revenue / 100) AS BIGINT), '{UNMAPPED_ACCOUNT_NAME}'
    FROM fin_fact_wide WHERE Revenue IS NOT NULL
  ) l
  JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = l.code
  JOIN (VALUES ('BS'), ('IS'), ('CIS')) AS s(sj_div)
    ON (l.statement = 'BS' AND s.sj_div = 'BS')
    OR (l.statement = 'IS' AND ((s.sj_div = 'IS' AND c.c_mktsegment <> 'BUILDING')
                             OR (s.sj_div = 'CIS' AND c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))))
) x"""


SQL_VIEWS["fin_raw"] = (_raw_sql(), ["fin_fact", "fin_fact_wide", "onto_master"])
