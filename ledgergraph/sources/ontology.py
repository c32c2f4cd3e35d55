"""The account ontology as small Spark dimension tables.

All tables here have a fixed, proven size bound (tens of rows), so they are
safe to broadcast.  The same rows are also rendered as SQL ``VALUES`` text
for the DuckDB oracles (``*_sql`` functions).
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reference_values as RV

MASTER_SCHEMA = "acc string, name_local string, name_eng string, grp string"
EDGE_SCHEMA = "child string, parent string, role string"
NODE_SCHEMA = "acc string, statement string, kind string, level int, sign int, belongs string"
LEXICON_SCHEMA = "kind string, word string, tag string, word_desc string, pos int"


_CACHE: "WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = WeakKeyDictionary()


def cached(spark: SparkSession, name: str, build) -> DataFrame:
    """Compile an ontology-derived table once per session and keep it in memory.

    Only for tables derived from the fixed ontology (tens of rows): they do not
    depend on the data, so one cached copy serves every query.
    """
    own = _CACHE.setdefault(spark, {})
    if name not in own:
        own[name] = build().cache()
        own[name].count()
    return own[name]


def _sign(acc: str) -> int | None:
    if acc in RV.UNSIGNED_ACCOUNTS or acc == "CalendarOneYear":
        return None
    return -1 if acc in RV.NEGATIVE_ACCOUNTS else 1


def _belongs(statement: str, kind: str, level: int) -> str:
    if level == 0:
        return "FinancialStatement"
    if kind == "Ratio":
        return "Ratios"
    return {"BS": "BalanceSheet", "IS": "IncomeStatement"}.get(statement, "FinancialStatement")


def node_rows() -> list[tuple]:
    rows = []
    for acc, _, _, group in RV.ACCOUNT_MASTER:
        statement, kind, level = group.split("-")
        rows.append((acc, statement, kind, int(level), _sign(acc), _belongs(statement, kind, int(level))))
    return rows


def lexicon_rows() -> list[tuple]:
    rows = []
    for kind, words, tag in (("year", RV.LEXICON_YEAR, "TIME"), ("quarter", RV.LEXICON_QUARTER, "TIME"),
                             ("words", RV.LEXICON_WORDS, "APPLY")):
        for pos, (w, d) in enumerate(words):
            rows.append((kind, w, tag, d, pos))
    return rows


def master_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RV.ACCOUNT_MASTER, MASTER_SCHEMA)


def decode_master(raw: DataFrame) -> DataFrame:
    """Split the packed group code ``Statement-Kind-Level`` into three typed columns."""
    parts = F.split(F.col("grp"), "-")
    return raw.select("acc", "name_local", "name_eng", parts.getItem(0).alias("statement"),
                      parts.getItem(1).alias("kind"), parts.getItem(2).cast("int").alias("level"))


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RV.ACCOUNT_EDGES, EDGE_SCHEMA)


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(node_rows(), NODE_SCHEMA)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), LEXICON_SCHEMA)


def triples(spark: SparkSession) -> DataFrame:
    """The triple set, derived by rule from the master, node properties and edges."""
    n = nodes(spark).alias("n")
    m = master_raw(spark).alias("m")
    acc = F.concat(F.lit("acc:"), F.col("n.acc"))
    typed = n.filter(F.col("n.acc") != "CalendarOneYear")
    parts = [
        typed.select(acc.alias("s"), F.lit("rdf:type").alias("p"), F.lit("acc:Account").alias("o")),
        n.join(m, F.col("n.acc") == F.col("m.acc")).select(
            acc.alias("s"), F.lit("rdfs:label").alias("p"),
            F.when(F.col("n.acc") == "CalendarOneYear", F.lit("365")).otherwise(F.col("m.name_local")).alias("o")),
        typed.select(acc.alias("s"), F.lit("acc:Account_Type").alias("p"), F.col("n.kind").alias("o")),
        typed.select(acc.alias("s"), F.lit("acc:Account_Belonging").alias("p"),
                     F.concat(F.lit("acc:"), F.col("n.belongs")).alias("o")),
        typed.filter(F.col("n.sign").isNotNull()).select(
            acc.alias("s"), F.lit("acc:Account_Property").alias("p"),
            F.when(F.col("n.sign") > 0, "Positive").otherwise("Negative").alias("o")),
        typed.select(acc.alias("s"), F.lit("acc:Account_Level").alias("p"), F.col("n.level").cast("string").alias("o")),
    ]
    e = edges(spark)
    inv = spark.createDataFrame(RV.INVERSE_PREDICATES, "role string, inverse string")
    parts.append(e.select(F.concat(F.lit("acc:"), "child").alias("s"), F.concat(F.lit("acc:"), "role").alias("p"),
                          F.concat(F.lit("acc:"), "parent").alias("o")))
    vocab = spark.createDataFrame(RV.VOCAB_TRIPLES, "s string, p string, o string")
    parts.append(vocab)
    forward = e.select("child", "parent", "role").unionByName(
        vocab.filter(F.col("p") == "acc:partOf").select(
            F.substring_index("s", ":", -1).alias("child"), F.substring_index("o", ":", -1).alias("parent"),
            F.lit("partOf").alias("role")))
    parts.append(forward.join(F.broadcast(inv), "role").select(
        F.concat(F.lit("acc:"), "parent").alias("s"), F.concat(F.lit("acc:"), "inverse").alias("p"),
        F.concat(F.lit("acc:"), "child").alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# SQL VALUES renderings for the oracles
# ---------------------------------------------------------------------------

def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows: list[tuple], cols: list[str], types: list[str] | None = None) -> str:
    """``SELECT * FROM (VALUES ...) t(cols)`` with explicit casts on the first row."""
    body = []
    for i, r in enumerate(rows):
        if i == 0 and types:
            body.append("(" + ", ".join(f"CAST({_lit(v)} AS {t})" for v, t in zip(r, types)) + ")")
        else:
            body.append("(" + ", ".join(_lit(v) for v in r) + ")")
    return f"SELECT * FROM (VALUES {', '.join(body)}) AS t({', '.join(cols)})"


def edges_sql() -> str:
    return values_sql(RV.ACCOUNT_EDGES, ["child", "parent", "role"], ["VARCHAR"] * 3)


def nodes_sql() -> str:
    return values_sql(node_rows(), ["acc", "statement", "kind", "level", "sign", "belongs"],
                      ["VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "VARCHAR"])


def master_sql() -> str:
    return values_sql(RV.ACCOUNT_MASTER, ["acc", "name_local", "name_eng", "grp"], ["VARCHAR"] * 4)


def lexicon_sql() -> str:
    return values_sql(lexicon_rows(), ["kind", "word", "tag", "word_desc", "pos"],
                      ["VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "INTEGER"])


# ---------------------------------------------------------------------------
# Compile step for the fixed ontology.  The account graph is configuration
# (tens of nodes), not data: its closure is enumerated once on the driver and
# shipped as a small broadcast table.  Data-sized graphs use the distributed
# closure in ``ledgergraph.operators.graph`` (tests check both agree).
# ---------------------------------------------------------------------------

def closure_rows(edge_rows: list[tuple[str, str]], weight: dict[str, int] | None = None) -> list[tuple]:
    """(ancestor, descendant, n_paths, weight, min_depth, max_depth) by path enumeration (acyclic input)."""
    parents: dict[str, list[str]] = {}
    for child, parent in edge_rows:
        parents.setdefault(child, []).append(parent)
    acc: dict[tuple[str, str], list] = {}

    def walk(start: str, node: str, w: int, depth: int, seen: tuple) -> None:
        for p in parents.get(node, []):
            if p in seen:
                raise ValueError("cycle in ontology edges")
            ww = w * (weight.get(node, 1) if weight else 1)
            r = acc.setdefault((p, start), [0, 0, depth, depth])
            r[0] += 1
            r[1] += ww
            r[2] = min(r[2], depth)
            r[3] = max(r[3], depth)
            walk(start, p, ww, depth + 1, seen + (p,))

    nodes = {c for c, _ in edge_rows} | {p for _, p in edge_rows}
    for n in sorted(nodes):
        walk(n, n, 1, 1, (n,))
    return sorted((a, d, v[0], v[1], v[2], v[3]) for (a, d), v in acc.items())


CLOSURE_SCHEMA = "ancestor string, descendant string, n_paths long, weight long, min_depth int, max_depth int"


def coef_rows() -> list[tuple]:
    """(ancestor, leaf, coef, n_paths) over partOf edges with child signs (unsigned = +1)."""
    po = [(c, p) for c, p, r in RV.ACCOUNT_EDGES if r == "partOf"]
    signs = {a: (s if s is not None else 1) for a, _, _, _, s, _ in node_rows()}
    parents = {p for _, p in po}
    return [(a, d, w, n) for a, d, n, w, _, _ in closure_rows(po, signs) if d not in parents]


def coef_df(spark: SparkSession) -> DataFrame:
    return cached(spark, "coef", lambda: spark.createDataFrame(
        coef_rows(), "ancestor string, leaf string, coef long, n_paths long"))


def partof_closure_df(spark: SparkSession) -> DataFrame:
    po = [(c, p) for c, p, r in RV.ACCOUNT_EDGES if r == "partOf"]
    signs = {a: (s if s is not None else 1) for a, _, _, _, s, _ in node_rows()}
    return cached(spark, "partof_closure", lambda: spark.createDataFrame(closure_rows(po, signs), CLOSURE_SCHEMA))


def all_roles_closure_df(spark: SparkSession) -> DataFrame:
    """Closure over every role (partOf, numerator, denominator) without the one-year duration node."""
    e = [(c, p) for c, p, _ in RV.ACCOUNT_EDGES if "CalendarOneYear" not in (c, p)]
    return cached(spark, "all_roles_closure", lambda: spark.createDataFrame(closure_rows(e), CLOSURE_SCHEMA))


def ratio_def_rows() -> dict[str, tuple[str, str, float]]:
    num = {p: c for c, p, r in RV.ACCOUNT_EDGES if r == "numerator" and c != "CalendarOneYear"}
    den = {p: c for c, p, r in RV.ACCOUNT_EDGES if r == "denominator"}
    days = {p for c, p, r in RV.ACCOUNT_EDGES if r == "numerator" and c == "CalendarOneYear"}
    return {d: (num[d], den[d], float(RV.DAYS_PER_YEAR) if d in days else 1.0) for d in num if d in den}


def target_plan_rows() -> list[tuple]:
    """How to evaluate each account as a question target, as rows
    (target, mode, unit, node, role, weight, scale):

    * value targets: one part, the node itself (a leaf or a signed rollup);
    * division targets: numerator and denominator parts of one unit;
    * sums of ratios: numerator/denominator parts of every ratio leaf, weighted by its coefficient.
    """
    defs = ratio_def_rows()
    leaves: dict[str, list[tuple[str, int]]] = {}
    for a, leaf, c, _ in coef_rows():
        leaves.setdefault(a, []).append((leaf, c))
    rows = []
    for acc, _, _, _ in RV.ACCOUNT_MASTER:
        if acc == "CalendarOneYear":
            continue
        if acc in defs:
            n, d, s = defs[acc]
            rows += [(acc, "ratio", acc, n, "num", 1.0, s), (acc, "ratio", acc, d, "den", 1.0, s)]
        elif acc in leaves and all(l in defs for l, _ in leaves[acc]):
            for l, c in leaves[acc]:
                n, d, s = defs[l]
                rows += [(acc, "ratio", l, n, "num", float(c), s), (acc, "ratio", l, d, "den", float(c), s)]
        else:
            rows.append((acc, "value", acc, acc, "val", 1.0, 1.0))
    return rows


def coef_ext_rows() -> list[tuple]:
    """coef plus identity rows for leaves, so any node (leaf or rollup) expands to (node, leaf, coef)."""
    rows = [(a, l, c) for a, l, c, _ in coef_rows()]
    parents = {a for a, _, _ in rows}
    for acc, _, _, _ in RV.ACCOUNT_MASTER:
        if acc not in parents:
            rows.append((acc, acc, 1))
    return rows
