"""Account evaluation queries (rollup, ratios, turnover, what-if) over fin_fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..sources import ontology as O
from ..sources.fixtures import LEAF_ACCOUNTS, sql_with
from . import sqlviews  # noqa: F401  (registers ontology SQL views)
from .registry import query

K = ["code", "bsns_year", "quarter"]


def _onto(t):
    e, n = O.edges(t.spark), O.nodes(t.spark)
    return e, n, O.coef_df(t.spark)


@query("eval_leaf", sql_with(["fin_fact", "onto_leafs"],
       "SELECT code, rpid, bsns_year, quarter, statement, account, value FROM fin_fact "
       "WHERE account IN (SELECT node FROM onto_leafs)"))
def eval_leaf(t):
    """EVA1: raw value of every leaf account (facts restricted to ontology leaves)."""
    _, _, coef = _onto(t)
    return EV.leaf_values(t.fin_fact, coef).select("code", "rpid", "bsns_year", "quarter", "statement",
                                                   "account", "value")


@query("eval_partof_one_level", sql_with(["fin_fact", "onto_pe"], """
SELECT f.code, f.bsns_year, f.quarter, pe.parent AS account, CAST(SUM(pe.s * f.value) AS BIGINT) AS value
FROM fin_fact f JOIN one_level pe ON pe.child = f.account
JOIN (SELECT parent, COUNT(*) AS need FROM one_level GROUP BY 1) n ON n.parent = pe.parent
GROUP BY f.code, f.bsns_year, f.quarter, pe.parent, n.need HAVING COUNT(*) = n.need""",
       extra={"one_level": ("SELECT * FROM onto_pe WHERE parent NOT IN (SELECT p.parent FROM onto_pe p "
                            "WHERE p.child IN (SELECT parent FROM onto_pe))", ["onto_pe"])}))
def eval_partof_one_level(t):
    """EVA2: Σ sign(child)·value(child) for parents whose children are all leaves."""
    e, n = O.edges(t.spark), O.nodes(t.spark)
    return EV.partof_one_level(t.fin_fact, e, n)


@query("eval_rollup_all_levels", sql_with(["fin_rollup"],
       "SELECT code, bsns_year, quarter, account, value, n_present, need FROM fin_rollup"))
def eval_rollup_all_levels(t):
    """EVA3: every rollup account at every level (partial sums carry n_present < need)."""
    _, _, coef = _onto(t)
    return EV.rollup(t.fin_fact, coef, complete_only=False)


@query("eval_rollup_complete_only", sql_with(["fin_rollup"],
       "SELECT code, bsns_year, quarter, account, value FROM fin_rollup WHERE n_present = need"))
def eval_rollup_complete_only(t):
    """EVA4: all-or-nothing rollup — any missing leaf gives no row."""
    _, _, coef = _onto(t)
    return EV.rollup(t.fin_fact, coef, complete_only=True).select(*K, "account", "value")


@query("eval_ratio", sql_with(["fin_ratio"],
       "SELECT code, bsns_year, quarter, account, ROUND(value, 6) AS value FROM fin_ratio WHERE scale = 1.0"))
def eval_ratio(t):
    """EVA5: num / den of every (non-turnover) ratio account, per company and period."""
    e, _, coef = _onto(t)
    defs = EV.ratio_definitions(e).filter(F.col("scale") == 1.0)
    r = EV.known_ratios(t.fin_fact, coef, defs)
    return r.select(*K, "account", F.round("value", 6).alias("value"))


@query("eval_turnover_days", sql_with(["fin_ratio"],
       "SELECT code, bsns_year, quarter, account, ROUND(value, 6) AS value FROM fin_ratio WHERE scale = 365.0"))
def eval_turnover_days(t):
    """EVA6: 365 · balance-sheet numerator / revenue."""
    e, _, coef = _onto(t)
    defs = EV.ratio_definitions(e).filter(F.col("scale") == 365.0)
    r = EV.known_ratios(t.fin_fact, coef, defs)
    return r.select(*K, "account", F.round("value", 6).alias("value"))


@query("eval_ratio_sum", sql_with(["fin_ratio", "onto_coef"], """
SELECT r.code, r.bsns_year, r.quarter, c.ancestor AS account, ROUND(SUM(c.coef * r.value), 6) AS value
FROM fin_ratio r JOIN onto_coef c ON c.leaf = r.account
JOIN (SELECT ancestor, COUNT(*) AS need FROM onto_coef GROUP BY 1) n ON n.ancestor = c.ancestor
WHERE c.ancestor IN (SELECT c2.ancestor FROM onto_coef c2 JOIN onto_ratio_defs d ON d.account = c2.leaf)
  AND r.value IS NOT NULL
GROUP BY r.code, r.bsns_year, r.quarter, c.ancestor, n.need HAVING COUNT(*) = n.need"""))
def eval_ratio_sum(t):
    """EVA7: partOf parents over ratio accounts (e.g. cost-of-sales + SG&A ratio)."""
    e, _, coef = _onto(t)
    out = EV.known_ratios(t.fin_fact, coef, EV.ratio_definitions(e), sums=True)
    return out.select(*K, "account", F.round("value", 6).alias("value"))


@query("eval_partof_real_cast", sql_with(["fin_fact", "onto_pe"], """
SELECT f.code, f.bsns_year, f.quarter, pe.parent AS account,
       SUM(CAST(CAST(pe.s AS REAL) * CAST(f.value AS REAL) AS DOUBLE)) AS value
FROM fin_fact f JOIN one_level pe ON pe.child = f.account
JOIN (SELECT parent, COUNT(*) AS need FROM one_level GROUP BY 1) n ON n.parent = pe.parent
GROUP BY f.code, f.bsns_year, f.quarter, pe.parent, n.need HAVING COUNT(*) = n.need""",
       extra={"one_level": ("SELECT * FROM onto_pe WHERE parent NOT IN (SELECT p.parent FROM onto_pe p "
                            "WHERE p.child IN (SELECT parent FROM onto_pe))", ["onto_pe"])}))
def eval_partof_real_cast(t):
    """EVA12: the single-precision mode (each value cast to REAL, sign as DOUBLE)."""
    e, n = O.edges(t.spark), O.nodes(t.spark)
    return EV.partof_real_cast(t.fin_fact, e, n)


# --------------------------------------------------------------------------- what-if
PCTS = [10, -5]
_PCT_SQL = "(SELECT 10 AS pct UNION ALL SELECT -5)"


def _plan(t):
    return O.cached(t.spark, "target_plan", lambda: t.spark.createDataFrame(
        O.target_plan_rows(), "target_account string, mode string, unit string, node string, role string, "
                              "weight double, scale double"))


def _scenarios(t, name, inside):
    """Every target with a part that holds the subject; ``inside`` = (node, subject).  Ontology-sized, kept in memory."""
    def build():
        s = _plan(t).select(F.col("target_account").alias("target"), "node").join(inside, "node").select(
            "target", "subject").distinct()
        s = s.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in PCTS])))
        return s.withColumn("scenario_id", F.concat_ws("|", "target", "subject", F.col("pct").cast("string")))
    return O.cached(t.spark, name, build)


def _leaf_scenarios(t):
    ext = t.spark.createDataFrame(O.coef_ext_rows(), "node string, subject string, coef long")
    leafs = [a for a, _ in LEAF_ACCOUNTS]
    return _scenarios(t, "leaf_scenarios", ext.filter(F.col("subject").isin(leafs)).select("node", "subject"))


def _internal_scenarios(t):
    parents = EV.partof_edges(O.edges(t.spark), O.nodes(t.spark)).select(F.col("parent").alias("subject")).distinct()
    below = O.partof_closure_df(t.spark).select(F.col("ancestor").alias("node"), F.col("descendant").alias("subject"))
    return _scenarios(t, "internal_scenarios", below.join(parents, "subject", "left_semi").unionByName(
        parents.select(F.col("subject").alias("node"), "subject")))


_SCEN_ID = "target || '|' || subject || '|' || CAST(pct AS VARCHAR) AS scenario_id"
_WHATIF_SQL_VIEWS = {
    "wi_ext": ("SELECT ancestor AS node, leaf, coef FROM onto_coef WHERE ancestor <> leaf UNION ALL "
               "SELECT acc, acc, 1 FROM onto_nodes WHERE acc NOT IN (SELECT parent FROM onto_pe)",
               ["onto_coef", "onto_nodes", "onto_pe"]),
    "wi_sums": ("SELECT c.ancestor AS target, c.coef, d.* FROM onto_coef c JOIN onto_ratio_defs d ON d.account = c.leaf "
                "WHERE c.ancestor <> c.leaf", ["onto_coef", "onto_ratio_defs"]),
    "wi_plan": ("""
SELECT account AS target, 'ratio' AS mode, account AS unit, num AS node, 'num' AS role, 1.0 AS weight, scale FROM onto_ratio_defs
UNION ALL SELECT account, 'ratio', account, den, 'den', 1.0, scale FROM onto_ratio_defs
UNION ALL SELECT target, 'ratio', account, num, 'num', coef, scale FROM wi_sums
UNION ALL SELECT target, 'ratio', account, den, 'den', coef, scale FROM wi_sums
UNION ALL SELECT acc, 'value', acc, acc, 'num', 1.0, 1.0 FROM onto_nodes WHERE acc <> 'CalendarOneYear'
AND acc NOT IN (SELECT account FROM onto_ratio_defs) AND acc NOT IN (SELECT target FROM wi_sums)""",
                ["onto_ratio_defs", "wi_sums", "onto_nodes"]),
    "leaf_scen": (f"SELECT *, {_SCEN_ID} FROM (SELECT DISTINCT p.target, e.leaf AS subject FROM wi_plan p "
                  "JOIN wi_ext e ON e.node = p.node WHERE e.leaf IN ("
                  + ", ".join(f"'{a}'" for a, _ in LEAF_ACCOUNTS) + f")) s, {_PCT_SQL} q", ["wi_plan", "wi_ext"]),
    "internal_scen": (f"SELECT *, {_SCEN_ID} FROM (SELECT DISTINCT p.target, c.subject FROM wi_plan p JOIN "
                      "(SELECT ancestor AS node, descendant AS subject FROM onto_closure UNION SELECT parent, parent FROM onto_pe) c "
                      f"ON c.node = p.node WHERE c.subject IN (SELECT parent FROM onto_pe)) s, {_PCT_SQL} q",
                      ["wi_plan", "onto_closure", "onto_pe"]),
}


def _whatif_sql(scen: str, cols: str) -> str:
    """Every fact scaled by hand for every scenario that holds it, then evaluated."""
    body = f"""
SELECT scenario_id, target, subject, pct, code, bsns_year, quarter,
  CASE mode WHEN 'value' THEN b ELSE ROUND(b, 6) END AS baseline,
  CASE mode WHEN 'value' THEN x ELSE ROUND(x, 6) END AS scenario_value,
  CASE mode WHEN 'value' THEN change / 100.0 ELSE ROUND(x - b, 6) + 0.0 END AS delta,
  ROUND(CASE WHEN b = 0 THEN NULL WHEN mode = 'value' THEN change / b ELSE (x - b) * 100 / b END, 6) + 0.0 AS pct_change
FROM (
  SELECT scenario_id, target, subject, pct, code, bsns_year, quarter, mode, SUM(change) AS change,
         SUM(weight * b) AS b, SUM(weight * x) AS x
  FROM (
    SELECT *, CASE mode WHEN 'value' THEN CAST(num_x - num AS DOUBLE) END AS change,
      CASE WHEN mode = 'value' THEN num / 100.0 WHEN den <> 0 THEN scale * CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS b,
      CASE WHEN mode = 'value' THEN num_x / 100.0 WHEN den_x <> 0 THEN scale * CAST(num_x AS DOUBLE) / CAST(den_x AS DOUBLE) END AS x
    FROM (
      SELECT scenario_id, target, subject, pct, mode, unit, weight, scale, n_units, code, bsns_year, quarter,
        MAX(CASE role WHEN 'num' THEN s END) AS num, MAX(CASE role WHEN 'num' THEN s_x END) AS num_x,
        MAX(CASE role WHEN 'den' THEN s END) AS den, MAX(CASE role WHEN 'den' THEN s_x END) AS den_x
      FROM (
        SELECT s.scenario_id, s.target, s.subject, s.pct, s.mode, s.unit, s.role, s.weight, s.scale, s.n_units,
               f.code, f.bsns_year, f.quarter, CAST(SUM(s.coef * f.value * 100) AS BIGINT) AS s,
               CAST(SUM(s.coef * f.value * s.mult) AS BIGINT) AS s_x
        FROM (SELECT s.*, p.mode, p.unit, p.role, p.weight, p.scale, e.leaf, e.coef, n.need, k.n_units,
                CASE WHEN EXISTS (SELECT 1 FROM wi_ext u WHERE u.node = s.subject AND u.leaf = e.leaf)
                     THEN 100 + s.pct ELSE 100 END AS mult
              FROM {scen} s JOIN wi_plan p ON p.target = s.target JOIN wi_ext e ON e.node = p.node
              JOIN (SELECT node, COUNT(*) AS need FROM wi_ext GROUP BY 1) n ON n.node = p.node
              JOIN (SELECT target, COUNT(DISTINCT unit) AS n_units FROM wi_plan GROUP BY 1) k ON k.target = s.target) s
        JOIN fin_fact f ON f.account = s.leaf
        GROUP BY s.scenario_id, s.target, s.subject, s.pct, s.mode, s.unit, s.role, s.weight, s.scale, s.n_units, s.need,
                 f.code, f.bsns_year, f.quarter HAVING COUNT(*) = s.need) a
      GROUP BY ALL) w
    WHERE num IS NOT NULL) v
  WHERE b IS NOT NULL AND x IS NOT NULL
  GROUP BY scenario_id, target, subject, pct, code, bsns_year, quarter, mode, n_units HAVING COUNT(*) = n_units) z"""
    return sql_with([scen, "fin_fact", "wi_plan", "wi_ext"], f"SELECT {cols} FROM ({body}) y", extra=_WHATIF_SQL_VIEWS)


_WI_ALL = "scenario_id, target, subject, pct, code, bsns_year, quarter, baseline, scenario_value, delta, pct_change"


@query("whatif_leaf", _whatif_sql("leaf_scen", "scenario_id, code, bsns_year, quarter, scenario_value"))
def whatif_leaf(t):
    """EVA9: scale one leaf by ±p% and re-evaluate every account that holds it, for every company/period."""
    _, _, coef = _onto(t)
    return EV.whatif(t.fin_fact, coef, _leaf_scenarios(t), plan=_plan(t)).select("scenario_id", *K, "scenario_value")


@query("whatif_internal", _whatif_sql("internal_scen", _WI_ALL))
def whatif_internal(t):
    """EVA10: subject is itself a rollup — every leaf under it is scaled."""
    _, _, coef = _onto(t)
    return EV.whatif(t.fin_fact, coef, _internal_scenarios(t), plan=_plan(t)).select(*_WI_ALL.split(", "))


@query("whatif_delta", _whatif_sql("leaf_scen", "scenario_id, code, bsns_year, quarter, baseline, scenario_value, delta, pct_change"))
def whatif_delta(t):
    """EVA11: baseline, scenario, delta and percent change side by side, ratios and turnover days included."""
    _, _, coef = _onto(t)
    return EV.whatif(t.fin_fact, coef, _leaf_scenarios(t), plan=_plan(t)).select(
        "scenario_id", *K, "baseline", "scenario_value", "delta", "pct_change")
