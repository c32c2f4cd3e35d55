"""Account evaluation: leaf lookup, signed rollups, ratios, turnover days,
sums of ratios and what-if scenarios — for every company and period at once.

The ontology is compiled once into small tables with a fixed size bound:

* ``coef(ancestor, leaf, coef, n_paths)`` — Σ over paths of Π child signs
  (partOf edges only), so a leaf reached by two paths counts twice in the
  value but once in the completeness count;
* ``need(ancestor, need)`` — how many distinct leaves an account needs;
* ``ratio_defs(account, num, den, scale)`` — division nodes (×365 when the
  numerator side includes the one-year duration node).

Facts are then joined to these *broadcast* tables (no shuffle of the facts
for the join) and aggregated by (company, year, quarter, account); the
aggregate does map-side partial sums, so a company holding a third of all
facts does not overload one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["code", "bsns_year", "quarter"]
DURATION_NODE = "CalendarOneYear"


def sign_col(prop: Column) -> Column:
    """Account property -> sign: 'positive' -> +1, anything else -> -1."""
    return F.when(F.lower(prop) == "positive", F.lit(1)).otherwise(F.lit(-1))


def partof_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """partOf edges with the child's sign (unsigned accounts count as +1)."""
    n = nodes.select(F.col("acc").alias("child"), F.coalesce("sign", F.lit(1)).alias("child_sign"))
    return edges.filter(F.col("role") == "partOf").join(F.broadcast(n), "child", "left").select(
        "child", "parent", "role", F.coalesce("child_sign", F.lit(1)).alias("child_sign"))


def leaf_need(coef: DataFrame) -> DataFrame:
    return coef.groupBy("ancestor").agg(F.count("leaf").alias("need"))


def ratio_definitions(edges: DataFrame) -> DataFrame:
    """(account, num, den, scale) for every division node."""
    num = edges.filter((F.col("role") == "numerator") & (F.col("child") != DURATION_NODE)).select(
        F.col("parent").alias("account"), F.col("child").alias("num"))
    den = edges.filter(F.col("role") == "denominator").select(F.col("parent").alias("account"),
                                                              F.col("child").alias("den"))
    days = edges.filter((F.col("role") == "numerator") & (F.col("child") == DURATION_NODE)).select(
        F.col("parent").alias("account"), F.lit(365.0).alias("scale"))
    return num.join(den, "account").join(days, "account", "left").select(
        "account", "num", "den", F.coalesce("scale", F.lit(1.0)).alias("scale"))


def leaf_values(facts: DataFrame, coef: DataFrame) -> DataFrame:
    """Leaf lookup: facts whose account is a leaf of the ontology."""
    lv = coef.select(F.col("leaf").alias("account")).distinct()
    return facts.join(F.broadcast(lv), "account", "left_semi")


def rollup(facts: DataFrame, coef: DataFrame, keys: list[str] = KEYS, complete_only: bool = True,
           include_leaves: bool = False, value_col: str = "value") -> DataFrame:
    """Σ coef·value per (keys, ancestor).  BIGINT in, BIGINT out (exact).

    ``complete_only`` keeps a row only when every leaf below the account has a
    fact for that key (the all-or-nothing rule); otherwise the partial sum is
    returned with ``n_present`` and ``need`` so callers can see the gap.
    """
    c = coef
    if not include_leaves:
        c = c.filter(F.col("ancestor") != F.col("leaf"))
    need = leaf_need(c)
    f = facts.select(*keys, F.col("account").alias("leaf"), F.col(value_col).alias("v"))
    j = f.join(F.broadcast(c.select("ancestor", "leaf", "coef")), "leaf")
    agg = j.groupBy(*keys, "ancestor").agg(F.sum(F.col("coef") * F.col("v")).alias("value"),
                                           F.count("leaf").alias("n_present"))
    out = agg.join(F.broadcast(need), "ancestor")
    if complete_only:
        out = out.filter(F.col("n_present") == F.col("need"))
    return out.select(*keys, F.col("ancestor").alias("account"), "value", "n_present", "need")


def partof_one_level(facts: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Parents whose partOf children are all leaves: Σ sign(child)·value(child), complete only."""
    pe = partof_edges(edges, nodes)
    parents_of_parents = pe.select(F.col("parent").alias("child")).distinct()
    inner_kids = pe.join(parents_of_parents, "child", "left_semi").select("parent").distinct()
    one = pe.join(inner_kids, "parent", "left_anti")
    coef = one.select(F.col("parent").alias("ancestor"), F.col("child").alias("leaf"),
                      F.col("child_sign").cast("long").alias("coef"))
    return rollup(facts, coef, keys).select(*keys, "account", "value")


def partof_real_cast(facts: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One-level rollup in single precision: Σ sign · CAST(value AS REAL), summed as double."""
    pe = partof_edges(edges, nodes)
    parents_of_parents = pe.select(F.col("parent").alias("child")).distinct()
    inner = pe.join(parents_of_parents, "child", "left_semi").select("parent").distinct()
    one = pe.join(inner, "parent", "left_anti")
    need = one.groupBy("parent").agg(F.count("child").alias("need"))
    f = facts.select(*keys, F.col("account").alias("child"), "value")
    j = f.join(F.broadcast(one), "child")
    agg = j.groupBy(*keys, "parent").agg(
        F.sum((F.col("child_sign").cast("float") * F.col("value").cast("float")).cast("double")).alias("value"),
        F.count("child").alias("n"))
    return agg.join(F.broadcast(need), "parent").filter(F.col("n") == F.col("need")).select(
        *keys, F.col("parent").alias("account"), "value")


def ratios(values: DataFrame, defs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """scale · num / den per key (NULL when den = 0); values are (keys, account, value)."""
    v = values.select(*keys, "account", F.col("value").cast("double").alias("v"))
    num = v.withColumnRenamed("account", "num").withColumnRenamed("v", "num_value")
    den = v.withColumnRenamed("account", "den").withColumnRenamed("v", "den_value")
    d = F.broadcast(defs)
    j = num.join(d, "num").join(den, keys + ["den"])
    return j.select(*keys, "account", F.try_divide(F.col("scale") * F.col("num_value"),
                                                   F.col("den_value")).alias("value"))


#: Rows of each plan table (scenarios, coefficients, parts) up to which a plan is compiled into columns.
PLAN_ROWS = 20_000


def leaves_by_node(coef: list) -> dict[str, dict[str, int]]:
    """ancestor -> {leaf: coefficient}; an account that is not there is a leaf of its own."""
    out: dict[str, dict[str, int]] = {}
    for r in coef:
        if r["ancestor"] != r["leaf"]:
            out.setdefault(r["ancestor"], {})[r["leaf"]] = int(r["coef"])
    return out


def wide_leaves(facts: DataFrame, accounts: list[str], keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """One row per key with a column per account (null where there is no fact), and the columns' names: one shuffle."""
    col = {x: f"leaf_{i}" for i, x in enumerate(sorted(accounts))}
    return facts.filter(F.col("account").isin(list(col))).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("account") == x, F.col("value"))).alias(c) for x, c in col.items()]), col


def known_ratios(facts: DataFrame, coef: DataFrame, defs: DataFrame, keys: list[str] = KEYS,
                 sums: bool = False) -> DataFrame:
    """(keys, account, value): every ratio whose numerator and denominator are complete, null where the latter is 0.

    With ``sums`` the accounts that are signed sums of ratios instead, where all their ratios have a value.  Coefficients and
    definitions are of the ontology's size: they are counted, and become columns over one wide row per key, so the facts are
    read and shuffled once; larger ones are joined.
    """
    small = [df.limit(PLAN_ROWS + 1).collect() for df in (coef.select("ancestor", "leaf", "coef"), defs)]
    if any(len(rows) > PLAN_ROWS for rows in small):
        f = facts.select(*keys, "account", F.col("value").cast("double").alias("value"))
        r = ratios(f.unionByName(rollup(facts, coef, keys).select(*keys, "account", F.col("value").cast("double").alias("value"))),
                   defs, keys)
        if not sums:
            return r
        higher = coef.join(defs.select(F.col("account").alias("leaf")), "leaf", "left_semi").select("ancestor").distinct()
        rc = coef.join(higher, "ancestor", "left_semi").withColumn("coef", F.col("coef").cast("double"))
        return rollup(r.filter(F.col("value").isNotNull()), rc, keys).select(*keys, "account", "value")
    leaves = leaves_by_node(small[0])
    by_account = {r["account"]: r for r in small[1]}

    def of(node: str) -> dict[str, int]:
        return leaves.get(node, {node: 1})
    wide, col = wide_leaves(facts, sorted({x for r in small[1] for n in (r["num"], r["den"]) for x in of(n)}), keys)

    def node(n: str) -> Column:
        return reduce(lambda x, y: x + y, [F.col(col[x]) * F.lit(c).cast("long") for x, c in of(n).items()])

    def ratio(r) -> Column:
        return F.try_divide(F.lit(float(r["scale"])) * node(r["num"]).cast("double"), node(r["den"]).cast("double"))
    if sums:
        targets = [a for a, ls in leaves.items() if set(ls) <= set(by_account)]
        each = [F.struct(F.lit(a).alias("account"), F.lit(True).alias("known"),
                         reduce(lambda x, y: x + y, [F.lit(float(c)) * ratio(by_account[x]) for x, c in leaves[a].items()]).alias("value"))
                for a in targets]
    else:
        each = [F.struct(F.lit(a).alias("account"), (node(r["num"]).isNotNull() & node(r["den"]).isNotNull()).alias("known"),
                         ratio(r).alias("value")) for a, r in by_account.items()]
    if not each:
        return wide.select(*keys, F.lit("").alias("account"), F.lit(0.0).alias("value")).limit(0)
    out = wide.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*").filter("known").drop("known")
    return out.filter(F.col("value").isNotNull()) if sums else out


#: The quarter of a fact that stands for its whole year.
WHOLE_YEAR = "ALL"


def yearly_facts(facts: DataFrame) -> DataFrame:
    """Facts of whole years: income lines summed over the year's quarters, balances as they were in its last one."""
    out = facts.groupBy("code", "bsns_year", "statement", "account").agg(F.sum("value").alias("total"),
                                                                         F.max_by("value", "quarter").alias("closing"))
    value = F.when(F.col("statement") == "IS", F.col("total")).otherwise(F.col("closing"))
    return out.select("code", "bsns_year", F.lit(WHOLE_YEAR).alias("quarter"), "statement", "account", value.alias("value"))


def shown_values(facts: DataFrame, coef: DataFrame, defs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, account, value): every account that has a value, as an answer shows it.

    Leaves and complete rollups in their own unit, ratios and sums of ratios rounded to 6 digits.
    """
    money = facts.select(*keys, "account", "value").unionByName(rollup(facts, coef, keys).select(*keys, "account", "value"))
    ratio = known_ratios(facts, coef, defs, keys).unionByName(known_ratios(facts, coef, defs, keys, sums=True))
    return money.withColumn("value", F.col("value").cast("double")).unionByName(
        ratio.filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 6)))


# ---------------------------------------------------------------------------
# What-if
# ---------------------------------------------------------------------------

def round6(x: Column) -> Column:
    """``F.round(x, 6) + 0.0`` without its way through a decimal's text, which is kept where x is large or near a tie.

    Below 1e6 a millionth of x is known to 3e-4, so off a tie by 1e-3 its nearest whole number is that of the decimal.
    """
    millionths = x * 1e6
    nearest = F.floor(millionths + 0.5)
    plain = (F.abs(x) < 1e6) & (F.abs(millionths - nearest) < 0.499)
    return F.when(plain, nearest / F.lit(1e6)).otherwise(F.round(x, 6) + F.lit(0.0))


def _shown(out: DataFrame, ids, keys: list[str]) -> DataFrame:
    """(ids, keys, baseline, scenario_value, delta, pct_change) of (b, x, change, is_value)."""
    def shown(x: Column, exact: Column) -> Column:
        return F.when(F.col("is_value"), exact).otherwise(round6(x))
    gap = F.col("x") - F.col("b")
    return out.select(
        *ids, *keys, shown(F.col("b"), F.col("b")).alias("baseline"), shown(F.col("x"), F.col("x")).alias("scenario_value"),
        shown(gap, F.col("change") / 100.0).alias("delta"),
        round6(F.try_divide(F.when(F.col("is_value"), F.col("change").cast("double")).otherwise(gap * 100),
                            F.col("b"))).alias("pct_change"))


def whatif(facts: DataFrame, coef: DataFrame, scenarios: DataFrame, keys: list[str] = KEYS,
           subject_leaves: DataFrame | None = None, plan: DataFrame | None = None) -> DataFrame:
    """Scale the subject by (100 + pct)/100 and re-evaluate the target: leaf, rollup, ratio, turnover or sum of ratios.

    ``scenarios``: (scenario_id, target, subject, pct int); a subject that is itself a rollup scales every leaf under
    it (``subject_leaves`` = (subject, leaf) pairs replaces that choice).  ``plan`` says how a target is evaluated
    (``ontology.target_plan_rows``); a target that it does not hold is the signed sum of its leaves.  ``facts`` has one
    row per (keys, account).

    Every part of a target is linear in the facts, so no fact is multiplied by scenarios: a scenario's part is
    100 · sum + pct · share, where ``share`` is the part of the sum under the subject, exact in BIGINT at 1e-2 units.
    The plan tables are of the ontology's size: they are counted, and up to ``PLAN_ROWS`` rows they become columns over
    one wide row per key, so the facts are shuffled once, by their keys, and never by account; larger plans are joined.
    A target with an incomplete part or a zero denominator gives no row.  Returns baseline, scenario value, delta and
    percent change side by side; those of ratios are rounded to six digits.
    """
    small = [df if df is None else df.limit(PLAN_ROWS + 1).collect() for df in (
        coef.select("ancestor", "leaf", "coef"), scenarios.select("scenario_id", "target", "subject", "pct"),
        subject_leaves if subject_leaves is None else subject_leaves.select("subject", "leaf"),
        plan if plan is None else plan.select("target_account", "mode", "unit", "node", "role", "weight", "scale"))]
    if any(rows is not None and len(rows) > PLAN_ROWS for rows in small):
        return whatif_by_joins(facts, coef, scenarios, keys, subject_leaves, plan)
    return whatif_by_row(facts, *small, keys)


def whatif_by_row(facts: DataFrame, coef: list, scenarios: list, subject_leaves: list | None, plan: list | None,
                  keys: list[str] = KEYS) -> DataFrame:
    """``whatif`` with plan tables as rows in the driver: node sums are columns of one row per key."""
    leaves = leaves_by_node(coef)
    given: dict[str, set[str]] = {}
    for r in subject_leaves or []:
        given.setdefault(r["subject"], set()).add(r["leaf"])
    parts: dict[str, list] = {}
    for r in plan or []:
        if r["mode"] == "ratio":
            parts.setdefault(r["target_account"], []).append(r)

    def of(node: str) -> dict[str, int]:
        return leaves.get(node, {node: 1})

    def under(subject: str) -> set[str]:
        return set(of(subject)) if subject_leaves is None else given.get(subject, set()) | {subject}
    place: dict[tuple[str, str], int] = {}

    def sum_of(node: str, subject: str | None = None) -> int:
        """Place of a sum among the columns: of a node, or of what lies under the subject in it (-1: nothing)."""
        own = [x for x in of(node) if subject is None or x in under(subject)]
        return place.setdefault((node, subject or ""), len(place)) if own else -1
    ratios: dict[tuple, int] = {}
    totals: dict[tuple, int] = {}

    def total_of(units: dict[str, dict], pct: int | None) -> int:
        """Place of a weighted sum of ratios; a ratio that holds nothing of the subject is the same in each scenario."""
        line = []
        for u in units.values():
            moved = pct != 0 and (u["num_share"] >= 0 or u["den_share"] >= 0) or pct is None
            key = (u["scale"], u["num"], u["num_share"] if moved else -1, u["den"], u["den_share"] if moved else -1,
                   pct if moved else 0)
            line.append((u["weight"], ratios.setdefault(key, len(ratios))))
        return totals.setdefault(tuple(line), len(totals))
    compiled = []
    for r in scenarios:
        s = {"scenario_id": r["scenario_id"], "target": r["target"], "subject": r["subject"], "pct": r["pct"],
             "is_value": r["target"] not in parts, "num": -1, "num_share": -1, "b": -1, "x": -1}
        if s["is_value"]:
            s["num"], s["num_share"] = sum_of(r["target"]), sum_of(r["target"], r["subject"])
        else:
            units: dict[str, dict] = {}
            for p in parts[r["target"]]:
                u = units.setdefault(p["unit"], {"weight": float(p["weight"]), "scale": float(p["scale"]),
                                                 "num": -1, "num_share": -1, "den": -1, "den_share": -1})
                u[p["role"]], u[p["role"] + "_share"] = sum_of(p["node"]), sum_of(p["node"], r["subject"])
            s["b"], s["x"] = total_of(units, 0), total_of(units, r["pct"])
        compiled.append(s)
    wide, col = wide_leaves(facts, sorted({x for node, _ in place for x in of(node)}), keys)

    def column(node: str, subject: str) -> Column:
        """A missing leaf makes the sum null."""
        terms = [F.col(col[x]) * F.lit(c).cast("long") for x, c in of(node).items() if not subject or x in under(subject)]
        return reduce(lambda x, y: x + y, terms)

    def rows(values: list, shape: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), f"array<{shape}>")

    def at(i: Column) -> Column:
        return F.get(F.col("sums"), i)

    def scaled(whole: Column, share: Column, pct: Column) -> Column:
        return at(whole) * 100 + F.coalesce(at(share), F.lit(0).cast("long")) * pct

    # per key: each sum, each ratio and each total once, whatever the number of scenarios that show it
    sums = [column(n, s) for n, s in place] or [F.lit(None).cast("long")]
    names = "scale", "num", "num_share", "den", "den_share", "pct"
    each_ratio = rows([dict(zip(names, k)) for k in ratios],
                      "struct<scale:double,num:int,num_share:int,den:int,den_share:int,pct:long>")
    each_total = rows([[{"weight": w, "ratio": i} for w, i in line] for line in totals], "array<struct<weight:double,ratio:int>>")
    known = F.transform(each_ratio, lambda u: F.try_divide(
        u["scale"] * scaled(u["num"], u["num_share"], u["pct"]).cast("double"),
        scaled(u["den"], u["den_share"], u["pct"]).cast("double")))

    def totals_of(known: Column) -> Column:
        return F.transform(each_total, lambda line: F.aggregate(  # null with any of its ratios
            line, F.lit(0.0), lambda x, u: x + u["weight"] * F.get(known, u["ratio"])))
    # the ratios are bound as a lambda's argument: as a column that is read once they would be put into the inner lambda
    w = wide.select(*keys, F.array(*sums).alias("sums")).withColumn(
        "totals", F.get(F.transform(F.array(known), totals_of), F.lit(0)))

    # per key and scenario: only places are looked up, so no lambda is called and no array copied for a row
    each = rows(compiled, "struct<scenario_id:string,target:string,subject:string,pct:long,is_value:boolean,num:int,num_share:int,"
                          "b:int,x:int>")
    j = w.select(*keys, "sums", "totals", F.explode(each).alias("s")).select(*keys, "sums", "totals", "s.*")
    now, then = at(F.col("num")) * 100, scaled(F.col("num"), F.col("num_share"), F.col("pct"))
    is_value = F.col("is_value")
    out = j.select(
        *keys, "scenario_id", "target", "subject", F.col("pct").cast("int").alias("pct"), "is_value",
        F.when(is_value, now / 100.0).otherwise(F.get("totals", F.col("b"))).alias("b"),
        F.when(is_value, then / 100.0).otherwise(F.get("totals", F.col("x"))).alias("x"),
        F.when(is_value, then - now).alias("change")).filter("b IS NOT NULL AND x IS NOT NULL")
    return _shown(out, ("scenario_id", "target", "subject", "pct"), keys)


def whatif_by_joins(facts: DataFrame, coef: DataFrame, scenarios: DataFrame, keys: list[str] = KEYS,
                    subject_leaves: DataFrame | None = None, plan: DataFrame | None = None) -> DataFrame:
    """``whatif`` for plans of any size: one aggregate gives the sum of each asked node and each asked share of it."""
    c = coef.filter(F.col("ancestor") != F.col("leaf")).select(F.col("ancestor").alias("node"), "leaf",
                                                               F.col("coef").cast("long").alias("coef"))
    own = scenarios.select(F.col("target").alias("target_account")).distinct()
    shape = "mode", "unit", "node", "role", "weight", "scale"
    value = [F.lit("value").alias("mode"), F.col("target_account").alias("unit"),
             F.col("target_account").alias("node"), F.lit("num").alias("role"), F.lit(1.0).alias("weight"),
             F.lit(1.0).alias("scale")]
    if plan is None:
        parts = own.select("target_account", *value)
    else:
        ratio = plan.filter(F.col("mode") == "ratio")
        parts = own.join(ratio, "target_account", "left_anti").select("target_account", *value).unionByName(
            ratio.join(own, "target_account", "left_semi").select("target_account", *shape))
    single = parts.select("node").unionByName(scenarios.select(F.col("subject").alias("node"))).distinct()
    ext = c.unionByName(single.join(c, "node", "left_anti").select("node", F.col("node").alias("leaf"),
                                                                   F.lit(1).cast("long").alias("coef")))
    under = (ext.select(F.col("node").alias("subject"), "leaf") if subject_leaves is None else
             subject_leaves.select("subject", "leaf").unionByName(
                 scenarios.select("subject", F.col("subject").alias("leaf")))).distinct()
    units = parts.groupBy("target_account").agg(F.countDistinct("unit").alias("n_units"))
    asked = scenarios.join(parts, scenarios.target == parts.target_account).join(units, "target_account")
    ids = "scenario_id", "target", "subject", "pct"
    asked = asked.select(*ids, "n_units", *shape)

    # which facts go into which sum: the whole node under subject '', the subject's share under its own name
    whole = ext.join(asked.select("node").distinct(), "node", "left_semi").select(
        "node", F.lit("").alias("part"), "leaf", "coef")
    share = asked.select("node", F.col("subject").alias("part")).distinct().join(ext, "node").join(
        under.withColumnRenamed("subject", "part"), ["part", "leaf"]).select("node", "part", "leaf", "coef")
    need = whole.groupBy("node").agg(F.count(F.lit(1)).alias("need")).withColumn("part", F.lit(""))
    f = facts.select(*keys, F.col("account").alias("leaf"), F.col("value").alias("v"))
    sums = f.join(whole.unionByName(share), "leaf").groupBy(*keys, "node", "part").agg(
        F.sum(F.col("coef") * F.col("v")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.join(need, ["node", "part"], "left").filter(F.col("need").isNull() | (F.col("n") == F.col("need")))

    line = asked.withColumn("part", F.explode(F.array(F.lit(""), F.col("subject")))).withColumn(
        "mult", F.when(F.col("part") == "", F.lit(100)).otherwise(F.col("pct")).cast("long"))
    j = sums.join(line, ["node", "part"])

    def total(role: str, x: Column) -> Column:
        return F.sum(F.when(F.col("role") == role, x))
    base = F.when(F.col("part") == "", F.col("s") * 100)
    u = j.groupBy(*keys, *ids, "n_units", "mode", "unit", "weight", "scale").agg(
        total("num", base).alias("num"), total("num", F.col("s") * F.col("mult")).alias("num_x"),
        total("den", base).alias("den"), total("den", F.col("s") * F.col("mult")).alias("den_x"))

    def ratio_of(num: str, den: str) -> Column:
        return F.try_divide(F.col("scale") * F.col(num).cast("double"), F.col(den).cast("double"))
    is_value = F.col("mode") == "value"
    u = u.filter(F.col("num").isNotNull()).select(
        *keys, *ids, "n_units", "mode", "weight", F.when(is_value, F.col("num_x") - F.col("num")).alias("change"),
        F.when(is_value, F.col("num") / 100.0).otherwise(ratio_of("num", "den")).alias("b"),
        F.when(is_value, F.col("num_x") / 100.0).otherwise(
            F.when(F.col("den").isNotNull(), ratio_of("num_x", "den_x"))).alias("x")).filter("b IS NOT NULL AND x IS NOT NULL")
    out = u.groupBy(*keys, *ids, "n_units", "mode").agg(
        F.count(F.lit(1)).alias("k"), F.sum("change").alias("change"), F.sum(F.col("weight") * F.col("b")).alias("b"),
        F.sum(F.col("weight") * F.col("x")).alias("x")).filter(F.col("k") == F.col("n_units"))

    return _shown(out.withColumn("is_value", is_value), ids, keys)
