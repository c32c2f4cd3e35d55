"""Question answering in bulk: slots -> validation -> evaluation -> answers.

One job answers every question: each question is keyed by its id, joined
to its company's facts for the period it asks about (a shuffle join on
(company, year, quarter)), the subject's leaves are scaled for what-if
questions, and the same evaluation operators as the batch rollups run with
the question id as an extra key.  Forecast questions join a per-(company,
account) OLS fit.  Errors are rows with a code and a message, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import account_rows

from ..sources import ontology as O
from ..sources import reference_values as RV
from . import dialog as DL
from . import evaluate as EV
from . import series as S

QK = ["question_id", "variant"]


def validate(questions: DataFrame, slots: DataFrame, pairs: DataFrame, spark: SparkSession,
             quarter_policy: str = "last") -> DataFrame:
    """QA1: intent-specific slot rules -> (question_id, code, intent, target, subject, pct, year, quarter, error_code, message).

    ``questions``: (question_id, code, bsns_year, predicted intent); the
    'today' of a question is 15 March of the year after its filing.  Where a
    question names no quarter, ``quarter_policy`` 'last' asks for the fourth and
    'sum' for the whole year (``evaluate.WHOLE_YEAR``).
    """
    names = {n for _, _, n, _, _ in account_rows()}
    name_map = spark.createDataFrame(
        [(n, a) for _, a, n, _, _ in account_rows()],
        "phrase string, acc string")
    yl = spark.createDataFrame(list(RV.LEXICON_YEAR) + list(RV.EXTRA_TIME_WORDS), "word string, year_desc string")
    ql = spark.createDataFrame(list(RV.LEXICON_QUARTER) + list(RV.EXTRA_TIME_WORDS), "word string, quarter_desc string")
    ap = spark.createDataFrame(list(RV.LEXICON_WORDS), "apply string, apply_desc string")

    q = questions if slots is None else questions.join(slots, questions.question_id == slots.doc, "left").drop("doc")
    q = q.withColumn("acc_arr", F.coalesce("acc_arr", F.array().cast("array<struct<start:int,phrase:string,tag:string>>")))
    q = q.withColumn("word", F.split("time", " ").getItem(0))
    q = q.join(F.broadcast(yl), "word", "left").join(F.broadcast(ql), "word", "left").join(F.broadcast(ap), "apply", "left")
    a1 = F.try_element_at("acc_arr", F.lit(1)).phrase
    a2 = F.try_element_at("acc_arr", F.lit(2)).phrase
    nm1 = name_map.select(F.col("phrase").alias("p1"), F.col("acc").alias("acc1"))
    nm2 = name_map.select(F.col("phrase").alias("p2"), F.col("acc").alias("acc2"))
    q = q.withColumn("p1", a1).withColumn("p2", a2)
    q = q.join(F.broadcast(nm1), "p1", "left").join(F.broadcast(nm2), "p2", "left")
    fwd = pairs.select(F.col("target").alias("acc1"), F.col("subject").alias("acc2"), F.lit(True).alias("fwd"))
    rev = pairs.select(F.col("target").alias("acc2"), F.col("subject").alias("acc1"), F.lit(True).alias("rev"))
    q = q.join(F.broadcast(fwd), ["acc1", "acc2"], "left").join(F.broadcast(rev), ["acc1", "acc2"], "left")

    q = q.withColumn("as_of", F.make_date(F.col("bsns_year") + 1, F.lit(3), F.lit(15)))
    q = DL.resolve_time(q, "time", "as_of", "year_desc", "quarter_desc")
    tr = {k: F.col("t_" + k) for k in ("year", "quarter", "error", "warning")}
    n_acc = F.size("acc_arr")
    unknown = F.exists("acc_arr", lambda x: ~x.phrase.isin(sorted(names)))
    first_unknown = F.try_element_at(F.filter("acc_arr", lambda x: ~x.phrase.isin(sorted(names))), F.lit(1)).phrase
    intent = F.col("intent")
    pct_n = F.split("percent", " ").getItem(0).try_cast("int")
    sign = F.when(F.col("apply_desc") == "UP", 1).when(F.col("apply_desc") == "DOWN", -1)

    count_msg = F.format_string("The question names %d accounts.", n_acc)
    q = q.withColumn("_sign", sign)
    sign = F.col("_sign")
    code = (F.when(tr["error"].isNotNull(), F.lit("TIME"))
            .when(unknown, F.lit("UNKNOWN_ACCOUNT"))
            .when(intent.isin("PAST.value", "IF.forecast") & (n_acc != 1), F.lit("ACCOUNT_COUNT"))
            .when((intent == "IF.fact") & (n_acc < 2), F.lit("ACCOUNT_COUNT"))
            .when((intent == "IF.fact") & F.col("fwd").isNull() & F.col("rev").isNull(), F.lit("NOT_RELATED"))
            .when((intent == "IF.fact") & (F.col("apply").isNull() | F.col("percent").isNull()), F.lit("MISSING_APPLY"))
            .when((intent == "IF.fact") & sign.isNull(), F.lit("BAD_APPLY")))
    q = q.withColumn("error_code", code)
    code = F.col("error_code")
    message = (F.when(code == "TIME", tr["error"])
               .when(code == "UNKNOWN_ACCOUNT", F.format_string("No account is called \"%s\".", first_unknown))
               .when(code == "ACCOUNT_COUNT", count_msg)
               .when(code == "NOT_RELATED", F.lit("Neither account contributes to the other."))
               .when(code == "MISSING_APPLY", F.format_string("A what-if needs a percentage and a verb; found %s and %s.",
                                                              F.coalesce("percent", F.lit("no percentage")),
                                                              F.coalesce("apply", F.lit("no verb"))))
               .when(code == "BAD_APPLY", F.lit("The verb says neither up nor down."))
               .otherwise(tr["warning"]))
    is_fact = intent == "IF.fact"
    target = (F.when(intent == "None", F.lit(None).cast("string"))
              .when(is_fact, F.when(F.col("fwd"), F.col("acc1")).when(F.col("rev"), F.col("acc2")))
              .otherwise(F.col("acc1")))
    subject = F.when(is_fact, F.when(F.col("fwd"), F.col("acc2")).when(F.col("rev"), F.col("acc1")))
    quarter = F.coalesce(F.concat(tr["quarter"].cast("string"), F.lit("Q")), F.lit("4Q"))
    if quarter_policy == "sum":
        named = F.coalesce(F.instr("time", "quarter") > 0, F.lit(False))
        quarter = F.when(named, quarter).otherwise(F.lit(EV.WHOLE_YEAR))
    return q.select("question_id", "code", "intent", target.alias("target_account"), subject.alias("subject_account"),
                    F.when(is_fact, sign * pct_n).alias("pct"), tr["year"].alias("year"),
                    F.when(tr["error"].isNull(), quarter).alias("quarter"), "error_code",
                    message.alias("message"))


def _plans(spark: SparkSession) -> tuple[list[str], DataFrame, DataFrame]:
    """(leaves, (target_account, is_value, units), (subject_account, under)): compiled from the ontology, some tens of rows.

    A unit's ``num`` and ``den`` have a coefficient per leaf, null where the leaf is not in it; ``under`` says of every leaf
    whether it lies under the subject.
    """
    below: dict[str, dict[str, int]] = {}
    for node, leaf, coef in O.coef_ext_rows():
        below.setdefault(node, {})[leaf] = coef
    leaves = sorted({x for ls in below.values() for x in ls})
    units: dict[str, dict[str, dict]] = {}
    value = set()
    for target, mode, unit, node, role, weight, scale in O.target_plan_rows():
        u = units.setdefault(target, {}).setdefault(unit, {"weight": weight, "scale": scale, "num": None, "den": None})
        u["num" if mode == "value" else role] = [below[node].get(x) for x in leaves] if node in below else None
        if mode == "value":
            value.add(target)
    shape = "array<struct<weight:double,scale:double,num:array<long>,den:array<long>>>"
    plan = spark.createDataFrame([(t, t in value, [(u["weight"], u["scale"], u["num"], u["den"]) for u in us.values()])
                                  for t, us in units.items()], f"target_account string, _is_value boolean, _units {shape}")
    under = spark.createDataFrame([(n, [x in ls for x in leaves]) for n, ls in below.items()],
                                  "subject_account string, _under array<boolean>")
    return leaves, plan, under


def evaluated(valid: DataFrame, facts: DataFrame) -> DataFrame:
    """``valid`` with (baseline, scenario): the target of every valid PAST.value / IF.fact question, null for others.

    Each question meets the one wide row of its company and period (one shuffle join), and its target's plan (compiled
    from the ontology and broadcast: the node itself, or numerator and denominator of each ratio) is evaluated in the
    row.  A sum is null with any leaf missing.  ``facts`` has one row per (company, period, account).
    """
    leaves, plan, under = _plans(valid.sparkSession)
    period = ["code", "bsns_year", "quarter"]
    wide, col = EV.wide_leaves(facts, leaves, period)
    w = wide.select(*[F.col(c).alias("_" + c) for c in period], F.array(*[F.col(col[x]) for x in leaves]).alias("_leaves"))
    ok = F.col("error_code").isNull() & F.col("intent").isin("PAST.value", "IF.fact")
    v = valid.join(F.broadcast(plan), "target_account", "left").join(F.broadcast(under), "subject_account", "left")
    j = v.join(w, (F.col("code") == F.col("_code")) & (F.col("year") == F.col("_bsns_year")) & (F.col("quarter") == F.col("_quarter")), "left")
    pct = F.lit(100).cast("long") + F.coalesce("pct", F.lit(0))
    now = F.transform("_leaves", lambda x: x * 100)
    then = F.when(F.col("_under").isNull(), now).otherwise(F.zip_with("_leaves", "_under", lambda x, u: x * F.when(u, pct).otherwise(100)))
    j = j.withColumn("_now", F.when(ok, now)).withColumn("_then", F.when(ok & (F.col("intent") == "IF.fact"), then))

    def total(coefs: Column, values: str) -> Column:
        return F.aggregate(F.zip_with(coefs, F.col(values), lambda c, x: F.when(c.isNull(), F.lit(0).cast("long")).otherwise(c * x)),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    def answer(values: str) -> Column:
        ratio = F.aggregate("_units", F.lit(0.0), lambda a, u: a + u["weight"] * F.try_divide(
            u["scale"] * total(u["num"], values).cast("double"), total(u["den"], values).cast("double")))
        exact = total(F.get("_units", F.lit(0))["num"], values) / 100.0
        return F.when(F.col(values).isNotNull(), F.when(F.col("_is_value"), exact).otherwise(F.round(ratio, 6)))
    return j.select(*[valid[c] for c in valid.columns if c not in ("target_account", "subject_account")], "target_account",
                    "subject_account", answer("_now").alias("baseline"), answer("_then").alias("scenario"))


def forecast_answers(facts: DataFrame, coef: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """QA4: per (company, account) lag-1 OLS on leaf and rollup values; next quarter after the latest.

    ``wanted`` (code, account) restricts the series to those asked about (a
    semi join before the windows and the regression aggregates).
    """
    f = facts.select("code", "bsns_year", "quarter", "account", "value")
    if wanted is not None:
        w = wanted.select("code", "account").distinct()
        f = f.join(w.select("code").distinct(), "code", "left_semi")
    roll = EV.rollup(f, coef, ["code", "bsns_year", "quarter"]).select("code", "bsns_year", "quarter", "account", "value")
    vals = f.unionByName(roll)
    if wanted is not None:
        vals = vals.join(w, ["code", "account"], "left_semi")
    p = S.pairs(vals)
    c = S.fit(p).filter(F.col("slope").isNotNull() & (F.col("sxx") > 0))  # a model needs spread in x
    pk = F.col("bsns_year") * 10 + F.substring("quarter", 1, 1).cast("int")
    last = vals.groupBy("code", "account").agg(F.max_by("value", pk).alias("last_value"),
                                               F.max_by("bsns_year", pk).alias("ly"), F.max_by("quarter", pk).alias("lq"))
    j = last.join(c, ["code", "account"])
    ny, nq = S.next_period(F.col("ly"), F.col("lq"))
    return j.select("code", "account", ny.cast("int").alias("f_year"), nq.alias("f_quarter"),
                    _whole(S.predict(S.scale(F.col("last_value")), F.col("intercept"), F.col("slope"))).alias("predicted"))


def _whole(c: Column) -> Column:
    """An answer is given to a whole unit of money, 1e4 of the facts' units."""
    return F.floor(c / F.lit(10000.0) + F.lit(0.5)).cast("long") * 10000


def answer_all(valid: DataFrame, facts: DataFrame, coef: DataFrame, intent: str | None = None) -> DataFrame:
    """QA5: one answer row per question (value, baseline for what-if, or an error); of one ``intent`` only, if given."""
    v = valid if intent is None else valid.filter(F.col("intent") == intent)
    if intent in (None, "IF.forecast"):
        asked = v.filter((F.col("intent") == "IF.forecast") & F.col("error_code").isNull()).select(
            "code", F.col("target_account").alias("account"))
        fc = forecast_answers(facts, coef, asked)
        fcq = fc.select("code", F.col("account").alias("target_account"), "f_year", "f_quarter", "predicted")
    if intent == "IF.forecast":
        v = v.withColumns({c: F.lit(None).cast("double") for c in ("baseline", "scenario")})
    else:
        v = evaluated(v, facts)
    if intent in (None, "IF.forecast"):
        v = v.join(fcq, ["code", "target_account"], "left")
    else:
        v = v.withColumns({c: F.lit(None).cast(k) for c, k in (("f_year", "int"), ("f_quarter", "string"), ("predicted", "long"))})
    is_fc = F.col("intent") == "IF.forecast"
    ok = F.col("error_code").isNull()
    answer = (F.when(~ok, F.lit(None).cast("double"))
              .when(F.col("intent") == "PAST.value", F.col("baseline"))
              .when(F.col("intent") == "IF.fact", F.col("scenario"))
              .when(is_fc, F.col("predicted").cast("double")))
    no_data = ok & F.col("intent").isin("PAST.value", "IF.fact", "IF.forecast") & answer.isNull()
    err = F.when(no_data, F.when(is_fc, F.lit("NO_MODEL")).otherwise(F.lit("NO_DATA"))).otherwise(F.col("error_code"))
    year = F.when(is_fc & ok, F.col("f_year")).otherwise(F.col("year"))
    quarter = F.when(is_fc & ok, F.col("f_quarter")).otherwise(F.col("quarter"))
    return v.select("question_id", "intent", "target_account", "subject_account", year.alias("year"),
                    quarter.alias("quarter"), answer.alias("answer"),
                    F.when(F.col("intent") == "IF.fact", F.col("baseline")).alias("baseline"),
                    err.alias("error_code"))
