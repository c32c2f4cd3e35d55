"""Question answering in bulk (QA1-QA5): the flagship end-to-end query.

The SQL oracles answer the same questions from the *generating* slots of the
corpus (no text understanding), so a match also proves that the Spark
pipeline recovered intent, accounts, time, apply word and percent from text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import evaluate as EV
from ..operators import nlu as NLU
from ..operators import qa as QA
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import fin_fact, fin_filing, sql_with, stored_facts
from . import sqlviews  # noqa: F401
from .q_eval import _onto
from .q_scalar import time_resolve_sql
from .q_text import CORPUS_VIEWS, _pairs
from .registry import query


def _valid(t):
    return t.derived("qa_valid", lambda: _build_valid(t), checkpoint=True)


def _build_valid(t):
    return _validate_questions(t, _questions(t))


def _questions(t):
    """The questions for one pass: not stored, from the facts that are stored for their answers."""
    q = C.build(fin_filing(t, stored_facts(t)), t.spark, _pairs(t))
    return q.select("question_id", "code", "bsns_year", "text")


def _validate_questions(t, questions, quarter_policy="last"):
    """Slots per question (dictionary tagging), rule intent, then the slot rules (broadcast lookups only)."""
    sl = NLU.question_slots_rows(questions, "question_id", "text", keep=["code", "bsns_year"])
    n_acc = F.size("acc_arr")
    intent = (F.when((n_acc >= 2) & (F.col("n_apply") > 0) & (F.col("n_pct") > 0), "IF.fact")
              .when((n_acc == 1) & F.col("has_will"), "IF.forecast")
              .when(n_acc == 1, "PAST.value").otherwise("None"))
    return QA.validate(sl.withColumn("intent", intent), None, _pairs(t), t.spark, quarter_policy)


def _yl():
    return O.values_sql(list(RV.LEXICON_YEAR) + list(RV.EXTRA_TIME_WORDS), ["word", "word_desc"], ["VARCHAR", "VARCHAR"])


def _ql():
    return O.values_sql(list(RV.LEXICON_QUARTER) + list(RV.EXTRA_TIME_WORDS), ["word", "word_desc"], ["VARCHAR", "VARCHAR"])


QA_VIEWS = {
    **CORPUS_VIEWS,
    "qa_in": (f"""
SELECT s.question_id, s.code, s.bsns_year, s.intent, s.time_phrase AS phrase, s.target, s.subject, s.apply_desc, s.number,
       make_date(CAST(s.bsns_year + 1 AS INTEGER), 3, 15) AS as_of, yl.word_desc AS year_desc, ql.word_desc AS quarter_desc
FROM c_slots s LEFT JOIN ({_yl()}) yl ON yl.word = split_part(s.time_phrase, ' ', 1)
LEFT JOIN ({_ql()}) ql ON ql.word = split_part(s.time_phrase, ' ', 1)""", ["c_slots"]),
    "qa_time": (time_resolve_sql("qa_in", "phrase", "as_of", "year_desc", "quarter_desc"), ["qa_in"]),
    "qa_valid": ("""
SELECT question_id, code, intent, target AS target_account, CASE WHEN intent = 'IF.fact' THEN subject END AS subject_account,
       CASE WHEN intent = 'IF.fact' THEN CASE apply_desc WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 END * number END AS pct,
       year, CASE WHEN error IS NULL THEN COALESCE(CAST(quarter AS VARCHAR) || 'Q', '4Q') END AS quarter,
       CASE WHEN error IS NOT NULL THEN 'TIME' END AS error_code, COALESCE(error, warning) AS message
FROM qa_time""", ["qa_time"]),
    "qa_fq": ("""
SELECT v.question_id, x.variant, f.account,
       f.value * CASE WHEN x.variant = 'scen' AND (f.account = v.subject_account OR EXISTS (
                   SELECT 1 FROM onto_coef c WHERE c.ancestor = v.subject_account AND c.leaf = f.account))
                 THEN 100 + v.pct ELSE 100 END AS value
FROM qa_valid v
JOIN (SELECT 'base' AS variant UNION ALL SELECT 'scen') x ON x.variant = 'base' OR v.intent = 'IF.fact'
JOIN fin_fact f ON f.code = v.code AND f.bsns_year = v.year AND f.quarter = v.quarter
WHERE v.error_code IS NULL AND v.intent IN ('PAST.value', 'IF.fact')""", ["qa_valid", "fin_fact", "onto_coef"]),
    "qa_val0": ("""
SELECT question_id, variant, account, CAST(value AS DOUBLE) AS value FROM qa_fq
UNION ALL
SELECT f.question_id, f.variant, c.ancestor, CAST(SUM(c.coef * f.value) AS DOUBLE) FROM qa_fq f
JOIN onto_coef c ON c.leaf = f.account AND c.ancestor <> c.leaf JOIN onto_need n ON n.ancestor = c.ancestor
GROUP BY f.question_id, f.variant, c.ancestor, n.need HAVING COUNT(*) = n.need""", ["qa_fq", "onto_coef", "onto_need"]),
    "qa_rat": ("""
SELECT a.question_id, a.variant, r.account, CASE WHEN b.value = 0 THEN NULL ELSE r.scale * a.value / b.value END AS value
FROM onto_ratio_defs r JOIN qa_val0 a ON a.account = r.num
JOIN qa_val0 b ON b.account = r.den AND b.question_id = a.question_id AND b.variant = a.variant""",
               ["onto_ratio_defs", "qa_val0"]),
    "qa_rsum": ("""
SELECT r.question_id, r.variant, c.ancestor AS account, SUM(c.coef * r.value) AS value
FROM qa_rat r JOIN onto_coef c ON c.leaf = r.account
JOIN (SELECT ancestor, COUNT(*) AS need FROM onto_coef GROUP BY 1) n ON n.ancestor = c.ancestor
WHERE c.ancestor IN (SELECT c2.ancestor FROM onto_coef c2 JOIN onto_ratio_defs d ON d.account = c2.leaf)
  AND r.value IS NOT NULL
GROUP BY r.question_id, r.variant, c.ancestor, n.need HAVING COUNT(*) = n.need""", ["qa_rat", "onto_coef", "onto_ratio_defs"]),
    "qa_vals": ("""
SELECT x.question_id, x.variant, x.account, CASE WHEN n.kind = 'Value' THEN x.value / 100.0 ELSE ROUND(x.value, 6) END AS v
FROM (SELECT * FROM qa_val0 UNION ALL SELECT * FROM qa_rat UNION ALL SELECT * FROM qa_rsum) x
JOIN onto_nodes n ON n.acc = x.account""", ["qa_val0", "qa_rat", "qa_rsum", "onto_nodes"]),
    "qa_fa": ("""
SELECT v.question_id, MAX(CASE WHEN a.variant = 'base' THEN a.v END) AS baseline,
       MAX(CASE WHEN a.variant = 'scen' THEN a.v END) AS scenario
FROM qa_vals a JOIN qa_valid v ON v.question_id = a.question_id AND v.target_account = a.account
GROUP BY v.question_id""", ["qa_vals", "qa_valid"]),
    "qa_series": ("""
SELECT code, bsns_year, quarter, account, value FROM fin_fact
UNION ALL SELECT code, bsns_year, quarter, account, value FROM fin_rollup WHERE n_present = need""",
                  ["fin_fact", "fin_rollup"]),
    "qa_pairs": ("""
SELECT code, account, value / 1e13 AS y, prev / 1e13 AS x FROM (
  SELECT *, LAG(value) OVER w AS prev,
         LAG(bsns_year * 4 + CAST(substr(quarter, 1, 1) AS INTEGER) - 1) OVER w AS prev_idx
  FROM qa_series WINDOW w AS (PARTITION BY code, account ORDER BY bsns_year, quarter)) s
WHERE prev IS NOT NULL AND prev_idx = bsns_year * 4 + CAST(substr(quarter, 1, 1) AS INTEGER) - 2""", ["qa_series"]),
    "qa_fc": ("""
SELECT l.code, l.account,
       CAST(CASE WHEN substr(l.lq, 1, 1) = '4' THEN l.ly + 1 ELSE l.ly END AS INTEGER) AS f_year,
       CAST((CAST(substr(l.lq, 1, 1) AS INTEGER) % 4) + 1 AS VARCHAR) || 'Q' AS f_quarter,
       CAST(floor(trunc((f.intercept + f.slope * (l.last_value / 1e13)) * 1e13) / 10000.0 + 0.5) AS BIGINT) * 10000 AS predicted
FROM (SELECT code, account,
             arg_max(value, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS last_value,
             arg_max(bsns_year, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS ly,
             arg_max(quarter, bsns_year * 10 + CAST(substr(quarter, 1, 1) AS INTEGER)) AS lq
      FROM qa_series GROUP BY code, account) l
JOIN (SELECT code, account, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
      FROM qa_pairs GROUP BY code, account HAVING regr_sxx(y, x) > 0) f ON f.code = l.code AND f.account = l.account
WHERE f.slope IS NOT NULL""", ["qa_series", "qa_pairs"]),
    "qa_answers": ("""
SELECT question_id, intent, target_account, subject_account, year, quarter, answer, baseline,
       CASE WHEN error_code IS NULL AND answer IS NULL AND intent IN ('PAST.value', 'IF.fact', 'IF.forecast')
            THEN CASE WHEN intent = 'IF.forecast' THEN 'NO_MODEL' ELSE 'NO_DATA' END ELSE error_code END AS error_code
FROM (
  SELECT v.question_id, v.intent, v.target_account, v.subject_account, v.error_code,
         CASE WHEN v.intent = 'IF.forecast' AND v.error_code IS NULL THEN fc.f_year ELSE v.year END AS year,
         CASE WHEN v.intent = 'IF.forecast' AND v.error_code IS NULL THEN fc.f_quarter ELSE v.quarter END AS quarter,
         CASE WHEN v.error_code IS NOT NULL THEN NULL WHEN v.intent = 'PAST.value' THEN fa.baseline
              WHEN v.intent = 'IF.fact' THEN fa.scenario WHEN v.intent = 'IF.forecast' THEN CAST(fc.predicted AS DOUBLE) END AS answer,
         CASE WHEN v.intent = 'IF.fact' THEN fa.baseline END AS baseline
  FROM qa_valid v LEFT JOIN qa_fa fa ON fa.question_id = v.question_id
  LEFT JOIN qa_fc fc ON fc.code = v.code AND fc.account = v.target_account) x""",
                   ["qa_valid", "qa_fa", "qa_fc"]),
}


def qsql(names, body):
    return sql_with(names, body, extra=QA_VIEWS)


def _facts_ckpt(t):
    """The facts for the several QA jobs that read them, from the wide rows that are stored once."""
    return t.derived("fin_fact_stored", lambda: fin_fact(t, stored_facts(t)))


def _answers(t, intent=None):
    return QA.answer_all(_valid(t), _facts_ckpt(t), _onto(t)[2], intent)


@query("qa_validate", qsql(["qa_valid"], "SELECT question_id, intent, target_account, subject_account, pct, year, quarter, "
                                          "error_code, message FROM qa_valid"))
def qa_validate(t):
    """QA1/SC9/SC12/GR9: slots from text -> target/subject, factor, period, or an error row."""
    return _valid(t).drop("code")


@query("qa_past_value", qsql(["qa_answers"], "SELECT question_id, target_account, year, quarter, answer FROM qa_answers "
                                             "WHERE intent = 'PAST.value' AND error_code IS NULL"))
def qa_past_value(t):
    """QA2: answer every 'what is X in <time>' question from the evaluated accounts."""
    a = _answers(t, "PAST.value")
    return a.filter((F.col("intent") == "PAST.value") & F.col("error_code").isNull()).select(
        "question_id", "target_account", "year", "quarter", "answer")


@query("qa_whatif", qsql(["qa_answers"], "SELECT question_id, target_account, subject_account, year, quarter, baseline, "
                                         "answer FROM qa_answers WHERE intent = 'IF.fact' AND error_code IS NULL"))
def qa_whatif(t):
    """QA3: what-if answers (target after scaling the subject) next to the baseline."""
    a = _answers(t, "IF.fact")
    return a.filter((F.col("intent") == "IF.fact") & F.col("error_code").isNull()).select(
        "question_id", "target_account", "subject_account", "year", "quarter", "baseline", "answer")


@query("qa_forecast", qsql(["qa_answers"], "SELECT question_id, target_account, year, quarter, answer FROM qa_answers "
                                           "WHERE intent = 'IF.forecast' AND error_code IS NULL"))
def qa_forecast(t):
    """QA4: next-quarter forecast of the asked account for the asking company."""
    a = _answers(t, "IF.forecast")
    return a.filter((F.col("intent") == "IF.forecast") & F.col("error_code").isNull()).select(
        "question_id", "target_account", "year", "quarter", "answer")


@query("qa_end_to_end", qsql(["qa_answers"], "SELECT question_id, intent, target_account, subject_account, year, quarter, "
                                             "answer, baseline, error_code FROM qa_answers"))
def qa_end_to_end(t):
    """QA5 (flagship): text -> tags -> slots -> validation -> evaluated answer or error, for every question."""
    return _answers(t)


def answer_questions(t, questions):
    """Answer an arbitrary questions frame (question_id, code, bsns_year, text) — used per micro-batch."""
    valid = _validate_questions(t, questions).checkpoint(eager=True)  # cut lineage per micro-batch
    return QA.answer_all(valid, _facts_ckpt(t), _onto(t)[2])


_BODY = QA_VIEWS["qa_valid"][0]
_LAST = "COALESCE(CAST(quarter AS VARCHAR) || 'Q', '4Q')"
YEAR_VIEWS = {
    **QA_VIEWS,
    "qa_valid": (_BODY.replace(_LAST, f"CASE WHEN strpos(COALESCE(phrase, ''), 'quarter') = 0 THEN 'ALL' ELSE {_LAST} END"),
                 ["qa_time"]),
    "qa_year_fact": ("""
SELECT code, bsns_year, quarter, account, value FROM fin_fact
UNION ALL SELECT code, bsns_year, 'ALL', account, CAST(CASE WHEN statement = 'IS' THEN SUM(value) ELSE arg_max(value, quarter) END AS BIGINT)
FROM fin_fact GROUP BY code, bsns_year, statement, account""", ["fin_fact"]),
    "qa_fq": (QA_VIEWS["qa_fq"][0].replace("JOIN fin_fact f", "JOIN qa_year_fact f"), ["qa_valid", "qa_year_fact", "onto_coef"]),
}


@query("qa_whole_year", sql_with(["qa_fa", "qa_valid"], """
SELECT v.question_id, v.intent, v.target_account, v.subject_account, v.year, v.quarter, fa.baseline, fa.scenario
FROM qa_valid v LEFT JOIN qa_fa fa ON fa.question_id = v.question_id
WHERE v.error_code IS NULL AND v.intent IN ('PAST.value', 'IF.fact')""", extra=YEAR_VIEWS))
def qa_whole_year(t):
    """QA2/QA3 by Q23's 'sum' policy: a question that names no quarter is answered for the whole year."""
    valid = t.derived("qa_valid_year", lambda: _validate_questions(t, _questions(t), "sum"), checkpoint=True)
    f = _facts_ckpt(t)
    asked = valid.filter(F.col("error_code").isNull() & F.col("intent").isin("PAST.value", "IF.fact"))
    a = QA.evaluated(asked, f.unionByName(EV.yearly_facts(f), allowMissingColumns=True))
    return a.select("question_id", "intent", "target_account", "subject_account", "year",
                                                       "quarter", "baseline", "scenario")
