"""Questions that can't be answered as they are put (QA1's errors, JN6, TX10 outside the dictionary).

Every filing asks one such question: an account name with a letter missing, two
accounts of which neither contributes to the other, a what-if without a
percentage, or a question for one value that names two accounts.  The SQL knows
from the generating slots what must come out; Spark has the text only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import nlu as NLU
from ..operators import qa as QA
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import sql_with
from .q_qa import _ql, _yl
from .q_scalar import time_resolve_sql
from .q_text import CORPUS_VIEWS, _pairs
from .registry import query

KINDS = ["misspelt", "unrelated", "no_percent", "two_accounts"]


def variant_questions(t):
    """(question_id, code, bsns_year, kind, text): one question a filing, chosen by its key."""
    spark, f = t.spark, t.fin_filing
    rows = C.account_rows()
    names = F.array(*[F.lit(r[2]) for r in rows])
    id_of = {r[1]: i for i, r in enumerate(rows)}
    related = [(r["target"], r["subject"]) for r in _pairs(t).select("target", "subject", "idx").orderBy("idx").collect()]
    both = set(related) | {(b, a) for a, b in related}
    apart = sorted((a, b) for a in id_of for b in id_of if a != b and (a, b) not in both)  # of the ontology's size

    def pick(pairs, end: int):
        return F.array(*[F.lit(rows[id_of[p[end]]][2]) for p in pairs])
    s, n = F.col("s"), len(rows)
    past = [f"{w} {u}" for _, u, w in C.time_word_rows("FUTURE")]

    def at(values, index):
        return F.get(F.array(*[F.lit(v) for v in values]) if isinstance(values, list) else values, index.cast("int"))
    q = f.select(F.col("rpid").alias("question_id"), "code", "bsns_year",
                 (F.col("code").cast("long") * 7 + F.col("bsns_year").cast("long") * 13
                  + F.substring("quarter", 1, 1).cast("long") * 31).alias("s"))
    a = F.floor(s / 4) % n
    b = (a + 1 + F.floor(s / 7) % (n - 1)) % n
    q = q.select(
        "*", at(KINDS, s % 4).alias("kind"), at(names, a).alias("a"), at(names, b).alias("b"),
        at(pick(apart, 0), F.floor(s / 3) % len(apart)).alias("u0"), at(pick(apart, 1), F.floor(s / 3) % len(apart)).alias("u1"),
        at(pick(related, 0), F.floor(s / 3) % len(related)).alias("r0"), at(pick(related, 1), F.floor(s / 3) % len(related)).alias("r1"),
        at(past, F.floor(s / 5) % len(past)).alias("time"),
        at([w for w, _ in RV.LEXICON_WORDS], F.floor(s / 13) % len(RV.LEXICON_WORDS)).alias("apply"),
        (F.floor(s / 17) % 98 + 1).cast("string").alias("number"))
    p = (2 + F.floor(s / 6) % (F.length("a") - 3)).cast("int")
    q = q.withColumn("p", p).withColumn("typed", F.expr("concat(substr(a, 1, p - 1), substr(a, p + 1))"))
    plain, whatif = RV.TEMPLATE_PAST, RV.TEMPLATES_WHATIF[0]
    percent = F.concat("number", F.lit(" percent"))
    text = (F.when(F.col("kind") == "misspelt", C.fill(plain, F.lit("what"), F.col("typed"), F.col("time")))
            .when(F.col("kind") == "unrelated", C.fill(whatif, *map(F.col, ("u0", "u1", "apply")), percent, F.col("time")))
            .when(F.col("kind") == "no_percent", F.replace(C.fill(whatif, *map(F.col, ("r0", "r1", "apply")), F.lit("?"), F.col("time")),
                                                           F.lit(" by ?"), F.lit("")))
            .otherwise(C.fill(plain, F.lit("what"), F.concat_ws(" and the ", "a", "b"), F.col("time"))))
    return q.select("question_id", "code", "bsns_year", "kind", text.alias("text"))


def _variants(t):
    return t.derived("variants", lambda: variant_questions(t))


def _past_sql():
    return O.values_sql([(i, f"{w} {u}") for i, u, w in C.time_word_rows("FUTURE")], ["i", "phrase"], ["INTEGER", "VARCHAR"])


VARIANT_VIEWS = {
    **CORPUS_VIEWS,
    "v_base": (f"""
SELECT b.question_id, b.code, b.bsns_year, b.s, a.name AS a, c.name AS b, p.phrase, 2 + (b.s // 6) % (length(a.name) - 3) AS p,
  make_date(CAST(b.bsns_year + 1 AS INTEGER), 3, 15) AS as_of, yl.word_desc AS year_desc, ql.word_desc AS quarter_desc
FROM c_base b JOIN (SELECT COUNT(*) AS n FROM c_acc) k ON TRUE JOIN c_acc a ON a.idx = (b.s // 4) % k.n
JOIN c_acc c ON c.idx = ((b.s // 4) % k.n + 1 + (b.s // 7) % (k.n - 1)) % k.n
JOIN ({_past_sql()}) p ON p.i = (b.s // 5) % {len(C.time_word_rows("FUTURE"))}
LEFT JOIN ({_yl()}) yl ON yl.word = split_part(p.phrase, ' ', 1) LEFT JOIN ({_ql()}) ql ON ql.word = split_part(p.phrase, ' ', 1)""",
               ["c_base", "c_acc"]),
    "v_time": (time_resolve_sql("v_base", "phrase", "as_of", "year_desc", "quarter_desc"), ["v_base"]),
    "v_out": ("""
SELECT question_id, CASE s % 4 WHEN 0 THEN 'misspelt' WHEN 1 THEN 'unrelated' WHEN 2 THEN 'no_percent' ELSE 'two_accounts' END AS kind,
  CASE s % 4 WHEN 0 THEN 'PAST.value' WHEN 3 THEN 'PAST.value' ELSE 'IF.fact' END AS intent,
  CASE WHEN error IS NOT NULL THEN 'TIME' ELSE CASE s % 4 WHEN 0 THEN 'UNKNOWN_ACCOUNT' WHEN 1 THEN 'NOT_RELATED'
    WHEN 2 THEN 'MISSING_APPLY' ELSE 'ACCOUNT_COUNT' END END AS error_code,
  substr(a, 1, p - 1) || substr(a, p + 1) AS typed, a
FROM v_time""", ["v_time"]),
}


def vsql(body):
    return sql_with(["v_out"], body, extra=VARIANT_VIEWS)


@query("qa_validate_variants", vsql("SELECT question_id, kind, intent, error_code FROM v_out"))
def qa_validate_variants(t):
    """QA1: the slot rules on questions that lack or spoil a slot; intent by how the question is put."""
    v = _variants(t)
    sl = NLU.question_slots_rows(v, "question_id", "text", keep=["code", "bsns_year", "kind", "text"], near=True)
    out = QA.validate(sl.withColumn("intent", NLU.cue_intent(F.col("text"))), None, _pairs(t), t.spark)
    return out.join(v.select("question_id", "kind"), "question_id").select("question_id", "kind", "intent", "error_code")


def _named(t):
    """Account names as typed in the variant questions, with the dictionary name one edit away where they are outside it."""
    def build():
        v = _variants(t).select("question_id", "text")
        g = NLU.ngrams(v, "question_id", "text", [])
        near = NLU.near_names(g, [])
        m = NLU._exact(g, []).withColumn("name", F.lit(None).cast("string")).unionByName(near)
        kept = NLU.longest_matches(m.select("doc", "start", "end", "tag", F.concat_ws("|", "phrase", "name").alias("phrase")))
        two = F.split("phrase", r"\|")
        return kept.filter(F.col("tag").isin("IS", "BS")).select(
            F.col("doc").alias("question_id"), "start", F.get(two, F.lit(0)).alias("name"), F.get(two, F.lit(1)).alias("nearest"))
    return t.derived("named", build)


@query("account_name_unknown", vsql("SELECT question_id, typed AS name FROM v_out WHERE kind = 'misspelt'"))
def account_name_unknown(t):
    """JN6: tagged account names that resolve to no account (left anti join): reported, not dropped silently."""
    names = O.master_raw(t.spark).select(F.lower("name_eng").alias("name"))
    return _named(t).join(F.broadcast(names), "name", "left_anti").select("question_id", "name")


@query("account_name_nearest", vsql("SELECT question_id, typed AS name, a AS nearest FROM v_out WHERE kind = 'misspelt'"))
def account_name_nearest(t):
    """TX10: names outside the dictionary with the account one edit away (deletion neighbourhoods)."""
    return _named(t).filter(F.col("nearest").isNotNull()).select("question_id", "name", "nearest")
