"""Corpus generation, annotation and text jobs (CG*, TX*, SC3-SC6, ST3, SO3, AG6, JN5, JN9, JN10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import graph as G
from ..operators import text as TX
from ..sources import io as IO
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import sql_with
from .registry import query


def _pairs(t):
    def build():
        c = O.all_roles_closure_df(t.spark)
        return C.pairs_df(c.select(F.col("ancestor").alias("target"), F.col("descendant").alias("subject")))
    return O.cached(t.spark, "qa_pairs", build)


def corpus(t, complex_tags: bool = False):
    """The corpus written once, for queries that read it several times."""
    return t.derived(f"corpus{complex_tags}", lambda: corpus_once(t, complex_tags), checkpoint=True)


def corpus_once(t, complex_tags: bool = False):
    """The corpus for one pass: not stored, so a query's filter and columns reach into its generation."""
    return C.build(t.fin_filing, t.spark, _pairs(t), complex_tags)


# ------------------------------------------------------------------------------------------ SQL twin
def _acc_sql():
    return O.values_sql(C.account_rows(), ["idx", "acc", "name", "statement", "kind"],
                        ["INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"])


def _tw_sql(excl):
    return O.values_sql(C.time_word_rows(excl), ["tw_idx", "unit", "t_word"], ["INTEGER", "VARCHAR", "VARCHAR"])


def _fmt(t):
    return t.replace("{}", "%s").replace("'", "''")


_W = RV.TEMPLATES_WHATIF
_MK = "'[E]' || {} || '[/E]'"


def _m(c):
    return _MK.format(c)


CORPUS_VIEWS = {
    "c_acc": (_acc_sql(), []),
    "c_pw": (_tw_sql("FUTURE"), []),
    "c_fw": (_tw_sql("PAST"), []),
    "c_ap": (O.values_sql([(i, w, d) for i, (w, d) in enumerate(RV.LEXICON_WORDS)], ["ap_idx", "apply_word", "apply_desc"],
                          ["INTEGER", "VARCHAR", "VARCHAR"]), []),
    "c_edges": ("SELECT child, parent FROM onto_edges WHERE child <> 'CalendarOneYear' AND parent <> 'CalendarOneYear'",
                ["onto_edges"]),
    "c_paths": ("SELECT parent AS target, child AS subject FROM c_edges UNION ALL "
                "SELECT e.parent, p.subject FROM c_paths p JOIN c_edges e ON e.child = p.target", ["c_edges"]),
    "c_pairs": ("SELECT p.target, p.subject, t.name AS t_name, t.statement AS t_st, t.kind AS t_kind, s.name AS s_name, "
                "s.statement AS s_st, s.kind AS s_kind, CAST(ROW_NUMBER() OVER (ORDER BY p.target, p.subject) - 1 AS INTEGER) AS idx "
                "FROM (SELECT DISTINCT target, subject FROM c_paths) p JOIN c_acc t ON t.acc = p.target "
                "JOIN c_acc s ON s.acc = p.subject", ["c_paths", "c_acc"]),
    "c_base": ("SELECT code, rpid AS question_id, bsns_year, quarter, CAST(code AS BIGINT) * 7 + CAST(bsns_year AS BIGINT) * 13 "
               "+ CAST(substr(quarter, 1, 1) AS BIGINT) * 31 AS s FROM fin_filing", ["fin_filing"]),
    "c_q": (f"""
SELECT b.code, b.question_id, b.bsns_year, b.quarter,
  CASE b.s % 3 WHEN 0 THEN 'PAST.value' WHEN 1 THEN 'IF.fact' ELSE 'IF.forecast' END AS intent,
  CASE (b.s // 2) % 2 WHEN 0 THEN '{RV.QUESTION_WORDS[0]}' ELSE '{RV.QUESTION_WORDS[1]}' END AS qword,
  CAST((b.s // 11) % {len(_W)} AS INTEGER) AS tmpl,
  a.acc AS a_acc, a.name AS a_name, a.statement AS a_st, a.kind AS a_kind,
  pr.target, pr.subject, pr.t_name, pr.t_st, pr.t_kind, pr.s_name, pr.s_st, pr.s_kind,
  pw.t_word || ' ' || pw.unit AS p_phrase, fw.t_word || ' ' || fw.unit AS f_phrase,
  ap.apply_word, ap.apply_desc, CAST((b.s // 17) % 98 + 1 AS INTEGER) AS number,
  CASE (b.s // 19) % 2 WHEN 0 THEN '{RV.PERCENT_WORDS[0]}' ELSE '{RV.PERCENT_WORDS[1]}' END AS pword
FROM c_base b
JOIN c_acc a ON a.idx = (b.s // 3) % (SELECT COUNT(*) FROM c_acc)
JOIN c_pairs pr ON pr.idx = (b.s // 3) % (SELECT COUNT(*) FROM c_pairs)
JOIN c_pw pw ON pw.tw_idx = (b.s // 5) % (SELECT COUNT(*) FROM c_pw)
JOIN c_fw fw ON fw.tw_idx = (b.s // 5) % (SELECT COUNT(*) FROM c_fw)
JOIN c_ap ap ON ap.ap_idx = (b.s // 13) % {len(RV.LEXICON_WORDS)}""", ["c_base", "c_acc", "c_pairs", "c_pw", "c_fw", "c_ap"]),
    "c_slots": ("""
SELECT code, question_id, bsns_year, quarter, intent, qword, tmpl,
  CASE WHEN intent = 'IF.forecast' THEN f_phrase ELSE p_phrase END AS time_phrase,
  CASE WHEN intent = 'IF.fact' THEN target ELSE a_acc END AS target,
  CASE WHEN intent = 'IF.fact' THEN t_name ELSE a_name END AS target_name,
  CASE WHEN intent = 'IF.fact' THEN t_st ELSE a_st END AS target_st,
  CASE WHEN intent = 'IF.fact' THEN t_kind ELSE a_kind END AS target_kind,
  CASE WHEN intent = 'IF.fact' THEN subject END AS subject,
  CASE WHEN intent = 'IF.fact' THEN s_name END AS subject_name,
  CASE WHEN intent = 'IF.fact' THEN s_st END AS subject_st,
  CASE WHEN intent = 'IF.fact' THEN s_kind END AS subject_kind,
  CASE WHEN intent = 'IF.fact' THEN apply_word END AS apply_word,
  CASE WHEN intent = 'IF.fact' THEN apply_desc END AS apply_desc,
  CASE WHEN intent = 'IF.fact' THEN CAST(number AS VARCHAR) || ' ' || pword END AS percent,
  CASE WHEN intent = 'IF.fact' THEN number END AS number
FROM c_q""", ["c_q"]),
    "c_marked": (f"""
SELECT *, CASE
  WHEN intent = 'PAST.value' THEN printf('{_fmt(RV.TEMPLATE_PAST)}', qword, {_m('target_name')}, {_m('time_phrase')})
  WHEN intent = 'IF.fact' THEN CASE tmpl
    WHEN 0 THEN printf('{_fmt(_W[0])}', {_m('target_name')}, {_m('subject_name')}, {_m('apply_word')}, {_m('percent')}, {_m('time_phrase')})
    WHEN 1 THEN printf('{_fmt(_W[1])}', {_m('target_name')}, {_m('subject_name')}, {_m('apply_word')}, {_m('percent')}, {_m('time_phrase')})
    WHEN 2 THEN printf('{_fmt(_W[2])}', {_m('subject_name')}, {_m('apply_word')}, {_m('percent')}, {_m('time_phrase')}, {_m('target_name')})
    ELSE printf('{_fmt(_W[3])}', {_m('subject_name')}, {_m('apply_word')}, {_m('percent')}, {_m('time_phrase')}, {_m('target_name')}) END
  ELSE printf('{_fmt(RV.TEMPLATE_FORECAST)}', qword, {_m('target_name')}, {_m('time_phrase')}) END AS marked_text
FROM c_slots""", ["c_slots"]),
    "c_ent0": ("""
SELECT question_id, surface, tag, strpos(marked_text, '[E]' || surface || '[/E]') - 1 AS start,
       strpos(marked_text, '[E]' || surface || '[/E]') - 1 + length('[E]' || surface || '[/E]') AS "end"
FROM (SELECT question_id, marked_text, target_name AS surface, target_st AS tag FROM c_marked
      UNION ALL SELECT question_id, marked_text, subject_name, subject_st FROM c_marked WHERE subject_name IS NOT NULL
      UNION ALL SELECT question_id, marked_text, apply_word, 'APPLY' FROM c_marked WHERE apply_word IS NOT NULL
      UNION ALL SELECT question_id, marked_text, percent, 'PERCENT' FROM c_marked WHERE percent IS NOT NULL
      UNION ALL SELECT question_id, marked_text, time_phrase, 'TIME' FROM c_marked) x""", ["c_marked"]),
    "c_ent": ("""
SELECT question_id, surface, tag, start AS m_start, "end" AS m_end, i,
       start - i * 7 AS start, start - i * 7 + ("end" - start) - 7 AS "end"
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY start, "end", tag) - 1 AS INTEGER) AS i FROM c_ent0) y""",
              ["c_ent0"]),
    "c_corpus": ("""
SELECT m.*, replace(replace(m.marked_text, '[E]', ''), '[/E]', '') AS text,
       (SELECT string_agg(CAST(e.start AS VARCHAR) || ',' || CAST(e."end" AS VARCHAR) || ',' || e.tag, ';' ORDER BY e.i)
        FROM c_ent e WHERE e.question_id = m.question_id) AS entities_str
FROM c_marked m""", ["c_marked", "c_ent"]),
}


def csql(names, body):
    return sql_with(names, body, extra=CORPUS_VIEWS)


def _corpus_out(df, intent):
    return df.filter(F.col("intent") == intent).select("question_id", "code", "text",
                                                       C.entities_string(F.col("entities")).alias("entities"), "intent")


@query("corpus_past", csql(["c_corpus"], "SELECT question_id, code, text, entities_str AS entities, intent FROM c_corpus "
                                         "WHERE intent = 'PAST.value'"))
def corpus_past(t):
    """CG1: 'what is X in <time>' questions (non-FUTURE time words), intent PAST.value."""
    return _corpus_out(corpus_once(t), "PAST.value")


@query("corpus_whatif", csql(["c_corpus"], "SELECT question_id, code, text, entities_str AS entities, intent FROM c_corpus "
                                           "WHERE intent = 'IF.fact'"))
def corpus_whatif(t):
    """CG2: what-if questions over (target, descendant) pairs with apply word and 1–98 percent."""
    return _corpus_out(corpus_once(t), "IF.fact")


@query("corpus_forecast", csql(["c_corpus"], "SELECT question_id, code, text, entities_str AS entities, intent FROM c_corpus "
                                             "WHERE intent = 'IF.forecast'"))
def corpus_forecast(t):
    """CG3: forecast questions (non-PAST time words), intent IF.forecast."""
    return _corpus_out(corpus_once(t), "IF.forecast")


@query("corpus_distinct", csql(["c_corpus"], "SELECT DISTINCT text, entities_str AS entities, intent FROM c_corpus"))
def corpus_distinct(t):
    """SO3: distinct on the nested record (text, entities, intent) — a hash aggregate, not a quadratic scan."""
    c = corpus_once(t)
    return c.select("text", "entities", "intent").dropDuplicates().select(
        "text", C.entities_string(F.col("entities")).alias("entities"), "intent")


@query("template_format", csql(["c_marked"], "SELECT question_id, marked_text FROM c_marked"))
def template_format(t):
    """SC3: template formatting with entity markers."""
    return C.generate(t.fin_filing, t.spark, _pairs(t)).select("question_id", "marked_text")


@query("entity_locate", csql(["c_ent"], 'SELECT question_id, surface, tag, m_start AS start, m_end AS "end" FROM c_ent'))
def entity_locate(t):
    """SC4: span of the first occurrence of each marked entity in the marked text."""
    c = C.locate_entities(C.generate(t.fin_filing, t.spark, _pairs(t)))
    e = c.select("question_id", "marked_text", F.explode("marked_entities").alias("e"))
    surface = F.expr("substring(marked_text, e.start + 4, e.`end` - e.start - 7)")
    return e.select("question_id", surface.alias("surface"), F.col("e.tag").alias("tag"),
                    F.col("e.start").alias("start"), F.col("e.end").alias("end"))


@query("entities_sorted", csql(["c_ent"], "SELECT question_id, i AS ordinal, tag, m_start AS start FROM c_ent"))
def entities_sorted(t):
    """ST3/WN3: entities ordered by start with their ordinal (array_sort + posexplode)."""
    c = C.locate_entities(C.generate(t.fin_filing, t.spark, _pairs(t)))
    e = c.select("question_id", F.posexplode("marked_entities").alias("ordinal", "e"))
    return e.select("question_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("e.tag").alias("tag"),
                    F.col("e.start").alias("start"))


@query("entity_marker_shift", csql(["c_ent", "c_corpus"], """
SELECT e.question_id, e.i AS ordinal, e.start, e."end", e.tag, substr(c.text, e.start + 1, e."end" - e.start) AS span_text,
       substr(c.text, e.start + 1, e."end" - e.start) = e.surface AS span_ok
FROM c_ent e JOIN c_corpus c ON c.question_id = e.question_id"""))
def entity_marker_shift(t):
    """CG5/SC5: strip markers, shift spans by ordinal × 7 and check the span text equals the entity."""
    c = corpus_once(t)
    e = c.select("question_id", "text", "marked_text", F.posexplode("entities").alias("ordinal", "e"),
                 F.col("marked_entities"))
    span = F.expr("substring(text, e.start + 1, e.`end` - e.start)")
    surface = F.expr("substring(marked_text, element_at(marked_entities, ordinal + 1).start + 4, "
                     "element_at(marked_entities, ordinal + 1).`end` - element_at(marked_entities, ordinal + 1).start - 7)")
    return e.select("question_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("e.start").alias("start"),
                    F.col("e.end").alias("end"), F.col("e.tag").alias("tag"), span.alias("span_text"),
                    (span == surface).alias("span_ok"))


@query("marker_strip", csql(["c_corpus"], "SELECT question_id, text FROM c_corpus"))
def marker_strip(t):
    """SC6: remove the entity markers from the text."""
    return corpus_once(t).select("question_id", "text")


@query("span_text", csql(["c_ent", "c_corpus"], """
SELECT e.question_id, e.i AS ordinal, substr(c.text, e.start + 1, e."end" - e.start) AS span
FROM c_ent e JOIN c_corpus c ON c.question_id = e.question_id"""))
def span_text(t):
    """SC5: slice the text by a half-open 0-based span."""
    e = corpus_once(t).select("question_id", "text", F.posexplode("entities").alias("ordinal", "e"))
    return e.select("question_id", F.col("ordinal").cast("int").alias("ordinal"),
                    F.expr("substring(text, e.start + 1, e.`end` - e.start)").alias("span"))


@query("entity_tag_complex", csql(["c_ent", "c_slots"], """
SELECT e.question_id, e.i AS ordinal,
       CASE WHEN e.tag IN ('BS', 'IS') THEN e.tag || '.' ||
            CASE WHEN e.surface = s.target_name THEN s.target_kind ELSE s.subject_kind END ELSE e.tag END AS tag
FROM c_ent e JOIN c_slots s ON s.question_id = e.question_id"""))
def entity_tag_complex(t):
    """CG7: complex knowledge tags ('IS.Value') instead of simple ones ('IS')."""
    c = C.locate_entities(C.generate(t.fin_filing, t.spark, _pairs(t)), complex_tags=True)
    e = c.select("question_id", F.posexplode("marked_entities").alias("ordinal", "e"))
    return e.select("question_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("e.tag").alias("tag"))


@query("entity_filter_hof", csql(["c_ent"], """
SELECT question_id, string_agg(tag || '@' || CAST(start AS VARCHAR), ';' ORDER BY i) AS account_entities
FROM c_ent WHERE tag IN ('IS', 'BS') GROUP BY question_id"""))
def entity_filter_hof(t):
    """PF8: keep only IS/BS entity spans with a higher-order ``filter`` on the array (no explode)."""
    c = corpus_once(t)
    f = F.filter("entities", lambda e: e.tag.isin("IS", "BS"))
    return c.select("question_id", F.array_join(F.transform(f, lambda e: F.concat(e.tag, F.lit("@"), e.start.cast("string"))),
                                                ";").alias("account_entities"))


# --------------------------------------------------------------------------------- split & counts
SPLIT_VIEWS = {
    "c_ranked": ("SELECT question_id, intent, text, ROW_NUMBER() OVER (PARTITION BY intent ORDER BY md5(question_id), question_id) AS r, "
                 "COUNT(*) OVER (PARTITION BY intent) AS n FROM c_corpus", ["c_corpus"]),
    "c_split": ("SELECT question_id, intent, text, CASE WHEN r <= CAST(ceil(0.05 * n) AS BIGINT) THEN 'test' "
                "WHEN r <= CAST(ceil(0.05 * n) AS BIGINT) + CAST(ceil(0.1 * (n - CAST(ceil(0.05 * n) AS BIGINT))) AS BIGINT) "
                "THEN 'valid' ELSE 'train' END AS split FROM c_ranked", ["c_ranked"]),
}


def ssql(names, body):
    return sql_with(names, body, extra={**CORPUS_VIEWS, **SPLIT_VIEWS})


def split(t):
    return t.derived("split", lambda: TX.stratified_split(corpus(t), "intent", "question_id", test=0.05, valid=0.1))


@query("split_stratified", ssql(["c_split"], "SELECT question_id, intent, split FROM c_split"))
def split_stratified(t):
    """CG6: exact stratified split (5 % test, then 10 % of the rest valid) by a hash order within each intent."""
    return split(t).select("question_id", "intent", "split")


@query("split_semi_anti", ssql(["c_split", "c_corpus"], """
SELECT 'train_by_anti' AS name, COUNT(*) AS n FROM c_corpus c
WHERE NOT EXISTS (SELECT 1 FROM c_split s WHERE s.question_id = c.question_id AND s.split <> 'train')
UNION ALL SELECT 'test_by_semi', COUNT(*) FROM c_corpus c
WHERE EXISTS (SELECT 1 FROM c_split s WHERE s.question_id = c.question_id AND s.split = 'test')"""))
def split_semi_anti(t):
    """JN5: membership of rows in a split by left-semi / left-anti joins on the row id."""
    c = corpus(t).select("question_id")
    s = split(t).select("question_id", "split")
    held = s.filter(F.col("split") != "train").select("question_id")
    test = s.filter(F.col("split") == "test").select("question_id")
    a = c.join(held, "question_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("train_by_anti").alias("name"), "n")
    b = c.join(test, "question_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("test_by_semi").alias("name"), "n")
    return a.unionByName(b)


@query("class_counts_intent", ssql(["c_split"], "SELECT split, intent, COUNT(*) AS n FROM c_split GROUP BY 1, 2"))
def class_counts_intent(t):
    """AG6: intent frequency per split."""
    return split(t).groupBy("split", "intent").agg(F.count(F.lit(1)).alias("n"))


@query("class_counts_tag", ssql(["c_split", "c_ent"],
       "SELECT s.split, e.tag, COUNT(*) AS n FROM c_split s JOIN c_ent e ON e.question_id = s.question_id GROUP BY 1, 2"))
def class_counts_tag(t):
    """AG6: entity-tag frequency per split (explode + group)."""
    s = split(t)
    return s.select("split", F.explode("entities").alias("e")).groupBy("split", F.col("e.tag").alias("tag")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("class_counts_account", ssql(["c_split", "c_ent"], """
SELECT s.split, substr(s.text, e.start + 1, e."end" - e.start) AS account, COUNT(*) AS n
FROM c_split s JOIN c_ent e ON e.question_id = s.question_id WHERE e.tag IN ('IS', 'BS') GROUP BY 1, 2"""))
def class_counts_account(t):
    """AG6: account-string frequency per split (substring by span)."""
    s = split(t)
    e = s.select("split", "text", F.explode(F.filter("entities", lambda x: x.tag.isin("IS", "BS"))).alias("e"))
    return e.groupBy("split", F.expr("substring(text, e.start + 1, e.`end` - e.start)").alias("account")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("utterances_to_json", csql(["c_corpus"], "SELECT text, entities_str AS entities, intent FROM c_corpus"))
def utterances_to_json(t):
    """SNK5/SRC5: write the corpus as JSON lines (entities as mixed arrays) and read it back typed."""
    c = corpus_once(t).select("text", "entities", "intent")
    path = IO.scratch_path(t.spark, "utterances")
    IO.write_utterances_json(c, path)
    return IO.read_utterances_json(t.spark, path).select("text", C.entities_string(F.col("entities")).alias("entities"),
                                                         "intent")
