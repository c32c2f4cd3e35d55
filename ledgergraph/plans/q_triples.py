"""Triples (entity-attribute-value) derived from the driver tables: typing,
set semantics, N-Triples, subject blocks, pivots; plus lexicon lookups on the
question corpus and next-word top-k over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dialog as DL
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import sql_with
from .q_text import CORPUS_VIEWS, corpus_once
from .registry import query

NS = "http://example.org/"


def customer_triples(t):
    """(s, p, o) of the customers' attributes, from one pass over them."""
    s = F.concat(F.lit("cust:"), F.col("c_custkey").cast("string"))
    po = F.array(F.struct(F.lit("rdfs:label").alias("p"), F.col("c_name").alias("o")),
                 F.struct(F.lit("acc:segment").alias("p"), F.concat(F.lit("seg:"), "c_mktsegment").alias("o")),
                 F.struct(F.lit("acc:nation").alias("p"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("o")))
    return t.customer.select(s.alias("s"), F.explode(po).alias("x")).select("s", "x.p", "x.o")


def eav(t):
    """(s, p, o) with duplicates: customer attributes, and part brands seen from every order line."""
    li = t.lineitem.select("l_partkey")
    pa = t.part.select("p_partkey", "p_brand")
    return customer_triples(t).unionByName(li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("s"), F.lit("acc:brand").alias("p"),
        F.concat(F.lit("brand:"), F.regexp_replace("p_brand", "#", "_")).alias("o")))


_EAV = {"eav": ("""
SELECT 'cust:' || CAST(c_custkey AS VARCHAR) AS s, 'rdfs:label' AS p, c_name AS o FROM customer
UNION ALL SELECT 'cust:' || CAST(c_custkey AS VARCHAR), 'acc:segment', 'seg:' || c_mktsegment FROM customer
UNION ALL SELECT 'cust:' || CAST(c_custkey AS VARCHAR), 'acc:nation', 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'part:' || CAST(p.p_partkey AS VARCHAR), 'acc:brand', 'brand:' || replace(p.p_brand, '#', '_')
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""", [])}


def esql(body):
    return sql_with(["eav"], body, extra=_EAV)


def _local(c):
    return F.expr(f"substring({c}, instr({c}, ':') + 1)")


@query("scan_triples", esql("""
SELECT DISTINCT s, p, o, strpos(o, ':') = 0 AS o_is_literal,
       CASE WHEN strpos(o, ':') > 0 THEN split_part(o, ':', 1) END AS o_prefix,
       CASE WHEN strpos(o, ':') > 0 THEN substr(o, strpos(o, ':') + 1) ELSE o END AS o_local FROM eav"""))
def scan_triples(t):
    """SRC2/Q27: type each object as IRI (prefix:local, split on the first ':') or literal."""
    e = eav(t).distinct()
    iri = F.instr("o", ":") > 0
    return e.select("s", "p", "o", (~iri).alias("o_is_literal"),
                    F.when(iri, F.substring_index("o", ":", 1)).alias("o_prefix"),
                    F.when(iri, _local("o")).otherwise(F.col("o")).alias("o_local"))


@query("triples_distinct", esql("SELECT p, COUNT(*) AS n_rows, COUNT(DISTINCT s || '|' || o) AS n_distinct FROM eav GROUP BY p"))
def triples_distinct(t):
    """SO4: a graph is a set of triples — rows vs distinct triples per predicate, from one count of each triple."""
    each = eav(t).groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("p").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))


def _iri_sql(c):
    return f"'<{NS}' || split_part({c}, ':', 1) || '#' || substr({c}, strpos({c}, ':') + 1) || '>'"


def _iri(c):
    return F.concat(F.lit("<" + NS), F.substring_index(c, ":", 1), F.lit("#"), _local(c), F.lit(">"))


@query("triples_to_ntriples", esql(f"""
SELECT DISTINCT {_iri_sql('s')} || ' ' || {_iri_sql('p')} || ' ' ||
       CASE WHEN strpos(o, ':') > 0 THEN {_iri_sql('o')} ELSE '"' || o || '"' END || ' .' AS line FROM eav"""))
def triples_to_ntriples(t):
    """SNK7: N-Triples lines of the distinct triples (objects without ':' are literals)."""
    e = eav(t).distinct()
    obj = F.when(F.instr("o", ":") > 0, _iri("o")).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))
    return e.select(F.concat_ws(" ", _iri("s"), _iri("p"), obj, F.lit(".")).alias("line"))


@query("triples_subject_blocks", esql("""
SELECT s, string_agg(p || ' ' || o, ' ; ' ORDER BY p, o) AS block, COUNT(*) AS n
FROM (SELECT DISTINCT s, p, o FROM eav) x GROUP BY s"""))
def triples_subject_blocks(t):
    """SNK7: Turtle-like blocks grouped by subject (a subject has a handful of triples: bounded groups)."""
    e = eav(t).distinct()
    g = e.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("po"), F.count(F.lit(1)).alias("n"))
    return g.select("s", F.array_join(F.transform("po", lambda x: F.concat_ws(" ", x.p, x.o)), " ; ").alias("block"), "n")


@query("node_properties_pivot", esql("""
SELECT s, MAX(CASE WHEN p = 'rdfs:label' THEN o END) AS label, MAX(CASE WHEN p = 'acc:segment' THEN o END) AS segment,
       MAX(CASE WHEN p = 'acc:nation' THEN o END) AS nation
FROM eav WHERE s LIKE 'cust:%' GROUP BY s"""))
def node_properties_pivot(t):
    """GR4: EAV -> one row per subject with a column per property (pivot with a fixed value list)."""
    pv = customer_triples(t).groupBy("s").pivot("p", ["rdfs:label", "acc:segment", "acc:nation"]).agg(F.max("o"))
    return pv.select("s", F.col("rdfs:label").alias("label"), F.col("acc:segment").alias("segment"),
                     F.col("acc:nation").alias("nation"))


# ------------------------------------------------------------------ lexicon lookups on the corpus
def _lex_sql():
    return O.lexicon_sql()


@query("lexicon_lookup", sql_with(["c_slots", "onto_lexicon"], """
SELECT s.question_id, split_part(s.time_phrase, ' ', 1) AS word, split_part(s.time_phrase, ' ', 2) AS unit, l.word_desc
FROM c_slots s LEFT JOIN onto_lexicon l ON l.kind = split_part(s.time_phrase, ' ', 2)
 AND l.word = split_part(s.time_phrase, ' ', 1)""", extra=CORPUS_VIEWS))
def lexicon_lookup(t):
    """JN7/Q10: time word -> description, keyed by (unit, word) so a word listed per unit resolves per unit."""
    c = corpus_once(t).select("question_id", F.split("time_phrase", " ").alias("w"))
    c = c.select("question_id", F.col("w")[0].alias("word"), F.col("w")[1].alias("unit"))
    lex = O.lexicon(t.spark).select(F.col("kind").alias("unit"), "word", "word_desc")
    return c.join(F.broadcast(lex), ["unit", "word"], "left").select("question_id", "word", "unit", "word_desc")


@query("ordinal_to_quarter", sql_with(["c_slots"], """
SELECT question_id, split_part(time_phrase, ' ', 1) AS word, CASE """ + " ".join(
    f"WHEN split_part(time_phrase, ' ', 1) = '{w}' THEN {q}" for q, w in RV.QUARTER_ORDINALS) + """ ELSE 4 END AS qnum
FROM c_slots WHERE split_part(time_phrase, ' ', 2) = 'quarter'""", extra=CORPUS_VIEWS))
def ordinal_to_quarter(t):
    """SC10/Q11: ordinal word -> quarter number (no match -> 4) for every quarter phrase asked."""
    c = corpus_once(t).filter(F.split("time_phrase", " ")[1] == "quarter")
    w = F.split("time_phrase", " ")[0]
    return c.select("question_id", w.alias("word"), DL.ordinal_to_quarter(w).alias("qnum"))


# ------------------------------------------------------------------ next-word top-k over documents
_WSR = r"[ \t\n\r\f]"


@query("topk_context_fill", f"""
WITH toks AS (
  SELECT doc_id, piece, token FROM (
    SELECT doc_id, unnest(string_split_regex(lower(text), '{_WSR}')) AS token,
           generate_subscripts(string_split_regex(lower(text), '{_WSR}'), 1) AS piece FROM documents) x
  WHERE length(token) > 0),
big AS (SELECT token AS context, LEAD(token) OVER (PARTITION BY doc_id ORDER BY piece) AS next_word FROM toks),
cnt AS (SELECT context, next_word, COUNT(*) AS n FROM big WHERE next_word IS NOT NULL GROUP BY 1, 2)
SELECT context, next_word, n, rk FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY context ORDER BY n DESC, next_word) AS rk FROM cnt) y WHERE rk <= 5""")
def topk_context_fill(t):
    """ST4 (re-aimed): the k=5 most frequent next words of every word, from bigram counts over whole documents."""
    d = t.documents.select("doc_id", F.posexplode(F.split(F.lower("text"), _WSR, -1)).alias("piece", "token"))
    d = d.filter(F.length("token") > 0)
    w = Window.partitionBy("doc_id").orderBy("piece")
    b = d.select(F.col("token").alias("context"), F.lead("token").over(w).alias("next_word")).filter(
        F.col("next_word").isNotNull())
    cnt = b.groupBy("context", "next_word").agg(F.count(F.lit(1)).alias("n"))  # partial aggregation map-side
    rk = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), "next_word"))
    return cnt.withColumn("rk", rk).filter(F.col("rk") <= 5)
