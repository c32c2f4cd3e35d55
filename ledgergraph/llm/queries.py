"""The registered queries ``opN_<name>`` and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontam, langid, lexsearch, linededup, mincut, mixing, nearjoin, packing, prefixtrie, quality,
               rules, warc)
from .common import table


def op1_mincut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mincut.extract(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.clean(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "row.source", F.col("cleaned").alias("text"), "n_lines", "n_dropped")


def op3_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conv.schema)
    return chat.digests(chat.examples(conv.unionByName(extra)))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "score", "kept")


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return led.select("doc_id", *rules.MEASURES, "failed_bits", (~rules.verdict("base")).alias("base_failed"),
                      rules.verdict("v1").alias("kept"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_id=F.col("doc_id"))
    return out.select("doc_id", "item_id", "score", "doc_start", "item_start", "words")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return out.withColumnRenamed("key", "page_id")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.labelled(table(spark, sf_dir, "documents"))


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return out.select("row.*", "sequence_id", "offset")


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(lexsearch.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_mincut_text, op2_line_frequency, op3_prefix_examples, op4_cross_parsing, op5_cube_mix, op6_weak_label_quality,
    op7_rule_ledger, op8_spaced_seeds, op9_warc_derivatives, op10_chosen_path, op11_vector_best_fit,
    op12_block_max_search, op13_time_forward_trie)}

_WORD = r"[^\x20\x09-\x0D]+"

_ORACLE2 = """
WITH p AS (SELECT coalesce('=' || source, '') AS k, md5(text) AS page, text FROM documents WHERE text IS NOT NULL),
tot AS (SELECT k, count(DISTINCT page) AS host_pages FROM p GROUP BY k),
l AS (SELECT DISTINCT k, page, trim(unnest(string_split(text, chr(10)))) AS line FROM p),
bad AS (SELECT l.k, line FROM l JOIN tot USING (k) WHERE line <> '' AND host_pages >= 10
        GROUP BY l.k, line, host_pages HAVING count(*) >= 10 AND count(*) > 0.1 * host_pages),
per AS (SELECT k, list(line) AS bad FROM bad GROUP BY k),
d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, coalesce('=' || source, '') AS k FROM documents),
f AS (SELECT d.*, list_filter(ls, lambda x: per.bad IS NULL OR NOT list_contains(per.bad, trim(x))) AS kept
      FROM d LEFT JOIN per USING (k))
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM f"""


def _escaped(c: str) -> str:
    c = rf"replace({c}, '\', '\s')"
    for s in chat.CONTROLS:
        c = rf"replace({c}, '{s}', '{s[0]}\p{s[1:]}')"
    return c


_ORACLE3 = f"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.TURN + chat.TEXT + chat.END)} AS seg,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t0),
c AS (SELECT *, sum(seg) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
  max(k) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_ORACLE7 = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM a),
c AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) AS tri
  FROM b),
u AS (SELECT doc_id, unnest(tri) AS g, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS pos FROM r, (VALUES (0), (1), (2)) x(o))
  GROUP BY doc_id),
m AS (SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
  CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_same_next
  FROM c LEFT JOIN rep ON rep.doc_id = c.doc_id),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
  + 4 * (n_words > 1000000)::INT + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 20 * n_words)::INT
  + 32 * (10 * n_symbols > n_words)::INT + 64 * (100 * n_dup_lines > 50 * n_lines)::INT
  + 128 * (100 * n_upper > 50 * n_letters)::INT + 256 * (100 * n_same_next > 30 * n_words)::INT AS BIGINT)
  AS failed_bits FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM f"""


def _windows(src: str, key: str) -> str:
    parts = []
    for no, m in enumerate(decontam.MASKS):
        seed = " || chr(10) || ".join(f"w[p + {o + 1}]" for o, b in enumerate(m) if b == "1")
        parts.append(f"SELECT {key}, p, {no} AS mask, {seed} AS seed FROM (SELECT {key}, w, "
                     f"unnest(range(0, len(w) - {decontam.SPAN - 1})) AS p FROM {src} WHERE len(w) >= {decontam.SPAN})")
    return " UNION ALL ".join(parts)


_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
#: Items of under SPAN words need the extra windows of the operator; the given benchmark has none.
_ORACLE8 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS ({_windows('d', 'doc_id')}), bs AS ({_windows('b', 'item_id')}),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.p - bs.p AS off FROM ds JOIN bs ON ds.seed = bs.seed AND ds.mask = bs.mask),
a AS (SELECT h.doc_id, h.item_id, greatest(off, 0) AS doc_start, greatest(-off, 0) AS item_start,
  least(len(d.w) - greatest(off, 0), len(b.w) - greatest(-off, 0)) AS words, d.w AS dw, b.w AS bw
  FROM h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
s AS (SELECT doc_id, item_id, doc_start, item_start, words, len(bw) AS n, unnest(range(1, words + 1)) AS i,
  unnest(list_transform(range(1, words + 1), lambda i: CASE WHEN dw[doc_start + i] = bw[item_start + i] THEN 1 ELSE -2 END))
  AS v FROM a),
r AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, doc_start, item_start ORDER BY i) AS upto FROM s),
q AS (SELECT *, upto - least(0, min(upto) OVER (PARTITION BY doc_id, item_id, doc_start, item_start ORDER BY i)) AS sc
  FROM r),
z AS (SELECT doc_id, item_id, doc_start, item_start, words, max(sc) AS score FROM q
  GROUP BY doc_id, item_id, doc_start, item_start, words, n HAVING max(sc) >= least(10, n)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id
  ORDER BY score DESC, doc_start, item_start DESC, words DESC) AS k FROM z)
SELECT doc_id, item_id, CAST(score AS BIGINT) AS score, CAST(doc_start AS BIGINT) AS doc_start,
  CAST(item_start AS BIGINT) AS item_start, CAST(words AS BIGINT) AS words FROM o WHERE k = 1"""

_ORACLE10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u a JOIN u b
  ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM j WHERE c >= 0.8 * (nx + ny - c) - 1e-9),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS y FROM r GROUP BY x), l AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(k.y, doc_id)) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k ON k.x = doc_id LEFT JOIN l ON l.x = doc_id"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS12 = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ORACLE12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS12} AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS i, unnest({_TERMS12}) AS term
  FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, i, term),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q)
  GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, st GROUP BY term, n_docs),
s AS (SELECT q.item_id, p.r, CAST(sum(q.times * w.w *
    ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * len(d.ts) * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, st GROUP BY q.item_id, p.r),
k AS (SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score
  FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""


_ORACLE13 = rf"""
WITH RECURSIVE bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
v AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''),
    lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM n, tab),
rb AS (SELECT v.c, o.pos AS d, role, text FROM v JOIN o ON o.c = v.b AND o.pos <= v.h
  UNION ALL SELECT v.c, o.pos - v.h + least(v.h, coalesce(n.n, 0)), role, text
  FROM v JOIN o ON o.c = v.c AND o.pos > v.h LEFT JOIN n ON n.c = v.b),
p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS k,
    len(regexp_extract_all(text, '{_WORD}')) AS words FROM rb
  UNION ALL SELECT c, 0, '', 0 FROM v),
r AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '-') AS pk, d = max(d) OVER (PARTITION BY c) AS last FROM p),
t AS (SELECT k, any_value(pk) AS pk, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS own
  FROM r GROUP BY k),
ch AS (SELECT pk AS k, count(*) AS children FROM t GROUP BY pk),
s AS (SELECT r.k, sum(t.own) AS saved, count(*) FILTER (WHERE ch.children IS NULL) AS leaves
  FROM t LEFT JOIN ch ON ch.k = t.k JOIN r ON r.c = t.c AND r.d <= t.d GROUP BY r.k),
e AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM r WHERE last GROUP BY k)
SELECT t.c AS conv_id, CAST(t.d AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(t.n AS BIGINT) AS n_convs,
  CAST(coalesce(ch.children, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM t JOIN s ON s.k = t.k LEFT JOIN t up ON up.k = t.pk LEFT JOIN ch ON ch.k = t.k LEFT JOIN e ON e.k = t.k"""

ORACLES = {"op2_line_frequency": _ORACLE2, "op3_prefix_examples": _ORACLE3, "op7_rule_ledger": _ORACLE7,
           "op8_spaced_seeds": _ORACLE8, "op10_chosen_path": _ORACLE10,
           "op12_block_max_search": _ORACLE12, "op13_time_forward_trie": _ORACLE13}
