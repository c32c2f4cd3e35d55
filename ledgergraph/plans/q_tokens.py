"""Token-level jobs on documents and on the question corpus (TX1-TX12, JN6, JN9, JN10, WN4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as IV
from ..operators import nlu as NLU
from ..operators import text as TX
from ..session import stored
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import sql_with
from .q_text import CORPUS_VIEWS, SPLIT_VIEWS, corpus, corpus_once, split
from .registry import query

_WS = r"[ \t\n\r\f]"


def _tok_sql(src: str, doc: str, text: str) -> str:
    return f"""
SELECT doc, CAST(ROW_NUMBER() OVER (PARTITION BY doc ORDER BY piece) - 1 AS INTEGER) AS pos, token,
       CAST(start AS INTEGER) AS start, CAST(start + length(token) AS INTEGER) AS "end"
FROM (SELECT doc, piece, token, COALESCE(SUM(length(token) + 1) OVER (PARTITION BY doc ORDER BY piece
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT {doc} AS doc, unnest(string_split_regex({text}, '{_WS}')) AS token,
                   generate_subscripts(string_split_regex({text}, '{_WS}'), 1) AS piece FROM {src}) p) s
WHERE length(token) > 0"""


def _gaz_rows():
    return NLU.gazetteer_rows()


TOKEN_VIEWS = {
    **CORPUS_VIEWS,
    "q_tok": (_tok_sql("c_corpus", "question_id", "regexp_replace(text, '[?,]', ' ', 'g')"), ["c_corpus"]),
    "q_bil": ("""
SELECT t.doc, t.pos, t.token, t.start, t."end",
       CASE WHEN e.tag IS NULL THEN 'O'
            ELSE CASE WHEN MIN(t.pos) OVER w = MAX(t.pos) OVER w THEN 'U' WHEN t.pos = MIN(t.pos) OVER w THEN 'B'
                      WHEN t.pos = MAX(t.pos) OVER w THEN 'L' ELSE 'I' END || '-' || e.tag END AS tag
FROM q_tok t LEFT JOIN c_ent e ON e.question_id = t.doc AND t.start >= e.start AND t."end" <= e."end"
WINDOW w AS (PARTITION BY t.doc, e.start)""", ["q_tok", "c_ent"]),
    "q_iob": ("SELECT *, CASE WHEN tag = 'O' THEN tag WHEN substr(tag, 1, 1) = 'U' THEN 'B-' || split_part(tag, '-', 2) "
              "WHEN substr(tag, 1, 1) = 'L' THEN 'I-' || split_part(tag, '-', 2) ELSE tag END AS iob FROM q_bil", ["q_bil"]),
    "q_gaz": (O.values_sql(_gaz_rows(), ["phrase", "tag"], ["VARCHAR", "VARCHAR"]), []),
    "q_list": ("""
SELECT doc, list(token ORDER BY pos) AS t, list(start ORDER BY pos) AS s, list("end" ORDER BY pos) AS e FROM q_tok GROUP BY doc""",
               ["q_tok"]),
    "q_ngram": (f"""
SELECT doc, i - 1 AS p0, i - 1 + k AS p1, array_to_string(t[i:i + k], ' ') AS phrase, s[i] AS start, e[i + k] AS "end"
FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM q_list) x JOIN range({NLU.max_gazetteer_tokens()}) r(k) ON i + k <= len(t)""",
                ["q_list"]),
    "q_match": ("""
SELECT n.doc, n.start, n."end", g.tag, n.phrase FROM q_ngram n JOIN q_gaz g ON g.phrase = n.phrase
UNION ALL
SELECT doc, start, "end", 'PERCENT', phrase FROM q_ngram WHERE regexp_full_match(phrase, '[0-9]+ (percent|%)')""",
                ["q_ngram", "q_gaz"]),
    "q_longest": ("""
SELECT m.* FROM q_match m WHERE NOT EXISTS (
  SELECT 1 FROM q_match o WHERE o.doc = m.doc AND o.start <= m.start AND o."end" >= m."end"
    AND (o."end" - o.start) > (m."end" - m.start))""", ["q_match"]),
}


def tsql(names, body):
    return sql_with(names, body, extra={**TOKEN_VIEWS, **SPLIT_VIEWS})


def _qtok(t):
    def build():
        c = corpus(t).select("question_id", F.regexp_replace("text", "[?,]", " ").alias("norm"))
        return TX.tokenize_offsets(c, "question_id", "norm")
    return t.derived("qtok", build)


def _all_matches(t):
    """Every dictionary/percent match in every question (stored: both sides of a self join read it)."""
    return t.derived("all_matches", lambda: NLU.match_rows(corpus_once(t), "question_id", "text"), checkpoint=True)


def _in_rows(t, *keep):
    """One row per question: (doc, *keep, its dictionary/percent matches), tagged in the pass that makes it."""
    return NLU.with_matches(corpus_once(t).withColumnRenamed("question_id", "doc"), "text", ["doc", *keep])


def _matches(t):
    return t.derived("matches", lambda: NLU.longest_matches(_in_rows(t)))


def _spans(t):
    c = corpus(t).select("question_id", F.explode("entities").alias("e"))
    return c.select(F.col("question_id").alias("doc"), F.col("e.start").alias("s_start"),
                    F.col("e.end").alias("s_end"), F.col("e.tag").alias("label"))


def _tagged(t, c, *keep):
    """One row per question of the corpus ``c``: (doc, *keep, tokens with their tags)."""
    return TX.tag_texts(c.select(F.col("question_id").alias("doc"), *keep, F.regexp_replace("text", "[?,]", " ").alias("norm"), "entities"),
                        "norm", "entities")


def _biluo(t):
    """A row per token; texts are dealt by question, so that windows over a question's tokens need no shuffle."""
    c = corpus(t).select("question_id", "text", "entities").repartition("question_id")
    return _tagged(t, c).select("doc", F.explode("tokens").alias("x")).select("doc", *[f"x.{c}" for c in ("pos", "token", "start", "end", "tag")])


@query("tokenize_offsets", _tok_sql("documents", "doc_id", "text"))
def tokenize_offsets(t):
    """TX1/UD4: whitespace tokens of every whole document with character offsets."""
    return TX.tokenize_offsets(t.documents, "doc_id", "text")


@query("spans_to_biluo", tsql(["q_bil"], "SELECT doc AS question_id, pos, token, tag FROM q_bil"))
def spans_to_biluo(t):
    """TX2/JN9: entity spans -> BILUO token tags by an interval join carrying the document key."""
    return _biluo(t).select(F.col("doc").alias("question_id"), "pos", "token", "tag")


@query("span_interval_join", tsql(["q_tok", "c_ent"], """
SELECT t.doc AS question_id, t.pos, e.tag, e.start AS span_start FROM q_tok t
JOIN c_ent e ON e.question_id = t.doc AND t.start >= e.start AND t."end" <= e."end\""""))
def span_interval_join(t):
    """JN9: tokens contained in entity spans (equi-join on the document + range filter)."""
    j = IV.containing(_qtok(t), _spans(t))
    return j.select(F.col("doc").alias("question_id"), "pos", F.col("label").alias("tag"), F.col("s_start").alias("span_start"))


_SENTENCES = _tok_sql("documents", "doc_id", "text").replace(_WS, r"[.!?\n]")
DOCUMENT_VIEWS = {
    "d_tok": (_tok_sql("documents", "doc_id", "text"), []),
    "d_sent": (_SENTENCES, []),
    "d_chunk": ("""
SELECT doc_id AS doc, k * 384 AS start, least(k * 384 + 512, n) AS "end" FROM (
  SELECT doc_id, length(text) AS n, unnest(range(CAST(ceil(length(text) / 384.0) AS BIGINT))) AS k FROM documents) x""", []),
}


def _sentences(t, prefix):
    s = TX.tokenize_offsets(t.documents, "doc_id", "text", sep=r"[.!?\n]")
    return s.select("doc", F.col("start").alias(f"{prefix}_start"), F.col("end").alias(f"{prefix}_end"))


@query("span_interval_join_documents", sql_with(["d_tok", "d_sent"], """
SELECT t.doc AS doc_id, t.pos, s.start AS span_start FROM d_tok t
JOIN d_sent s ON s.doc = t.doc AND t.start >= s.start AND t."end" <= s."end\"""", extra=DOCUMENT_VIEWS))
def span_interval_join_documents(t):
    """JN9: tokens of every whole document within its sentences; the join goes by blocks of characters."""
    j = IV.containing(TX.tokenize_offsets(t.documents, "doc_id", "text"), _sentences(t, "s"))
    return j.select(F.col("doc").alias("doc_id"), "pos", F.col("s_start").alias("span_start"))


@query("span_overlap_pairs_documents", sql_with(["d_chunk", "d_sent"], """
SELECT c.doc AS doc_id, c.start AS chunk_start, s.start AS sentence_start,
  CAST(least(c."end", s."end") - greatest(c.start, s.start) AS BIGINT) AS shared
FROM d_chunk c JOIN d_sent s ON s.doc = c.doc AND c.start < s."end" AND s.start < c."end\"""", extra=DOCUMENT_VIEWS))
def span_overlap_pairs_documents(t):
    """JN10: overlapping chunks of 512 characters (a new one every 384) against the sentences that they cut or hold."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / 384) - 1)).alias("k")
    c = t.documents.filter(F.length("text") > 0).select(F.col("doc_id").alias("doc"), F.length("text").alias("n"), k).select(
        "doc", (F.col("k") * 384).alias("a_start"), F.least(F.col("k") * 384 + 512, F.col("n")).alias("a_end"))
    j = IV.overlapping(c, _sentences(t, "b"))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return j.select(F.col("doc").alias("doc_id"), F.col("a_start").alias("chunk_start"), F.col("b_start").alias("sentence_start"),
                    shared.cast("long").alias("shared"))


@query("biluo_to_iob", tsql(["q_iob"], "SELECT doc AS question_id, pos, tag AS biluo, iob FROM q_iob"))
def biluo_to_iob(t):
    """TX3: BILUO -> IOB (U->B, L->I)."""
    b = _biluo(t)
    return b.select(F.col("doc").alias("question_id"), "pos", F.col("tag").alias("biluo"), TX.biluo_to_iob(F.col("tag")).alias("iob"))


@query("iob_to_biluo", tsql(["q_iob"], """
SELECT doc AS question_id, pos, iob, back, back = tag AS roundtrip_ok FROM (
  SELECT *, CASE WHEN iob = 'O' THEN iob
    WHEN substr(iob, 1, 1) = 'B' THEN CASE WHEN cont THEN iob ELSE 'U-' || split_part(iob, '-', 2) END
    WHEN substr(iob, 1, 1) = 'I' THEN CASE WHEN cont THEN iob ELSE 'L-' || split_part(iob, '-', 2) END END AS back
  FROM (SELECT *, COALESCE(substr(nxt, 1, 1) = 'I' AND split_part(nxt, '-', 2) = split_part(iob, '-', 2), FALSE) AS cont
        FROM (SELECT *, LEAD(iob) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM q_iob) a) b) c"""))
def iob_to_biluo(t):
    """TX3: IOB -> BILUO with the next tag (lead), and the round trip check."""
    b = _biluo(t).withColumn("iob", TX.biluo_to_iob(F.col("tag")))
    r = TX.iob_to_biluo(b)
    return r.select(F.col("doc").alias("question_id"), "pos", "iob", F.col("biluo").alias("back"),
                    (F.col("biluo") == F.col("tag")).alias("roundtrip_ok"))


@query("tags_to_spans", tsql(["q_bil"], """
SELECT doc AS question_id, MIN(start) AS start, MAX("end") AS "end", MIN(split_part(tag, '-', 2)) AS label FROM (
  SELECT *, SUM(CASE WHEN substr(tag, 1, 1) IN ('B', 'U') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM q_bil WHERE tag <> 'O') x
GROUP BY doc, grp"""))
def tags_to_spans(t):
    """TX4: merge consecutive tagged tokens back into spans (gaps and islands)."""
    s = TX.tags_to_spans(_biluo(t))
    return s.select(F.col("doc").alias("question_id"), "start", "end", "label")


_PIECES = {
    "q_piece": ("""
SELECT t.doc, t.pos, t.tag, substr(t.token, k * 4 + 1, 4) AS piece, t.start + k * 4 AS p_start,
       t.start + k * 4 + length(substr(t.token, k * 4 + 1, 4)) AS p_end
FROM q_bil t, LATERAL (SELECT unnest(range(CAST(ceil(length(t.token) / 4.0) AS BIGINT))) AS k) r""", ["q_bil"]),
    "q_align": ("""
SELECT p.doc, t.pos, p.p_start, p.p_end, p.piece, t.tag FROM q_piece p
JOIN q_bil t ON t.doc = p.doc AND p.p_start < t."end" AND t.start < p.p_end""", ["q_piece", "q_bil"]),
}


@query("token_alignment", sql_with(["q_align"], "SELECT doc AS question_id, pos, p_start, p_end, piece FROM q_align",
                                   extra={**TOKEN_VIEWS, **_PIECES}))
def token_alignment(t):
    """TX5: align a second tokenisation (≤4-char pieces) to the tokens by character overlap within a question."""
    b = _biluo(t)
    a = TX.align(b, TX.word_pieces(b))
    return a.select(F.col("doc").alias("question_id"), "pos", "p_start", "p_end", "piece")


@query("tag_projection", sql_with(["q_align"], """
SELECT doc AS question_id, p_start, piece, CASE
  WHEN tag = 'O' OR n = 1 THEN tag
  WHEN substr(tag, 1, 1) = 'B' THEN CASE WHEN k = 1 THEN tag ELSE 'I-' || split_part(tag, '-', 2) END
  WHEN substr(tag, 1, 1) = 'I' THEN 'I-' || split_part(tag, '-', 2)
  WHEN substr(tag, 1, 1) = 'L' THEN CASE WHEN k = n THEN tag ELSE 'I-' || split_part(tag, '-', 2) END
  WHEN substr(tag, 1, 1) = 'U' THEN CASE WHEN k = 1 THEN 'B-' WHEN k = n THEN 'L-' ELSE 'I-' END || split_part(tag, '-', 2)
  END AS piece_tag
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, pos ORDER BY p_start) AS k,
             COUNT(*) OVER (PARTITION BY doc, pos) AS n FROM q_align) x""", extra={**TOKEN_VIEWS, **_PIECES}))
def tag_projection(t):
    """TX6: project BILUO tags onto pieces (first/middle/last piece rules)."""
    b = _biluo(t)
    p = TX.project_tags(TX.align(b, TX.word_pieces(b)))
    return p.select(F.col("doc").alias("question_id"), "p_start", "piece", "piece_tag")


@query("lemma_lookup", tsql(["q_tok"], """
SELECT doc AS question_id, pos, token, CASE
  WHEN suffix(lower(token), 'ies') AND length(token) > 4 THEN regexp_replace(lower(token), 'ies$', '') || 'y'
  WHEN regexp_matches(lower(token), '(ss|x|ch|sh)es$') THEN regexp_replace(lower(token), 'es$', '')
  WHEN suffix(lower(token), 's') AND NOT suffix(lower(token), 'ss') AND length(token) > 3 THEN regexp_replace(lower(token), 's$', '')
  ELSE lower(token) END AS lemma FROM q_tok"""))
def lemma_lookup(t):
    """TX7: rule lemma of every question token (plural endings)."""
    tok = _qtok(t)
    return tok.select(F.col("doc").alias("question_id"), "pos", "token", TX.lemma(F.col("token")).alias("lemma"))


def _tag_ids_sql():
    return O.values_sql(NLU.tag_label_rows(), ["tag", "id"], ["VARCHAR", "INTEGER"])


@query("encode_labels", sql_with(["q_iob", "c_corpus"], f"""
SELECT i.doc AS question_id, '0,' || string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY i.pos) || ',0' AS tag_ids,
       CASE c.intent {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RV.INTENT_LABELS)} END AS intent_id
FROM q_iob i JOIN ({_tag_ids_sql()}) m ON m.tag = i.iob JOIN c_corpus c ON c.question_id = i.doc
GROUP BY i.doc, c.intent""", extra=TOKEN_VIEWS))
def encode_labels(t):
    """TX8/SC18: tags and intents to ids through the label maps, padded with 0 at both ends."""
    enc = NLU.encode_tags(t.spark, _tagged(t, corpus_once(t), "intent"))
    return enc.select(F.col("doc").alias("question_id"), F.array_join("ids", ",").alias("tag_ids"),
                    NLU.intent_id(F.col("intent")).alias("intent_id"))


@query("pad_sequences", sql_with(["q_iob"], f"""
SELECT question_id, batch_id, ids || repeat(',0', CAST(mx - n AS INTEGER)) AS padded,
       '1' || repeat(',1', CAST(n - 1 AS INTEGER)) || repeat(',0', CAST(mx - n AS INTEGER)) AS mask
FROM (SELECT *, MAX(n) OVER (PARTITION BY batch_id) AS mx FROM (
  SELECT question_id, ids, n, (ROW_NUMBER() OVER (ORDER BY question_id) - 1) // 64 AS batch_id FROM (
    SELECT i.doc AS question_id, '0,' || string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY i.pos) || ',0' AS ids,
           COUNT(*) + 2 AS n
    FROM q_iob i JOIN ({_tag_ids_sql()}) m ON m.tag = i.iob GROUP BY i.doc) a) b) c""", extra=TOKEN_VIEWS))
def pad_sequences(t):
    """TX9/AG7: right-pad each batch of 64 sequences to the batch maximum, with an attention mask."""
    enc = NLU.encode_tags(t.spark, _tagged(t, corpus_once(t))).withColumnRenamed("doc", "question_id")
    return NLU.pad_batches(stored(enc), "question_id", "ids", 64)  # read twice: for the ranges of its order, and to deal it


@query("gazetteer_tag", tsql(["q_longest"],
       'SELECT doc AS question_id, start, "end", tag, phrase AS surface FROM q_longest'))
def gazetteer_tag(t):
    """TX10: dictionary tagging — n-grams (≤ longest entry) ⋈ account/time/apply phrases, longest match wins."""
    return _matches(t).select(F.col("doc").alias("question_id"), "start", "end", "tag",
                              F.col("phrase").alias("surface"))


@query("span_overlap_pairs", tsql(["q_match"], """
SELECT a.doc AS question_id, a.start AS a_start, a."end" AS a_end, a.tag AS a_tag, b.start AS b_start, b."end" AS b_end,
       b.tag AS b_tag
FROM q_match a JOIN q_match b ON a.doc = b.doc AND a.start < b."end" AND b.start < a."end"
 AND (a.start < b.start OR (a.start = b.start AND (a."end" < b."end" OR (a."end" = b."end" AND a.tag < b.tag))))"""))
def span_overlap_pairs(t):
    """JN10: overlapping dictionary matches (a character claimed twice) by a self range join within a question."""
    m = _all_matches(t)
    return NLU.overlap_pairs(m).withColumnRenamed("doc", "question_id")


@query("entities_to_slots", tsql(["q_longest"], """
SELECT doc AS question_id,
  string_agg(CASE WHEN tag IN ('IS', 'BS') THEN phrase || ':' || tag END, '|' ORDER BY start) AS accounts,
  arg_max(CASE WHEN tag = 'TIME' THEN phrase END, CASE WHEN tag = 'TIME' THEN start END) AS time,
  arg_max(CASE WHEN tag = 'PERCENT' THEN phrase END, CASE WHEN tag = 'PERCENT' THEN start END) AS percent,
  arg_max(CASE WHEN tag = 'APPLY' THEN phrase END, CASE WHEN tag = 'APPLY' THEN start END) AS apply
FROM q_longest GROUP BY doc"""))
def entities_to_slots(t):
    """TX11/WN4: accounts in text order; other tags last-wins."""
    return NLU.slots(_in_rows(t)).withColumnRenamed("doc", "question_id")


@query("tags_last_wins", tsql(["q_longest"], """
SELECT doc AS question_id, tag, phrase AS value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, tag ORDER BY start DESC) AS rn FROM q_longest
  WHERE tag NOT IN ('IS', 'BS')) x WHERE rn = 1"""))
def tags_last_wins(t):
    """WN4: per question and tag keep the last occurrence (dictionary-assignment semantics)."""
    m = _matches(t).filter(~F.col("tag").isin("IS", "BS"))
    w = Window.partitionBy("doc", "tag").orderBy(F.desc("start"))
    return m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        F.col("doc").alias("question_id"), "tag", F.col("phrase").alias("value"))


@query("account_name_resolve", tsql(["q_longest", "onto_master"], """
SELECT m.doc AS question_id, m.phrase, a.acc FROM q_longest m
LEFT JOIN onto_master a ON lower(a.name_eng) = m.phrase WHERE m.tag IN ('IS', 'BS')"""))
def account_name_resolve(t):
    """JN6: mentioned account name -> account id on the normalised (lower-case) name."""
    m = _matches(t).filter(F.col("tag").isin("IS", "BS"))
    names = O.master_raw(t.spark).select("acc", F.lower("name_eng").alias("phrase"))
    return m.join(F.broadcast(names), "phrase", "left").select(F.col("doc").alias("question_id"), "phrase", "acc")


@query("intent_rules", tsql(["q_longest", "c_corpus"], """
SELECT c.question_id, c.intent AS true_intent, CASE
  WHEN COALESCE(s.n_acc, 0) >= 2 AND s.n_apply > 0 AND s.n_pct > 0 THEN 'IF.fact'
  WHEN COALESCE(s.n_acc, 0) = 1 AND strpos(c.text, ' will be the ') > 0 THEN 'IF.forecast'
  WHEN COALESCE(s.n_acc, 0) = 1 THEN 'PAST.value' ELSE 'None' END AS predicted_intent
FROM c_corpus c LEFT JOIN (
  SELECT doc, SUM(CASE WHEN tag IN ('IS', 'BS') THEN 1 ELSE 0 END) AS n_acc,
         SUM(CASE WHEN tag = 'APPLY' THEN 1 ELSE 0 END) AS n_apply, SUM(CASE WHEN tag = 'PERCENT' THEN 1 ELSE 0 END) AS n_pct
  FROM q_longest GROUP BY doc) s ON s.doc = c.question_id"""))
def intent_rules(t):
    """TX12 (rules): intent from the slots and the template verb — a baseline next to the learned model."""
    return NLU.rule_intent(_in_rows(t, "intent", "text").withColumnRenamed("doc", "question_id"))


@query("intent_classify", sql_with(["c_split"], r"""
SELECT question_id, true_intent, intent AS predicted_intent FROM (
  SELECT t.question_id, t.intent AS true_intent, d.intent, row_number() OVER (PARTITION BY t.question_id
    ORDER BY ROUND(ln(d.n_docs / a.n) + COALESCE(p.part, 0.0), 6) DESC, d.intent) AS k
  FROM c_split t JOIN nb_docs d ON t.split = 'test' CROSS JOIN (SELECT SUM(n_docs) AS n FROM nb_docs) a
  LEFT JOIN (SELECT h.question_id, c.intent, SUM(ln((COALESCE(n.n, 0) + 1) / (c.n_words + v.v))) AS part
    FROM nb_words h JOIN (SELECT DISTINCT word FROM nb_counts) u ON u.word = h.word AND h.split = 'test'
    CROSS JOIN (SELECT intent, SUM(n) AS n_words FROM nb_counts GROUP BY 1) c
    CROSS JOIN (SELECT COUNT(DISTINCT word) AS v FROM nb_counts) v
    LEFT JOIN nb_counts n ON n.intent = c.intent AND n.word = h.word GROUP BY 1, 2) p
  ON p.question_id = t.question_id AND p.intent = d.intent) x WHERE k = 1""", extra={**CORPUS_VIEWS, **SPLIT_VIEWS, **{
    "nb_words": (r"SELECT question_id, intent, split, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS word "
                 "FROM c_split", ["c_split"]),
    "nb_counts": ("SELECT intent, word, COUNT(*) AS n FROM nb_words WHERE split = 'train' GROUP BY 1, 2", ["nb_words"]),
    "nb_docs": ("SELECT intent, COUNT(*) AS n_docs FROM c_split WHERE split = 'train' GROUP BY 1", ["c_split"])}}))
def intent_classify(t):
    """TX12 (learned): naive Bayes by exact word counts, trained on the train split, scored on test."""
    s = split(t).select("question_id", "text", "intent", "split")
    return NLU.train_and_score_intent(s)


# ------------------------------------------------------------------------------ sequence scoring
from ..operators import sequence as SQ  # noqa: E402

SEQ_VIEWS = {
    "s_seq": ("SELECT doc, pos, lower(token) AS word, iob AS tag FROM q_iob", ["q_iob"]),
    "s_trans": ("""
SELECT from_tag, to_tag, COUNT(*) AS n FROM (
  SELECT COALESCE(LAG(tag) OVER w, '<S>') AS from_tag, tag AS to_tag FROM s_seq WINDOW w AS (PARTITION BY doc ORDER BY pos)
  UNION ALL
  SELECT tag, '</S>' FROM (SELECT tag, LEAD(tag) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM s_seq) x WHERE nxt IS NULL) y
GROUP BY 1, 2""", ["s_seq"]),
    "s_tlp": (f"""
SELECT t.from_tag, t.to_tag, t.n, f.n_from, ln((t.n + 1) / (f.n_from + {len(SQ.tag_set()) + 1})) AS logprob
FROM s_trans t JOIN (SELECT from_tag, SUM(n) AS n_from FROM s_trans GROUP BY 1) f ON f.from_tag = t.from_tag""", ["s_trans"]),
    "s_em": ("SELECT tag, word, COUNT(*) AS n FROM s_seq GROUP BY 1, 2", ["s_seq"]),
    "s_elp": ("""
SELECT e.tag, e.word, e.n, ln((e.n + 1) / (t.n_tag + v.v)) AS logprob FROM s_em e
JOIN (SELECT tag, SUM(n) AS n_tag FROM s_em GROUP BY 1) t ON t.tag = e.tag
JOIN (SELECT COUNT(DISTINCT word) AS v FROM s_em) v ON TRUE""", ["s_em"]),
}


def ssq(names, body):
    return sql_with(names, body, extra={**TOKEN_VIEWS, **SEQ_VIEWS})


def _seq(t):
    """(doc, words, tags): a row per question, stored."""
    return t.derived("seq", lambda: SQ.sequences(_tagged(t, corpus_once(t))), checkpoint=True)


@query("tag_transition_counts", ssq(["s_trans"], "SELECT from_tag, to_tag, n FROM s_trans"))
def tag_transition_counts(t):
    """SQ1: start / transition / end counts between tags (lag/lead windows + group)."""
    return SQ.transitions(_seq(t))


@query("tag_transition_logprob", ssq(["s_tlp"], "SELECT from_tag, to_tag, ROUND(logprob, 6) AS logprob FROM s_tlp"))
def tag_transition_logprob(t):
    """SQ1: add-one smoothed transition log-probabilities."""
    lp = SQ.transition_logprob(SQ.transitions(_seq(t)))
    return lp.select("from_tag", "to_tag", F.round("logprob", 6).alias("logprob"))


@query("tag_emission_counts", ssq(["s_elp"], "SELECT tag, word, n, ROUND(logprob, 6) AS logprob FROM s_elp"))
def tag_emission_counts(t):
    """SQ2: word × tag emission counts and smoothed log-probabilities."""
    e = SQ.emission_logprob(SQ.emissions(_seq(t)))
    return e.select("tag", "word", "n", F.round("logprob", 6).alias("logprob"))


@query("sequence_score", ssq(["s_seq", "s_tlp", "s_elp"], """
SELECT s.doc, ROUND(SUM(tl.logprob + el.logprob + CASE WHEN s.nxt IS NULL THEN en.logprob ELSE 0 END), 6) AS score,
       COUNT(*) AS length
FROM (SELECT *, COALESCE(LAG(tag) OVER w, '<S>') AS from_tag, LEAD(tag) OVER w AS nxt FROM s_seq
      WINDOW w AS (PARTITION BY doc ORDER BY pos)) s
JOIN s_tlp tl ON tl.from_tag = s.from_tag AND tl.to_tag = s.tag
JOIN s_elp el ON el.tag = s.tag AND el.word = s.word
LEFT JOIN s_tlp en ON en.from_tag = s.tag AND en.to_tag = '</S>'
GROUP BY s.doc"""))
def sequence_score(t):
    """SQ3: score of each given tag path (start + transitions + emissions + end)."""
    seq = _seq(t)
    tr = SQ.transition_logprob(SQ.transitions(seq))
    em = SQ.emission_logprob(SQ.emissions(seq))
    return SQ.score(seq, tr, em)


def _dp(t):
    seq = _seq(t)
    return SQ.decode(seq, SQ.transition_logprob(SQ.transitions(seq)), SQ.emissions(seq), posterior=False)


def recursion_views(seq: str, tlp: str, em: str, p: str, backward: bool = False) -> dict:
    """Views of the recursions over sequences ``seq`` (doc, pos, word, tag) with transitions ``tlp`` and counts ``em``:
    {p}f has alpha and the best scores per position, {p}path the best paths, {p}b (if asked for) beta."""
    tags = SQ.tag_set()
    k, lst = len(tags), "[" + ", ".join(f"'{x}'" for x in tags) + "]"

    def logsum(x: str) -> str:
        return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda w: exp(w - list_max({x}))))))"
    prev = "list_transform(range(1, {k} + 1), lambda i: {v}[i] + m.tr[(i - 1) * {k} + j])".replace("{k}", str(k))
    views = {
        f"{p}tags": (f"SELECT unnest({lst}) AS tag, unnest(range(1, {k + 1})) AS i", []),
        f"{p}from": (f"SELECT f, coalesce(MAX(n_from), 0) AS n_from FROM (SELECT tag AS f FROM {p}tags UNION ALL SELECT '<S>') a "
                     f"LEFT JOIN {tlp} t ON t.from_tag = a.f GROUP BY f", [f"{p}tags", tlp]),
        f"{p}mat": (f"""
SELECT (SELECT list(coalesce(t.logprob, -ln(f.n_from + {k + 1})) ORDER BY g.i) FROM {p}tags g JOIN {p}from f ON f.f = '<S>'
          LEFT JOIN {tlp} t ON t.from_tag = '<S>' AND t.to_tag = g.tag) AS st,
  (SELECT list(coalesce(t.logprob, -ln(f.n_from + {k + 1})) ORDER BY g.i) FROM {p}tags g JOIN {p}from f ON f.f = g.tag
          LEFT JOIN {tlp} t ON t.from_tag = g.tag AND t.to_tag = '</S>') AS en,
  (SELECT list(coalesce(t.logprob, -ln(f.n_from + {k + 1})) ORDER BY g.i, h.i) FROM {p}tags g JOIN {p}tags h ON TRUE
          JOIN {p}from f ON f.f = g.tag LEFT JOIN {tlp} t ON t.from_tag = g.tag AND t.to_tag = h.tag) AS tr""",
                    [f"{p}tags", f"{p}from", tlp]),
        f"{p}vec": (f"""
SELECT w.word, list(ln((coalesce(e.n, 0) + 1) / (coalesce(c.n, 0) + v.v)) ORDER BY g.i) AS e
FROM (SELECT DISTINCT word FROM {seq}) w JOIN {p}tags g ON TRUE JOIN (SELECT COUNT(DISTINCT word) AS v FROM {em}) v ON TRUE
LEFT JOIN (SELECT tag, SUM(n) AS n FROM {em} GROUP BY 1) c ON c.tag = g.tag LEFT JOIN {em} e ON e.tag = g.tag AND e.word = w.word
GROUP BY w.word""", [f"{p}tags", seq, em]),
        f"{p}e": (f"SELECT s.doc, s.pos, v.e, g.i AS gold, MAX(s.pos) OVER (PARTITION BY s.doc) AS last FROM {seq} s "
                  f"JOIN {p}vec v ON v.word = s.word JOIN {p}tags g ON g.tag = s.tag", [seq, f"{p}vec", f"{p}tags"]),
        f"{p}f": (f"""
SELECT x.doc, x.pos, x.last, list_transform(range(1, {k + 1}), lambda j: m.st[j] + x.e[j]) AS a,
  list_transform(range(1, {k + 1}), lambda j: m.st[j] + x.e[j]) AS d, CAST([] AS BIGINT[]) AS bk,
  m.st[x.gold] + x.e[x.gold] AS own, x.gold FROM {p}e x, {p}mat m WHERE x.pos = 0
UNION ALL
SELECT x.doc, x.pos, x.last, list_transform(range(1, {k + 1}), lambda j: {logsum(prev.replace('{v}', 'q.a'))} + x.e[j]),
  list_transform(range(1, {k + 1}), lambda j: list_max({prev.replace('{v}', 'q.d')}) + x.e[j]),
  list_transform(range(1, {k + 1}), lambda j: CAST(list_position({prev.replace('{v}', 'q.d')}, list_max({prev.replace('{v}', 'q.d')})) AS BIGINT)),
  q.own + m.tr[(q.gold - 1) * {k} + x.gold] + x.e[x.gold], x.gold
FROM {p}f q JOIN {p}e x ON x.doc = q.doc AND x.pos = q.pos + 1, {p}mat m""", [f"{p}e", f"{p}mat"]),
        f"{p}end": (f"""
SELECT doc, last, z, own + m.en[gold] AS own, list_max(b) AS best, CAST(list_position(b, list_max(b)) AS BIGINT) AS tag FROM (
  SELECT f.*, {logsum(f"list_transform(range(1, {k + 1}), lambda j: f.a[j] + m.en[j])")} AS z,
    list_transform(range(1, {k + 1}), lambda j: f.d[j] + m.en[j]) AS b FROM {p}f f, {p}mat m WHERE f.pos = f.last) y, {p}mat m""",
                    [f"{p}f", f"{p}mat"]),
        f"{p}walk": (f"""
SELECT doc, last AS pos, tag FROM {p}end
UNION ALL SELECT w.doc, w.pos - 1, f.bk[w.tag] FROM {p}walk w JOIN {p}f f ON f.doc = w.doc AND f.pos = w.pos WHERE w.pos > 0""",
                     [f"{p}end", f"{p}f"]),
        f"{p}path": (f"SELECT doc, string_agg(g.tag, ' ' ORDER BY pos) AS path FROM {p}walk w JOIN {p}tags g ON g.i = w.tag GROUP BY doc",
                     [f"{p}walk", f"{p}tags"]),
    }
    if backward:
        nxt = f"list_transform(range(1, {k + 1}), lambda j: m.tr[(i - 1) * {k} + j] + (x.e[j] + q.b[j]))"
        views[f"{p}b"] = (f"""
SELECT x.doc, x.pos, m.en AS b FROM {p}e x, {p}mat m WHERE x.pos = x.last
UNION ALL
SELECT q.doc, q.pos - 1, list_transform(range(1, {k + 1}), lambda i: {logsum(nxt)})
FROM {p}b q JOIN {p}e x ON x.doc = q.doc AND x.pos = q.pos, {p}mat m WHERE q.pos > 0""", [f"{p}e", f"{p}mat"])
    return views


_REC = recursion_views("s_seq", "s_tlp", "s_em", "r_")


def rsq(names, body):
    return sql_with(names, body, extra={**TOKEN_VIEWS, **SEQ_VIEWS, **_REC})


@query("sequence_logz", rsq(["r_end"], "SELECT doc, ROUND(z, 6) AS logz FROM r_end"))
def sequence_logz(t):
    """SQ4: log partition function per sequence, the forward recursion over its array of emissions."""
    return _dp(t).select("doc", F.round("logz", 6).alias("logz"))


@query("sequence_loglik", rsq(["r_end"], """
SELECT doc, ROUND(own - z, 6) AS value, 'none' AS reduction FROM r_end
UNION ALL SELECT NULL, ROUND(SUM(own - z), 4), 'sum' FROM r_end
UNION ALL SELECT NULL, ROUND(AVG(own - z), 6), 'mean' FROM r_end
UNION ALL SELECT NULL, ROUND(SUM(own - z) / SUM(last + 1), 6), 'token_mean' FROM r_end"""))
def sequence_loglik(t):
    """SQ5: log-likelihood = score − logZ per sequence, plus sum / mean / token-mean reductions."""
    ll = stored(_dp(t).select("doc", "length", (F.col("score") - F.col("logz")).alias("llh")))  # read twice
    per = ll.select("doc", F.round("llh", 6).alias("value"), F.lit("none").alias("reduction"))
    agg = ll.agg(F.round(F.sum("llh"), 4).alias("sum"), F.round(F.avg("llh"), 6).alias("mean"),
                 F.round(F.sum("llh") / F.sum("length"), 6).alias("token_mean"))
    red = agg.selectExpr("stack(3, 'sum', sum, 'mean', mean, 'token_mean', token_mean) AS (reduction, value)") \
        .select(F.lit(None).cast("string").alias("doc"), "value", "reduction")
    return per.unionByName(red)


@query("viterbi_decode", rsq(["r_end", "r_path", "s_seq"], """
SELECT e.doc, ROUND(e.best, 6) AS best_score, p.path AS best_path, g.gold_path, p.path = g.gold_path AS exact
FROM r_end e JOIN r_path p ON p.doc = e.doc
JOIN (SELECT doc, string_agg(tag, ' ' ORDER BY pos) AS gold_path FROM s_seq GROUP BY doc) g ON g.doc = e.doc"""))
def viterbi_decode(t):
    """SQ6: best tag path per sequence (the max-plus recursion with the way back) next to the gold path."""
    return _dp(t).select("doc", F.round("best_score", 6).alias("best_score"), SQ.tag_names(F.col("best")).alias("best_path"),
                         SQ.tag_names(F.col("gold")).alias("gold_path"), (F.col("best") == F.col("gold")).alias("exact"))


@query("label_map_invert", sql_with(["q_iob"], """
SELECT doc AS question_id, '[PAD],' || string_agg(iob, ',' ORDER BY pos) || ',[PAD]' AS tags
FROM q_iob GROUP BY doc""", extra=TOKEN_VIEWS))
def label_map_invert(t):
    """SRC6/SC18: invert the tag label map (id -> name, map_from_arrays) and decode every encoded sequence."""
    enc = NLU.encode_tags(t.spark, _tagged(t, corpus_once(t)))
    rows = NLU.tag_label_rows()
    inv = F.map_from_arrays(F.array(*[F.lit(i) for _, i in rows]), F.array(*[F.lit(n) for n, _ in rows]))
    return enc.select(F.col("doc").alias("question_id"),
                      F.array_join(F.transform("ids", lambda i: F.element_at(inv, i)), ",").alias("tags"))
