"""Question understanding as DataFrame jobs: dictionary (gazetteer) tagging with
longest match, slot collection, rule and learned intent, label encoding and
batch padding.

The gazetteer (account names, time phrases, apply words) is bounded by the
ontology and lexicon, so it goes with the plan: ``with_matches`` tags a text in its own
row.  Words one edit from a name need every n-gram (``ngrams``: ``lead()`` over each text's
token window, one shuffle by text id).
Texts are read in lower case; sentence punctuation counts as a blank (so
offsets hold), ``10%`` as ``10 %``, and a word whose base form is an entry
("rises") as that entry.  Longest match keeps, per text, the matches no longer match covers; every join and
window is keyed by the text id.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import reference_values as RV
from . import intervals as IV
from . import text as TX
from .corpus import account_rows
from .keys import dense_surrogate_key

PERCENT_PATTERN = "^[0-9]+ ?(percent|%)$"
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"  # what $ is to Spark: the end, or a last line's end behind it
_PERCENT, _PERCENT_SIGN = re.compile(f"[0-9]+ ?(?:percent|%){_END}"), re.compile(f"^([0-9]+)%{_END}")
#: Words (a row of counts each) up to which a join broadcasts them.
BROADCAST_WORDS = 200_000
#: Sentence punctuation; a full stop inside a number or word is none.
PUNCTUATION = r"[?,!;:]|\.(?=\s|$)"


def gazetteer_rows() -> list[tuple[str, str]]:
    """(phrase, tag): account names -> statement, '<word> year|quarter' -> TIME, apply words -> APPLY."""
    rows: dict[str, str] = {}
    for _, _, name, st, _ in account_rows():
        rows.setdefault(name, st)
    for unit, words in (("year", RV.LEXICON_YEAR), ("quarter", RV.LEXICON_QUARTER)):
        for w, _ in words:
            rows.setdefault(f"{w} {unit}", "TIME")
    for w, _ in RV.LEXICON_WORDS:
        rows.setdefault(w, "APPLY")
    return sorted(rows.items())


def max_gazetteer_tokens() -> int:
    return max(len(p.split(" ")) for p, _ in gazetteer_rows())


def longest_matches(m: DataFrame) -> DataFrame:
    """Drop a match when a strictly longer match in the same text covers it.

    The matches of one text (a handful) are gathered once by text id and
    filtered with ``exists`` — one shuffle of the matches, no self join that
    would evaluate the matching pipeline twice.  Texts tagged in their rows
    (``with_matches``: doc, ..., _matches) are filtered where they lie.
    """
    keep = [c for c in m.columns if c not in ("doc", "start", "end", "tag", "phrase", "_matches")]
    g = m if "_matches" in m.columns else m.groupBy("doc", *keep).agg(
        F.collect_list(F.struct("start", "end", "tag", "phrase")).alias("_matches"))
    return g.select("doc", *keep, F.explode(_longest()).alias("x")).select(
        "doc", *keep, "x.start", "x.end", "x.tag", "x.phrase")


def _longest() -> Column:
    """The ``_matches`` of a row that no longer one covers."""
    return F.expr("filter(_matches, x -> NOT exists(_matches, o -> o.start <= x.start AND o.`end` >= x.`end` "
                  "AND (o.`end` - o.start) > (x.`end` - x.start)))")


def overlap_pairs(m: DataFrame) -> DataFrame:
    """Pairs of matches sharing at least one character (ordered so each pair appears once)."""
    a = m.select(*[F.col(c).alias("a_" + c) for c in ("doc", "start", "end", "tag")])
    b = m.select(*[F.col(c).alias("b_" + c) for c in ("doc", "start", "end", "tag")])
    j = IV.overlapping(a.withColumnRenamed("a_doc", "doc"), b.withColumnRenamed("b_doc", "doc"))
    before = F.struct("a_start", "a_end", "a_tag") < F.struct("b_start", "b_end", "b_tag")
    return j.filter(before).select("doc", "a_start", "a_end", "a_tag", "b_start", "b_end", "b_tag")


def _last(tag: str) -> Column:
    return F.max_by(F.when(F.col("tag") == tag, F.col("phrase")), F.when(F.col("tag") == tag, F.col("start")))


def _of(*tags: str) -> Column:
    return F.filter("_kept", lambda x: x["tag"].isin(*tags))


def _last_of(tag: str) -> Column:
    return F.array_max(F.transform(_of(tag), lambda x: F.struct(x["start"], x["phrase"].alias("phrase"))))["phrase"]


def _accounts_of() -> Column:
    return F.array_sort(F.transform(_of("IS", "BS"), lambda x: F.struct(
        x["start"].alias("start"), x["phrase"].alias("phrase"), x["tag"].alias("tag"))))


def slots(m: DataFrame) -> DataFrame:
    """(doc, accounts 'name:TAG|…' in text order, time, percent, apply — each last-wins).

    ``m``: the longest matches, or texts tagged in their rows (``with_matches``), whose slots are filled there; a text
    without a match has no row.
    """
    if "_matches" in m.columns:
        kept = m.select("doc", _longest().alias("_kept")).filter(F.size("_kept") > 0)
        agg = kept.select("doc", _accounts_of().alias("acc_arr"), _last_of("TIME").alias("time"), _last_of("PERCENT").alias("percent"),
                          _last_of("APPLY").alias("apply"))
    else:
        acc = F.array_sort(F.collect_list(F.when(F.col("tag").isin("IS", "BS"),
                                                 F.struct("start", "phrase", "tag"))))
        agg = m.groupBy("doc").agg(acc.alias("acc_arr"), _last("TIME").alias("time"), _last("PERCENT").alias("percent"),
                                   _last("APPLY").alias("apply"))
    accounts = F.when(F.size("acc_arr") > 0, F.array_join(
        F.transform("acc_arr", lambda x: F.concat(x.phrase, F.lit(":"), x.tag)), "|"))
    return agg.select("doc", accounts.alias("accounts"), "time", "percent", "apply")


def rule_intent(questions: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """(question_id, true_intent, predicted_intent); without ``m`` the questions bring their matches (``with_matches``)."""
    if m is None:
        j = questions.withColumn("_kept", _longest()).select("*", *[F.size(_of(*tags)).alias(n) for n, tags in (
            ("n_acc", ("IS", "BS")), ("n_apply", ("APPLY",)), ("n_pct", ("PERCENT",)))])
    else:
        counts = m.groupBy("doc").agg(
            F.sum(F.when(F.col("tag").isin("IS", "BS"), 1).otherwise(0)).alias("n_acc"),
            F.sum(F.when(F.col("tag") == "APPLY", 1).otherwise(0)).alias("n_apply"),
            F.sum(F.when(F.col("tag") == "PERCENT", 1).otherwise(0)).alias("n_pct"))
        j = questions.join(counts, questions.question_id == counts.doc, "left")
    n_acc = F.coalesce("n_acc", F.lit(0))
    pred = (F.when((n_acc >= 2) & (F.col("n_apply") > 0) & (F.col("n_pct") > 0), "IF.fact")
            .when((n_acc == 1) & (F.instr("text", " will be the ") > 0), "IF.forecast")
            .when(n_acc == 1, "PAST.value").otherwise("None"))
    return j.select("question_id", F.col("intent").alias("true_intent"), pred.alias("predicted_intent"))


def cue_intent(text: Column) -> Column:
    """Intent by how the question is put, whatever slots it has, so that a missing slot is an error and not another intent."""
    t = F.lower(text)
    return (F.when(t.rlike("^(what happens|what will be the effect|when|if) "), "IF.fact")
            .when(t.contains(" will be the "), "IF.forecast").when(t.contains(" is the "), "PAST.value").otherwise("None"))


def tag_label_rows() -> list[tuple[str, int]]:
    """Tag -> id: 'O' at the offset, then B-/I- per entity tag; special tokens as given."""
    rows = [("O", RV.TAG_ID_OFFSET)]
    for i, tag in enumerate(RV.ENTITY_TAGS):
        rows.append((f"B-{tag}", RV.TAG_ID_OFFSET + 1 + 2 * i))
        rows.append((f"I-{tag}", RV.TAG_ID_OFFSET + 2 + 2 * i))
    return list(RV.SPECIAL_TAG_LABELS) + rows


def label_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tag_label_rows(), "iob string, id int")


def intent_id(c: Column) -> Column:
    expr = None
    for k, v in RV.INTENT_LABELS:
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def encode_tags(spark: SparkSession, tagged: DataFrame) -> DataFrame:
    """(doc, pos, iob) -> (doc, ids array<int>) with 0 padding at both ends.

    Texts tagged in their rows (``text.tag_texts``: doc, ..., tokens) are encoded where they lie, and keep their columns.
    """
    if "tokens" in tagged.columns:
        ids = F.create_map(*[F.lit(x) for r in tag_label_rows() for x in r])
        known = F.array_compact(F.transform("tokens.iob", lambda tag: F.element_at(ids, tag)))
        out = tagged.withColumn("ids", F.concat(F.array(F.lit(0)), known, F.array(F.lit(0)))).drop("tokens")
        return out.filter(F.size("ids") > 2)
    j = tagged.join(F.broadcast(label_map(spark)), "iob")
    agg = j.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("p"))
    return agg.select("doc", F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x.id), F.array(F.lit(0))).alias("ids"))


def pad_batches(enc: DataFrame, id_col: str, ids_col: str, batch: int) -> DataFrame:
    """Batch ids from a dense rank (no single-partition window); pad to the batch max; attention mask."""
    ranked = dense_surrogate_key(enc, [id_col], "_rk")
    r = ranked.withColumn("batch_id", ((F.col("_rk") - 1) / batch).cast("long")).withColumn("n", F.size(ids_col))
    r = r.withColumn("mx", F.max("n").over(Window.partitionBy("batch_id")))  # ≤ batch rows per window
    pad = F.array_repeat(F.lit(0), (F.col("mx") - F.col("n")).cast("int"))
    padded = F.array_join(F.concat(F.col(ids_col), pad), ",")
    mask = F.array_join(F.concat(F.array_repeat(F.lit(1), F.col("n").cast("int")), pad), ",")
    return r.select(id_col, "batch_id", padded.alias("padded"), mask.alias("mask"))


def train_and_score_intent(s: DataFrame) -> DataFrame:
    """Multinomial naive Bayes by exact word counts: trained on split='train', predictions for split='test'.

    Words are lower-cased runs of word characters; counts per (intent, word) are one grouped aggregate, and scoring
    joins the test words with the counted vocabulary.  Add-one smoothing; words never seen in training say nothing;
    ties go to the intent first by name.
    """
    words = s.select("question_id", "intent", "split", F.explode(F.split(F.lower("text"), "\\W+")).alias("word")) \
        .filter(F.col("word") != "")
    train = words.filter(F.col("split") == "train")
    counts = train.groupBy("intent", "word").agg(F.count(F.lit(1)).alias("n"))
    vocab = counts.select("word").distinct()
    size = vocab.agg(F.count(F.lit(1)).alias("v"))
    total = counts.groupBy("intent").agg(F.sum("n").alias("n_words"))
    docs = s.filter(F.col("split") == "train").groupBy("intent").agg(F.count(F.lit(1)).alias("n_docs"))
    n_all = docs.agg(F.sum("n_docs").alias("all_docs"))
    classes = docs.join(total, "intent").join(F.broadcast(size), how="inner").join(F.broadcast(n_all), how="inner")
    classes = F.broadcast(classes)  # one row per intent
    test = s.filter(F.col("split") == "test").select("question_id", F.col("intent").alias("true_intent"))
    prior = test.join(classes, how="inner").select("question_id", "true_intent", "intent",
                                                   F.ln(F.col("n_docs") / F.col("all_docs")).alias("prior"))
    heard = words.filter(F.col("split") == "test").select("question_id", "word").join(vocab, "word") \
        .groupBy("question_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    part = heard.join(classes, how="inner").join(counts, ["intent", "word"], "left").select(
        "question_id", "intent", (F.col("tf") * F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.col("n_words") + F.col("v"))))
        .alias("part")).groupBy("question_id", "intent").agg(F.sum("part").alias("part"))
    score = prior.join(part, ["question_id", "intent"], "left").withColumn(
        "score", F.round(F.col("prior") + F.coalesce("part", F.lit(0.0)), 6))
    return score.groupBy("question_id", "true_intent").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "intent")).alias("b")).select(
        "question_id", "true_intent", F.col("b.intent").alias("predicted_intent"))


def intent_posteriors(s: DataFrame, smoothing: tuple[float, ...] = (1.0,), splits: tuple[str, ...] | None = None) -> DataFrame:
    """(question_id, split, label, smoothing, pred, p_label) of naive Bayes trained on split='train', for every row.

    The counted words of a class are columns of one row per word, so a question's words are joined once whatever the
    number of classes and smoothings; classes and totals are collected (a row per class).  ``splits`` names the splits
    that are scored (all): the model is that of the whole train split, and words of other rows are not dealt out.
    """
    def words_of(rows: DataFrame) -> DataFrame:
        return rows.select("question_id", "intent", "split", F.explode(F.split(F.lower("text"), r"\W+")).alias("word")).filter("word <> ''")
    scored = s if splits is None else s.filter(F.col("split").isin(*splits))
    scored = scored.select("question_id", "split", "intent", "text").repartition("question_id")  # texts, not words: what follows stays in place
    words = words_of(scored)
    counts = words_of(s).filter(F.col("split") == "train").groupBy("intent", "word").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    prior = {r["intent"]: r["n"] for r in s.filter(F.col("split") == "train").groupBy("intent").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {r["intent"]: r["n"] for r in counts.groupBy("intent").agg(F.sum("n").alias("n")).collect()}
    classes, every = sorted(prior), sum(prior.values())
    vec = counts.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("intent") == c, F.col("n"))), F.lit(0)).alias(f"n{i}")
                                       for i, c in enumerate(classes)])
    v = vec.count()
    heard = words.groupBy("question_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    j = heard.join(F.broadcast(vec) if v <= BROADCAST_WORDS else vec, "word")
    parts = [F.sum(F.col("tf") * F.ln((F.col(f"n{i}") + F.lit(a)) / F.lit(total.get(c, 0) + a * v))).alias(f"s{i}_{k}")
             for k, a in enumerate(smoothing) for i, c in enumerate(classes)]
    rows = scored.select("question_id", "split", F.col("intent").alias("label")).join(j.groupBy("question_id").agg(*parts), "question_id", "left")

    def score(i: int, k: int) -> Column:
        return F.lit(math.log(prior[classes[i]] / every)) + F.coalesce(F.col(f"s{i}_{k}"), F.lit(0.0))
    runs = F.array(*[F.struct(F.lit(float(a)).alias("smoothing"), F.array(*[F.struct(
        score(i, k).alias("s"), F.lit(c).alias("c")) for i, c in enumerate(classes)]).alias("x")) for k, a in enumerate(smoothing)])
    r = rows.select("question_id", "split", "label", F.explode(runs).alias("r")).select("question_id", "split", "label", "r.*")
    r = r.withColumn("top", F.array_max(F.transform("x", lambda c: c["s"])))
    rel = F.transform("x", lambda c: F.struct(F.exp(c["s"] - F.col("top")).alias("e"), c["c"].alias("c")))
    z = F.aggregate(rel, F.lit(0.0), lambda acc, c: acc + c["e"])
    mine = F.get(F.filter(rel, lambda c: c["c"] == F.col("label")), F.lit(0))["e"]
    pred = F.get(F.filter("x", lambda c: F.round(c["s"], 6) == F.round(F.col("top"), 6)), F.lit(0))["c"]  # ties: first by name
    return r.select("question_id", "split", "label", "smoothing", pred.alias("pred"), (mine / z).alias("p_label"))


# ---------------------------------------------------------------------------
# Row-wise dictionary tagging (codegen-friendly): tokens by posexplode with a
# running offset, n-grams by lead() over the same per-text window, a
# broadcast hash join with the dictionary, longest match by a keyed anti
# join.  One shuffle (by text id) for the windows, one for the anti join.
# ---------------------------------------------------------------------------

def ngrams(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(doc, *keep, start, end, phrase): every run of words as long as the longest dictionary entry, or shorter."""
    n = max_gazetteer_tokens()
    texts = df.select(F.col(id_col).alias("doc"), *keep, F.lower(text_col).alias("text")).repartition("doc")
    p = texts.select("doc", *keep, F.posexplode(F.split(F.regexp_replace("text", PUNCTUATION, " "), " ", -1))
                     .alias("piece", "token"))
    w = Window.partitionBy("doc").orderBy("piece")
    p = p.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                         F.lit(0)).cast("int"))
    p = p.filter(F.length("token") > 0).withColumn("end", (F.col("start") + F.length("token")).cast("int"))
    leads = [F.lead("token", k).over(w).alias(f"t{k}") for k in range(1, n)]
    ends = [F.lead("end", k).over(w).alias(f"e{k}") for k in range(1, n)]
    p = p.select("doc", *keep, "token", "start", "end", *leads, *ends)
    grams = [F.struct(F.col("token").alias("phrase"), F.col("end").alias("end"))]
    for k in range(1, n):
        words = ["token"] + [f"t{j}" for j in range(1, k + 1)]
        grams.append(F.when(F.col(f"t{k}").isNotNull(), F.struct(F.concat_ws(" ", *words).alias("phrase"),
                                                                   F.col(f"e{k}").alias("end"))))
    g = p.select("doc", *keep, "start", F.explode(F.array(*grams)).alias("g")).filter(F.col("g").isNotNull())
    return g.select("doc", *keep, "start", F.col("g.end").alias("end"), F.col("g.phrase").alias("phrase"))


def match_rows(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, near: bool = False) -> DataFrame:
    """All dictionary / percent matches: (doc, *keep, start, end, tag, phrase).

    ``near`` adds words that are one edit from an account name, with the phrase as typed (``near_names``).
    """
    keep = keep or []
    if not near:
        m = with_matches(df.select(F.col(id_col).alias("doc"), *keep, F.col(text_col).alias("_text")), "_text", ["doc", *keep])
        return m.select("doc", *keep, F.explode("_matches").alias("m")).select("doc", *keep, "m.*")
    g = ngrams(df, id_col, text_col, keep)
    return _exact(g, keep).unionByName(near_names(g, keep).drop("name"))


def phrase_matches(text: str | None, tag_of: dict[str, str], first: set[str], longest: int) -> list[tuple[int, int, str, str]]:
    """(start, end, tag, phrase) of the dictionary and percent matches of a text in lower case without punctuation.

    One pass over its words: only runs that begin as an entry does are put together.
    """
    words, at = [], 0
    for piece in (text or "").split(" "):
        if piece:
            words.append((piece, at, at + len(piece)))
        at += len(piece) + 1
    out = []
    for j, (token, start, end) in enumerate(words):
        digit = "0" <= token[0] <= "9"
        if token in tag_of:
            out.append((start, end, tag_of[token], token))
        elif digit and _PERCENT.match(token):
            out.append((start, end, "PERCENT", _PERCENT_SIGN.sub(r"\1 %", token)))
        elif token.endswith("s") and (base := TX.plain_lemma(token)) in tag_of and " " not in base:
            out.append((start, end, tag_of[base], base))
        if digit or token in first:
            phrase = token
            for n, (word, _, stop) in enumerate(words[j + 1:j + longest], 2):
                phrase += " " + word
                if phrase in tag_of:
                    out.append((start, stop, tag_of[phrase], phrase))
                elif n == 2 and digit and _PERCENT.match(phrase):
                    out.append((start, stop, "PERCENT", phrase))
    return out


def with_matches(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns) with ``_matches`` array<struct<start, end, tag, phrase>>: the matches of each row's text.

    A text is tagged where it lies, without a shuffle, in one pass over its words (``phrase_matches``).
    """
    keep = df.columns if keep is None else keep
    entries = gazetteer_rows()
    tag_of, first = dict(entries), {p.split(" ")[0] for p, _ in entries if " " in p}
    longest = max_gazetteer_tokens()
    kind = [("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("phrase", pa.string())]

    def run(batches):
        for batch in batches:
            rows, size = [], []
            for x in batch.column("_plain").to_pylist():
                got = phrase_matches(x, tag_of, first, longest)
                rows += got
                size.append(len(got))
            columns = zip(*rows) if rows else [()] * len(kind)
            found = pa.ListArray.from_arrays(pa.array([0, *accumulate(size)], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(x, k) for x, (_, k) in zip(columns, kind, strict=True)], names=[c for c, _ in kind]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [found], [*keep, "_matches"])
    plain = F.regexp_replace(F.lower(text), PUNCTUATION, " ")
    schema = T.StructType([df.schema[c] for c in keep]).add("_matches", T.ArrayType(T.StructType(
        [T.StructField(c, T.StringType() if k == pa.string() else T.IntegerType()) for c, k in kind])))
    return df.select(*keep, plain.alias("_plain")).mapInArrow(run, schema)


def _exact(g: DataFrame, keep: list[str]) -> DataFrame:
    # the dictionary is bounded by ontology and lexicon: broadcast
    gaz = g.sparkSession.createDataFrame(gazetteer_rows(), "phrase string, tag string")
    base = g.sparkSession.createDataFrame([r for r in gazetteer_rows() if " " not in r[0]], "base string, base_tag string")
    g = g.withColumn("base", F.when(~F.col("phrase").contains(" "), TX.lemma(F.col("phrase"))))
    j = g.join(F.broadcast(gaz), "phrase", "left").join(F.broadcast(base), "base", "left")
    pct = F.col("phrase").rlike(PERCENT_PATTERN)
    by_base = F.col("tag").isNull() & ~pct & F.col("base_tag").isNotNull()
    return j.select("doc", *keep, "start", "end",
                    F.coalesce("tag", F.when(pct, F.lit("PERCENT")), "base_tag").alias("tag"),
                    F.when(by_base, F.col("base")).when(pct, F.regexp_replace("phrase", "^([0-9]+)%$", "$1 %"))
                    .otherwise(F.col("phrase")).alias("phrase")).filter(F.col("tag").isNotNull())


#: Shortest account name that is sought with an edit.
NEAR_MIN = 6


def deletions(c: Column) -> Column:
    """The string and every string with one character less."""
    less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), less))


def near_index() -> list[tuple[str, str, str]]:
    """(key, name, tag): the deletion neighbourhood of every account name."""
    out = set()
    for _, _, name, st, _ in account_rows():
        if len(name) >= NEAR_MIN:
            out |= {(name[:i] + name[i + 1:], name, st) for i in range(len(name))} | {(name, name, st)}
    return sorted(out)


def may_be_near(phrase: Column) -> Column:
    """Whether a phrase can be one edit from an account name; nearly every n-gram fails here, before its deletions are listed.

    One edit leaves the first half of a name or its second half whole, and changes its length by one at most.  A name as
    it is written is no edit, unless another name is one edit from it.
    """
    names = sorted({r[2] for r in account_rows() if len(r[2]) >= NEAR_MIN})
    by_key: dict[str, set[str]] = {}
    for key, name, _ in near_index():
        by_key.setdefault(key, set()).add(name)
    crowded = {n for group in by_key.values() if len(group) > 1 for n in group}
    size, few = F.length(phrase), NEAR_MIN // 2  # letters that every half has: two look-ups settle most n-grams
    first = {f"{len(n)}:{n[:len(n) // 2]}" for n in names}
    last = {f"{len(n)}:{n[len(n) // 2:]}" for n in names}

    def half_of(length: Column) -> Column:
        """Whether a name of this length begins as the phrase does, or ends so."""
        h = F.floor(length / 2).cast("int")
        return (F.concat_ws(":", length.cast("string"), phrase.substr(F.lit(1), h)).isin(sorted(first))
                | F.concat_ws(":", length.cast("string"), F.right(phrase, length - h)).isin(sorted(last)))
    return (size.between(min(map(len, names)) - 1, max(map(len, names)) + 1)
            & (F.substring(phrase, 1, few).isin(sorted({n[:few] for n in names}))
               | F.right(phrase, F.lit(few)).isin(sorted({n[-few:] for n in names})))
            & (half_of(size - 1) | half_of(size) | half_of(size + 1)) & ~phrase.isin(sorted(set(names) - crowded)))


def near_names(g: DataFrame, keep: list[str]) -> DataFrame:
    """n-grams exactly one edit (a letter more, less or other) from an account name: (doc, *keep, start, end, tag, phrase, name).

    Two strings one edit apart share a string of their deletion neighbourhoods, so the join is an equality on keys; the
    index is of the ontology's size and broadcast, hence n-grams are not shuffled.  Deletions are listed only of the few
    n-grams that share a half with a name of like length (``may_be_near``).
    """
    k = g.filter(may_be_near(F.col("phrase"))).withColumn("key", F.explode(deletions(F.col("phrase"))))
    index = g.sparkSession.createDataFrame(near_index(), "key string, name string, tag string")
    m = k.join(F.broadcast(index), "key").filter(F.levenshtein("phrase", "name") == 1)
    best = m.groupBy("doc", *keep, "start", "end", "phrase").agg(F.min(F.struct("name", "tag")).alias("n"))
    plain = TX.lemma(F.col("phrase"))  # a plural of a name is the name
    return best.filter(plain.contains(" ") | (plain != F.col("n.name"))).select(
        "doc", *keep, "start", "end", "n.tag", "phrase", "n.name")


def question_slots_rows(questions: DataFrame, id_col: str, text_col: str, keep: list[str], near: bool = False) -> DataFrame:
    """One row per question: (question_id, *keep, acc_arr, time, percent, apply, n_apply, n_pct, has_will)."""
    will = (F.instr(F.lower(text_col), " will be the ") > 0).alias("has_will")
    if not near:
        return _slots_in_place(questions.select(F.col(id_col).alias("question_id"), *keep, will, F.col(text_col).alias("_text")))
    base = questions.select(F.col(id_col).alias("doc"), *keep, will)
    m = longest_matches(match_rows(questions.select(id_col, text_col), id_col, text_col, near=near))
    acc = F.array_sort(F.collect_list(F.when(F.col("tag").isin("IS", "BS"), F.struct("start", "phrase", "tag"))))
    agg = m.groupBy("doc").agg(acc.alias("acc_arr"), _last("TIME").alias("time"), _last("PERCENT").alias("percent"),
                               _last("APPLY").alias("apply"),
                               F.sum(F.when(F.col("tag") == "APPLY", 1).otherwise(0)).alias("n_apply"),
                               F.sum(F.when(F.col("tag") == "PERCENT", 1).otherwise(0)).alias("n_pct"))
    j = base.join(agg, "doc", "left")
    return j.withColumnRenamed("doc", "question_id").withColumn(
        "acc_arr", F.coalesce("acc_arr", F.array().cast("array<struct<start:int,phrase:string,tag:string>>")))


def _slots_in_place(q: DataFrame) -> DataFrame:
    """The slots of every row's ``_text``, whose matches are gathered and filtered in the row itself: no shuffle."""
    cols = [c for c in q.columns if c != "_text"]
    m = with_matches(q, "_text", cols).select(*cols, _longest().alias("_kept"))
    some = F.size("_kept") > 0
    return m.select(*cols, _accounts_of().alias("acc_arr"), _last_of("TIME").alias("time"), _last_of("PERCENT").alias("percent"),
                    _last_of("APPLY").alias("apply"), F.when(some, F.size(_of("APPLY"))).cast("long").alias("n_apply"),
                    F.when(some, F.size(_of("PERCENT"))).cast("long").alias("n_pct"))
