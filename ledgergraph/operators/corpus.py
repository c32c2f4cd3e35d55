"""Labelled-question corpus at data scale.

Every filing (company, year, quarter) gets one question, chosen
deterministically from integer arithmetic on its key: an intent, a template,
an account (or a target/subject pair from the ontology closure), a time
phrase, an apply word and a percentage.  Text is produced with entity markers,
entity spans are located in the marked text, sorted, and shifted when the
markers are stripped — all as per-row column expressions (no shuffle).
The choice tables (accounts, pairs, words) are bounded by the ontology and
lexicon sizes and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reference_values as RV

S_ENT, E_ENT = RV.ENTITY_START, RV.ENTITY_END
MARK_LEN = len(S_ENT) + len(E_ENT)
INTENTS = ["PAST.value", "IF.fact", "IF.forecast"]


def account_rows() -> list[tuple]:
    """(idx, acc, name, statement, kind) of the non-structural accounts, in master order."""
    out = []
    for acc, _, eng, grp in RV.ACCOUNT_MASTER:
        if acc in RV.STRUCTURAL_ACCOUNTS:
            continue
        st, kind, _ = grp.split("-")
        out.append((len(out), acc, eng.lower(), st, kind))
    return out


def time_word_rows(exclude: str) -> list[tuple]:
    """(idx, unit, word) of time words whose desc is not ``exclude``, years then quarters."""
    out = []
    for unit, words in (("year", RV.LEXICON_YEAR), ("quarter", RV.LEXICON_QUARTER)):
        for w, d in words:
            if d != exclude:
                out.append((len(out), unit, w))
    return out


def accounts_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(account_rows(), "idx int, acc string, name string, statement string, kind string")


def pairs_df(closure_pairs: DataFrame) -> DataFrame:
    """Index the (target, subject) pairs: bounded by the ontology, numbered in sorted order."""
    from pyspark.sql import Window
    acc = accounts_df(closure_pairs.sparkSession)
    t = acc.select(F.col("acc").alias("target"), F.col("name").alias("t_name"), F.col("statement").alias("t_st"),
                   F.col("kind").alias("t_kind"))
    s = acc.select(F.col("acc").alias("subject"), F.col("name").alias("s_name"), F.col("statement").alias("s_st"),
                   F.col("kind").alias("s_kind"))
    p = closure_pairs.join(t, "target").join(s, "subject")
    w = Window.orderBy("target", "subject")  # a few hundred rows at most: ontology-sized
    return p.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def mark(c: Column) -> Column:
    return F.concat(F.lit(S_ENT), c, F.lit(E_ENT))


def fill(template: str, *columns: Column) -> Column:
    """The template with a column for each ``{}``."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for c, p in zip(columns, parts[1:], strict=True) for x in (c, F.lit(p))])


def generate(filings: DataFrame, spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """filings (code, rpid, bsns_year, quarter) -> marked questions with their generating slots."""
    n = F.col("code").cast("long")
    qn = F.substring("quarter", 1, 1).cast("long")
    s = n * 7 + F.col("bsns_year").cast("long") * 13 + qn * 31
    base = filings.select("code", "rpid", "bsns_year", "quarter", s.alias("s"))
    acc = accounts_df(spark)
    n_acc = len(account_rows())
    past_words = spark.createDataFrame(time_word_rows("FUTURE"), "tw_idx int, unit string, t_word string")
    fut_words = spark.createDataFrame(time_word_rows("PAST"), "tw_idx int, unit string, t_word string")
    n_past, n_fut = len(time_word_rows("FUTURE")), len(time_word_rows("PAST"))
    apply_words = spark.createDataFrame([(i, w, d) for i, (w, d) in enumerate(RV.LEXICON_WORDS)],
                                        "ap_idx int, apply_word string, apply_desc string")
    n_pairs = pairs.count()  # ontology-sized (bounded): used as a modulus only

    intent_i = (F.col("s") % 3).cast("int")
    q = base.select("*", F.element_at(F.array(*[F.lit(x) for x in INTENTS]), intent_i + 1).alias("intent"),
                    F.element_at(F.array(*[F.lit(w) for w in RV.QUESTION_WORDS]),
                                 ((F.col("s") / 2).cast("long") % 2 + 1).cast("int")).alias("qword"),
                    ((F.col("s") / 3).cast("long") % n_acc).cast("int").alias("acc_idx"),
                    ((F.col("s") / 3).cast("long") % n_pairs).cast("int").alias("pair_idx"),
                    ((F.col("s") / 5).cast("long") % n_past).cast("int").alias("past_tw"),
                    ((F.col("s") / 5).cast("long") % n_fut).cast("int").alias("fut_tw"),
                    ((F.col("s") / 11).cast("long") % len(RV.TEMPLATES_WHATIF)).cast("int").alias("tmpl"),
                    ((F.col("s") / 13).cast("long") % len(RV.LEXICON_WORDS)).cast("int").alias("ap_idx"),
                    ((F.col("s") / 17).cast("long") % 98 + 1).cast("int").alias("number"),
                    F.element_at(F.array(*[F.lit(p) for p in RV.PERCENT_WORDS]),
                                 ((F.col("s") / 19).cast("long") % 2 + 1).cast("int")).alias("pword"))
    q = q.join(F.broadcast(acc.select(F.col("idx").alias("acc_idx"), F.col("acc").alias("a_acc"),
                                      F.col("name").alias("a_name"), F.col("statement").alias("a_st"),
                                      F.col("kind").alias("a_kind"))), "acc_idx")
    q = q.join(F.broadcast(pairs.select(F.col("idx").alias("pair_idx"), "target", "subject", "t_name", "t_st",
                                        "t_kind", "s_name", "s_st", "s_kind")), "pair_idx")
    q = q.join(F.broadcast(past_words.select(F.col("tw_idx").alias("past_tw"), F.col("unit").alias("p_unit"),
                                             F.col("t_word").alias("p_word"))), "past_tw")
    q = q.join(F.broadcast(fut_words.select(F.col("tw_idx").alias("fut_tw"), F.col("unit").alias("f_unit"),
                                            F.col("t_word").alias("f_word"))), "fut_tw")
    q = q.join(F.broadcast(apply_words), "ap_idx")

    is_past, is_fact = F.col("intent") == "PAST.value", F.col("intent") == "IF.fact"
    time_phrase = F.when(F.col("intent") == "IF.forecast", F.concat_ws(" ", "f_word", "f_unit")) \
        .otherwise(F.concat_ws(" ", "p_word", "p_unit"))
    target_name = F.when(is_fact, F.col("t_name")).otherwise(F.col("a_name"))
    target = F.when(is_fact, F.col("target")).otherwise(F.col("a_acc"))
    target_st = F.when(is_fact, F.col("t_st")).otherwise(F.col("a_st"))
    target_kind = F.when(is_fact, F.col("t_kind")).otherwise(F.col("a_kind"))
    percent = F.concat_ws(" ", F.col("number").cast("string"), F.col("pword"))
    q = q.select("code", "rpid", "bsns_year", "quarter", "intent", "qword", "tmpl", time_phrase.alias("time_phrase"),
                 target.alias("target"), target_name.alias("target_name"), target_st.alias("target_st"),
                 target_kind.alias("target_kind"),
                 F.when(is_fact, F.col("subject")).alias("subject"),
                 F.when(is_fact, F.col("s_name")).alias("subject_name"),
                 F.when(is_fact, F.col("s_st")).alias("subject_st"),
                 F.when(is_fact, F.col("s_kind")).alias("subject_kind"),
                 F.when(is_fact, F.col("apply_word")).alias("apply_word"),
                 F.when(is_fact, F.col("apply_desc")).alias("apply_desc"),
                 F.when(is_fact, percent).alias("percent"),
                 F.when(is_fact, F.col("number")).alias("number"))
    mt, ms, ma, mp, mtime = (mark(F.col("target_name")), mark(F.col("subject_name")), mark(F.col("apply_word")),
                             mark(F.col("percent")), mark(F.col("time_phrase")))
    w = RV.TEMPLATES_WHATIF
    whatif_text = (F.when(F.col("tmpl") == 0, fill(w[0], mt, ms, ma, mp, mtime))
                   .when(F.col("tmpl") == 1, fill(w[1], mt, ms, ma, mp, mtime))
                   .when(F.col("tmpl") == 2, fill(w[2], ms, ma, mp, mtime, mt))
                   .otherwise(fill(w[3], ms, ma, mp, mtime, mt)))
    text = (F.when(is_past, fill(RV.TEMPLATE_PAST, F.col("qword"), mt, mtime))
            .when(is_fact, whatif_text)
            .otherwise(fill(RV.TEMPLATE_FORECAST, F.col("qword"), mt, mtime)))
    return q.withColumn("marked_text", text).withColumnRenamed("rpid", "question_id")


def entity_struct(marked_text: Column, surface: Column, tag: Column) -> Column:
    m = mark(surface)
    start = F.position(m, marked_text) - 1  # first occurrence of the marked surface
    return F.when(surface.isNotNull(), F.struct(start.alias("start"), (start + F.length(m)).alias("end"),
                                                tag.alias("tag")))


def locate_entities(q: DataFrame, complex_tags: bool = False) -> DataFrame:
    """Add ``marked_entities``: spans in the marked text, sorted by start."""
    def acc_tag(st, kind):
        return F.concat_ws(".", F.col(st), F.col(kind)) if complex_tags else F.col(st)
    mt = F.col("marked_text")
    ents = F.array(entity_struct(mt, F.col("target_name"), acc_tag("target_st", "target_kind")),
                   entity_struct(mt, F.col("subject_name"), acc_tag("subject_st", "subject_kind")),
                   entity_struct(mt, F.col("apply_word"), F.lit("APPLY")),
                   entity_struct(mt, F.col("percent"), F.lit("PERCENT")),
                   entity_struct(mt, F.col("time_phrase"), F.lit("TIME")))
    ents = F.array_sort(F.filter(ents, lambda e: e.isNotNull()))
    return q.withColumn("marked_entities", ents)


def strip_and_shift(q: DataFrame) -> DataFrame:
    """Remove markers and shift spans by ordinal × marker length."""
    text = F.replace(F.replace(F.col("marked_text"), F.lit(S_ENT), F.lit("")), F.lit(E_ENT), F.lit(""))

    def shift(e, i):
        ns = e.start - i * MARK_LEN
        return F.struct(ns.alias("start"), (ns + (e.end - e.start) - MARK_LEN).alias("end"), e.tag.alias("tag"))
    return q.withColumn("text", text).withColumn("entities", F.transform("marked_entities", shift))


def entities_string(c: Column) -> Column:
    """Arrays rendered as 'start,end,TAG;…' so results hash the same in any engine."""
    return F.array_join(F.transform(c, lambda e: F.concat_ws(",", e.start.cast("string"), e.end.cast("string"),
                                                             e.tag)), ";")


def build(filings: DataFrame, spark: SparkSession, pairs: DataFrame, complex_tags: bool = False) -> DataFrame:
    """The whole corpus: question_id, code, period, slots, marked text, text, entities."""
    return strip_and_shift(locate_entities(generate(filings, spark, pairs), complex_tags))
