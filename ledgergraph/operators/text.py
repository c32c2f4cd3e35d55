"""Token-level text jobs: tokenisation with offsets, span <-> BILUO tags,
IOB conversion, re-tokenisation alignment and tag projection, lemmas,
label encoding and padding, dictionary (gazetteer) tagging, slot filling
and the stratified split.

Token tables are ``(doc, pos, token, start, end)``; every join between a
token table and a span table carries the document key as an equality, so
Spark plans a hash/sort-merge join on the key with a range filter, never a
nested loop.  Windows are partitioned by document (bounded by text length).
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import dense_surrogate_key

#: Tag of a token that a span touches without fitting it.
MISALIGNED = "-"
WS = "[ \t\n\r\f]"
TOKEN = re.compile("[^" + WS[1:] + "+")


def dealt(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by document, over ``parts`` tasks or as many as the session has."""
    return df.repartition("doc") if parts is None else df.repartition(parts, "doc")


def tokenize_offsets(df: DataFrame, doc: str, text: str, sep: str = WS, parts: int | None = None) -> DataFrame:
    """Whitespace tokens (or pieces between ``sep``, one character each) with 0-based half-open character offsets: (doc, pos, token, start, end).

    Every whitespace character separates, so the start of piece i is the sum
    of (length + 1) of the pieces before it; empty pieces are dropped after
    the offsets are known.  The running sum is a window per document.
    """
    docs = dealt(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")), parts)  # texts, not tokens
    parts = docs.select("doc", F.posexplode(F.split("text", sep, -1)).alias("piece", "token"))
    w = Window.partitionBy("doc").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0)).cast("int"))
    toks = parts.filter(F.length("token") > 0)
    wp = Window.partitionBy("doc").orderBy("piece")
    return toks.select("doc", (F.row_number().over(wp) - 1).cast("int").alias("pos"), "token", "start",
                       (F.col("start") + F.length("token")).cast("int").alias("end"))


def spans_to_biluo(tokens: DataFrame, spans: DataFrame, block: int | None = None, parts: int | None = None) -> DataFrame:
    """Tokens x spans within a document -> BILUO tag per token, 'O' outside, '-' where a span does not fit.

    ``spans``: (doc, s_start, s_end, label), no two of a document sharing a character.  Tokens of a span are numbered
    inside it: one token -> U, first -> B, last -> L, else I.  A span whose ends are not ends of tokens is misaligned:
    every token that it touches gets '-', so that it can be counted (``misaligned``).  A token takes the first span that
    it touches: of the spans that end behind the token's start the nearest.  It is found in one pass over the document,
    from its last character to its first, so that rows are dealt by document only and a text dealt so stays in place;
    ``block``, the characters that a range join took together, changes nothing any more.
    """
    t = tokens.select("doc", F.col("start").alias("_at"), F.struct("pos", "token", "start", "end").alias("_t"))
    s = spans.filter(F.col("doc").isNotNull()).select("doc", F.col("s_end").alias("_at"), F.struct("s_start", "s_end", "label").alias("_s"))
    t, s = (t.withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType)),
            dealt(s.select("doc", "_at", F.lit(None).cast(t.schema["_t"].dataType).alias("_t"), "_s"), parts))
    # a span that ends where a token starts comes after the token
    back = Window.partitionBy("doc").orderBy(F.desc("_at"), F.col("_t").isNull())
    j = t.unionByName(s).withColumn("_s", F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    j = j.filter(F.col("_t").isNotNull()).withColumn("_s", F.when(F.col("_s.s_start") < F.col("_t.end"), F.col("_s")))
    j = j.select("doc", "_t.*", "_s.*")
    w = Window.partitionBy("doc", F.coalesce("s_start", -1 - F.col("pos")))  # a token outside is alone
    lo, hi = F.min("pos").over(w), F.max("pos").over(w)
    fits = (F.min("start").over(w) == F.col("s_start")) & (F.max("end").over(w) == F.col("s_end"))
    prefix = (F.when(lo == hi, "U").when(F.col("pos") == lo, "B").when(F.col("pos") == hi, "L").otherwise("I"))
    tag = (F.when(F.col("label").isNull(), F.lit("O")).when(~fits, F.lit(MISALIGNED))
           .otherwise(F.concat(prefix, F.lit("-"), F.col("label"))))
    return j.select("doc", "pos", "token", "start", "end", tag.alias("tag"))


def tag_words(text: str | None, spans: list[tuple[int, int, str | None]]) -> list[tuple[int, str, int, int, str, str]]:
    """(pos, token, start, end, BILUO tag, IOB tag) of each token of a text, in one pass over its tokens and spans."""
    found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text or "")]
    spans, at, own = sorted(spans, key=lambda e: e[:2][::-1]), 0, []
    for _, start, end in found:  # a token takes the first span that it touches
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        own.append(at if at < len(spans) and spans[at][0] < end else -1)
    out = []
    for i, (token, start, end) in enumerate(found):
        tag = iob = "O"
        if own[i] >= 0 and spans[own[i]][2] is not None:
            if i == 0 or own[i - 1] != own[i]:
                lo, hi = i, i + 1
                while hi < len(own) and own[hi] == own[i]:
                    hi += 1
                fits = (found[lo][1], found[hi - 1][2]) == spans[own[i]][:2]
            if fits:
                prefix = "U" if hi - lo == 1 else "B" if i == lo else "L" if i == hi - 1 else "I"
                tag, iob = f"{prefix}-{spans[own[i]][2]}", f"{'B' if i == lo else 'I'}-{spans[own[i]][2]}"
            else:
                tag = iob = MISALIGNED
        out.append((i, token, start, end, tag, iob))
    return out


def tag_texts(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``tokenize_offsets``, ``spans_to_biluo`` and ``biluo_to_iob`` of texts whose spans are in their rows.

    ``spans``: array<struct<start, end, tag>>, no two sharing a character.  The other columns are kept; ``tokens`` is
    array<struct<pos, token, start, end, tag, iob>>.  A row's text is tagged where it lies: no token is shuffled or sorted.
    """
    keep = [c for c in df.columns if c not in (text, spans)]
    kind = [("pos", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("iob", pa.string())]

    def run(batches):
        for batch in batches:
            each = batch.column(spans)
            e = each.flatten()
            flat = list(zip(*[e.field(c).to_pylist() for c in ("start", "end", "tag")], strict=True))
            rows, size, at = [], [], 0
            for s, n in zip(batch.column(text).to_pylist(), each.value_lengths().to_pylist(), strict=True):
                got = tag_words(s, flat[at:at + (n or 0)])
                at += n or 0
                rows += got
                size.append(len(got))
            columns = zip(*rows) if rows else [()] * len(kind)
            tokens = pa.ListArray.from_arrays(pa.array([0, *accumulate(size)], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(x, k) for x, (_, k) in zip(columns, kind, strict=True)], names=[c for c, _ in kind]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [tokens], [*keep, "tokens"])
    schema = T.StructType([df.schema[c] for c in keep]).add("tokens", T.ArrayType(T.StructType(
        [T.StructField(c, T.StringType() if k == pa.string() else T.IntegerType()) for c, k in kind])))
    return df.select(*keep, text, spans).mapInArrow(run, schema)


def misaligned(tagged: DataFrame) -> DataFrame:
    """(doc, tokens): documents with spans that fit no tokens, and how many tokens they touch."""
    return tagged.filter(F.col("tag") == MISALIGNED).groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"))


def biluo_to_iob(tag: Column) -> Column:
    p = F.substring(tag, 1, 1)
    rest = F.substring_index(tag, "-", -1)
    return (F.when(tag == "O", tag).when(p == "U", F.concat(F.lit("B-"), rest))
            .when(p == "L", F.concat(F.lit("I-"), rest)).otherwise(tag))


def iob_to_biluo(tagged: DataFrame) -> DataFrame:
    """IOB -> BILUO: needs the next tag (lead over the document's token order)."""
    w = Window.partitionBy("doc").orderBy("pos")
    nxt = F.lead("iob").over(w)
    p = F.substring("iob", 1, 1)
    rest = F.substring_index(F.col("iob"), "-", -1)
    cont = nxt.isNotNull() & (F.substring(nxt, 1, 1) == "I") & (F.substring_index(nxt, "-", -1) == rest)
    out = (F.when(F.col("iob") == "O", F.col("iob"))
           .when(p == "B", F.when(cont, F.col("iob")).otherwise(F.concat(F.lit("U-"), rest)))
           .when(p == "I", F.when(cont, F.col("iob")).otherwise(F.concat(F.lit("L-"), rest))))
    return tagged.withColumn("biluo", out)


def tags_to_spans(tagged: DataFrame, tag: str = "tag") -> DataFrame:
    """Gaps and islands: a running count of span starts groups consecutive tokens into spans."""
    w = Window.partitionBy("doc").orderBy("pos")
    p = F.substring(tag, 1, 1)
    begins = F.when(p.isin("B", "U"), 1).otherwise(0)
    t = tagged.filter(F.col(tag) != "O").withColumn("grp", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("doc", "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                      F.first(F.substring_index(F.col(tag), "-", -1)).alias("label")) \
        .select("doc", "start", "end", "label")


def word_pieces(tokens: DataFrame, size: int = 4) -> DataFrame:
    """A second tokenisation: every token cut into pieces of at most ``size`` characters."""
    n = ((F.length("token") + (size - 1)) / size).cast("int")
    p = tokens.select("doc", "pos", "token", "start", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    ps = F.col("start") + F.col("k") * size
    return p.select("doc", "start", "k", F.substring("token", F.col("k") * size + 1, size).alias("piece"),
                    ps.alias("p_start")).select(
        "doc", "piece", F.col("p_start").alias("start"), (F.col("p_start") + F.length("piece")).alias("end"))


def align(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Many-to-one alignment of pieces to tokens by character overlap within a document."""
    t = tokens.select("doc", "pos", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "tag")
    p = pieces.select("doc", F.col("start").alias("p_start"), F.col("end").alias("p_end"), "piece")
    j = p.join(t, (p.doc == t.doc) & (p.p_start < t.t_end) & (t.t_start < p.p_end)).select(
        p.doc, "pos", "p_start", "p_end", "piece", "tag")
    return j


def project_tags(aligned: DataFrame) -> DataFrame:
    """Split each token's tag over its pieces (B->B,I,I; L->I,I,L; U->B,I,L; I/O unchanged)."""
    w = Window.partitionBy("doc", "pos")
    k = F.row_number().over(w.orderBy("p_start"))
    n = F.count(F.lit(1)).over(w)
    a = aligned.withColumn("k", k).withColumn("n", n)
    p = F.substring("tag", 1, 1)
    rest = F.substring_index(F.col("tag"), "-", -1)
    first, last, only = F.col("k") == 1, F.col("k") == F.col("n"), F.col("n") == 1

    def t(x):
        return F.concat(F.lit(x + "-"), rest)
    out = (F.when((F.col("tag") == "O") | only, F.col("tag"))
           .when(p == "B", F.when(first, t("B")).otherwise(t("I")))
           .when(p == "I", t("I"))
           .when(p == "L", F.when(last, t("L")).otherwise(t("I")))
           .when(p == "U", F.when(first, t("B")).when(last, t("L")).otherwise(t("I"))))
    return a.select("doc", "pos", "p_start", "p_end", "piece", "tag", out.alias("piece_tag"))


def lemma(word: Column) -> Column:
    """Rule lemma for English plurals (ies -> y, es after s/x/ch/sh -> '', s -> '')."""
    w = F.lower(word)
    return (F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y")))
            .when(w.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
            .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), F.regexp_replace(w, "s$", ""))
            .otherwise(w))


def plain_lemma(word: str) -> str:
    """``lemma`` of a word in lower case that ends in s."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if not word.endswith("ss") and len(word) > 3 else word


def stratified_split(df: DataFrame, stratum: str, id_col: str, test: float, valid: float) -> DataFrame:
    """Exact per-stratum split by a hash order, without a per-stratum window.

    Rows get a dense global rank in (stratum, md5(id), id) order (range
    partitioned, so a stratum holding a third of all rows is spread over many
    tasks); rank within the stratum = global rank − stratum offset.  The first
    ceil(test·n) are test, the next ceil(valid·rest) valid, the others train.
    """
    keyed = df.withColumn("_h", F.unhex(F.md5(F.col(id_col).cast("string"))))
    ranked = dense_surrogate_key(keyed, [stratum, "_h", id_col], "_g", drop=("_h",))
    stats = ranked.groupBy(stratum).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    r = ranked.join(F.broadcast(stats), stratum)  # one row per stratum
    rank = F.col("_g") - F.col("_g0") + 1
    n_test = F.ceil(F.col("_n") * test)
    n_valid = F.ceil((F.col("_n") - n_test) * valid)
    split = F.when(rank <= n_test, "test").when(rank <= n_test + n_valid, "valid").otherwise("train")
    return r.withColumn("split", split).drop("_g", "_g0", "_n")
