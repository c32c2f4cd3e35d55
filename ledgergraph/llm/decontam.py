"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts become sequences of lower-cased runs of letters and digits.  A seed is a
fixed mask over ``SPAN`` token positions; positions marked 0 are ignored, so a
hash of the marked tokens survives substitutions at the others.  Seeds of the
benchmark are joined with the seeds at every position of every whole document;
around a hit the two texts are laid on each other at the hit's offset, and the
best stretch (+1 a shared word, -2 a differing one) must reach ``min_score``
(10, or all words of a shorter item).  Of a run of neighbouring hits of one
mask only the first is verified: the others lay the texts the same way.

Items shorter than ``SPAN`` words are sought as one window of all their words;
items of fewer than ``MIN_WORDS`` words say too little and match nothing.

Scale: documents are not shuffled.  The benchmark's seeds are broadcast in parts
of at most ``PART_ROWS`` rows (counted), one pass over the documents per part; with
several parts each pass is a job of its own, so that one part is held at a time.
A document's windows are generated and probed inside one code-generated stage,
which keeps all hits of a document until it has gone through its windows: a hit
takes only the words with it that lie beside the item's, never the whole document.

Defined cases: null and empty texts have no words and match nothing; repeated
rows are each reported by their id (equal ids and texts once); a tie of two
offsets gives the leftmost; an empty benchmark matches nothing; extra columns
pass through ``clean_documents`` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, small, wide_hash

SPAN = 11
MASKS = ("11100101011", "11010110101", "10111001011")
MIN_WORDS = 5
PART_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """array<bigint>: hash of each token; empty for null."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(text.isNull() | (plain == ""), F.array().cast("array<bigint>")) \
        .otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def _offsets(mask: str) -> list[int]:
    return [i for i, b in enumerate(mask) if b == "1"]


def _seed(words: Column, at: Column, no: int, mask: str) -> Column:
    return F.xxhash64(F.lit(no), *[F.get(words, at + o) for o in _offsets(mask)])


def _all_masks(lengths: list[int]) -> list[str]:
    """The spaced masks, and a full window for each length of the short items."""
    return [*MASKS, *["1" * n for n in lengths]]


def _benchmark_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(seed, mask, item, q, size): item is the benchmark's own words' number, size how many they are."""
    n = F.size("words")
    parts = []
    for no, m in enumerate(masks):
        full = no >= len(MASKS)
        fit = items.filter(n == len(m)) if full else items.filter(n >= SPAN)
        at = fit.select("item", "words", F.explode(F.sequence(F.lit(0), n - len(m))).alias("q"))
        parts.append(at.select(_seed(F.col("words"), F.col("q"), no, m).alias("seed"), F.lit(no).alias("mask"),
                               "item", "q", F.size("words").alias("size")))
    return reduce(DataFrame.unionAll, parts)


def _best_stretch(a: Column, b: Column) -> Column:
    """Score of the best run of two aligned arrays: +1 where equal, -2 where not."""
    steps = F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(-2)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
                       lambda s, x: F.struct(F.greatest(s["now"] + x, F.lit(0)).alias("now"),
                                             F.greatest(s["best"], s["now"] + x).alias("best")),
                       lambda s: s["best"])


def overlaps(df: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             min_score: int = 10, part_rows: int = PART_ROWS, **keep: Column) -> DataFrame:
    """(keep..., t1, t2, item_id, score, doc_start, item_start, words): verified overlaps; t1, t2 hash the text."""
    items = bench.select(F.col(f"`{item_id}`").alias("item_id"), word_hashes(F.col(f"`{item_text}`")).alias("words")) \
        .filter(F.size("words") >= MIN_WORDS).withColumn("item", F.xxhash64("item_id", "words"))
    items = cut(items.dropDuplicates(["item"]))
    short = items.filter(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct()
    masks = _all_masks(sorted(r["n"] for r in short.collect()))  # at most SPAN - MIN_WORDS lengths
    seeds = cut(_benchmark_seeds(items, masks))
    n_parts = -(-seeds.count() // part_rows) or 1
    t1, t2 = wide_hash(F.col(f"`{text}`"))
    docs = df.select(*[c.alias(k) for k, c in keep.items()], t1.alias("t1"), t2.alias("t2"),
                     word_hashes(F.col(f"`{text}`")).alias("w"))
    shortest = min([SPAN, *[len(m) for m in masks]])
    at = docs.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - shortest, F.lit(0)))).alias("p"))
    probes = at.select("*", F.explode(F.array(*[_seed(F.col("w"), F.col("p"), no, m) for no, m in enumerate(masks)]))
                       .alias("seed"))
    found = []
    for part in range(n_parts):
        own = items.filter(F.pmod("item", F.lit(n_parts)) == part)
        side = seeds.filter(F.pmod("item", F.lit(n_parts)) == part)
        d0, i0 = F.greatest(F.col("p") - F.col("q"), F.lit(0)), F.greatest(F.col("q") - F.col("p"), F.lit(0))
        hit = probes.join(F.broadcast(side), "seed").select("*", d0.alias("doc_start"), i0.alias("item_start"))
        hit = hit.withColumn("n", F.least(F.size("w") - F.col("doc_start"), F.col("size") - F.col("item_start")))
        hit = hit.select(*keep, "t1", "t2", "mask", "item", "p", "q", "doc_start", "item_start", "n",
                         F.slice("w", F.col("doc_start") + 1, F.col("n")).alias("beside"))
        hit = hit.join(F.broadcast(own), "item")
        before = reduce(Column.__or__, [
            (F.col("mask") == no) & reduce(Column.__and__, [
                F.get("beside", F.col("p") - F.col("doc_start") - 1 + o) == F.get("words", F.col("q") - 1 + o)
                for o in _offsets(m)])
            for no, m in enumerate(masks)])
        first = (F.col("p") == 0) | (F.col("q") == 0) | ~F.coalesce(before, F.lit(False))
        score = _best_stretch(F.col("beside"), F.slice("words", F.col("item_start") + 1, F.col("n")))
        hit = hit.filter(first).withColumn("score", score).filter(F.col("score") >= F.least(F.lit(min_score), F.size("words")))
        hit = _best(hit.select(*keep, "t1", "t2", "item_id", "score", "doc_start", "item_start", F.col("n").alias("words")), [*keep])
        found.append(cut(hit) if n_parts > 1 else hit)
    out = _best(reduce(DataFrame.unionAll, found), [*keep]) if n_parts > 1 else found[0]
    return out.select(*keep, "t1", "t2", "item_id", *[F.col(c).cast("long").alias(c) for c in ("score", "doc_start", "item_start", "words")])


def _best(hits: DataFrame, keep: list[str]) -> DataFrame:
    """The best hit of each text and item, the leftmost of equal scores."""
    best = F.max(F.struct("score", (-F.col("doc_start")).alias("neg"), "item_start", "words")).alias("b")
    return hits.groupBy(*keep, "t1", "t2", "item_id").agg(best).select(
        *keep, "t1", "t2", "item_id", "b.score", (-F.col("b.neg")).alias("doc_start"), "b.item_start", "b.words")


def clean_documents(df: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text overlaps no benchmark item, with their own columns."""
    bad = small(cut(overlaps(df, bench, text, **options).select("t1", "t2").distinct()))
    t1, t2 = wide_hash(F.col(f"`{text}`"))
    return packed(df, t1=t1, t2=t2).join(bad, ["t1", "t2"], "left_anti").select("row.*")
