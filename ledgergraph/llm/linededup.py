"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host; a line's frequency is the share of the host's pages
that contain it, and lines above ``ratio`` (on at least ``min_pages`` pages)
are boilerplate and dropped wherever they stand on that host's pages.
Identical pages of a host count as one page, so a page stored a thousand
times does not turn its own lines into boilerplate.

Near copies are many pages to a count of pages, so a large group of them would
turn its own article into boilerplate.  ``cleaned_documents`` therefore lets a
line go only if pages of other words vote for it (``voted``): a page of whose
sampled five-word runs ``COPY_SHARE`` or more stand on many pages of the host has
no vote, and the line must pass the ratio among the pages that have one.

Scale: line hashes, not lines, are shuffled, after a map-side combine (a line
on every page of a hot host sends one row per task).  At most
(mean distinct lines per page) / ratio lines of a host can pass the ratio, so
the table of boilerplate lines has a few hundred rows per host; it is broadcast
when its counted rows are few, else joined over ``SALTS`` parts of every host.

Defined cases: null text stays null, empty text empty; blank lines are never
counted or dropped; lines are compared after trimming blanks; null host is a
host of its own; repeated rows are all cleaned alike; an empty table gives an
empty result; extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, key_of, packed, small, wide_hash

SALTS = 64
#: Five-word runs of a page that are looked at (those of least hash, so near copies take mostly the same).
SAMPLE = 8
#: A page of whose sample this share is on many pages of its host is taken for one of a group of near copies.
COPY_SHARE = 0.6
#: Votes that a line needs at least, against chance.
MIN_VOTES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.1,
                min_pages: int = 10) -> DataFrame:
    """(hkey, l1, l2, pages, host_pages): the lines of each host above the ratio, by 128-bit hash."""
    t = F.col(f"`{text}`")
    pages = df.filter(t.isNotNull()).select(key_of(F.col(f"`{host}`")).alias("hkey"), F.xxhash64(t).alias("page"),
                                            t.alias("t"))
    totals = pages.groupBy("hkey").agg(F.count_distinct("page").alias("host_pages")) \
        .filter(F.col("host_pages") >= min_pages)
    line = pages.select("hkey", "page", F.explode(F.array_distinct(F.transform(lines_of(F.col("t")), lambda x: F.trim(x))))
                        .alias("line")).filter(F.col("line") != "")
    l1, l2 = wide_hash(F.col("line"))
    found = line.select("hkey", "page", l1.alias("l1"), l2.alias("l2")).groupBy("hkey", "l1", "l2") \
        .agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= min_pages)
    return found.join(totals, "hkey").filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def _with_lists(rows: DataFrame, per_host: DataFrame, few: bool) -> DataFrame:
    """The rows (hkey, t, ...) with their host's list: broadcast where few, else over ``SALTS`` parts of every host."""
    if few:
        return rows.join(F.broadcast(per_host), "hkey", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
    spread = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["hkey", "salt"], "left")


def sample_runs(text: Column) -> Column:
    """array<bigint>: the ``SAMPLE`` least hashes of the text's five-word runs (of all its words if fewer)."""
    words = F.transform(F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +"),
                        lambda w: F.xxhash64(w))
    # bound as a lambda's variable: inside the inner lambda the expression itself would split the text for every word
    runs = F.get(F.transform(F.array(words), lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - 5, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(5)]))), 0)
    return F.slice(F.sort_array(F.array_distinct(runs)), 1, SAMPLE)


def voted(df: DataFrame, bad: DataFrame, text: str, host: str, ratio: float) -> DataFrame:
    """(hkey, l1, l2): the lines of ``bad`` that pages outside groups of near copies vote for."""
    t = F.col(f"`{text}`")
    pages = df.filter(t.isNotNull()).select(key_of(F.col(f"`{host}`")).alias("hkey"), t.alias("t"))
    pages = pages.join(small(cut(bad.select("hkey").distinct())), "hkey", "left_semi")
    pages = pages.select("hkey", F.xxhash64("t").alias("page"), sample_runs(F.col("t")).alias("runs"),
                         F.transform(lines_of(F.col("t")), lambda x: F.struct(*[
                             h.alias(n) for n, h in zip(("l1", "l2"), wide_hash(F.trim(x)))])).alias("ls"),
                         F.xxhash64("t").alias("t"))
    lists = bad.groupBy("hkey").agg(F.collect_list(F.struct("l1", "l2")).alias("bad"))
    few = bad.count() <= BROADCAST_ROWS
    pages = cut(_with_lists(pages, lists, few).select("hkey", "page", "t", "runs",
                                                      F.array_intersect("ls", "bad").alias("ls")))
    totals = pages.groupBy("hkey").agg(F.count_distinct("page").alias("host_pages"))
    often = cut(pages.select("hkey", "page", F.explode("runs").alias("run")).groupBy("hkey", "run")
                .agg(F.count_distinct("page").alias("n")).filter("n > 1").join(totals, "hkey")
                .filter(F.col("n") > F.lit(ratio / 2) * F.col("host_pages")).select("hkey", "run"))
    common = often.groupBy("hkey").agg(F.collect_list("run").alias("often"))
    shared = F.coalesce(F.size(F.array_intersect("runs", "often")), F.lit(0))
    voters = _with_lists(pages, common, often.count() <= BROADCAST_ROWS) \
        .filter(F.col("often").isNull() | (shared < F.lit(COPY_SHARE) * F.size("runs")))
    able = voters.groupBy("hkey").agg(F.count_distinct("page").alias("voters"))
    votes = voters.select("hkey", "page", F.explode("ls").alias("l")).groupBy("hkey", "l.l1", "l.l2") \
        .agg(F.count_distinct("page").alias("votes")).filter(F.col("votes") >= MIN_VOTES)
    return votes.join(able, "hkey").join(totals, "hkey").filter(
        (F.col("votes") > F.lit(ratio) * F.col("voters")) & (F.col("votes") > F.lit(ratio / 4) * F.col("host_pages"))) \
        .select("hkey", "l1", "l2")


def clean(df: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.1,
          min_pages: int = 10, vote: bool = False) -> DataFrame:
    """(row, cleaned, n_lines, n_dropped): every row, its text without its host's boilerplate lines, line counts."""
    bad = cut(boilerplate(df, text, host, ratio, min_pages).select("hkey", "l1", "l2"))
    if vote and bad.take(1):
        bad = cut(voted(df, bad, text, host, ratio))
    few = bad.count() <= BROADCAST_ROWS
    per_host = bad.groupBy("hkey").agg(F.collect_list(F.struct("l1", "l2")).alias("bad"))
    joined = _with_lists(packed(df, t=text, hkey=key_of(F.col(f"`{host}`"))), per_host, few)
    every = joined.select("row", "t", "bad", lines_of(F.col("t")).alias("ls"))

    def stays(x: Column) -> Column:
        h1, h2 = wide_hash(F.trim(x))
        return (F.trim(x) == "") | ~F.array_contains(F.col("bad"), F.struct(h1.alias("l1"), h2.alias("l2")))

    kept = every.withColumn("kept", F.when(F.col("bad").isNull(), F.col("ls")).otherwise(F.filter("ls", stays)))
    return kept.select("row", F.when(F.col("bad").isNull(), F.col("t")).otherwise(F.array_join("kept", "\n"))
                       .alias("cleaned"),
                       F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("ls") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"))


def cleaned_documents(df: DataFrame, text: str = "text", host: str = "source", length: str = "n_chars",
                      **options) -> DataFrame:
    """The same columns with the cleaned text and its length; rows that were nothing but boilerplate go.

    Lines that only near copies share stay (``voted``): which copy stays is for a near-duplicate stage to say.
    """
    out = clean(df, text, host, vote=True, **options).filter((F.col("n_dropped") == 0) | (F.trim("cleaned") != ""))
    return out.select(*[F.col("cleaned").alias(c) if c == text else
                        F.length("cleaned").cast(df.schema[c].dataType).alias(c) if c == length else
                        F.col("row").getField(c).alias(c) for c in df.columns])
