"""Range joins of intervals in texts, by blocks of characters.

An interval is listed under every block of ``block`` characters that it touches,
and the join is on (text, block) with the range test behind it.  So the work
for a long text is spread over its blocks, and a position meets only what lies
in its own block: neither tokens times spans of a text nor all pairs of its
matches.  A pair that shares several blocks counts in the block of its later
start, hence once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _blocks(start: str, end: str, block: int) -> Column:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return F.explode(F.sequence(F.floor(F.col(start) / block), F.floor(last / block)))


def containing(tokens: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """tokens (doc, start, end, ...) with each span (doc, s_start, s_end, ...) that holds them whole."""
    s = spans.withColumn("_b", _blocks("s_start", "s_end", block)).withColumnRenamed("doc", "_d")
    t = tokens.withColumn("_t", F.floor(F.col("start") / block))
    j = t.join(s, (t["doc"] == s["_d"]) & (t["_t"] == s["_b"]) & (t["start"] >= s["s_start"]) & (t["end"] <= s["s_end"]))
    return j.drop("_d", "_t", "_b")


def overlapping(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs that share a character; columns (doc, a_start, a_end, ...) and (doc, b_start, b_end, ...)."""
    x = a.withColumn("_x", _blocks("a_start", "a_end", block))
    y = b.withColumn("_y", _blocks("b_start", "b_end", block)).withColumnRenamed("doc", "_d")
    later = F.floor(F.greatest(x["a_start"], y["b_start"]) / block)
    j = x.join(y, (x["doc"] == y["_d"]) & (x["_x"] == y["_y"]) & (x["_x"] == later)
               & (x["a_start"] < y["b_end"]) & (y["b_start"] < x["a_end"]))
    return j.drop("_d", "_x", "_y")
