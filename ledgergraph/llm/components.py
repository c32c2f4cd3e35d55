"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges shrink towards stars whose centre is the component's smallest id; each
round is two grouped minima (combined before the shuffle) and two joins on the
node, and is written to the shared checkpoint folder, so a lost executor costs
one round at most.  Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round; edges are (a, b) with a < b."""
    if large:  # every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a node and its smaller neighbours
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a, b): root is the smallest id of its component."""
    now, before = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), None
    while True:
        now = cut(_star(_star(now, True).distinct(), False).filter("a <> b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
