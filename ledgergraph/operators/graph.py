"""Graph operators over edge tables ``(child, parent, role)``.

Graph patterns are joins; reachability is a transitive closure computed by
semi-naive iteration: one join and one partial-aggregated groupBy per level,
until the frontier is empty.  Each frontier is checkpointed into
``spark.checkpoint.dir``, so lineage stays short and a lost executor recomputes
one round.  There is no depth limit; a cycle is found where a node becomes its
own ancestor, and raises.

``below`` / ``above`` seed the closure, so a question about a few nodes never
builds all pairs.  The edges that can extend a frontier are first reduced to
its distinct ends (combined before the shuffle, broadcast behind their count):
near the roots these are a handful, so a parent with a third of all rows need
not be a shuffle key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CLOSURE_COLS = ["ancestor", "descendant", "n_paths", "weight", "min_depth", "max_depth"]
#: Rows (two names and a number each) up to which a join side is broadcast.
BROADCAST_ROWS = 200_000
#: A node at more than one edge in this many is hot: there are fewer of them than this, whatever the size of the graph.
HOT_NODES = 10_000


def _step_agg(df: DataFrame) -> DataFrame:
    return df.groupBy("ancestor", "descendant").agg(
        F.sum("n_paths").alias("n_paths"), F.sum("weight").alias("weight"),
        F.min("min_depth").alias("min_depth"), F.max("max_depth").alias("max_depth"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def closure(edges: DataFrame, weight: Column | None = None, below: DataFrame | None = None,
            above: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant) pairs with path count, sum of path weight products and depths.

    ``weight`` is a per-edge multiplier (default 1); the weight of a path is the
    product of its edge weights, and ``weight`` sums it over all paths (so a
    node reached by two paths contributes twice, while the pair is one row).
    ``above`` (node): only pairs whose ancestor is one of these; ``below`` (node):
    only pairs whose descendant is one of these.  Raises ValueError on a cycle.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    w = (weight if weight is not None else F.lit(1)).cast("long")
    e = edges.select(F.col("child").alias("e_child"), F.col("parent").alias("e_parent"), w.alias("e_w")).checkpoint()
    down = above is not None
    start = e
    if above is not None:
        start = start.join(_small(above.select(F.col("node").alias("e_parent")).distinct()), "e_parent", "left_semi")
    if below is not None and not down:
        start = start.join(below.select(F.col("node").alias("e_child")).distinct(), "e_child", "left_semi")
    frontier = _step_agg(start.select(
        F.col("e_parent").alias("ancestor"), F.col("e_child").alias("descendant"), F.lit(1).cast("long").alias("n_paths"),
        F.col("e_w").alias("weight"), F.lit(1).alias("min_depth"), F.lit(1).alias("max_depth"))).checkpoint()
    end, near, far = ("descendant", "e_parent", "e_child") if down else ("ancestor", "e_child", "e_parent")
    other = "ancestor" if down else "descendant"
    levels = []
    while True:
        state = frontier.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(end).alias("ends"),
                             F.count_if(F.col("ancestor") == F.col("descendant")).alias("cycles")).first()
        if not state["rows"]:
            break
        if state["cycles"]:
            raise ValueError("the edge table has a cycle")
        levels.append(frontier)
        ends = frontier.select(F.col(end).alias(near)).distinct()
        step = e.join(F.broadcast(ends) if state["ends"] <= BROADCAST_ROWS else ends, near, "left_semi")
        j = frontier.join(step, F.col(end) == F.col(near))  # broadcast by its size at run time, else split where skewed
        frontier = _step_agg(j.select(F.col(far).alias(end), other, "n_paths",
                                      (F.col("weight") * F.col("e_w")).alias("weight"),
                                      (F.col("min_depth") + 1).alias("min_depth"),
                                      (F.col("max_depth") + 1).alias("max_depth"))).checkpoint()
    if not levels:
        return frontier.select(*CLOSURE_COLS)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    out = _step_agg(out)
    if below is not None and down:
        out = out.join(below.select(F.col("node").alias("descendant")).distinct(), "descendant", "left_semi")
    return out.select(*CLOSURE_COLS)


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes that are never a parent (``node``)."""
    kids = edges.select(F.col("child").alias("node"))
    parents = edges.select(F.col("parent").alias("node"))
    return kids.join(parents, "node", "left_anti").distinct()


def node_heights(edges: DataFrame) -> DataFrame:
    """(node, height): longest path down to a leaf (0 for leaves), peeled level by level from the leaves.

    A round keeps the distinct parents of the last one, so it holds nodes, never pairs.  Raises ValueError on a cycle.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("child", "parent").distinct().checkpoint()
    nodes = e.select(F.col("child").alias("node")).union(e.select(F.col("parent").alias("node"))).distinct().checkpoint()
    most = nodes.count()
    level, k, parts = leaves(e), 0, [nodes.withColumn("height", F.lit(0))]
    while True:
        level = e.join(_small(level.checkpoint()), F.col("child") == F.col("node"), "left_semi") \
            .select(F.col("parent").alias("node")).distinct().checkpoint()
        k += 1
        if level.isEmpty():
            break
        if k >= most:
            raise ValueError("the edge table has a cycle")
        parts.append(level.withColumn("height", F.lit(k)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.max("height").alias("height"))


def bfs_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): nodes below each root with their BFS (shortest) depth."""
    c = closure(edges, above=roots.select(F.col("root").alias("node")))
    return c.select(F.col("ancestor").alias("root"), F.col("descendant").alias("node"), F.col("min_depth").alias("depth"))


def reachable_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep (a, b) pairs where ``a`` is an ancestor of ``b``; only the ancestors of the asked ``b`` are built."""
    c = closure(edges, below=pairs.select(F.col("b").alias("node")))
    return pairs.join(c.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b")), ["a", "b"], "left_semi")


def inverse_edges(edges: DataFrame, inverse_map: DataFrame) -> DataFrame:
    """(child, parent, role) -> (parent, child, inverse role)."""
    return edges.join(F.broadcast(inverse_map), "role").select(
        F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("inverse").alias("role"))


def subset_edges(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """(knowledge, child, parent, role): the edges with both ends in a named subset, once for each (knowledge, node) set."""
    a = subset.select("knowledge", F.col("node").alias("child"))
    b = subset.select("knowledge", F.col("node").alias("parent"))
    return edges.join(a, "child").join(b, ["knowledge", "parent"]).select("knowledge", "child", "parent", "role")


def end_attributes(edges: DataFrame, attrs: DataFrame, end: str, prefix: str, hot_nodes: int = HOT_NODES) -> DataFrame:
    """The edges with the attributes of the node at their ``end`` as columns ``<prefix>_<attribute>``, null where it has none.

    ``attrs``: (node, attributes), one row per node.  A node at more than one edge in ``hot_nodes`` would send all its edges
    to one task; there are fewer than ``hot_nodes`` such nodes by that count, so their attributes are broadcast and only the
    other edges are shuffled.  Edges without that end stay, with nulls.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    a = attrs.select(F.col("node").alias(end), *[F.col(c).alias(f"{prefix}_{c}") for c in attrs.columns if c != "node"])
    total = edges.count()
    hot = edges.filter(F.col(end).isNotNull()).groupBy(end).agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") * F.lit(hot_nodes) > F.lit(total)).select(end).checkpoint()
    warm = edges.join(F.broadcast(hot.join(a, end, "left")), end)
    cold = edges.join(F.broadcast(hot), end, "left_anti").join(a, end, "left")
    return warm.unionByName(cold).select(*edges.columns, *a.columns[1:])


def subtree_nodes(edges: DataFrame) -> DataFrame:
    """All nodes mentioned by an adjacency table (parent ∪ children)."""
    return edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct()


def role_dictionary(edges: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """parent -> sorted, de-duplicated child list."""
    e = edges
    if skip:
        e = e.filter(~F.col("child").isin(skip) & ~F.col("parent").isin(skip))
    return e.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def iri_local_name(c: Column, strict: bool = False) -> Column:
    """``ns#local`` -> ``local``; NULL (or an error when strict) unless exactly one '#'."""
    parts = F.split(c, "#")
    ok = F.size(parts) == 2
    if strict:
        return F.when(ok, parts.getItem(1)).otherwise(F.raise_error(F.concat(F.lit("not a single-# IRI: "), c)))
    return F.when(ok, parts.getItem(1))
