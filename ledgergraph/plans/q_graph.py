"""Graph queries on a data-sized DAG (orders/customers/nations/regions, parts/brands/types)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.fixtures import big_edges, sql_with
from .registry import query

_PATHS = {
    "big_paths": ("SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM big_edges "
                  "UNION ALL SELECT e.parent, p.descendant, p.depth + 1 FROM big_paths p "
                  "JOIN big_edges e ON e.child = p.ancestor", ["big_edges"]),
    "big_closure": ("SELECT ancestor, descendant, COUNT(*) AS n_paths, MIN(depth) AS min_depth, "
                    "MAX(depth) AS max_depth FROM big_paths GROUP BY 1, 2", ["big_paths"]),
}


def _closure(t):
    return G.closure(big_edges(t))


@query("graph_closure", sql_with(["big_closure"], "SELECT * FROM big_closure", extra=_PATHS))
def graph_closure(t):
    """GR7: all (ancestor, descendant) pairs with path multiplicity and depths (iterative, checkpointed)."""
    return _closure(t).select("ancestor", "descendant", "n_paths", "min_depth", "max_depth")


@query("graph_bfs_depth", sql_with(["big_closure"],
       "SELECT ancestor AS root, descendant AS node, min_depth AS depth FROM big_closure WHERE ancestor LIKE 'R%'",
       extra=_PATHS))
def graph_bfs_depth(t):
    """GR6: BFS depth of every node below each region root."""
    roots = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    return G.bfs_depth(big_edges(t), roots)


_PAIRS_SQL = """
SELECT DISTINCT 'N' || CAST(s.s_nationkey AS VARCHAR) AS a, 'O' || CAST(l.l_orderkey AS VARCHAR) AS b
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
UNION
SELECT DISTINCT 'O' || CAST(l.l_orderkey AS VARCHAR), 'R' || CAST(n.n_regionkey AS VARCHAR)
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
"""


def _pairs(t):
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_regionkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    a = j.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("a"),
                 F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("b"))
    b = j.join(n, j.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("a"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("b"))
    return a.union(b).distinct()


@query("graph_reachable_pairs", sql_with(["big_closure"],
       f"SELECT a, b FROM ({_PAIRS_SQL}) p WHERE EXISTS (SELECT 1 FROM big_closure c "
       "WHERE c.ancestor = p.a AND c.descendant = p.b)", extra=_PATHS))
def graph_reachable_pairs(t):
    """GR8: keep (supplier nation, order) pairs where the nation is an ancestor of the order."""
    return G.reachable_pairs(_pairs(t), big_edges(t))


@query("target_subject_resolve", sql_with(["big_closure"], f"""
SELECT p.a, p.b,
       CASE WHEN f.ancestor IS NOT NULL THEN p.a WHEN r.ancestor IS NOT NULL THEN p.b END AS target,
       CASE WHEN f.ancestor IS NOT NULL THEN p.b WHEN r.ancestor IS NOT NULL THEN p.a END AS subject,
       CASE WHEN f.ancestor IS NULL AND r.ancestor IS NULL THEN 'NOT_RELATED' END AS error_code
FROM ({_PAIRS_SQL}) p
LEFT JOIN big_closure f ON f.ancestor = p.a AND f.descendant = p.b
LEFT JOIN big_closure r ON r.ancestor = p.b AND r.descendant = p.a""", extra=_PATHS))
def target_subject_resolve(t):
    """GR9: which of two nodes is the target (ancestor) and which the subject; else NOT_RELATED."""
    p = _pairs(t)
    asked = p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node")))
    clos = G.closure(big_edges(t), below=asked).select("ancestor", "descendant")
    fwd = clos.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), F.lit(True).alias("fwd"))
    rev = clos.select(F.col("ancestor").alias("b"), F.col("descendant").alias("a"), F.lit(True).alias("rev"))
    j = p.join(fwd, ["a", "b"], "left").join(rev, ["a", "b"], "left")
    return j.select(
        "a", "b",
        F.when(F.col("fwd"), F.col("a")).when(F.col("rev"), F.col("b")).alias("target"),
        F.when(F.col("fwd"), F.col("b")).when(F.col("rev"), F.col("a")).alias("subject"),
        F.when(F.col("fwd").isNull() & F.col("rev").isNull(), F.lit("NOT_RELATED")).alias("error_code"))


@query("graph_node_heights", sql_with(["big_closure", "big_edges"], """
SELECT n.node, COALESCE(h.height, 0) AS height
FROM (SELECT child AS node FROM big_edges UNION SELECT parent FROM big_edges) n
LEFT JOIN (SELECT ancestor, MAX(max_depth) AS height FROM big_closure GROUP BY 1) h ON h.ancestor = n.node""",
       extra=_PATHS))
def graph_node_heights(t):
    """EVA13/ST2: height of every node (longest path to a leaf) — drives bottom-up strata."""
    return G.node_heights(big_edges(t))


@query("graph_inverse_edges", sql_with(["big_edges"],
       "SELECT parent AS child, child AS parent, 'hasPart' AS role FROM big_edges"))
def graph_inverse_edges(t):
    """GR10: materialise inverse edges (partOf -> hasPart)."""
    inv = t.spark.createDataFrame([("partOf", "hasPart")], "role string, inverse string")
    return G.inverse_edges(big_edges(t), inv)


@query("graph_inverse_check", sql_with(["big_edges"], """
SELECT 'forward_without_inverse' AS check_name, COUNT(*) AS n FROM big_edges e
WHERE NOT EXISTS (SELECT 1 FROM (SELECT parent AS child, child AS parent FROM big_edges) i
                  WHERE i.child = e.parent AND i.parent = e.child)
UNION ALL
SELECT 'inverse_without_forward', COUNT(*) FROM (SELECT parent AS child, child AS parent FROM big_edges) i
WHERE NOT EXISTS (SELECT 1 FROM big_edges e WHERE e.parent = i.child AND e.child = i.parent)"""))
def graph_inverse_check(t):
    """GR10: both directions of the inverse relation agree (anti joins both ways; expect zeros)."""
    e = big_edges(t).select("child", "parent")
    inv = G.inverse_edges(big_edges(t), t.spark.createDataFrame([("partOf", "hasPart")], "role string, inverse string"))
    i = inv.select("child", "parent")
    back = i.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    fwd_missing = e.join(back, ["child", "parent"], "left_anti").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("forward_without_inverse").alias("check_name"), "n")
    inv_missing = back.join(e, ["child", "parent"], "left_anti").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit("inverse_without_forward").alias("check_name"), "n")
    return fwd_missing.unionByName(inv_missing)


@query("graph_subtree_nodes", sql_with(["big_edges"],
       "SELECT parent AS node FROM big_edges UNION SELECT child FROM big_edges"))
def graph_subtree_nodes(t):
    """GR3/SO6: every node mentioned by the adjacency table (parents ∪ children, distinct)."""
    return G.subtree_nodes(big_edges(t))


@query("graph_subtree_relations", sql_with(["big_closure", "big_edges"], """
SELECT e.child, e.parent, e.role FROM big_edges e
WHERE e.parent IN (SELECT descendant FROM big_closure WHERE ancestor = 'R1' UNION SELECT 'R1')
  AND e.child LIKE 'C%'""", extra=_PATHS))
def graph_subtree_relations(t):
    """GR2/JN4: edges into the subtree of one region whose child is typed customer."""
    root = t.spark.createDataFrame([("R1",)], "node string")
    clos = G.closure(big_edges(t), above=root)
    sub = clos.select(F.col("descendant").alias("parent")).union(root)
    e = big_edges(t)
    return e.join(sub, "parent", "left_semi").filter(F.col("child").startswith("C")).select("child", "parent", "role")


_SUBSET_SQL = """
SELECT s.knowledge, e.child, e.parent, e.role
FROM (SELECT ancestor AS knowledge, descendant AS node FROM big_closure WHERE ancestor LIKE 'R%'
      UNION SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'R' || CAST(r_regionkey AS VARCHAR) FROM region) s
JOIN big_edges e ON e.child = s.node
JOIN (SELECT ancestor AS knowledge, descendant AS node FROM big_closure WHERE ancestor LIKE 'R%'
      UNION SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'R' || CAST(r_regionkey AS VARCHAR) FROM region) s2
  ON s2.knowledge = s.knowledge AND s2.node = e.parent"""


def _region_edges(t):
    roots = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("knowledge"))
    clos = G.closure(big_edges(t), above=roots.select(F.col("knowledge").alias("node")))
    subset = clos.select(F.col("ancestor").alias("knowledge"), F.col("descendant").alias("node")).union(
        roots.select("knowledge", F.col("knowledge").alias("node")))
    return G.subset_edges(big_edges(t), subset)


@query("graph_subset_edges", sql_with(["big_closure", "big_edges"], _SUBSET_SQL, extra=_PATHS))
def graph_subset_edges(t):
    """GR1: named knowledge subsets (one per region) and the edges with both ends inside."""
    return _region_edges(t)


@query("graph_subset_inverse_edges", sql_with(["big_closure", "big_edges"], f"""
SELECT x.knowledge || 'R' AS knowledge, x.parent AS child, x.child AS parent, 'hasPart' AS role FROM ({_SUBSET_SQL}) x""",
       extra=_PATHS))
def graph_subset_inverse_edges(t):
    """GR1: the inverse subsets, named with an R at the end: the same nodes by the inverse roles, parent to child."""
    inv = t.spark.createDataFrame([("partOf", "hasPart")], "role string, inverse string")
    e = _region_edges(t).join(F.broadcast(inv), "role")
    return e.select(F.concat("knowledge", F.lit("R")).alias("knowledge"), F.col("parent").alias("child"),
                    F.col("child").alias("parent"), F.col("inverse").alias("role"))


_NS = [("O", "http://example.org/order#"), ("C", "http://example.org/customer#"),
       ("S", "http://example.org/supplier#"), ("N", "http://example.org/nation#"),
       ("R", "http://example.org/region#"), ("P", "http://example.org/part#"),
       ("B", "http://example.org/brand#"), ("T", "http://example.org/type#")]


@query("iri_expand", sql_with(["big_edges"], """
SELECT e.child AS node, ns.iri || CASE WHEN substr(e.child, 2, 1) = ':' THEN substr(e.child, 3) ELSE substr(e.child, 2) END AS iri
FROM (SELECT DISTINCT child FROM big_edges) e
JOIN (VALUES """ + ", ".join(f"('{p}', '{i}')" for p, i in _NS) + """) AS ns(prefix, iri)
  ON ns.prefix = substr(e.child, 1, 1)"""))
def iri_expand(t):
    """GR14: prefix expansion of node ids to full IRIs (broadcast prefix table)."""
    ns = t.spark.createDataFrame(_NS, "prefix string, iri string")
    nodes = big_edges(t).select(F.col("child").alias("node")).distinct()
    local = F.when(F.substring("node", 2, 1) == ":", F.expr("substring(node, 3)")).otherwise(F.expr("substring(node, 2)"))
    j = nodes.join(F.broadcast(ns), F.substring("node", 1, 1) == ns.prefix)
    return j.select("node", F.concat("iri", local).alias("iri"))


@query("iri_local_name", "SELECT page_id, CASE WHEN len(string_split(url, '#')) = 2 "
       "THEN string_split(url, '#')[2] END AS local_name FROM pages")
def iri_local_name(t):
    """GR13: local name after the single '#' of an IRI (NULL when not exactly one '#')."""
    return t.pages.select("page_id", G.iri_local_name(F.col("url")).alias("local_name"))


def _size_case(col: str) -> str:
    from ..sources.reference_values import LEVEL_NODE_SIZE
    return "CASE " + " ".join(f"WHEN {col} = {lv} THEN {sz}" for lv, sz in LEVEL_NODE_SIZE) + " ELSE 10 END"


_NODES_SQL = f"""
SELECT n.node AS id, n.node AS label, CASE WHEN substr(n.node, 2, 1) = ':' THEN substr(n.node, 1, 1)
       WHEN n.node IN ('WORLD', 'PARTS') THEN n.node ELSE substr(n.node, 1, 1) END AS grp,
       {_size_case('COALESCE(d.depth, 0)')} AS size, 'depth ' || CAST(COALESCE(d.depth, 0) AS VARCHAR) AS title
FROM (SELECT child AS node FROM big_edges UNION SELECT parent FROM big_edges) n
LEFT JOIN (SELECT descendant, MIN(min_depth) AS depth FROM big_closure WHERE ancestor IN ('WORLD', 'PARTS') GROUP BY 1) d
  ON d.descendant = n.node"""


@query("graph_export_nodes", sql_with(["big_closure", "big_edges"], _NODES_SQL, extra=_PATHS))
def graph_export_nodes(t):
    """GR11: node rows for drawing (id, label, group, size by depth from the root, title), deduplicated."""
    from ..sources.reference_values import LEVEL_NODE_SIZE
    e = big_edges(t)
    nodes = G.subtree_nodes(e)
    tops = t.spark.createDataFrame([("WORLD",), ("PARTS",)], "node string")
    d = G.closure(e, above=tops).groupBy(F.col("descendant").alias("node")) \
        .agg(F.min("min_depth").alias("depth"))
    j = nodes.join(d, "node", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    size = None
    for lv, sz in LEVEL_NODE_SIZE:
        size = F.when(F.col("depth") == lv, F.lit(sz)) if size is None else size.when(F.col("depth") == lv, F.lit(sz))
    grp = F.when(F.col("node").isin("WORLD", "PARTS"), F.col("node")).otherwise(F.substring("node", 1, 1))
    return j.select(F.col("node").alias("id"), F.col("node").alias("label"), grp.alias("grp"),
                    size.otherwise(F.lit(10)).alias("size"),
                    F.concat(F.lit("depth "), F.col("depth").cast("string")).alias("title"))


@query("graph_export_edges", sql_with(["big_edges"],
       "SELECT child AS \"from\", parent AS \"to\", role AS title, 2 AS weight FROM big_edges"))
def graph_export_edges(t):
    """GR11/GR12: edge rows for drawing (from, to, title = role, weight)."""
    return big_edges(t).select(F.col("child").alias("from"), F.col("parent").alias("to"), F.col("role").alias("title"),
                               F.lit(2).alias("weight"))


@query("graph_export_edge_ends", sql_with(["big_closure", "big_edges"], """
SELECT e.child AS "from", e.parent AS "to", e.role AS title, 2 AS weight, a.label AS from_label, a.grp AS from_grp,
       a.size AS from_size, a.title AS from_title, b.label AS to_label, b.grp AS to_grp, b.size AS to_size, b.title AS to_title
FROM big_edges e LEFT JOIN drawn a ON a.id = e.child LEFT JOIN drawn b ON b.id = e.parent""",
       extra={**_PATHS, "drawn": (_NODES_SQL, ["big_closure", "big_edges"])}))
def graph_export_edge_ends(t):
    """JN11/GR11: edge rows for drawing with the label, group, size and title of the nodes at both ends."""
    attrs = t.derived("drawn_nodes", lambda: graph_export_nodes(t).withColumnRenamed("id", "node"), checkpoint=True)
    e = G.end_attributes(graph_export_edges(t), attrs, "from", "from")
    return G.end_attributes(e, attrs, "to", "to")
