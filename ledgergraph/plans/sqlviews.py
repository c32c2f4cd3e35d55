"""SQL text (DuckDB oracle only) for the compiled ontology tables."""

from __future__ import annotations

from ..sources.fixtures import SQL_VIEWS, LEAF_ACCOUNTS

ONTOLOGY_VIEWS = {
    "onto_pe": ("SELECT e.child, e.parent, CAST(COALESCE(n.sign, 1) AS BIGINT) AS s FROM onto_edges e "
                "LEFT JOIN onto_nodes n ON n.acc = e.child WHERE e.role = 'partOf'", ["onto_edges", "onto_nodes"]),
    "onto_paths": ("SELECT parent AS ancestor, child AS node, s AS c, 1 AS depth FROM onto_pe "
                   "UNION ALL SELECT pe.parent, p.node, p.c * pe.s, p.depth + 1 FROM onto_paths p "
                   "JOIN onto_pe pe ON pe.child = p.ancestor", ["onto_pe"]),
    "onto_closure": ("SELECT ancestor, node AS descendant, CAST(SUM(c) AS BIGINT) AS coef, COUNT(*) AS n_paths, "
                     "MIN(depth) AS min_depth, MAX(depth) AS max_depth FROM onto_paths GROUP BY 1, 2", ["onto_paths"]),
    "onto_leafs": ("SELECT DISTINCT child AS node FROM onto_pe WHERE child NOT IN (SELECT parent FROM onto_pe)",
                   ["onto_pe"]),
    "onto_coef": ("SELECT ancestor, descendant AS leaf, coef, n_paths FROM onto_closure "
                  "WHERE descendant IN (SELECT node FROM onto_leafs)", ["onto_closure", "onto_leafs"]),
    "onto_need": ("SELECT ancestor, COUNT(*) AS need FROM onto_coef GROUP BY 1", ["onto_coef"]),
    "onto_ratio_defs": (
        "SELECT n.parent AS account, n.child AS num, d.child AS den, "
        "CASE WHEN y.parent IS NULL THEN 1.0 ELSE 365.0 END AS scale "
        "FROM onto_edges n JOIN onto_edges d ON d.parent = n.parent AND d.role = 'denominator' "
        "LEFT JOIN onto_edges y ON y.parent = n.parent AND y.role = 'numerator' AND y.child = 'CalendarOneYear' "
        "WHERE n.role = 'numerator' AND n.child <> 'CalendarOneYear'", ["onto_edges"]),
    "fin_rollup": (
        "SELECT f.code, f.bsns_year, f.quarter, c.ancestor AS account, CAST(SUM(c.coef * f.value) AS BIGINT) AS value, "
        "COUNT(*) AS n_present, n.need FROM fin_fact f JOIN onto_coef c ON c.leaf = f.account "
        "JOIN onto_need n ON n.ancestor = c.ancestor GROUP BY f.code, f.bsns_year, f.quarter, c.ancestor, n.need",
        ["fin_fact", "onto_coef", "onto_need"]),
    "fin_known": (
        "SELECT code, bsns_year, quarter, account, CAST(value AS DOUBLE) AS value FROM fin_fact "
        "UNION ALL SELECT code, bsns_year, quarter, account, CAST(value AS DOUBLE) FROM fin_rollup "
        "WHERE n_present = need", ["fin_fact", "fin_rollup"]),
    "fin_ratio": (
        "SELECT a.code, a.bsns_year, a.quarter, r.account, r.scale, "
        "CASE WHEN b.value = 0 THEN NULL ELSE r.scale * a.value / b.value END AS value "
        "FROM onto_ratio_defs r JOIN fin_known a ON a.account = r.num "
        "JOIN fin_known b ON b.account = r.den AND b.code = a.code AND b.bsns_year = a.bsns_year "
        "AND b.quarter = a.quarter", ["onto_ratio_defs", "fin_known"]),
}
SQL_VIEWS.update(ONTOLOGY_VIEWS)

LEAF_LIST_SQL = ", ".join(f"'{a}'" for a, _ in LEAF_ACCOUNTS)
