"""Main text of web pages by minimum-cut labelling.

A page's text blocks are the nodes of a graph.  A classifier's evidence for
content or boilerplate becomes a capacity to the source or the sink; blocks
next to each other, and blocks under the same parent, are tied by smoothness
edges that weaken with their distance in the element tree.  The minimum cut
(max-flow) separates content from boilerplate at the least total of evidence
overruled and ties cut.

Blocks whose evidence is at least the sum of their ties keep their own side in
some minimum cut, so they are settled first, exactly, and the flow runs over
the few that are left.

Defined cases: null or empty html gives an empty text, as does a page without a
content block; broken markup is read tolerantly; long pages are read whole;
repeated rows give equal results; evidence that balances exactly is
boilerplate; extra columns pass through ``extract`` as the packed row.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import packed
from .htmlparse import Node, Page, parse

#: Capacities are whole thousandths.
UNIT = 1000
_BOILER_TAGS = frozenset("nav aside footer form menu dialog address".split())
_MAIN_TAGS = frozenset("article main".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "footer header masthead toolbar topbar comment comments commentlist reply replies disqus respond share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination pager widget "
    "copyright legal skip toc complementary contentinfo navigation".split())
_MAIN_WORDS = frozenset("article main content post entry story body articlebody maincontent".split())
_READER_WORDS = frozenset("ad ads advert comment comments reply related promo sponsored teaser".split())
_STRONG = 8.0


def _structure(nodes: list[Node]) -> list[float]:
    """Evidence of each element from itself and its ancestors: inside boilerplate stays boilerplate."""
    out: list[float] = []
    inside: list[bool] = []
    around: set[int] = set()  # elements that enclose an article, a form around a whole page say
    for n in nodes:
        k = n.parent if n.tag in _MAIN_TAGS else -1
        while k > 0 and k not in around:
            around.add(k)
            k = nodes[k].parent
    for place, n in enumerate(nodes):
        up = out[n.parent] if n.parent >= 0 else 0.0
        was_main = inside[n.parent] if n.parent >= 0 else False
        main = was_main
        if up <= -_STRONG:
            value = up
        elif (n.tag in _BOILER_TAGS or n.words & _BOILER_WORDS or n.tag == "header" and not was_main) \
                and place not in around and n.tag not in ("body", "html") \
                and not (n.tag in _MAIN_TAGS and not was_main and not n.words & _READER_WORDS):
            value = -_STRONG
        elif n.tag in _MAIN_TAGS or n.words & _MAIN_WORDS and n.tag not in ("body", "html"):
            value, main = 4.0, True
        else:
            value = up
        out.append(value)
        inside.append(main)
    return out


def _evidence(page: Page) -> list[int]:
    """Signed evidence of each block, in units: above 0 for content."""
    place = _structure(page.nodes)
    out = []
    for b in page.blocks:
        e = place[b.node]
        words = b.text.count(" ") + 1
        density = b.link_chars / len(b.text)
        if density > 0.5:
            e -= 2.0
        elif words >= 15:
            e += 1.5
        elif words < 4 and e <= 0:
            e -= 1.0
        if b.text[-1] in ".!?:;\"'»”)" and words > 3:
            e += 0.5
        if page.nodes[b.node].tag in ("h1", "h2", "h3"):
            e += 0.3
        if e <= 2 and (b.text[0] == "©" or b.text[:9].lower() == "copyright"):
            e -= 3.0
        out.append(round(e * UNIT))
    return out


def _ties(page: Page) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): neighbours in page order, and successive blocks under one parent."""
    nodes, blocks = page.nodes, page.blocks

    def distance(a: int, b: int) -> int:
        steps = 0
        while a != b:
            if nodes[a].depth >= nodes[b].depth:
                a = nodes[a].parent
            else:
                b = nodes[b].parent
            steps += 1
        return steps

    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, max(1, UNIT >> min(distance(blocks[i - 1].node, b.node), 9))))
        parent = nodes[b.node].parent
        before = last.get(parent)
        if before is not None and before != i - 1:
            out.append((before, i, UNIT >> 2))
        last[parent] = i
    return out


def label(evidence: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut: True for the source (content) side; the smallest source side where cuts tie."""
    n = len(evidence)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in ties:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    e = list(evidence)
    side: list[bool | None] = [None] * n
    total = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # settle blocks that outweigh all their open ties; their ties become evidence of the neighbours
        i = queue.popleft()
        if side[i] is not None or abs(e[i]) < total[i] or (e[i] == total[i] and e[i] > 0) or (not e[i] and total[i]):
            continue
        side[i] = e[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                e[j] += c if side[i] else -c
                total[j] -= c
                queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(s) for s in side]
    source, sink = n, n + 1
    cap: dict[int, dict[int, int]] = {source: {}, sink: {}}
    for i in left:
        cap[i] = {j: c for j, c in near[i].items() if side[j] is None}
        cap[i][source] = cap[i][sink] = 0
        if e[i] > 0:
            cap[source][i] = e[i]
        else:
            cap[i][sink] = -e[i]
            cap[sink][i] = 0
        cap[source].setdefault(i, 0)
        cap[sink].setdefault(i, 0)
    while True:  # shortest augmenting paths
        came = {source: source}
        walk = deque([source])
        while walk and sink not in came:
            u = walk.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in came:
                    came[v] = u
                    walk.append(v)
        if sink not in came:
            break
        flow, v = None, sink
        while v != source:
            u = came[v]
            flow = cap[u][v] if flow is None else min(flow, cap[u][v])
            v = u
        v = sink
        while v != source:
            u = came[v]
            cap[u][v] -= flow
            cap[v][u] += flow
            v = u
    for i in left:
        side[i] = i in came
    return [bool(s) for s in side]


def main_text(source: str | None) -> str:
    """Content blocks in page order, one a line."""
    page = parse(source)
    if not page.blocks:
        return ""
    chosen = label(_evidence(page), _ties(page))
    return "\n".join(b.text for b, c in zip(page.blocks, chosen) if c)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """(row, text): every whole row and its page's main text (empty if there is none).

    One narrow pass: pages are independent, nothing is shuffled.
    """
    @F.pandas_udf(StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype="object")

    return packed(df, html=html).select("row", text("html").alias("text"))
