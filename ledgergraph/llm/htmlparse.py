"""A small tolerant HTML reader: visible text blocks with their place in the element tree.

A block is the text between block-level tags; inline tags and ``br`` do not end
it.  Character references are decoded, white space becomes one blank.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>"
    r"|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s=/"'>]+)""")
_WORD = re.compile(r"[a-z0-9]+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
#: Never visible text.
HIDDEN = frozenset("head script style noscript template iframe object svg select option button textarea title "
                   "datalist canvas audio video map".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
           "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
           "option": ("option", ("select",))}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset[str]       # words of class, id and role
    hidden: bool


@dataclass
class Block:
    text: str
    node: int                   # innermost block-level element
    link_chars: int


@dataclass
class Page:
    title: str = ""
    links: list[str] = field(default_factory=list)
    metas: list[tuple[str, str]] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attrs(raw: str) -> dict[str, str]:
    out = {}
    for m in _ATTR.finditer(raw):
        v = m[2] or ""
        out.setdefault((m[1] or m[3]).lower(), html.unescape(v[1:-1] if v[:1] in "\"'" and v[:1] else v))
    return out


def squeeze(text: str) -> str:
    return " ".join(text.split())


def parse(source: str | None) -> Page:
    """Null counts as empty.  Time grows with the length of the page."""
    page = Page(nodes=[Node("", -1, 0, frozenset(), False)])
    if not source:
        return page
    nodes, blocks = page.nodes, page.blocks
    stack = [0]
    held: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        if held:
            text = squeeze(html.unescape("".join(held)))
            if text and not nodes[stack[-1]].hidden:
                k = stack[-1]
                while nodes[k].tag in INLINE:
                    k = nodes[k].parent
                blocks.append(Block(text, k, len(squeeze(html.unescape("".join(linked)))) if linked else 0))
            held.clear()
            linked.clear()

    def pop_to(place: int) -> None:
        nonlocal in_link
        for k in stack[place:]:
            in_link -= nodes[k].tag == "a"
        del stack[place:]

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        piece = source[at: m.start()] if m else source[at:]
        if piece and not nodes[stack[-1]].hidden:
            held.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in INLINE:
                if tag == "a" or tag in ("b", "i", "em", "strong", "span", "u", "font", "small"):
                    for place in range(len(stack) - 1, 0, -1):
                        here = nodes[stack[place]].tag
                        if here == tag:
                            in_link -= tag == "a"
                            del stack[place]
                            break
                        if here not in INLINE:
                            break
                continue
            flush()
            for place in range(len(stack) - 1, 0, -1):
                if nodes[stack[place]].tag == tag:
                    pop_to(place)
                    break
            continue
        if tag not in INLINE:
            flush()
            close = _CLOSES.get(tag)
            for place in range(len(stack) - 1, 0, -1):
                here = nodes[stack[place]].tag
                if here == "p" and not close:
                    pop_to(place)
                    break
                if close and here in close[0].split():
                    pop_to(place)
                    break
                if here not in INLINE and (not close or here in close[1]):
                    break
        raw = m["attrs"]
        attrs = _attrs(raw) if raw and raw != "/" else {}
        if tag == "a" and attrs.get("href"):
            page.links.append(attrs["href"])
        elif tag == "meta" and attrs.get("content"):
            name = attrs.get("name") or attrs.get("property")
            if name:
                page.metas.append((name, attrs["content"]))
        if tag == "br":
            held.append("\n")
            continue
        if tag in VOID or raw.endswith("/") and tag not in INLINE and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            body = source[at: end.start()] if end else source[at:]
            if tag == "title" and not page.title:
                page.title = squeeze(html.unescape(body))
            at = end.end() if end else len(source)
            continue
        up = nodes[stack[-1]]
        style = attrs.get("style", "").replace(" ", "").lower()
        words = frozenset(_WORD.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower())) \
            if attrs else frozenset()
        hidden = up.hidden or tag in HIDDEN or "hidden" in attrs or "display:none" in style
        nodes.append(Node(tag, stack[-1], up.depth + 1, words, hidden))
        stack.append(len(nodes) - 1)
        in_link += tag == "a"
    flush()
    return page
