"""Minimum-cut text extraction (op1) and WARC derivatives (op9)."""

import base64
import gzip
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgergraph.llm import mincut, queries, warc
from ledgergraph.llm.htmlparse import parse
from ledgergraph.llm.mincut import label, main_text

SF = "/root/testdata/sf0.001"


def _cost(evidence, ties, side):
    return (sum(e for e, s in zip(evidence, side) if e > 0 and not s) + sum(-e for e, s in zip(evidence, side) if e < 0 and s)
            + sum(c for i, j, c in ties if side[i] != side[j]))


def test_label_is_a_minimum_cut():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(1, 8)
        evidence = [rnd.choice([-3, -2, -1, 0, 1, 2, 3]) for _ in range(n)]
        ties = [(i, j, rnd.randint(1, 3)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        best = min(_cost(evidence, ties, s) for s in itertools.product([False, True], repeat=n))
        assert _cost(evidence, ties, label(evidence, ties)) == best


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><p>x";</script></head>
<body class="home"><header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><form action="/s"><input name=q><button>Go</button>Search here</form>
<main><article><h1>Head&nbsp;line</h1><p>First <b>bold</b>,
 with  &lt;tags&gt; &eacute;&#233; and 3 < 4.<p>Second one<br>goes on.<div class="ad">Buy now, really, it is cheap.</div>
<aside>See also this.</aside><ul><li>Item a<li>Item b</ul><!-- <p>no</p> --></article>
<section id="comments"><p>Nice post, I liked reading all of it very much today, thank you so much for it.</p></section></main>
<div id="sidebar"><p>Popular: a long list of things that people read on this site every single day of the year.</p></div>
<footer>&copy; 2020 Me</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == ("Head line\nFirst bold, with <tags> éé and 3 < 4.\nSecond one goes on.\nItem a\nItem b")


def test_page_without_article_uses_evidence():
    text = "This is a long paragraph of running text that tells a story in many words, one after the other, to the end."
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><p>{text}</p><p>{text}</p></div></body>"
    assert main_text(page) == f"{text}\n{text}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "plain words of no markup that go on for quite a while, "
                                  "long enough to count as a text.", "</p></div>", "<div " * 50, "<p>" * 3000, "&#xZZ;&bogus;",
                                  "<script>", "<a href='x>y", "<p>" + "a b " * 200_000])
def test_broken_and_long_pages(page):
    out = main_text(page)
    assert isinstance(out, str)
    if page and page.startswith("plain"):
        assert out == page


def test_form_around_the_page():
    assert main_text("<form><div class=nav>Menu</div><article><p>Text here.</p></article></form>") == "Text here."


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, row string, text string")


def test_extract_edge_rows(spark):
    pages = _pages(spark, [(1, "u", PAGE, "r", "t"), (1, "u", PAGE, "r", "t"), (None, None, None, None, None), (2, "", "", "", "")])
    out = mincut.extract(pages).select("row.page_id", "row.row", "text").collect()
    assert sorted(((r[0] or 0), r[2]) for r in out) == sorted([(1, main_text(PAGE))] * 2 + [(0, ""), (2, "")])
    assert mincut.extract(pages.limit(0)).count() == 0


def test_op1_against_templates(spark):
    import html
    import re
    out = {r.page_id: r for r in queries.op1_mincut_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        inner = re.sub(r"<br>|</?b>", " ", re.search(r"(?s)<article>(.*)</article>", p.html)[1])
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert out[p.page_id].text == "\n".join(x for x in want if x)
        assert out[p.page_id].n_chars == len(out[p.page_id].text)


def test_warc_records_are_linked_and_digested(spark, tmp_path):
    pages = _pages(spark, [(1, "http://a/x", PAGE, "r", "t"), (2, None, None, None, None), (3, "http://b/", "é\r\n\r\nü", "", "")])
    rec = warc.derive(warc.responses(pages))
    rows = rec.collect()
    assert len(rows) == 6
    by = {(r.key, r.warc_type): r for r in rows}
    for k in (1, 2, 3):
        meta, conv = by[k, "metadata"], by[k, "conversion"]
        assert meta.refers_to == conv.refers_to and meta.concurrent_to == conv.record_id
        assert conv.concurrent_to == meta.record_id and meta.record_id != conv.record_id
        assert f"source-payload-digest: {conv.source_digest}" in meta.block
        for r in (meta, conv):
            assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    assert by[1, "conversion"].source_digest == warc.digest(PAGE.encode())
    assert "outlink: /a" in by[1, "metadata"].block and "title: T & U" in by[1, "metadata"].block
    assert "http-content-type: text/html; charset=utf-8" in by[1, "metadata"].block
    assert by[2, "conversion"].block == ""
    path = f"file://{tmp_path}/w"
    warc.write(rec, path)
    back = {r.headers["WARC-Record-ID"]: r for r in warc.read(spark, path).collect()}
    assert len(back) == 6
    for r in rows:
        got = back[r.record_id]
        assert bytes(got.block).decode() == r.block and got.headers["WARC-Refers-To"] == r.refers_to
        assert got.headers["WARC-Block-Digest"] == r.block_digest and got.headers.get("WARC-Target-URI") == r.target_uri
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_framing_errors():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_warc_headers_as_others_write_them():
    data = (b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Target-URI:   http://a/?x=1: 2 \r\nX-Note: one\r\n two\r\nX-Note: three\r\n"
            b"content-length: 5\r\n\r\n\r\n\r\n\xff\r\n\r\nWARC/1.1\r\nX-Raw: \xff\r\nContent-Length:0\r\n\r\n\r\n\r\n")
    (h, block), (h2, empty) = warc.parse_records(data)
    assert h["WARC-Type"] == "response" and h["WARC-Target-URI"] == "http://a/?x=1: 2" and h["X-Note"] == "one two, three"
    assert block == b"\r\n\r\n\xff" and empty == b"" and h2["X-Raw"] == "\ufffd"
    assert list(warc.parse_records(b"")) == []
    ok = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse_records(ok * 3))) == 3
    for cut in range(1, len(ok)):
        with pytest.raises(ValueError):
            list(warc.parse_records(ok + ok[:cut]))
    for bad in (ok.replace(b"Content-Length: 3", b"X: 3"), ok.replace(b"Content-Length: 3", b"Content-Length: -3"),
                ok.replace(b": 3", b" 3"), ok.replace(b" 3", b" 4"), b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_warc_reads_files_of_one_member_or_many(spark, tmp_path, monkeypatch):
    def rec(i, block):
        return f"WARC/1.1\r\nWARC-Record-ID:<{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    recs = [rec(i, b"x" * (i * 7 % 5)) for i in range(2500)] + [rec("long", bytes(range(256)) * 80_000)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs[:1200]))
    (tmp_path / "sub" / "one.warc.gz").write_bytes(gzip.compress(b"".join(recs[1200:])))
    (tmp_path / "plain.warc").write_bytes(recs[-1] + recs[0])
    (tmp_path / "none.warc").write_bytes(b"")
    got = warc.read(spark, f"file://{tmp_path}").select(F.col("headers")["WARC-Record-ID"].alias("id"), F.length("block").alias("n"),
                                                        F.sha2("block", 256).alias("h"))
    rows = got.collect()
    assert len(rows) == len(recs) + 2 and len({r.id for r in rows}) == len(recs)
    assert {(r.n, r.h) for r in rows if r.id == "<long>"} == {(20_480_000, hashlib.sha256(bytes(range(256)) * 80_000).hexdigest())}
    assert all(r.n == int(r.id[1:-1]) * 7 % 5 for r in rows if r.id != "<long>")


def test_warc_derivatives_of_long_and_repeated_rows_and_clashing_names(spark):
    long = "<html><body><article><p>" + "word " * 400_000 + "</p></article></body></html>"
    pages = _pages(spark, [(1, "http://a/", long, "r", "t"), (2, "http://b/", "<p>x</p>", "r", "t"), (2, "http://b/", "<p>x</p>", "r", "t")])
    clash = pages.withColumns({c: F.lit("other") for c in ("key", "payload", "block", "record_id", "n", "r")})
    for df in (pages, clash):
        rows = warc.derive(warc.responses(df)).collect()
        assert len(rows) == 6  # a repeated row has its records again
        conv = {r.key: r for r in rows if r.warc_type == "conversion"}
        assert len(conv[1].block) == 400_000 * 5 - 1 and conv[2].block == "x"
        assert len({r.record_id for r in rows if r.key == 2}) == 2  # of the same page: the same identifiers
        raw = conv[1].block.encode()
        assert conv[1].block_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_op9_covers_all_pages(spark):
    out = queries.op9_warc_derivatives(spark, SF)
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert out.count() == 2 * n and out.select("record_id").distinct().count() == 2 * n
    one = out.filter("warc_type = 'conversion'").join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").first()
    assert one.block == "\n".join(b.text for b in parse(one.html).blocks)
    assert out.filter(F.col("block_digest") != F.col("payload_digest")).count() == 0
