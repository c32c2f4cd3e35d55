"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response record is a row (record_id, date, target_uri, http_headers,
payload, payload_digest).  ``derive`` gives two records per response:

* ``metadata``: the page's title, description fields and link targets, the
  source's HTTP headers and digest, as ``application/warc-fields``;
* ``conversion``: the visible text, as ``text/plain``.

Both name the response in ``WARC-Refers-To`` and each other in
``WARC-Concurrent-To``; identifiers are a hash of the response's identifier and
the record type, so a rerun writes the same ones.  Digests are base32 SHA-1.

``write`` lays records out as WARC/1.1 files with Spark's text writer (the blank
lines that end a record are its line separator), ``read`` parses such files
through Spark's binary reader, a record at a time, so both work on any store Spark
reaches.

Defined cases: null html is an empty payload; a null URL leaves out the target
header; a null id gets the identifier of the empty one; equal rows give equal
records, all kept; a page without text has an empty conversion; long pages are
converted whole; an empty table gives no record; extra columns are not read, whatever
their names.  Records of repeated rows share their identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .htmlparse import parse

SEPARATOR = "\r\n\r\n"
RECORD = StructType([StructField(n, StringType()) for n in (
    "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_digest",
    "payload_digest", "block_digest")] + [StructField("content_length", LongType()), StructField("block", StringType())])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(parts).encode()).digest()[:16], version=5)}>"


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows of crawled pages: (key, target_uri, date, http_headers, payload)."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"))
    return pages.select(F.col(f"`{page_id}`").alias("key"), F.col(f"`{url}`").alias("target_uri"),
                        F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload"))


def _fields(pairs: list[tuple[str, str]]) -> str:
    """``name: value`` lines; line breaks in a value become blanks."""
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in pairs)


def _derive_one(response: str, uri: str | None, date: str, http: str, payload: str) -> list[tuple]:
    raw = payload.encode("utf-8", "surrogatepass")
    source = digest(raw)
    page = parse(payload)
    ids = {kind: record_id(response, kind) for kind in ("metadata", "conversion")}
    text = "\n".join(b.text for b in page.blocks)
    http_lines = [tuple(x.split(": ", 1)) for x in http.split("\r\n")[1:] if ": " in x]
    meta = _fields([("source-payload-digest", source), ("source-status", http.split("\r\n", 1)[0]),
                    *[(f"http-{k.lower()}", v) for k, v in http_lines], ("title", page.title),
                    *[(f"meta-{k.lower()}", v) for k, v in page.metas], *[("outlink", x) for x in page.links],
                    ("text-length", str(len(text)))])
    out = []
    for kind, other, mime, block in (("metadata", "conversion", "application/warc-fields", meta),
                                     ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "surrogatepass")
        d = digest(data)
        out.append((kind, ids[kind], response, ids[other], uri, date, mime, source, d, d, len(data), block))
    return out


def derive(resp: DataFrame) -> DataFrame:
    """Two linked records per response row, beside its ``key``: one narrow pass, nothing is shuffled."""
    key = resp.schema["key"].dataType
    schema = StructType([StructField("key", key), StructField("n", LongType()), *RECORD.fields])
    rows = resp.select("key", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k"), "target_uri", "date",
                       "http_headers", "payload")

    @F.pandas_udf(StringType())
    def made(k: pd.Series, uri: pd.Series) -> pd.Series:
        return pd.Series([record_id(a, b or "", "response") for a, b in zip(k, uri)], dtype="object")

    @F.pandas_udf(_records_type())
    def both(rid: pd.Series, uri: pd.Series, date: pd.Series, http: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(RECORD.fieldNames(), r)) for r in _derive_one(*x)]
                          for x in zip(rid, uri, date, http, payload)])

    out = rows.select("key", F.explode(both(made("k", "target_uri"), "target_uri", "date", "http_headers", "payload"))
                      .alias("r"))
    return out.select("key", "r.*")


def _records_type():
    from pyspark.sql.types import ArrayType
    return ArrayType(RECORD)


def rendered(rec: Column | None = None) -> Column:
    """A record's WARC/1.1 text without the two line ends that close it."""
    def line(name: str, col: str) -> Column:
        return F.when(F.col(col).isNull(), F.lit("")).otherwise(
            F.concat(F.lit(name + ": "), F.col(col).cast("string"), F.lit("\r\n")))
    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"),
                    line("WARC-Date", "date"), line("WARC-Target-URI", "target_uri"),
                    line("WARC-Refers-To", "refers_to"), line("WARC-Concurrent-To", "concurrent_to"),
                    line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"),
                    line("Content-Type", "content_type"), line("Content-Length", "content_length"))
    return F.concat(head, F.lit("\r\n"), F.col("block"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one per task, in any folder that Spark can write."""
    records.select(rendered().alias("value")).write.option("lineSep", SEPARATOR).option(
        "compression", compression).mode("overwrite").text(path)


def _line(f: BinaryIO, at: str) -> bytes:
    line = f.readline()
    if not line.endswith(b"\n"):
        raise ValueError(f"the file ends within the header of {at}")
    return line.rstrip(b"\r\n")


def stream_records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, one record held at a time.

    White space around a header's value may be missing or more than one; a line that starts with white space continues the
    one before; of a repeated header the values are joined by ", "; bytes that are no UTF-8 become U+FFFD in headers and
    stay as they are in blocks.  ValueError where the framing is broken: no version line, a header without a colon, no or a
    wrong Content-Length, a stream that ends within a record.
    """
    n = 0
    while first := f.readline():
        n += 1
        at = f"record {n}"
        if not first.startswith(b"WARC/") or not first.endswith(b"\n"):
            raise ValueError(f"no WARC version line at {at}")
        headers: dict[str, str] = {}
        name = None
        while line := _line(f, at):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and name:
                headers[name] += " " + text.strip()
                continue
            name, colon, value = text.partition(":")
            if not colon:
                raise ValueError(f"a header of {at} has no colon")
            name, value = name.strip(), value.strip()
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not (length.isascii() and length.isdigit()):
            raise ValueError(f"{at} has no Content-Length")
        block = f.read(int(length))
        if len(block) != int(length) or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"{at} does not end where Content-Length says")
        yield headers, block


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """:func:`stream_records` over bytes in memory."""
    return stream_records(io.BytesIO(data))


#: Bytes of blocks after which a batch of read records is passed on.
READ_BYTES = 16 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block binary) of every record under ``path``.

    A file is one row of Spark's binary source, so it must be below 2 GB as stored; it is unpacked record by record (a gzip
    file may have a member for each record or one for all) and records go on in batches of about 16 MB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                raw = io.BytesIO(data)
                heads, blocks, size = [], [], 0
                for h, block in stream_records(gzip.open(raw) if name.endswith(".gz") else raw):
                    heads.append(h)
                    blocks.append(block)
                    size += len(block)
                    if size >= READ_BYTES or len(heads) >= 1000:
                        yield pd.DataFrame({"headers": heads, "block": blocks})
                        heads, blocks, size = [], [], 0
                if heads:
                    yield pd.DataFrame({"headers": heads, "block": blocks})
    return files.mapInPandas(records, "headers map<string,string>, block binary")
