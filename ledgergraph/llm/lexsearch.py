"""Ranked lexical search: a block-max inverted index in shards, searched by MaxScore.

**Index** (``build``).  Every text is read once, whole.  A task cuts the rows that it
reads into shards of bounded tokens; within a shard documents are numbered by
rising length, so that a block's documents are alike.  A row of the index is one
term's posting list in one shard: blocks of 128 postings, each with its last
document, largest term frequency and shortest length (its maxima) beside the
packed gaps and frequencies; one more row per shard has the documents' ids and
lengths.  The index is a table of its own in the shared folder, so searches,
statistics and lost executors never read the texts again.

**Statistics.**  N, L and each term's document frequency are sums over the index,
so they cover all documents.

**Search** (``search``).  Items come in blocks of bounded number; a block's posting
rows are found by a join on the term and meet by shard.  In a shard every item
runs Block-Max MaxScore over windows of documents: lists in rising order of
their global bound; those whose bounds add up to less than the score to beat
are non-essential and bring no candidate; the essential ones are added up; for the
candidates, non-essential lists follow in falling order, and a candidate whose
score, the *block's* maximum and the bounds of the lists below can't reach the
score to beat is dropped before the block is unpacked.  Shard heaps of ``k`` are
merged by a ranked window (limited in each task before its shuffle).

Scores are 64-bit integers, so the result does not depend on shards or order.

Defined cases: null text and texts without a term are in no list and not
counted; null items rank nothing; equal scores go by ascending doc_id, null
doc_id last; rows that share a doc_id are documents of their own; rows that
share an item id are items of their own, ranked apart; very long texts are
read in pieces cut between terms; an empty table gives an empty result; extra
columns are not read.  Terms are compared by 64 bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import dense_surrogate_key
from .common import cut, small, small_batches
from .textnum import word_hashes

#: Postings of a block; most tokens and documents of a shard; items searched at once; documents of a window.
BLOCK, SHARD_TOKENS, SHARD_DOCS, ITEM_BLOCK, WINDOW = 128, 2_000_000, 50_000, 256, 8192
INDEX = ("shard bigint, term bigint, df bigint, tokens bigint, last binary, max_tf binary, min_len binary, "
         "place binary, width binary, data binary")
#: The bytes of a term: 0-9, a-z, A-Z (lower-cased) and all of non-ASCII characters; every other byte separates.
_TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()
_CUT = 1 << 20


def _parts(raw: bytes) -> list[bytes]:
    """A long text in pieces of about a megabyte, cut between terms."""
    out, a = [], 0
    while len(raw) - a > _CUT:
        b = raw.rfind(b" ", a, a + _CUT)
        if b < 0:
            b = raw.find(b" ", a + _CUT)
            if b < 0:
                break
        out.append(raw[a:b])
        a = b
    return [*out, raw[a:]]


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the terms of each text, in order."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for p in _parts((t or "").encode("utf-8", "replace").translate(_TERM_BYTES)):
            parts.append(p)
            owner.append(i)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b]) <= _CUT):
            size += len(parts[b])
            b += 1
        hashes, counts = word_hashes(parts[a:b])
        for i, h in zip(owner[a:b], np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])):
            out[i].append(h)
        a = b
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def _bytes_column(buffer: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``buffer``; ``starts`` has the byte where each begins, and the end."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1,
                                       [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(buffer)])


def _pack_columns(values: np.ndarray, width: np.ndarray, start: np.ndarray, nth: np.ndarray, of: np.ndarray,
                  out: np.ndarray) -> None:
    """Each value in its block's width (1, 2 or 4 bytes), little-endian, at the block's start."""
    for w in (1, 2, 4):
        m = width[of] == w
        at = start[of[m]] + nth[m] * w
        for j in range(w):
            out[at + j] = (values[m] >> (8 * j)) & 255


def shard_rows(ids: list, terms: list[np.ndarray], shard: int) -> pa.RecordBatch:
    """The index rows of one shard: ``ids`` (int or None) and hashes of the terms of its documents."""
    n = np.fromiter(map(len, terms), np.int64, len(terms))
    order = np.argsort(n, kind="stable")
    n = n[order]
    tokens = np.concatenate([terms[i] for i in order])
    doc = np.repeat(np.arange(len(n)), n)
    by = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[by], doc[by]
    first = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1]))))
    tf = np.diff(np.concatenate((first, [len(tokens)])))
    term, doc = tokens[first], doc[first]
    head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))  # first posting of each term
    df = np.diff(np.concatenate((head, [len(term)])))
    nth = np.arange(len(term)) - np.repeat(head, df)
    starts = np.flatnonzero(nth % BLOCK == 0)  # first posting of each block
    size = np.diff(np.concatenate((starts, [len(term)])))
    of, nth = np.repeat(np.arange(len(starts)), size), np.arange(len(term)) - np.repeat(starts, size)
    gap = np.where(nth == 0, doc, np.concatenate(([0], doc[1:] - doc[:-1])))
    gap_max, tf_max = np.maximum.reduceat(gap, starts), np.maximum.reduceat(tf, starts)
    wide = lambda m: np.where(m < 256, 1, np.where(m < 65536, 2, 4))
    gw, tw = wide(gap_max), wide(tf_max)
    bytes_ = size * (gw + tw)
    place = np.cumsum(bytes_) - bytes_
    data = np.zeros(int(bytes_.sum()), np.uint8)
    _pack_columns(gap, gw, place, nth, of, data)
    _pack_columns(tf, tw, place + size * gw, nth, of, data)
    block_of_term = np.searchsorted(starts, np.concatenate((head, [len(term)])))
    byte_of_term = np.concatenate((place, [len(data)]))[block_of_term]
    shortest = n[doc[starts]]  # documents are numbered by length
    last = doc[np.concatenate((starts[1:], [len(term)])) - 1]
    inside = place - np.repeat(byte_of_term[:-1], np.diff(block_of_term))
    four = lambda x: _bytes_column(x.astype("<i4").view(np.uint8), block_of_term * 4)
    cols = [four(last), four(tf_max), four(shortest), four(inside),
            _bytes_column((gw * 16 + tw).astype(np.uint8), block_of_term), _bytes_column(data, byte_of_term)]
    known = np.array([i is not None for i in ids], np.uint8)[order]
    values = np.array([0 if i is None else i for i in ids], "<i8")[order]
    docs = [values.tobytes(), known.tobytes(), n.astype("<i8").tobytes()]
    k = len(df)
    cols = [pa.concat_arrays([c, pa.array([v], pa.binary())]) for c, v in
            zip(cols, [docs[0], docs[1], docs[2], b"", b"", b""])]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k + 1, shard)), pa.array(np.append(term[head], 0), mask=np.append(np.zeros(k, bool), True)),
         pa.array(np.append(df, len(n))), pa.array(np.append(np.zeros(k, np.int64), n.sum())), *cols],
        names=[c.split()[0] for c in INDEX.split(", ")])


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS,
          shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all rows, written to the shared folder; rows of a shard's documents have a null term."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        from pyspark import TaskContext
        at = (TaskContext.get().partitionId() << 32)  # shard numbers of this task
        ids, terms, tokens = [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                for d, h in zip(part.column(0).to_pylist(), terms_of(part.column(1).to_pylist())):
                    if len(h):
                        ids.append(d)
                        terms.append(h)
                        tokens += len(h)
                    if tokens >= shard_tokens or len(ids) >= shard_docs:
                        yield shard_rows(ids, terms, at)
                        at, ids, terms, tokens = at + 1, [], [], 0
        if ids:
            yield shard_rows(ids, terms, at)
    return cut(rows.mapInArrow(run, INDEX))


def statistics(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n, total = index.filter("term IS NULL").agg(F.sum("df"), F.sum("tokens")).first()
    return n or 0, total or 0


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(no, item_id, term, times): the items' terms with their repeats; ``no`` numbers the items."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                term, times = np.unique(terms_of([part.column(2)[0].as_py()])[0], return_counts=True)
                cols = [part.column(c).take(pa.array(np.zeros(len(term), np.int64))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(term), pa.array(times.astype(np.int64))],
                                                 names=["no", "item_id", "term", "times"])
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("no", "item_id", "text").mapInArrow(
        run, f"no bigint, item_id {kind}, term bigint, times bigint")


class Shard:
    """The posting lists of a shard that a block of items asks for."""

    def __init__(self, pdf: pd.DataFrame, n_docs: int, n_terms: int):
        own = pdf[pdf["docs"]].iloc[0]
        self.doc_id = np.frombuffer(own["last"], "<i8")
        self.known = np.frombuffer(own["max_tf"], np.uint8) > 0
        length = np.frombuffer(own["min_len"], "<i8")
        self.m = 75 + (25 * length * n_docs) // n_terms
        lists = pdf[~pdf["docs"]]
        self.at = {int(t): i for i, t in enumerate(lists["term"])}
        self.rows = list(lists[["last", "max_tf", "min_len", "place", "width", "data", "df"]].itertuples(index=False))
        self.opened: dict[int, tuple] = {}
        self.unpacked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.norm = (n_docs, n_terms)

    def list_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(last document, score bound for weight 1) of each block."""
        if i not in self.opened:
            r = self.rows[i]
            last, tf, length = (np.frombuffer(x, "<i4").astype(np.int64) for x in (r.last, r.max_tf, r.min_len))
            m = 75 + (25 * length * self.norm[0]) // self.norm[1]
            self.opened[i] = last, (1_000_000_000 * tf) // (1000 * tf + 12 * m), \
                np.frombuffer(r.place, "<i4"), np.frombuffer(r.width, np.uint8)
        return self.opened[i][:2]

    def block(self, i: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores for weight 1) of a block, unpacked when first asked for."""
        if (i, b) not in self.unpacked:
            r, (last, _, place, width) = self.rows[i], self.opened[i]
            size = BLOCK if b < len(last) - 1 else int(r.df) - BLOCK * b
            gw, tw = int(width[b]) >> 4, int(width[b]) & 15
            doc = np.frombuffer(r.data, f"<u{gw}", size, int(place[b])).astype(np.int64).cumsum()
            tf = np.frombuffer(r.data, f"<u{tw}", size, int(place[b]) + size * gw).astype(np.int64)
            self.unpacked[i, b] = doc, (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[doc])
        return self.unpacked[i, b]

    def top(self, query: list[tuple[int, int]], k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best for (term, weight) pairs, by score, then doc_id (null last)."""
        lists = []
        for term, w in query:
            if w > 0 and term in self.at:
                i = self.at[term]
                last, bound = self.list_of(i)
                lists.append((int(bound.max()) * w, i, w, last, bound))
        lists.sort(key=lambda x: x[:2])
        reach = np.cumsum([x[0] for x in lists])  # what the lists up to here can add
        best_doc, best, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for a in range(0, len(self.m), window) if lists else ():
            z = min(a + window, len(self.m))
            split = int(np.searchsorted(reach, beat))  # lists before it can't bring a score of ``beat`` together
            score = np.zeros(z - a, np.int64)
            for _, i, w, last, _ in lists[split:]:
                for b in range(int(np.searchsorted(last, a)), int(np.searchsorted(last, z - 1)) + 1):
                    if b < len(last):
                        doc, value = self.block(i, b)
                        lo, hi = np.searchsorted(doc, (a, z))
                        score[doc[lo:hi] - a] += w * value[lo:hi]
            found = np.flatnonzero(score)
            got = score[found]
            found = found + a
            for j in range(split - 1, -1, -1):
                keep = got + reach[j] >= beat
                found, got = found[keep], got[keep]
                if not len(found):
                    break
                _, i, w, last, bound = lists[j]
                b = np.searchsorted(last, found)
                inside = b < len(last)
                most = np.where(inside, w * bound[np.minimum(b, len(last) - 1)], 0) + (reach[j - 1] if j else 0)
                keep = got + most >= beat  # by the block's maximum, before it is unpacked
                found, got, b, inside = found[keep], got[keep], b[keep], inside[keep]
                for x in np.unique(b[inside]):
                    doc, value = self.block(i, int(x))
                    mine = np.flatnonzero(b == x)
                    p = np.minimum(np.searchsorted(doc, found[mine]), len(doc) - 1)
                    got[mine] += np.where(doc[p] == found[mine], w * value[p], 0)
            keep = got >= beat
            if keep.any():
                best_doc, best = np.concatenate([best_doc, found[keep]]), np.concatenate([best, got[keep]])
                order = np.lexsort((self.doc_id[best_doc], ~self.known[best_doc], -best))[:k]
                best_doc, best = best_doc[order], best[order]
                if len(best) == k:
                    beat = int(best[-1])  # an equal score may still have a smaller id
        return best_doc, best


def _searcher(queries: dict[int, list[tuple[int, int]]], n_docs: int, n_terms: int, k: int):
    """The function that finds a shard's heap of every item."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, got = Shard(pdf, n_docs, n_terms), []
        for no, query in queries.items():
            doc, score = shard.top(query, k)
            got += [(no, int(shard.doc_id[d]) if shard.known[d] else None, int(s)) for d, s in zip(doc, score)]
        return pd.DataFrame({n: pd.array([g[i] for g in got], "Int64") for i, n in enumerate(("no", "doc_id", "score"))})
    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 20,
           item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of the index."""
    spark = index.sparkSession
    n_docs, n_terms = statistics(index)
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    if not n_docs:
        return out
    plain = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    asked = cut(item_terms(dense_surrogate_key(plain, ["item_id", "text"], "no")))
    postings = index.join(small(asked.select("term").distinct()), "term", "left_semi")
    postings = cut(postings)
    df = postings.groupBy("term").agg(F.sum("df").alias("df"))
    weighted = cut(asked.join(df, "term"))
    weighted = weighted.withColumn("block", F.floor((F.col("no") - 1) / item_block).cast("long"))
    n_blocks = weighted.agg(F.max("block")).first()[0]
    for block in range(0 if n_blocks is None else n_blocks + 1):
        # a block of items is bounded by its number of items, not by the documents
        mine: dict[int, list[tuple[int, int]]] = {}
        for r in weighted.filter(F.col("block") == block).select("no", "term", "times", "df").collect():
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            mine.setdefault(r["no"], []).append((r["term"], w * r["times"]))
        need = weighted.filter(F.col("block") == block).select("term").distinct()
        own = index.filter("term IS NULL").unionByName(postings.join(small(need), "term", "left_semi").select(*index.columns))
        own = own.withColumn("docs", F.col("term").isNull()).withColumn("term", F.coalesce("term", F.lit(0)))

        heaps = own.groupBy("shard").applyInPandas(_searcher(mine, n_docs, n_terms, k), "no bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = weighted.filter(F.col("block") == block).select("no", "item_id").distinct()
        out = out.unionByName(best.join(names, "no").select("item_id", "rank", "doc_id", "score"))
    return out
