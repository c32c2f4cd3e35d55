"""Best-fit packing of documents into sequences under several capacities (vector bin packing).

A document is its token ids (a public tokenizer's file, no special tokens
added) and one end id.  Only a document longer than a sequence is cut, into
pieces of a whole sequence; the last piece may be shorter.  Every piece costs
(tokens, 1 document, tokens squared for attention); a sequence has a capacity of
each.  Pieces are placed in falling order of length; each goes to the open
sequence that, under *every* capacity, leaves the smallest weighted norm of
residuals (``rule="norm"``) or has the largest weighted dot product of residual
and cost (``rule="dot"``); where none takes it, a sequence is opened.

On Spark: texts are tokenised where they lie and never shuffled; pieces of a
whole sequence are done at once; the others are dealt by hash into blocks of
bounded rows, each packed by one task, whatever a source or a group of copies
holds.  Sequences that a block leaves under ``fill`` are opened again and their
pieces meet in the next round's blocks, as long as a round at least halves
the pieces that are left; so the blocks' unfilled ends are packed with one
another and no piece is left out.

Tokenising is by words: ids of a word (a run without blank or U+0009..U+000D,
punctuation at its end apart) do not depend on its neighbours, so each worker
keeps ids of the words that it has seen, by 64 bits of hash, and gives the
tokenizer only new ones, many at once.

Defined cases: null or empty text is the end id alone (one piece); ties and
repeated rows are pieces of their own, equal ones interchangeable; null doc_id
stays null; very long texts are cut as above; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches
from .textnum import slices, span_hashes, spans

TOKENIZER = "word_bpe_49k.json"
#: Most pieces of a block: what one task packs at once.
BLOCK_ROWS = 20_000
#: Words whose ids a worker keeps.
KEPT_WORDS = 4_000_000
#: Bytes behind a letter or digit that begin a run of their own for the tokenizer (no part of a special token's string).
_PUNCTUATION, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[list(b'.,;:!?"()*#$%&-')] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


class WordIds:
    """ids of whole texts, by words that are looked up once.

    Words are held by 64 bits of hash in a sorted array beside their ids; a batch's words are sorted and looked up
    together, so Python runs once per new word only.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(file)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word's run of letters
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.key, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _runs_of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); a few hundred a call: each has one end mark, else singly."""
        ids, sizes = [], []
        for k in range(0, len(words), 256):
            part = words[k:k + 256]
            got = np.array(self.plain(" ".join(part)), np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(part) or stops[-1] != len(got):
                each = [self.plain(w) for w in part]
                got, stops = np.array(list(itertools.chain(*each)), np.uint32), np.cumsum([len(e) for e in each])
            ids.append(got)
            sizes.append(np.diff(stops, prepend=0))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of new words: runs of letters together, the others one by one."""
        letters = np.fromiter((w.isalpha() for w in words), bool, len(words))
        a, a_size = self._runs_of_letters([w for w, m in zip(words, letters) if m])
        each = [self.plain(w) for w, m in zip(words, letters) if not m]
        size = np.empty(len(words), np.int64)
        size[letters], size[~letters] = a_size, [len(e) for e in each]
        flat = np.empty(int(size.sum()), np.uint32)
        mine = np.repeat(letters, size)
        flat[mine], flat[~mine] = a, list(itertools.chain(*each))
        return flat, size

    def texts(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each text's)."""
        buf, at, length, counts = parts_of(raw)
        words, which = np.unique(span_hashes(buf, at, length), return_inverse=True)
        if len(self.key) + len(words) > KEPT_WORDS:
            self._forget()
        place = np.searchsorted(self.key, words)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == words[known]
        new = np.flatnonzero(~known)
        if len(new):
            some = np.zeros(len(words), np.int64)
            some[which] = np.arange(len(which))  # a place of each word
            some = some[new]
            ids, size = self.encode([buf[s:s + n].tobytes().decode("utf-8", "replace")
                                     for s, n in zip(at[some].tolist(), length[some].tolist())])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.start = np.insert(self.start, place[new], self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, place[new], size)
            self.key = np.insert(self.key, place[new], words[new])
            self.used += len(ids)
            place = np.searchsorted(self.key, words)
        own = place[which]
        size = self.size[own]
        upto = np.concatenate(([0], np.cumsum(size)))
        last = np.cumsum(counts)
        return gather(self.flat, self.start[own], size), upto[last] - upto[last - counts]


def parts_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``textnum.spans``; up to three signs of punctuation behind an ASCII letter or digit are a part of their own."""
    buf, at, length, counts = spans(raw)
    tail, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for _ in range(3):
        open_ &= (length - tail > 1) & _PUNCTUATION[buf[at + length - tail - 1]]
        tail += open_
    tail = np.where(_ALNUM[buf[at + length - tail - 1]], tail, 0)
    n = 1 + (tail > 0)
    upto = np.concatenate(([0], np.cumsum(n)))
    starts, sizes = np.repeat(at, n), np.repeat(length - tail, n)
    second = upto[1:][tail > 0] - 1
    starts[second], sizes[second] = (at + length - tail)[tail > 0], tail[tail > 0]
    last = np.cumsum(counts)
    return buf, starts, sizes, upto[last] - upto[last - counts]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``start`` and have ``size`` values, one after another."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


_BY_FILE: dict[str, WordIds] = {}


def _tokenizer(name: str) -> WordIds:
    """One a worker process, kept between its tasks."""
    if name not in _BY_FILE:
        import os

        import public_tokenizers
        _BY_FILE[name] = WordIds(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _BY_FILE[name]


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0,
           max_tokens: int = 2048, max_attention: int | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; no shuffle.

    ``tokenizer``: a file of the public tokenizers, or an absolute path that all executors have.
    """
    small_batches(df.sparkSession)
    most = max_tokens if max_attention is None else min(max_tokens, math.isqrt(max_attention))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())]
                          + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []))

    def run(batches):
        tok = _tokenizer(tokenizer)
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8", "replace") for t in b.column(1)]
            for a, z in slices([len(r) + 1 for r in raw], 4 << 20):
                flat, counts = tok.texts(raw[a:z])
                upto = np.cumsum(counts)
                with_end = np.insert(flat, upto, end_id).astype("<u4")
                stop = upto + np.arange(1, z - a + 1)
                whole = counts + 1
                n = -(-whole // most)
                of = np.repeat(np.arange(z - a), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * most
                length = np.minimum(whole[of] - start, most)
                at = (stop - whole)[of] + start
                crc = [zlib.crc32(with_end[s:s + k]) for s, k in zip(at.tolist(), length.tolist())]
                cols = [b.column(0).take(pa.array(of + a)), pa.array(piece.astype(np.int32)), pa.array(start),
                        pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(length) - length, length.sum()), pa.int32()),
                                                         pa.array(with_end.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
    return rows.mapInArrow(run, schema)


def best_fit(costs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of each row of ``costs`` (in the given order) by vector best fit; equal scores take the earliest bin."""
    scaled, w = costs / capacity, weights
    bins = np.empty(len(costs), np.int64)
    least = np.minimum.accumulate(costs[::-1], 0)[::-1]  # the smallest costs still to come
    left, share, name, made = np.empty((64, costs.shape[1])), np.empty((64, costs.shape[1])), np.empty(64, np.int64), 0
    n = 0  # open bins
    for i, c in enumerate(costs):
        if i % 256 == 0 and n:  # bins that can take no more rows are closed
            keep = (left[:n] >= least[i]).all(1)
            k = int(keep.sum())
            left[:k], share[:k], name[:k] = left[:n][keep], share[:n][keep], name[:n][keep]
            n = k
        fits = np.flatnonzero((left[:n] >= c).all(1))
        if len(fits):
            if rule == "norm":
                score = (np.square(share[fits] - scaled[i]) * w).sum(1)
            else:
                score = -(share[fits] @ (scaled[i] * w))
            j = fits[score.argmin()]
        else:
            if n == len(left):
                left, share, name = np.vstack([left, left]), np.vstack([share, share]), np.concatenate([name, name])
            left[n], share[n], name[n] = capacity, 1.0, made
            j, n, made = n, n + 1, made + 1
        left[j] -= c
        share[j] -= scaled[i]
        bins[i] = name[j]
    return bins


def pack(parts: DataFrame, length: str = "length", max_tokens: int = 2048, max_documents: int = 2048,
         max_attention: int = 2048 ** 2, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm",
         block_rows: int = BLOCK_ROWS, fill: float = 0.995) -> DataFrame:
    """Every row of ``parts`` as ``row`` with (sequence_id, offset); no sequence passes any capacity.

    A row that alone passes a capacity raises ValueError (``pieces`` makes none).
    """
    capacity = np.array([max_tokens, max_documents, max_attention], float)
    rows = cut(parts.select(F.struct(*[F.col(f"`{c}`") for c in parts.columns]).alias("row"),
                            F.col(f"`{length}`").cast("long").alias("len")))
    stats = rows.agg(F.max("len"), F.sum((F.col("len") < max_tokens).cast("long"))).first()
    if stats[0] is not None and (stats[0] > max_tokens or stats[0] ** 2 > max_attention or max_documents < 1):
        raise ValueError("a row passes a capacity alone")
    whole = rows.filter(F.col("len") == max_tokens).select(
        "row", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = rows.filter(F.col("len") < max_tokens).withColumn("h", F.xxhash64("row"))
    out, left, turn = whole, stats[1] or 0, 0
    schema = T.StructType([*open_.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("used", T.LongType())])
    w = np.array(weights, float)

    def packer(turn: int):
        def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(neg=-pdf["len"]).sort_values(["neg", "h"], kind="stable").drop(columns="neg")
            size = pdf["len"].to_numpy(float)
            b = best_fit(np.stack([size, np.ones(len(size)), size * size], 1), capacity, w, rule)
            pdf["sequence_id"] = (turn << 56) + (int(key[0]) << 20) + b
            by = pdf.groupby("sequence_id")["len"]
            pdf["offset"], pdf["used"] = by.cumsum() - pdf["len"], by.transform("sum")
            return pdf[schema.names]
        return block

    while left:
        blocks = -(-left // block_rows)
        dealt = open_.groupBy(F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(blocks)).alias("b"))
        packed = cut(dealt.applyInPandas(packer(turn), schema))
        under = packed.filter(F.col("used") < fill * max_tokens)
        again = under.count() if blocks > 1 else 0
        if not again or again > left / 2:
            out = out.unionByName(packed.select("row", "sequence_id", "offset"))
            break
        out = out.unionByName(packed.filter(F.col("used") >= fill * max_tokens).select("row", "sequence_id", "offset"))
        open_, left, turn = under.select("row", "len", "h"), again, turn + 1
    return out


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, n_documents, ids) of packed pieces that carry their ids; a sequence is bounded by its capacity."""
    part = F.struct("offset", F.col(f"row.{ids}").alias("ids"))
    seq = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("ps"))
    return seq.select("sequence_id", F.size("ps").cast("long").alias("n_documents"),
                      F.flatten(F.transform("ps", lambda p: p["ids"])).alias("ids"))
