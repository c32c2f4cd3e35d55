"""Vectorised word and shingle hashes of a batch of texts (used inside Arrow batches).

Words are split at ASCII white space only (blank, U+0009..U+000D), which
``bytes.split`` does on UTF-8.  Hashes are fixed functions of the bytes, so
every executor gets the same values.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (wraps around silently)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 77)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of each text in order, number of words of each text)."""
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ws = _WS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], ws)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    after = np.cumsum(size)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    inside = ~ws
    where = np.flatnonzero(inside)
    length = ends - starts
    nth = np.cumsum(length)
    place = np.arange(len(where)) - np.repeat(nth - length, length)
    vals = _BYTE[buf[where]] * _powers(int(length.max()))[place]
    hashed = mix(np.add.reduceat(vals, nth - length) + length.astype(np.uint64))
    upto = np.searchsorted(starts, after)
    return hashed, np.diff(np.concatenate(([0], upto)))


def spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts' bytes, each word's place there and its length, number of words of each text)."""
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _WS[buf])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    after = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return buf, starts, ends - starts, np.diff(np.concatenate(([0], np.searchsorted(starts, after))))


def span_hashes(buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span (none of them empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    before = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(before, length)
    vals = _BYTE[buf[place + np.repeat(starts, length)]] * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(vals, before) + length.astype(np.uint64))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words inside a text; a text of 1..k-1 words has one shingle of all its words."""
    factor = seeds(k, 991)
    n = len(words)
    first = np.cumsum(counts) - counts
    acc = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        acc[: n - j] += words[j:] * factor[j]
    own = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first, own) + (np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own))
    out = mix(acc[at] + np.uint64(k))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        place = (np.cumsum(own) - own)[short]
        for p, d in zip(place, short):
            w = words[first[d]: first[d] + counts[d]]
            out[p] = mix(np.array([np.sum(w * factor[: len(w)], dtype=np.uint64)]) + np.uint64(len(w)))[0]
    return out, own


def slices(lengths: list[int], limit: int = 1 << 20):
    """Index ranges whose summed lengths stay near ``limit`` (one long text may stand alone)."""
    a, total = 0, 0
    for i, n in enumerate(lengths):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)
