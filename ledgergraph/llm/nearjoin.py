"""N-gram Jaccard join by chosen paths.

Texts are sets of hashes of five-word runs.  Texts with the same words are
one class first (copies are never expanded).  Every class gets ``TOKENS``
min-hash values; a token is (place, value), and two sets of similarity s share
each place with chance s.

Chosen paths: in each of ``runs`` repetitions a node of the tree picks tokens
by a hash of its path, each place with chance 1 / (threshold * TOKENS); a set
goes on to every picked place with its own value there.  So a set has about
1/threshold children a level, a pair at the threshold shares one of them on
average, and dissimilar sets part.  Buckets of at most ``bucket_rows`` sets are
compared pair by pair; larger ones are split a level further, down to
``max_depth``; what is larger still is compared in blocks, every block with every
other, so no bucket is capped.  The runs needed for ``recall`` follow from the
survival of the branching process down to the deepest level (``runs_for``).

Bucket comparison uses the min-hash estimate with a margin below the threshold
(``slack``) and returns a spanning forest, never all pairs.  Its components are
gathered with their exact sets (each set once, in blocks where large) and every
pair inside is checked exactly: this gives links, link counts and, with a last
pass of components over the exact links, classes.  So what the sketches add
wrongly is removed, and a pair that all runs missed is found again wherever
its texts are connected otherwise.

Defined cases: null, empty and word-less texts are alike to nothing, each row a
class of its own; texts of one to four words have one run of all their words;
words are lower-cased runs of non-blanks; repeated rows are copies; long texts
are hashed whole; extra columns pass through ``representatives`` untouched.
Null ids are kept out of groups (a class is named by its smallest id).  Rows of
one id are one document: their texts share a class, of which one row stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import cut, packed, small, small_batches
from .components import components
from .textnum import mix, seeds, shingles, slices, word_hashes

TOKENS = 64
_A, _B = seeds(TOKENS, 4242), seeds(TOKENS, 777)


def survival(depth: int) -> float:
    """Chance that a pair at the threshold shares a path of this depth in one run (Poisson(1) branching)."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return 1 - lost


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def signatures(texts: list[str | None], size: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Part by part (rows a to b, about half a megabyte of text): the sorted distinct run hashes of each text, 16-bit
    min-hash values (b - a, TOKENS) and 128-bit class keys (b - a, 2)."""
    for a, b in slices([len(t) + 1 if t else 1 for t in texts], 1 << 19):
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[a:b]]
        words, counts = word_hashes(raw)
        del raw
        runs, own = shingles(words, counts, size)
        ends, wends = np.cumsum(own), np.cumsum(counts)
        sets: list[np.ndarray] = []
        sig, key = np.zeros((b - a, TOKENS), np.uint16), np.zeros((b - a, 2), np.int64)
        for i in range(b - a):
            w = words[wends[i] - counts[i]: wends[i]]
            s = np.unique(runs[ends[i] - own[i]: ends[i]])
            sets.append(s)
            if len(s):
                for c in range(0, TOKENS, 16):
                    least = (s[None, :] * _A[c:c + 16, None] + _B[c:c + 16, None]).min(1)
                    sig[i, c:c + 16] = (mix(least) >> np.uint64(48)).astype(np.uint16)
                at = np.arange(1, len(w) + 1, dtype=np.uint64)
                key[i] = [mix(np.array([np.sum(mix(w + at * k), dtype=np.uint64)]))[0].view(np.int64)
                          for k in (_A[0], _A[1])]
        yield a, b, sets, sig, key


def extend(paths: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (path, signature) row: (row number, child path)."""
    chance = np.uint64(min(1.0, 1 / (threshold * TOKENS)) * (2 ** 64 - 1))
    rows, out = [], []
    for a in range(0, len(paths), 4096):
        p = paths[a:a + 4096].astype(np.uint64)
        picked = mix(p[:, None] ^ _B[None, :]) < chance
        r, i = np.nonzero(picked)
        rows.append(r + a)
        out.append(mix(p[r] * _A[i] + sig[a:a + 4096][r, i].astype(np.uint64) + np.uint64(i.size and 1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def _unpack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), TOKENS)


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _bucket_edges(sig: np.ndarray, side: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs agreeing in ``least`` places or more; with ``side``, of pairs across sides only."""
    n = len(sig)
    forest, out = _Forest(n), []
    for i in range(n - 1):
        later = np.arange(i + 1, n) if side is None else np.flatnonzero(side[i + 1:] != side[i]) + i + 1
        if not len(later):
            continue
        near = later[(sig[later] == sig[i]).sum(1) >= least]
        out += [(i, int(j)) for j in near if forest.join(i, int(j))]
    return out


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``keys`` in batches; many small groups come in one frame."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        last = f[keys].iloc[-1]
        same = (f[keys] == last).all(axis=1).to_numpy()
        start = len(f) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start == 0 and held and (held[-1][keys].iloc[-1] == last).all():
            held.append(f)
            continue
        whole = pd.concat([*held, f.iloc[:start]]) if held else f.iloc[:start]
        if len(whole):
            yield whole
        held = [f.iloc[start:]]
    if held:
        yield pd.concat(held)


def _bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    v = frame[keys].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]).any(1), [True])))


def classes(df: DataFrame, doc_id: str, text: str, size: int, threshold: float, runs: int, depth: int) -> DataFrame:
    """One row per class of equal word sequences: (rep, copies, sig, paths), and the ids: (uid, k1, k2)."""
    root = seeds(runs, 31337)

    @F.pandas_udf(StructType([StructField("k1", LongType()), StructField("k2", LongType()),
                              StructField("sig", BinaryType()), StructField("paths", ArrayType(LongType()))]))
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for a, b, sets, sig, key in signatures(texts.tolist(), size):
            n = b - a
            owner, path = np.repeat(np.arange(n), runs), np.tile(root, n).view(np.int64)
            for _ in range(depth):
                at, path = extend(path, sig[owner], threshold)
                owner = owner[at]
            order = np.argsort(owner, kind="stable")
            parts = np.split(path[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])
            out += [(*k, m.tobytes(), np.unique(p)) if len(s) else (*k, None, None)
                    for k, m, p, s in zip(key, sig, parts, sets)]
        return pd.DataFrame(out, columns=["k1", "k2", "sig", "paths"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("uid"), sketch(F.col(f"`{text}`")).alias("s"))
    return rows.select("uid", "s.*").filter(F.col("uid").isNotNull() & F.col("sig").isNotNull())


def similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
            recall: float = 0.99, depth: int = 2, max_depth: int = 5, bucket_rows: int = 512,
            slack: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, sizes): members (uid, rep), exact links as a forest (a, b) of representatives, and
    counts (rep, copies, linked): ``linked`` documents of other classes are at or above the threshold."""
    small_batches(df.sparkSession)
    runs = runs_for(recall, max(depth + 1, max_depth))
    sk = cut(classes(df, doc_id, text, size, threshold, runs, depth))
    one = cut(sk.groupBy("k1", "k2").agg(F.min(F.struct("uid", "sig", "paths")).alias("m"),
                                         F.count(F.lit(1)).alias("copies"))
              .select("k1", "k2", F.col("m.uid").alias("rep"), "copies", "m.sig", "m.paths"))
    members = sk.select("uid", "k1", "k2").join(one.select("k1", "k2", "rep"), ["k1", "k2"]).select("uid", "rep")
    if one.groupBy("rep").count().filter("count > 1").take(1):  # several texts under one id: one document, one text
        one = cut(one.groupBy("rep").agg(F.min(F.struct("k1", "k2", "sig", "paths")).alias("m"),
                                         F.sum("copies").alias("copies"))
                  .select("rep", "copies", "m.sig", "m.paths"))
    sig = one.select("rep", "sig")
    least = int(math.floor((threshold - slack) * TOKENS))

    open_, leaves, level = one.select("rep", F.explode("paths").alias("path")), [], depth
    while True:
        sizes = open_.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        sized = cut(open_.join(sizes, "path"))
        leaves.append(sized.filter(F.col("n") <= bucket_rows))
        large = sized.filter(F.col("n") > bucket_rows)
        if level >= max_depth or not large.take(1):
            leaves.append(large)
            break
        grow = F.pandas_udf(lambda p, s: pd.Series(_children(p, s, threshold)), ArrayType(LongType()))
        open_ = large.join(sig, "rep").select("rep", F.explode(grow("path", "sig")).alias("path"))
        level += 1
    buckets = leaves[0]
    for x in leaves[1:]:
        buckets = buckets.unionByName(x)
    blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
    buckets = buckets.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    spread = buckets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    spread = spread.select("path", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep")
    near = spread.join(sig, "rep").repartition("path", "x", "y").sortWithinPartitions("path", "x", "y", "rep")
    forest = near.mapInPandas(lambda fs: _compare_sketches(fs, least), "a long, b long").distinct()
    groups = components(cut(forest))                      # (node, root): what may be alike

    exact = _exact(df, doc_id, text, size, threshold, groups, one.select("rep", "copies"), bucket_rows)
    exact = cut(exact)
    links = exact.filter(F.col("b").isNotNull()).select("a", "b").distinct()
    counts = exact.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    sizes = one.select("rep", "copies").join(counts, "rep", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return members, links, sizes


def _children(paths: pd.Series, sigs: pd.Series, threshold: float) -> list[np.ndarray]:
    at, child = extend(paths.to_numpy(np.int64).view(np.uint64), _unpack(sigs), threshold)
    order = np.argsort(at, kind="stable")
    return [np.unique(p) for p in np.split(child[order], np.cumsum(np.bincount(at, minlength=len(paths)))[:-1])]


def _compare_sketches(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    keys = ["path", "x", "y"]
    for frame in _groups(frames, keys):
        sig, rep = _unpack(frame["sig"]), frame["rep"].to_numpy()
        own, cross = frame["own"].to_numpy(), (frame["x"] != frame["y"]).to_numpy()
        edges = _bounds(frame, keys)
        length = np.diff(edges)
        pairs: list[tuple[int, int]] = []
        two = edges[:-1][length == 2]  # most buckets: all at once
        if len(two):
            ok = ((sig[two] == sig[two + 1]).sum(1) >= least) & (~cross[two] | (own[two] != own[two + 1]))
            pairs += [(int(i), int(i) + 1) for i in two[ok]]
        for a, n in zip(edges[:-1][length > 2], length[length > 2]):
            side = own[a:a + n] if cross[a] else None
            pairs += [(a + i, a + j) for i, j in _bucket_edges(sig[a:a + n], side, least)]
        ab = np.array([(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in pairs], np.int64).reshape(-1, 2)
        yield pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})


def _exact(df: DataFrame, doc_id: str, text: str, size: int, threshold: float, groups: DataFrame, copies: DataFrame,
           bucket_rows: int) -> DataFrame:
    """Inside every group all pairs of exact sets: (a, b, null) spanning links, (rep, null, n) linked documents."""
    count = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = small(cut(groups.join(count, "root").join(copies, F.col("node") == F.col("rep"))
                       .select("rep", "root", "n", "copies")))
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("t")) \
        .join(wanted, "rep").groupBy("rep", "root", "n", "copies").agg(F.min("t").alias("t"))

    @F.pandas_udf(BinaryType())
    def as_set(texts: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for part in signatures(texts.tolist(), size) for s in part[2]], dtype="object")

    rows = rows.select("rep", "root", "copies", F.ceil(F.col("n") / bucket_rows).cast("int").alias("m"),
                       as_set("t").alias("s")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "copies", "s")
    ready = spread.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "rep")
    return ready.mapInPandas(lambda fs: _compare_sets(fs, threshold), "a long, b long, n long")


def _compare_sets(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    keys = ["root", "x", "y"]
    for frame in _groups(frames, keys):
        edges = _bounds(frame, keys)
        for a, e in zip(edges[:-1], edges[1:]):
            part = frame.iloc[a:e]
            own = part["own"].to_numpy()
            cross = own if part["x"].iloc[0] != part["y"].iloc[0] else None
            yield _pairs_in(part["rep"].to_numpy(), part["copies"].to_numpy(),
                            [np.frombuffer(s, np.uint64) for s in part["s"]], cross, threshold)


def _pairs_in(rep: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None,
              threshold: float) -> pd.DataFrame:
    """Exact pairs of one block (pair) through an inverted index of its sets."""
    n = len(rep)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posted, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
    ends = np.cumsum(size)
    forest, links, linked = _Forest(n), [], np.zeros(n, np.int64)
    for i in range(n):
        t = token[ends[i] - size[i]: ends[i]]
        lo, hi = first[t], first[t + 1]
        many = hi - lo
        if not (many > 1).any():
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        shared = np.bincount(posted[at], minlength=n)
        ok = shared >= threshold * (size + size[i] - shared) - 1e-9
        ok[: i + 1] = False
        if side is not None:
            ok &= side != side[i]
        js = np.flatnonzero(ok)
        linked[i] += int(copies[js].sum())
        linked[js] += copies[i]
        links += [(i, int(j)) for j in js if forest.join(i, int(j))]
    a = [min(rep[i], rep[j]) for i, j in links]
    b = [max(rep[i], rep[j]) for i, j in links]
    some = np.flatnonzero(linked)
    return pd.DataFrame({"a": pd.Series([*a, *rep[some]], dtype="int64"),
                         "b": pd.Series([*b, *[None] * len(some)], dtype="Int64"),
                         "n": pd.Series([*[None] * len(a), *linked[some]], dtype="Int64")})


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(uid, class_id, n_links) of every row: its class's smallest id, and how many other rows it is linked to."""
    members, links, sizes = similar(df, doc_id, text, **options)
    roots = components(cut(links))
    rep = sizes.join(roots, F.col("rep") == F.col("node"), "left").select(
        "rep", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.col("linked")).alias("n_links"))
    known = members.join(rep, "rep").select("uid", "class_id", "n_links")
    return known


def labelled(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links): one row for every input row, those alike to nothing with themselves."""
    known = near_duplicates(df, doc_id, text, **options).groupBy("uid").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return df.select(F.col(f"`{doc_id}`").alias("doc_id")).join(known, F.col("doc_id") == F.col("uid"), "left") \
        .select("doc_id", F.coalesce("class_id", F.col("doc_id").cast("long")).alias("class_id"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay: of each class the one with the smallest id, and every row alike to nothing."""
    known = cut(near_duplicates(df, doc_id, text, **options).groupBy("uid").agg(
        F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("rows")))
    gone = small(known.filter(F.col("class_id") != F.col("uid")).select("uid"))
    again = known.filter((F.col("class_id") == F.col("uid")) & (F.col("rows") > 1)).select("uid")
    rows = packed(df, uid=F.col(f"`{doc_id}`").cast("long")).join(gone, "uid", "left_anti")
    if not again.take(1):
        return rows.select("row.*")
    again = small(again)
    once = rows.join(again, "uid").groupBy("uid").agg(F.first("row").alias("row"))
    return rows.join(again, "uid", "left_anti").select("row.*").unionByName(once.select("row.*"))
