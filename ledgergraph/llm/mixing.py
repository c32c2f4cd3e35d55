"""Mixing sources to target weights by balanced sampling (cube method).

A document's inclusion probability is its source's target over its source's
size; a factor of 1 or more gives whole copies first and leaves the fraction.
Within a source, the fractions walk through the null space of two balancing
constraints (number of documents, number of words) until all but a few are 0
or 1, so both totals stay what they were.

The walk runs in blocks of bounded size on Spark: the rows of a source are
dealt by hash over as many blocks as its row count asks for, each block leaves
at most two undecided rows, and these meet in the next round's blocks; a
source of any size needs a few rounds, each 1/1000 of the one before.  Only
the last two rows of a source are decided apart (landing): whichever of the
four choices leaves the word total nearest to its target.

Sizes are words; sources in code point order, null last, take the weights in
turn.  Targets share ``share`` of all words by weight, never more than
``max_repeat`` times a source's words; what is over is shared again.

Defined cases: null text has size 0 (a row that no total feels: it is taken
with its source's probability and counts 0 words); rows that agree in id,
source and size are one unit decided together, so repeats and ties rerun
alike; null ids are units too; an empty table gives an empty result; extra
columns are not read by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, key_of

#: Most rows of a block: what one task's group holds.
BLOCK_ROWS = 4000


def targets(sizes: list[int], weights: list[int], max_repeat: int = 3, share: Fraction = Fraction(1)) -> list[Fraction]:
    """Share ``share`` of the total by weight; caps at ``max_repeat`` times a size, the excess shared again by weight."""
    left, out = Fraction(sum(sizes)) * share, [Fraction(0)] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > max_repeat * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(max_repeat * sizes[i]) if over else level * weights[i]
        left -= sum((out[i] for i in over), Fraction(0))
        open_ = [i for i in open_ if over and i not in over]
    return out


def cube_flight(pi: np.ndarray, balance: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Flight phase: ``pi`` (n) walks in the null space of ``balance`` (n, p) until at most p entries are fractional.

    Only p + 1 undecided units are held at a time; each step decides at least one of them.
    """
    pi = pi.astype(float).copy()
    p = balance.shape[1]
    scale = np.abs(balance).max(0) if len(balance) else np.ones(p)
    a = balance / np.where(scale > 0, scale, 1)
    held: list[int] = []
    for nxt in [*np.flatnonzero((pi > 1e-9) & (pi < 1 - 1e-9)).tolist(), None]:
        if nxt is not None:
            held.append(nxt)
            if len(held) < p + 1:
                continue
        while len(held) > p:
            x = pi[held]
            u = np.linalg.svd(a[held].T)[2][-1] if p != 2 else np.cross(a[held, 0], a[held, 1])
            size = np.abs(u).max()
            if size < 1e-12:  # the constraints agree on these units: any direction that keeps the first
                u = _kernel(a[held].T)
            else:
                u = u / size
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 1e-12, (1 - x) / u, np.where(u < -1e-12, -x / u, np.inf)).min()
                down = np.where(u > 1e-12, x / u, np.where(u < -1e-12, (x - 1) / u, np.inf)).min()
            x = x + u * up if draw.random() * (up + down) < down else x - u * down
            x = np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))
            pi[held] = x
            held = [h for h, v in zip(held, x) if 0 < v < 1]
    return pi


def _kernel(m: np.ndarray) -> np.ndarray:
    u = np.linalg.svd(m)[2][-1]
    return u / np.abs(u).max()


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(neg=-pdf["size"] * pdf["n"]).sort_values(["neg", "h", "ukey"], kind="stable") \
        .drop(columns="neg").reset_index(drop=True)
    n = pdf["n"].to_numpy(float)
    words = pdf["size"].to_numpy(float) * n
    draw = np.random.default_rng(int(pdf["h"].iloc[0]) & (2 ** 63 - 1))
    pdf["pi"] = cube_flight(pdf["pi"].to_numpy(float), np.stack([n, words], 1), draw)
    return pdf


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last one or two undecided units of a source: the choice with the nearest word, then document, total."""
    pdf = pdf.sort_values(["h", "ukey", "size"], kind="stable").reset_index(drop=True)
    pi, n = pdf["pi"].to_numpy(float), pdf["n"].to_numpy(float)
    words = pdf["size"].to_numpy(float) * n
    choices = [np.array([k >> i & 1 for i in range(len(pi))], float) for k in range(1 << len(pi))]
    pdf["pi"] = min(choices, key=lambda c: (abs(((c - pi) * words).sum()), abs(((c - pi) * n).sum())))
    return pdf


def source_targets(units: DataFrame, max_repeat: int, weights: tuple[int, ...]) -> DataFrame:
    """(skey, source_size, target, factor): one row per source, a configuration-sized list."""
    spark = units.sparkSession
    got = units.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    got.sort(key=lambda r: (r["skey"] == "", r["skey"]))
    w = [weights[i % len(weights)] for i in range(len(got))]
    goal = targets([r["words"] for r in got], w, max_repeat)
    rows = [(r["skey"], r["words"], float(g), float(g / r["words"]) if r["words"] else 0.0)
            for r, g in zip(got, goal)]
    return spark.createDataFrame(rows, "skey string, source_size bigint, target double, factor double")


def _cube(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows: (ukey, skey, size, n, factor) -> the same with ``copies``; rounds of bounded blocks, then the landing."""
    spark = rows.sparkSession
    rows = rows.withColumn("h", F.xxhash64("ukey", "skey", "size")).withColumn("whole", F.floor("factor")) \
        .withColumn("pi", F.col("factor") - F.floor("factor"))
    schema = rows.schema
    names = schema.fieldNames()
    fractional = (F.col("pi") > 0) & (F.col("pi") < 1)
    done, open_, turn = [rows.filter(~fractional)], rows.filter(fractional), 0
    while True:
        left = open_.groupBy("skey").agg(F.count(F.lit(1)).alias("units")).collect()  # one row per source
        if not left:
            break
        blocks = spark.createDataFrame([(r["skey"], -(-r["units"] // block_rows)) for r in left],
                                       "skey string, parts bigint")
        dealt = open_.join(F.broadcast(blocks), "skey") \
            .withColumn("b", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("parts")))
        walked = cut(dealt.groupBy("skey", "b").applyInPandas(lambda g: _block(g)[names], schema))
        done.append(walked.filter(~fractional))
        open_, turn = walked.filter(fractional), turn + 1
        if max(r["units"] for r in left) <= block_rows:
            done.append(open_.groupBy("skey").applyInPandas(lambda g: _land(g)[names], schema))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("ukey", "skey", "size", "n", (F.col("whole") + F.round("pi")).cast("long").alias("copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeat: int = 3,
        weights: tuple[int, ...] = (1, 2, 3), block_rows: int = BLOCK_ROWS,
        strata: tuple[float, ...] = (0.1, 0.01, 0.0)) -> DataFrame:
    """(ukey, skey, size, n, source_size, target, copies): how often each unit is taken.

    ``strata``: units above these shares of their source's target are balanced among themselves, the largest first;
    what a stratum's landing leaves over or short goes into the probabilities of the next.  Spark shuffles ids and
    sizes only, no text; the driver gets sums per source and stratum.
    """
    t = F.col(f"`{text}`")
    words = df.select(key_of(F.col(f"`{doc_id}`")).alias("ukey"), key_of(F.col(f"`{source}`")).alias("skey"),
                      F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = cut(words.groupBy("ukey", "skey", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = F.broadcast(source_targets(units, max_repeat, weights))
    own = F.col("size") * F.col("n")
    level = F.lit(len(strata) - 1)
    for k in reversed(range(len(strata) - 1)):
        level = F.when(own > F.col("target") * strata[k], k).otherwise(level)
    rows = units.join(per_source.select("skey", "target"), "skey").withColumn("level", level)
    sums = {(r["skey"], r["level"]): r["words"] for r in rows.groupBy("skey", "level").agg(F.sum(own).alias("words"))
            .collect()}
    goal = {r["skey"]: r["target"] for r in per_source.collect()}
    left = {s: sum(w for (x, _), w in sums.items() if x == s) for s in goal}
    out = None
    for k in range(len(strata)):
        factor = [(s, min(max(goal[s] / left[s], 0.0), float(max_repeat)) if left[s] else 0.0) for s in goal]
        if not any(x == k for _, x in sums):
            continue
        factors = df.sparkSession.createDataFrame(factor, "skey string, factor double")
        part = rows.filter(F.col("level") == k).join(F.broadcast(factors), "skey")
        done = _cube(part.select("ukey", "skey", "size", "n", "factor"), block_rows)
        if k < len(strata) - 1:
            done = cut(done)
            for r in done.groupBy("skey").agg(F.sum(F.col("copies") * own).alias("taken")).collect():
                goal[r["skey"]] -= r["taken"]
            for s in goal:
                left[s] -= sums.get((s, k), 0)
        out = done if out is None else out.unionByName(done)
    if out is None:
        out = units.withColumn("copies", F.lit(0).cast("long"))
    return out.join(per_source, "skey").select("ukey", "skey", "size", "n", "source_size", "target", "copies")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """Every input row with what the mix does with it: (row, size, source_size, target, taken)."""
    t = F.col(f"`{text}`")
    cols = [f"`{c}`" for c in df.columns]
    rows = df.select(F.struct(*cols).alias("row"), key_of(F.col(f"`{doc_id}`")).alias("a"),
                     key_of(F.col(f"`{source}`")).alias("b"),
                     F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("c"))
    m = mix(df, doc_id, text, source, **options)
    j = rows.join(m, (rows["a"] == m["ukey"]) & (rows["b"] == m["skey"]) & (rows["c"] == m["size"]))
    return j.select("row", m["size"], "source_size", "target", (m["size"] * F.col("copies")).alias("taken"))
