"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good (+1), bad (-1) or abstain (0) on
   every document, from whole-text measurements taken once.
2. Expectation-maximisation estimates the class prior and each labeller's
   accuracies.  It runs over the counts of distinct vote patterns of *all*
   documents; the patterns are at most 3^labellers rows, whatever the input.
3. Posterior labels of a bounded, documented sample (``sample_rows``) train a
   linear scorer on hashed character-class n-grams and binned measurements;
   rows are weighted by how common their pattern is among all documents.
4. Every whole text is scored; ``kept`` is score >= ``threshold``.

Defined cases: null or empty text, or text without a word, has no evidence
and is rejected with score 0; repeated rows get equal results; long texts are
read whole; an empty table gives an empty result; extra columns pass through
``classify`` untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType)

from .common import cut, packed
from .rules import MEASURES, measure_text

LABELLERS = ["symbols_per_word", "upper_share", "repeated_windows", "same_next_word", "mean_word", "repeated_lines",
             "punctuated_end", "cased_start"]
_GRAM, _BITS = 4, 12
_BINS = 8
N_FEATURES = (1 << _BITS) + _BINS * 6 + 1


def _ratios(m: tuple[int, ...]) -> np.ndarray:
    g = dict(zip(MEASURES, m))
    n = max(g["n_words"], 1)
    return np.array([g["n_symbols"] / n, g["n_upper"] / max(g["n_letters"], 1), g["n_repeat_words"] / n,
                     g["n_same_next"] / n, g["word_chars"] / n, g["n_dup_lines"] / max(g["n_lines"], 1)])


def votes(text: str, m: tuple[int, ...]) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 abstains.  Thresholds are wide apart, the middle abstains."""
    sym, up, rep, same, mean, dup = _ratios(m)
    few = m[0] < 10
    end = text.rstrip()[-1:]
    start = text.lstrip()[:1]
    return [
        -1 if sym > 0.1 else 1 if sym == 0 else 0,
        -1 if up > 0.5 and not few else 1 if up < 0.1 else 0,
        -1 if rep > 0.5 and not few else 1 if rep < 0.1 else 0,
        -1 if same > 0.3 and not few else 1 if same < 0.1 else 0,
        0 if few else -1 if mean > 12 or mean < 2 else 1 if 3.5 < mean < 6.2 else 0,
        -1 if dup > 0.5 and not few else 1 if dup == 0 and m[5] > 1 else 0,
        -1 if end and end in _ODD else 1 if end and end in ".!?" else 0,
        1 if start.isupper() and not text.lstrip()[1:2].isupper() else 0,
    ]


_ODD = "#*$%&|<>"
# character classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence end, 6 other punctuation, 7 symbol
_FAR = 0x250


def _classes() -> np.ndarray:
    out = np.zeros(_FAR + 1, np.int64)
    for i in range(_FAR):
        ch = chr(i)
        out[i] = (4 if ch == "\n" else 3 if ch.isspace() else 2 if ch.isdigit() else 1 if ch.isupper()
                  else 0 if ch.isalpha() else 5 if ch in ".!?" else 7 if ch in _ODD else 6)
    return out


_CLASS = _classes()


def features(text: str, m: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): hashed n-grams of run-collapsed character classes, scaled to unit length, and binned ratios."""
    codes = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _FAR)]
    codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes
    pad = np.concatenate((codes, np.full(_GRAM - 1, 4)))
    key = pad[: len(codes)].copy()
    for j in range(1, _GRAM):
        key = key * 8 + pad[j: j + len(codes)]
    hashed = (key * 0x9E3779B1 >> 7) & ((1 << _BITS) - 1)
    idx, count = np.unique(hashed, return_counts=True)
    val = count / np.sqrt((count ** 2).sum()) if len(count) else count.astype(float)
    r = _ratios(m) * np.array([1, 1, 1, 1, 0.05, 1])
    bins = np.minimum((np.sqrt(np.clip(r, 0, 1)) * _BINS).astype(int), _BINS - 1) + np.arange(6) * _BINS
    return (np.concatenate((idx, bins + (1 << _BITS), [N_FEATURES - 1])),
            np.concatenate((val, np.full(6, 0.5), [1.0])))


@dataclass
class LabelModel:
    prior: float          # share of good documents
    p_good: np.ndarray    # (labellers, 3): chance of a vote (-1, 0, 1) on a good document, given that it speaks
    p_bad: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of votes."""
        at = np.arange(pattern.shape[1])
        spoke = pattern != 0  # to abstain says nothing about the class
        g = np.log(self.prior) + (np.log(self.p_good[at, pattern + 1]) * spoke).sum(1)
        b = np.log(1 - self.prior) + (np.log(self.p_bad[at, pattern + 1]) * spoke).sum(1)
        return 1 / (1 + np.exp(np.clip(b - g, -500, 500)))


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> LabelModel:
    """EM over vote patterns (rows) and how many documents have each."""
    k = pattern.shape[1]
    if not len(pattern):
        return LabelModel(0.5, np.full((k, 3), 1 / 3), np.full((k, 3), 1 / 3))
    bad = (pattern < 0).any(1)  # start: any vote for bad, against none
    q = np.where(bad, 0.1, 0.9)
    last = -1.0
    for _ in range(rounds):
        w = count * q, count * (1 - q)
        prior = float(np.clip(w[0].sum() / count.sum(), 0.01, 0.99))
        p = [np.stack([np.array([x[pattern[:, j] == v].sum() if v else 0.0 for v in (-1, 0, 1)]) + [1, 0.5, 1]
                       for j in range(k)]) for x in w]
        model = LabelModel(prior, p[0] / p[0].sum(1, keepdims=True), p[1] / p[1].sum(1, keepdims=True))
        q = model.posterior(pattern)
        now = float((count * q).sum() / count.sum())
        if abs(now - last) < tol:
            break
        last = now
    return model


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray, epochs: int = 30,
               rate: float = 0.5, l2: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft targets by Adagrad over a fixed order of small batches."""
    w, g2 = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    n = len(rows)
    for e in range(epochs):
        order = np.random.default_rng(e).permutation(n)
        for a in range(0, n, 64):
            part = order[a: a + 64]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            own = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(own, w[idx] * val, len(part))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) * weight[part]
            grad = np.bincount(idx, err[own] * val, N_FEATURES) / len(part) + l2 * w
            g2 += grad ** 2
            w -= rate * grad / np.sqrt(g2)
    return w


def _pattern_udf():
    @F.pandas_udf(LongType())
    def pattern(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            m = measure_text(t)
            out.append(sum((v + 1) * 3 ** j for j, v in enumerate(votes(t, m))) if m[0] else -1)
        return pd.Series(out, dtype="int64")
    return pattern


def decode(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3 ** j % 3 - 1 for j in range(len(LABELLERS))], 1).astype(int)


@dataclass
class Scorer:
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        m = measure_text(text)
        if not m[0]:
            return 0.0
        idx, val = features(text, m)
        return float(1 / (1 + np.exp(-np.clip((self.weights[idx] * val).sum(), -30, 30))))


def fit(df: DataFrame, text: str = "text", sample_rows: int = 4000) -> tuple[Scorer, LabelModel]:
    """Label model over the vote patterns of all rows; scorer over ``sample_rows`` of them (the bound of the fit).

    The sample takes as many distinct texts of every pattern (the first by text hash, ranked before the shuffle), so
    rare kinds are seen; weights give each pattern the square root of its true share.  Texts are turned into
    features where they lie; the driver gets at most ``sample_rows`` sparse vectors.
    """
    t = F.col(f"`{text}`")
    voted = cut(df.select(F.xxhash64(t).alias("h"), _pattern_udf()(t).alias("pattern")))
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
              if r["pattern"] >= 0}
    pattern = np.array(sorted(counts), np.int64)
    count = np.array([counts[p] for p in pattern], float)
    model = fit_labels(decode(pattern), count)
    if not len(pattern):
        return Scorer(np.zeros(N_FEATURES)), model
    each = max(1, sample_rows // len(pattern))
    ranked = voted.filter("pattern >= 0").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("pattern").orderBy("h"))).filter(F.col("r") <= each)
    picked = ranked.select("h", "pattern")  # at most sample_rows rows: a proven bound for the broadcast

    @F.pandas_udf(StructType([StructField("i", ArrayType(IntegerType())), StructField("v", ArrayType(FloatType()))]))
    def vector(texts: pd.Series) -> pd.DataFrame:
        got = [features(x, measure_text(x)) for x in texts]
        return pd.DataFrame({"i": [g[0].astype(np.int32) for g in got], "v": [g[1].astype(np.float32) for g in got]})

    found = df.select(F.xxhash64(t).alias("h"), t.alias("t")).join(F.broadcast(picked), "h") \
        .groupBy("h", "pattern").agg(F.min("t").alias("t"))
    rows = sorted((r["pattern"], r["h"], r["f"]) for r in found.select("pattern", "h", vector("t").alias("f")).collect())
    own = np.searchsorted(pattern, np.array([r[0] for r in rows]))
    share = np.bincount(own, minlength=len(pattern))
    weight = np.sqrt(count[own] / share[own])
    target = model.posterior(decode(pattern))[own]
    vectors = [(np.array(f["i"]), np.array(f["v"], float)) for _, _, f in rows]
    return Scorer(fit_linear(vectors, target, weight / weight.mean())), model


def classify(df: DataFrame, text: str = "text", threshold: float = 0.7, sample_rows: int = 4000) -> DataFrame:
    """(row, score, kept): every whole row as a struct, its score and the verdict."""
    scorer, _ = fit(df, text, sample_rows)
    weights = df.sparkSession.sparkContext.broadcast(scorer.weights)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        model = Scorer(weights.value)
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return packed(df, text=text).select("row", score("text").alias("score")) \
        .withColumn("kept", F.col("score") >= threshold)
