"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one bit per failed rule; a policy is a versioned choice of
bits, applied later with a bitwise AND, and ablations (what would a policy
keep without rule k?) are plain bitwise aggregation over the ledger: no text
is read again.

Defined cases: null and empty texts have no words and fail ``few_words``;
texts of any length are measured whole; repeated rows are measured one by
one; extra columns do not matter; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_same_next"]
_SYMBOLS = "#*$%&|<>"
_FAR = 0x250  # tables for the common letters; the last place stands for all others, which are asked one by one
_ALPHA = np.array([chr(i).isalpha() for i in range(_FAR)] + [False])
_UPPER = np.array([chr(i).isupper() for i in range(_FAR)] + [False])


def measure_text(text: str | None) -> tuple[int, ...]:
    """All measurements of one whole text (order of ``MEASURES``)."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x and x.encode("utf-8", "surrogatepass").split()]
        dup = len(full) - len(set(full))
        n_lines = len(full)
    else:
        n_lines = 1 if n else 0
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    near = np.minimum(codes, _FAR)
    letters, upper = int(_ALPHA[near].sum()), int(_UPPER[near].sum())
    if int(codes.max()) >= _FAR:
        beyond = [chr(x) for x in codes[codes >= _FAR]]
        letters += sum(map(str.isalpha, beyond))
        upper += sum(map(str.isupper, beyond))
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return n, chars, symbols, dup, repeat, n_lines, upper, letters, same


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measure_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in text], columns=MEASURES, dtype="int64")


def rules() -> list[tuple[str, Column]]:
    """(name, failed) over the columns of ``MEASURES``; the place is the bit, so new rules go to the end."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("many_words", c("n_words") > 1_000_000),
        ("short_mean_word", c("word_chars") < 2 * c("n_words")),
        ("long_mean_word", c("word_chars") > 20 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        ("upper_case", 100 * c("n_upper") > 50 * c("n_letters")),
        ("same_next_word", 100 * c("n_same_next") > 30 * c("n_words")),
    ]


BASE_BITS = 0b11
#: Policies: version -> bits whose failure rejects a document.
POLICIES = {"base": BASE_BITS, "v1": 0b1_1111_1111}


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the measurements and ``failed_bits`` (bit k set: rule k failed)."""
    keep = list(df.columns) if keep is None else keep
    measured = df.select(*[F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)],
                         measure_udf(F.col(f"`{text}`")).alias("m"))
    flat = measured.select(*[f"keep_{i}" for i in range(len(keep))], "m.*")
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    flat = flat.withColumn("failed_bits", bits)
    return flat.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep) if k not in MEASURES
                         and k != "failed_bits"], *MEASURES, "failed_bits")


def verdict(policy: str = "v1", bits: Column | None = None) -> Column:
    """True where no rule of the policy failed."""
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, fail only it (kept if it went), and kept without it.

    One partial aggregation over the distinct bit patterns (at most 2^rules rows), never over texts.
    """
    mask = POLICIES[policy]
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")) \
        .agg(F.count(F.lit(1)).alias("n"))
    names = [(k, n) for k, (n, _) in enumerate(rules()) if mask >> k & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(n).alias("rule"),
                                        F.lit(1 << k).cast("long").alias("one")) for k, n in names])).alias("r")
    return patterns.select("bits", "n", rows).groupBy("r.bit", "r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.one"))) == 0, F.col("n")).otherwise(0))
        .alias("n_kept_without"))
