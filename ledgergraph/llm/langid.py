"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed greedily into longest matches against each automaton;
a text in the language needs few, long phrases.  The language with the fewest
phrases, normalised by log2 of its training length (the cost of naming a
match) and by the length parsed, wins.

The automata become one dense transition table with the restart folded in:
where a state has no transition for a character, the entry leads to where the
root goes on that character and carries the flag "a phrase begins here".  So
parsing is one table look-up per character and language, done for a thousand
text segments at once.  Every character of a text is parsed, in segments of
``segment`` characters (a phrase ends at a segment's end), whatever its length.

Defined cases: null text, empty text and text without a letter give ``und``
with score 0, as does everything when nothing can be learned; ties go to the
language first by code point; a null id is neither held out nor learned from.
Repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray   # code point -> character class; 0 no letter, 1 a letter not learned
    step: np.ndarray      # (state * width + class) -> next state * 2 + (a phrase begins)
    width: int
    roots: np.ndarray
    cost: np.ndarray      # log2 of each language's training length


def suffix_automaton(seq: list[int], cut: int) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``seq`` that do not cross ``cut``."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        if c == cut:
            last = 0
            continue
        if c in to[last]:  # after a cut the string may already be there
            q = to[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            to.append(dict(to[q]))
            length.append(length[last] + 1)
            link.append(link[q])
            copy, p = len(to) - 1, last
            while p >= 0 and to[p].get(c) == q:
                to[p][c] = copy
                p = link[p]
            link[q] = copy
            last = copy
            continue
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, p = len(to) - 1, last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                copy = len(to) - 1
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


def encode(classes: np.ndarray, text: str) -> np.ndarray:
    """Character classes of the lower-cased text; a run of non-letters becomes one separator, none at the ends."""
    got = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = got > 0
    keep = letter | np.concatenate(([False], letter[:-1]))
    got = got[keep]
    return got[:-1] if len(got) and got[-1] == 0 else got


def learn(samples: list[tuple[str, str]], max_classes: int = 250) -> Model:
    """samples: (lang, text); a bounded list."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    seen: dict[str, int] = {}
    for _, text in samples:
        for ch in text.lower():
            if ch.isalpha():
                seen[ch] = seen.get(ch, 0) + 1
    letters = sorted(sorted(seen, key=lambda c: (-seen[c], c))[:max_classes])
    classes = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for k, ch in enumerate(letters):
        classes[ord(ch)] = k + 2
    width = len(letters) + 2
    tables, roots, cost, base = [], [], [], 0
    for lang in langs:
        seq: list[int] = []
        for text in sorted(by[lang]):
            seq += [*encode(classes, text).tolist(), -1]
        auto = suffix_automaton(seq, -1)
        first = np.full(width, base, np.int64)
        for c, s in auto[0].items():
            first[c] = base + s
        table = np.tile(first * 2 + 1, (len(auto), 1))
        for s, edges in enumerate(auto):
            for c, t in edges.items():
                table[s, c] = (base + t) * 2 + (s == 0)
        tables.append(table.astype(np.int32))
        roots.append(base)
        cost.append(np.log2(max(2, len(seq))))
        base += len(auto)
    step = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    return Model(langs, classes, step, width, np.array(roots, np.int32), np.array(cost))


def parse(model: Model, seqs: list[np.ndarray], segment: int = 1024) -> np.ndarray:
    """Phrases of every sequence by every language: array (languages, sequences)."""
    owner, parts = [], []
    for i, s in enumerate(seqs):
        for a in range(0, len(s), segment):
            owner.append(i)
            parts.append(s[a: a + segment])
    out = np.zeros((len(model.langs), len(seqs)))
    if not parts:
        return out
    size = np.array([len(p) for p in parts])
    order = np.argsort(-size, kind="stable")
    grid = np.zeros((int(size.max()), len(parts)), np.int32)
    for col, k in enumerate(order):
        grid[: size[k], col] = parts[k]
    active = np.searchsorted(-size[order], -np.arange(len(grid)), side="left")  # segments longer than t
    state = np.repeat(model.roots[:, None], len(parts), 1)
    phrases = np.zeros(state.shape, np.int32)
    for t in range(len(grid)):
        n = active[t]
        if n < state.shape[1]:
            state = np.ascontiguousarray(state[:, :n])
        got = model.step.take(state * model.width + grid[t, :n])
        phrases[:, :n] += got & 1
        state = got >> 1
    for lang in range(len(model.langs)):
        out[lang] = np.bincount(np.array(owner)[order], phrases[lang], len(seqs))
    return out


def predict(model: Model, texts: list[str | None], segment: int = 1024) -> tuple[list[str], list[float]]:
    seqs = [encode(model.classes, t) if t else np.zeros(0, np.uint8) for t in texts]
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    need = parse(model, seqs, segment) * model.cost[:, None]
    best = need.argmin(0)
    two = np.sort(need, 0)[:2]
    score = np.clip(1 - two[0] / np.maximum(two[1], 1e-9), 0, 1) if len(two) == 2 else np.ones(len(texts))
    none = np.array([len(s) == 0 for s in seqs])
    return ([UNKNOWN if e else model.langs[b] for b, e in zip(best, none)], np.where(none, 0.0, score).tolist())


def bucket(doc_id: str = "doc_id"):
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5


def sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 80,
           chars: int = 400) -> list[tuple[str, str]]:
    """At most ``per_lang`` excerpts of ``chars`` characters from the middle of learnable documents, per language.

    Chosen by a hash order of the id, ranked before the shuffle (WindowGroupLimit), so a task sends at
    most ``per_lang`` rows per language and the driver gets languages x per_lang short strings.
    """
    t = F.col(f"`{text}`")
    rows = df.filter((bucket(doc_id) != 0) & F.col(f"`{lang}`").isNotNull() & t.isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"),
        F.substring(t, F.greatest(F.lit(1), (F.length(t) / 2).cast("int") - chars // 2), F.lit(chars)).alias("x"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))) \
        .filter(F.col("r") <= per_lang)
    return [(r["lang"], r["x"]) for r in top.select("lang", "x").collect()]


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 80,
             chars: int = 400, segment: int = 1024) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    from .textnum import slices
    learned = df.sparkSession.sparkContext.broadcast(vars(learn(sample(df, doc_id, text, lang, per_lang, chars))))

    @F.pandas_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def guess(texts: pd.Series) -> pd.DataFrame:
        model, rows, langs, scores = Model(**learned.value), texts.tolist(), [], []
        for a, b in slices([len(t) if t else 1 for t in rows]):
            got = predict(model, rows[a:b], segment)
            langs += got[0]
            scores += got[1]
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    out = df.select(F.col(f"`{doc_id}`").alias("doc_id"),
                    F.coalesce(bucket(doc_id) == 0, F.lit(False)).alias("held_out"), guess(F.col(f"`{text}`")).alias("g"))
    return out.select("doc_id", "held_out", "g.lang_pred", "g.score")
