"""Chosen-path near-duplicate join (op10) and the corpus pipeline."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgergraph.llm import components, nearjoin, quality
from .edge import edge_docs, empty_docs
from .test_native import _words, brute_lines, brute_overlap

SF = "/root/testdata/sf0.001"


def brute_near(rows, threshold=0.8):
    """{id: (class, links)} by comparing all pairs that share a run."""
    sets, inv = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            inv[g].append(i)
    up, links = {i: i for i in sets}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, s in sets.items():
        shared = Counter(j for g in s for j in inv[g] if j > i)
        for j, c in shared.items():
            if c >= threshold * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in sets}


def planted(seed=8):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    rows, k = [], 0
    base = rnd.choices(vocab, k=150)
    passage = rnd.choices(vocab, k=60)

    def edited(words, edits):
        w = list(words)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        return " ".join(w)
    for _ in range(60):                       # a dense group of near copies
        rows.append((k := k + 1, edited(base, rnd.randint(0, 3))))
    for _ in range(40):                       # exact copies
        rows.append((k := k + 1, " ".join(base)))
    for _ in range(80):                       # texts that share a passage but are not alike
        rows.append((k := k + 1, " ".join(passage + rnd.choices(vocab, k=rnd.randint(30, 200)))))
    for _ in range(60):                       # pairs
        w = rnd.choices(vocab, k=rnd.randint(20, 120))
        rows.append((k := k + 1, " ".join(w)))
        rows.append((k := k + 1, edited(w, rnd.randint(0, 2))))
    rows += [(k + 1, "one two"), (k + 2, "One  two"), (k + 3, ""), (k + 4, "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket_rows", [512, 16])
def test_near_duplicates_against_brute_force(spark, bucket_rows):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.labelled(df, bucket_rows=bucket_rows).collect()}
    want = brute_near(rows)
    assert len(got) == len(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * len(rows), [(got[i], want[i]) for i in wrong][:5]


def test_near_edge_rows(spark):
    docs = edge_docs(spark)
    got = nearjoin.labelled(docs).collect()
    by = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert len(got) == docs.count()
    assert by[1][0] == by[7][0] == by[8][0] == by[10][0] == 1 and by[1][1] == 3
    assert by[2] == (2, 0) and by[3] == (3, 0) and by[4] == (4, 0) and by[None] == (None, 0)
    kept = nearjoin.representatives(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 2, 3, 4, 5, 6, 9, 11, 12, None])
    assert nearjoin.labelled(empty_docs(spark)).count() == 0 and nearjoin.representatives(empty_docs(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    touched = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: root(i) for i in touched}


def test_survival_and_runs():
    assert nearjoin.survival(1) == pytest.approx(1 - 2.718281828 ** -1)
    r = nearjoin.runs_for(0.99, 3)
    assert (1 - nearjoin.survival(3)) ** r <= 0.01 < (1 - nearjoin.survival(3)) ** (r - 1)


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]

    def rows(df):
        return sorted((r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect())
    one = stages["quality_classifier"](spark, docs, SF).cache()
    scorer, _ = quality.fit(docs)
    assert rows(one) == [r for r in rows(docs) if scorer.score(r[2]) >= 0.7]
    two = stages["line_dedup"](spark, one, SF).cache()
    want = {i: t for i, t in brute_lines(rows(one)) if t.strip(" ") or not dict((a, c) for a, _, c in rows(one))[i].strip(" ")}
    assert {i: t for i, _, t in rows(two)} == want
    three = stages["ngram_jaccard_join"](spark, two, SF).cache()
    near = brute_near([(i, t) for i, _, t in rows(two)])
    assert [r[0] for r in rows(three)] == sorted(i for i, (c, _) in near.items() if c == i)
    four = stages["benchmark_decontamination"](spark, three, SF).cache()
    items = [_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in rows(three) if not any(brute_overlap(_words(r[2]), w) >= min(10, len(w)) for w in items)]
    assert [r[0] for r in rows(four)] == clean
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    five = stages["mixing"](spark, four, SF).toPandas()
    assert set(docs.columns) < set(five.columns) and (five.mix_taken > 0).all()
    for _, g in five.groupby("source"):
        assert abs(g.mix_taken.sum() - g.mix_target.iloc[0]) <= max(0.1 * g.mix_target.iloc[0], g.mix_size.max())


def test_run_writes_and_rereads(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "mix_taken" in out.columns
    assert out.filter(F.col("mix_taken") > 3 * F.col("mix_size")).count() == 0


def test_stages_on_empty_and_edge_tables(spark, tmp_path):
    for make in (empty_docs, edge_docs):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                out.count()


@pytest.mark.parametrize("differ", ["line", "blanks", "words"])
def test_one_whole_text_of_a_near_copy_group_stays(spark, differ):
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    article = [" ".join(rnd.choices(vocab, k=30)) for _ in range(12)]
    data = []
    for i in range(150):
        lines = [" ".join(rnd.choices(vocab, k=25)) for _ in range(6)]
        if i < 50:                                     # a third of the source
            lines = list(article)
            if differ == "line":
                lines[5] = f"changed line {i} " + " ".join(rnd.choices(vocab, k=6))
            elif differ == "blanks":
                lines = [x + " " * rnd.randint(0, 3) for x in lines] + [""] * (i % 7)
            else:
                for k in rnd.sample(range(12), 2):
                    lines[k] = " ".join([*lines[k].split()[:-1], f"edit{i}"])
        data.append((i, "a", "\n".join(["Share this page", *lines])))
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    stages = dict(corpus_pipeline.STAGES)
    cleaned = stages["line_dedup"](spark, df, SF).cache()
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == {i: t.removeprefix("Share this page\n") for i, _, t in data}
    kept = {r.doc_id: r.text for r in stages["ngram_jaccard_join"](spark, cleaned, SF).collect()}
    group = [i for i in kept if i < 50]
    assert len(kept) == 100 + len(group) and group == [min(group)] and kept[group[0]] == got[group[0]]


def test_runs_reach_the_recall_at_the_deepest_level(spark, monkeypatch):
    asked, classes = [], nearjoin.classes
    monkeypatch.setattr(nearjoin, "classes", lambda *a: asked.append(a[5]) or classes(*a))
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for deepest in (3, 5, 8):
        assert {r.doc_id: r.class_id for r in nearjoin.labelled(df, max_depth=deepest).collect()} == {1: 1, 2: 1, 3: 3}
        assert (1 - nearjoin.survival(deepest)) ** asked[-1] <= 0.01
