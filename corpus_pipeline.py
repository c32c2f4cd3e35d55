"""The corpus pipeline: five stages, each one an operator of ``ledgergraph.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns they were given.

1. quality: documents that the weak-label classifier rejects go.
2. lines: boilerplate lines of a source go, and documents that were nothing else.
3. near: of each group of near duplicates the document with the smallest id stays.
4. benchmark: documents that overlap a benchmark item go.
5. mix: the documents taken by the balanced mix, with their words, target and how many words of them are taken.

The scorer of stage 1, the sketches of stage 3 and the walk of stage 5 cannot
be written in SQL, so ``ORACLE_SQL`` is None; tests hold every stage against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergraph.llm import decontam, linededup, mixing, nearjoin, quality
from ledgergraph.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs).filter("kept").select("row.*")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cleaned_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed_documents(docs)
    return out.filter((F.col("taken") > 0) & (F.col("size") > 0)).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        *[F.col(c).alias(n) for c, n in (("size", "mix_size"), ("source_size", "mix_source_size"),
                                         ("target", "mix_target"), ("taken", "mix_taken"))])


STAGES = [("quality_classifier", quality_stage), ("line_dedup", lines_stage), ("ngram_jaccard_join", near_stage),
          ("benchmark_decontamination", benchmark_stage), ("mixing", mix_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
