"""Corpus pipeline: rules, near-duplicate removal, decontamination, mixing and token output.

Defined cases: null and empty texts fail the rules; repeated rows are near duplicates of each other; extra columns of
documents stay until the last stage, which keeps them in its files; without benchmark items nothing is contaminated; an
empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import decontaminate, jaccard_forest, mixing, repetition, token_store
from halyard.llm._store import new_path, text_batches
from halyard.llm.queries import tokenizer_path

#: Sources are mixed in proportion to the square root of their sizes.
TEMPER = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    text_batches(spark)
    return repetition.kept_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    text_batches(spark)
    return jaccard_forest.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    text_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's rate draws it, in a global random order."""
    # columns that replicate defines itself step aside, so that the caller's own keep their values
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in mixing.DEFINED}
    return mixing.replicate(docs.withColumnsRenamed(aside), temper=TEMPER).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids in the random order of the copies; returns the digests read back from the files."""
    text_batches(spark)
    return token_store.token_output(mixing.in_random_order(docs), tokenizer_path(), order=["shuffle_key"])


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token_output", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
