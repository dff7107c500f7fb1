"""A corpus pipeline of five stages, each an operator of ``symloom.llm``.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each one's result as
Parquet to the shared folder and rereads it as the next one's ``docs``.  All but the last return
the columns of ``documents``.  The session's Arrow batches get small (see ``small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import jaccard, mixing, quality, secrets, tiling
from symloom.llm.staging import small_batches, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    small_batches(spark)
    return jaccard.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item, or more, go."""
    small_batches(spark)
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every document stays."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, source."""
    small_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]
#: No SQL form: the learned scores and the sampling can't be written in it.  Tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
