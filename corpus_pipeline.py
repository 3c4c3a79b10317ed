"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import exact_dedup, mixing, near_copies, packing, quality
from quantloom.llm.common import importable, read, shared_dir


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark removes a job's shuffle files when the job ends and not when memory happens to be collected; the session's own setting comes
    back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, tidy in the jobs that it runs itself, whoever calls it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tidy(spark):
            return stage(spark, docs, sf_dir)

    return run


@tidied
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels given for them, accepts."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@tidied
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id."""
    return exact_dedup.keep_distinct(docs)


@tidied
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by chains of near copies (0.8 of their five-word shingles), the one with the smallest doc_id. SimHash proposes
    pairs, least-value fingerprints the pairs that it misses, and all are verified."""
    importable(spark)
    return near_copies.keep_one(docs)


@tidied
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per epoch, the last of each source cut at its budget."""
    return mixing.apply_mix(docs)


@tidied
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in their sequences, with their ids."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


#: SQL can't express the classifier, the near copies or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    with tidy(spark):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
    return docs
