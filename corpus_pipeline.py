"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, mixing.

Each stage takes the documents that the one before kept, applies its operator to all of them and returns the columns of
documents; the last adds the number of the copy.  Empty input gives empty output with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gapwise.llm import decontaminate, mixing, near, pii, quality
from gapwise.llm.common import table
from gapwise.plans.registry import query
from gapwise.scale import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more; it learns from the labels outside the held-out fold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` counted anew."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights, in random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("personal data", no_personal_data),
    ("mixing", mixed),
]

#: fitted models (quality, span classifier) and signatures have no SQL form; tests compare every stage with brute force
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/gapwise/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
