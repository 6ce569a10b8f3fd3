"""Corpus pipeline: filter, deduplicate, decontaminate, redact, mix.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before it kept, and returns the columns of ``documents`` (the last one
adds its own).  ``run`` writes each stage to the shared folder as Parquet and
reads it back, so a lost executor never reaches behind a finished stage.

Rows with a null ``doc_id`` pass the near-duplicate stage (they cannot be named
as copies); the other stages decide by row, also where ids are shared; null and empty texts are kept; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate, mixture, pii, quality, simhash
from parley.llm.common import table
from parley.session import scratch_path, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ship_package(spark)
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship_package(spark)
    return pii.redact(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words."""
    names = {n.lower() for n in docs.columns}
    free = lambda n: n if n.lower() not in names else free(f"mix_{n}")
    return mixture.take(docs, free("copies"), free("taken"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixture", mixture_stage),
]

# Fitted scorers, XXH64 fingerprints and boosted trees have no SQL; the stages
# are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
