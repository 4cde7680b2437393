"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and is written as Parquet and read
again before the next. All but the last return the columns of ``documents``, whatever further ones that table has; the
last returns what sharding does.

Null and empty texts fail the quality rules and end there; very long ones are judged whole. Rows that repeat an id pass
every stage together and get slots of their own. Of equally similar documents the smallest id stays; rows without an id
are never dropped as copies. Empty tables of documents or of items give empty results and nothing to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import decontaminate, mixing, neardup, quality, sharding
from lithoframe.llm.common import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (5-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_inside=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources meet their target weights, in a global random order."""
    return mixing.mix(docs, names=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each document."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", rules),
    ("near-duplicates", near_dedup),
    ("decontamination", clean_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]
#: Near-duplicates, decontamination and the jump hash have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
