"""Corpus pipeline: each stage takes what the stage before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, mixing, shards, similar, toxicity
from riskloom.session import stage_root


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labelled documents that are left for learning."""
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by a Jaccard similarity of 0.8 or more of their 5-word shingles.

    SimHash fingerprints in the Gray index give the pairs compared first, SuperMinHash bands those that lie further apart.
    """
    return similar.keep_one_similar(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, question and answer, go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and those of sources below their weight again, as often as the mixture has them."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row stands in the shuffled shards, with the document."""
    return shards.shuffle_shards(docs).select("record.*", "shard", "slot", "grown_shard")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL expresses the trained classifier and the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = f"{stage_root(spark)}/corpus-pipeline/{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
