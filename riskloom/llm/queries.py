"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, decontaminate, gru, hard_negatives, main_text, merkle, mixing, secret_scan, shards, simhash, superminhash, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(mixing.mix(table(spark, sf_dir, "documents")))
    source = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("source")
    return plan.select(F.col("id").alias("doc_id"), source, "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "position")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.scores(docs, model)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shuffle_shards(table(spark, sf_dir, "documents")))


def op7_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.scores(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumnRenamed("key", "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_counts(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_multiprobe": op1_multiprobe,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_sharding": op6_sharding,
    "op7_gru": op7_gru,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_superminhash": op13_superminhash,
}

ORACLES = {"op2_mixing": mixing.ORACLE, "op8_secrets": secret_scan.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_merkle": merkle.ORACLE, "op13_superminhash": superminhash.ORACLE}
