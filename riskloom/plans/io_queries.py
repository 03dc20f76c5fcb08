"""Registered queries of the file formats: tables are written to a run folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import history
from riskloom.plans import adapters as A
from riskloom.plans import data_queries
from riskloom.plans.registry import ORACLES, query, rounded, with_ctes
from riskloom.session import stage_root
from riskloom.sources import files, sinks, tensors


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/riskloom-files/{name}-{uuid.uuid4().hex}"


_PLAIN = "SELECT transaction_id, type, nullif(name_dest, '') AS name_dest, round(amount, 4) AS amount, is_fraud FROM txn"


def _plain(spark, d):
    return A.txn(spark, d).select("transaction_id", "type", F.nullif("name_dest", F.lit("")).alias("name_dest"), "amount", "is_fraud")


@query("a1_read_raw_csv", with_ctes(A.TXN) + _PLAIN)
def a1(spark, d):
    path = _folder(spark, "csv")
    _plain(spark, d).write.option("header", True).csv(path)
    raw = files.read_raw_csv(spark, path)
    return rounded(raw.withColumns({"amount": F.col("amount").cast("double"), "is_fraud": F.col("is_fraud").cast("int")}), "amount", digits=4)


@query("a7_write_table", with_ctes(A.TXN) + _PLAIN)
def a7(spark, d):
    path = _folder(spark, "table")
    files.write_table(_plain(spark, d), path)
    files.write_table(_plain(spark, d), path)  # the second write replaces the first
    return rounded(files.read_table(spark, path), "amount", digits=4)


@query("a8_write_report", with_ctes(A.TXN) + "SELECT type, count(*) AS n, sum(is_fraud)::BIGINT AS positives, max(nullif(name_dest, '')) AS last_dest FROM txn GROUP BY type")
def a8(spark, d):
    path = _folder(spark, "report")
    files.write_report(_plain(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum("is_fraud").cast("bigint").alias("positives"), F.max("name_dest").alias("last_dest")), path)
    return files.read_jsonl(spark, path, "type string, n bigint, positives bigint, last_dest string")


@query("a9_write_sequences", ORACLES["f9_sequence_dataset"])
def a9(spark, d):
    path = _folder(spark, "sequences")
    tensors.write_sequences(history.sequence_dataset(A.txn(spark, d)), path)
    return data_queries.sequence_digest(tensors.read_sequences(spark, path))


@query("a10_audit_sink", with_ctes(A.TXN) + """
SELECT transaction_id, is_fraud, strftime(transaction_timestamp::TIMESTAMP, '%Y') AS year, strftime(transaction_timestamp::TIMESTAMP, '%m') AS month, strftime(transaction_timestamp::TIMESTAMP, '%d') AS day FROM txn""")
def a10(spark, d):
    path = _folder(spark, "audit")
    sinks.audit_sink(A.txn(spark, d).select("transaction_id", "is_fraud", F.col("transaction_timestamp").alias("processed_at")), path)
    back = spark.read.schema("transaction_id string, is_fraud int, year string, month string, day string").json(path)
    return back.select("transaction_id", "is_fraud", "year", "month", "day")


@query("a12_read_jsonl", with_ctes(A.TXN) + _PLAIN)
def a12(spark, d):
    path = _folder(spark, "jsonl")
    files.write_jsonl(_plain(spark, d), path)
    return rounded(files.read_jsonl(spark, path, "transaction_id string, type string, name_dest string, amount double, is_fraud int"), "amount", digits=4)
