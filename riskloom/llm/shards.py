"""Sharding by a two-pass external shuffle. DataFrame functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import stage_root


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 40
    #: UTF-8 bytes that a bucket should hold; it is permuted in the memory of one task.
    bucket_bytes: int = 16 << 20
    seed: int = 5


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a record: its text (null: none) and 16 more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_of(id_: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard of an id, and its shard if there were one more: the shard whose seeded hash with the id is the largest.

    A new shard wins an id from the others or leaves it where it is. All rows of a null id are in one shard.
    """

    def draw(i: int) -> Column:
        return F.struct(F.xxhash64(F.lit(seed), F.lit(i), id_).alias("h"), F.lit(i).alias("i"))

    best = F.array_max(F.array(*[draw(i) for i in range(shards)]))
    return best["i"], F.greatest(best, draw(shards))["i"]


def write_shards(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", config: ShardConfig | None = None) -> None:
    """Write all rows of ``docs`` under ``path/shard=<n>``, each row as a struct ``record`` with ``bucket`` and ``pos``.

    First pass: a seeded hash scatters the rows of a shard uniformly over as many buckets as its share of all bytes fills;
    the hash also takes a row's place in its input partition, so rows that repeat, or share an id, spread like any others.
    The input should be a table or a checkpoint, so that this place is the same when a task runs again. Second pass: each
    bucket is shuffled by the Fisher-Yates method in memory and written. One task writes a bucket as a whole, so a task
    that runs again cannot mix two orders.
    """
    config = config or ShardConfig()
    total = docs.agg(F.sum(text_size(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // (config.shards * config.bucket_bytes)))
    shard, _ = shard_of(F.col(id_), config.shards, config.seed)
    draw = F.xxhash64(F.lit(config.seed), F.lit("bucket"), F.col(id_), F.monotonically_increasing_id())
    rows = docs.select(F.struct("*").alias("record"), shard.alias("shard"), draw.alias("draw")).withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("long"))
    dealt = rows.repartition(config.shards * buckets, "shard", "bucket").sortWithinPartitions("shard", "bucket", "draw")
    bucket = dealt.groupBy("shard", "bucket").agg(F.collect_list("record").alias("records"))
    bucket.select("shard", "bucket", F.posexplode(F.shuffle("records", config.seed)).alias("pos", "record")).write.partitionBy("shard").parquet(path)


def read_shards(docs_schema: DataFrame, path: str) -> DataFrame:
    """``(record, shard, slot)`` of written shards: the slots of a shard count its buckets one after the other, without gaps."""
    spark = docs_schema.sparkSession
    record = docs_schema.select(F.struct("*").alias("record")).schema.add("bucket", "long").add("pos", "integer").add("shard", "integer")
    rows = spark.read.schema(record).parquet(path)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("shard", "bucket", start.alias("start")), ["shard", "bucket"]).select("record", "shard", (F.col("start") + F.col("pos")).cast("long").alias("slot"))


def shuffle_shards(docs: DataFrame, id_: str = "doc_id", text: str = "text", config: ShardConfig | None = None) -> DataFrame:
    """All rows of ``docs`` as ``(record, shard, slot, grown_shard)``, from shards written to the shared folder.

    Law of the shards: the id and the number of shards decide. Null ids, null and empty texts, repeated rows and clashing
    column names are kept as they are; an empty table gives an empty one.
    """
    config = config or ShardConfig()
    path = f"{stage_root(docs.sparkSession)}/shards/{uuid.uuid4().hex}"
    write_shards(docs, path, id_, text, config)
    _, grown = shard_of(F.col(f"record.{id_}"), config.shards, config.seed)
    return read_shards(docs, path).withColumn("grown_shard", grown)


def digest(sharded: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each record stands, without its text; the CRC of a null text is that of an empty one."""
    body = F.col(f"record.{text}")
    return sharded.select(
        F.col(f"record.{id_}").alias("doc_id"), text_size(body).alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )
