"""Profiles of all users between micro-batches, as a table in hash buckets of the user."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.profiles import KNOWN, START, as_of_profile, state_after
from riskloom.operators.skew import HOT_ROWS
from riskloom.session import delete, stage

_STATE = "n bigint, mean double, m2 double, in_10min bigint, in_hour bigint, last_ts timestamp, last_country string"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ProfileStore:
    """Versions of the profiles below ``path``, one for each micro-batch, and of the values that users are known by.

    A batch reads only the buckets of its users, from the last compacted version on, and writes only the users it has changed; every
    ``compact_every`` batches the versions become one. It reads versions before its own alone, so that a replayed batch finds the state it
    found first and overwrites what it left. No list and no user's batch is ever one row or one frame.
    """

    path: str
    buckets: int = 64
    compact_every: int = 16
    key: str = "user_id"
    hot_rows: int = HOT_ROWS

    def _versions(self, spark: SparkSession, kind: str, base: int, until: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of the compacted version ``base`` and of the batches from there up to ``until``, that one left out."""
        names = [f"{self.path}/{kind}/upto={base}"] + [f"{self.path}/{kind}/batch={i}" for i in range(base, until)]
        schema = f"{self.key} string, " + (_STATE if kind == "state" else "kind string, value string") + ", v bigint, bucket int"
        parts = [spark.read.schema(schema).parquet(p) for p in names if exists(spark, p)]  # at most compact_every + 1
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "bucket")]
        return rows.groupBy(self.key, "bucket").agg(F.max_by(F.struct(*rest), "v").alias("s")).select(self.key, "bucket", "s.*")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def attach(self, batch: DataFrame, batch_id: int, order: Sequence[str] = ("event_time", "transaction_id")) -> DataFrame:
        """Rows of a micro-batch (a table that reads the same twice) with the profile before each; the store then holds the state after.

        The result is a staged table.
        """
        spark, key, base = batch.sparkSession, self.key, batch_id - batch_id % self.compact_every
        place = bucket_of(F.col(key), self.buckets)
        touched = [r[0] for r in batch.select(place).distinct().collect()]  # no more than there are buckets
        state = self._versions(spark, "state", base, batch_id, touched)
        seen = self._versions(spark, "known", base, batch_id, touched)
        start = spark.createDataFrame([], f"{key} string, {_STATE}")
        if state is not None:
            start = self._latest(state).drop("v", "bucket").join(batch.select(key).distinct(), key, "left_semi")
        known = None if seen is None else seen.select(key, "kind", "value")
        done = stage(as_of_profile(batch, key, order, hot_rows=self.hot_rows, start=start, seen=known), "profiled")
        tag = {"v": F.lit(batch_id).cast("bigint"), "bucket": place}
        self._write(state_after(done, key, order).withColumns(tag), f"{self.path}/state/batch={batch_id}")
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.col(f"{k}_is_new").alias("new")) for k in KNOWN]))
        fresh = done.select(key, pairs.alias("p")).where("p.new").select(key, "p.kind", "p.value").withColumns(tag)
        self._write(fresh, f"{self.path}/known/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            for kind in ("state", "known"):
                rows = self._versions(spark, kind, base, batch_id + 1)
                self._write(self._latest(rows) if kind == "state" else rows, f"{self.path}/{kind}/upto={batch_id + 1}")
                # Only the last batch can come again, and it reads from ``base`` on.
                for old in [f"upto={base - self.compact_every}", *[f"batch={i}" for i in range(max(0, base - self.compact_every), base)]]:
                    delete(spark, f"{self.path}/{kind}/{old}")
        return done.drop(START).withColumn("last_country", F.coalesce("last_country", F.lit("")))
