"""Idempotent table insert, dated audit log and profile snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_sink(df: DataFrame, path: str, ts: str = "processed_at", mode: str = "append") -> None:
    """One JSON record per event below ``year=/month=/day=`` of the processing date (UTC)."""
    stamp = F.col(ts).cast("timestamp")
    (
        df.withColumns(
            {
                "year": F.date_format(stamp, "yyyy"),
                "month": F.date_format(stamp, "MM"),
                "day": F.date_format(stamp, "dd"),
            }
        )
        .write.mode(mode).partitionBy("year", "month", "day").json(path)
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. A grouped minimum combines before the shuffle, so many copies of
    one key cost nothing; a row_number window would move them all to one task."""
    rest = [c for c in df.columns if c not in order]
    first = F.min_by(F.struct(*df.columns), F.struct(*order, *[F.xxhash64(*rest)] if rest else []))
    return df.groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*")


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str = "transaction_id", order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``target`` does not hold yet."""
    fresh = first_per_key(batch, key, order or [c for c in batch.columns if c != key])
    return fresh.join(target.select(key), key, "left_anti").select(*batch.columns)


#: Bits of the filter of one bucket; Spark's bitmaps have that many.
_BITS = 32_768


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_BITS))


def insert_bucketed(batch: DataFrame, path: str, key: str = "transaction_id", order: list[str] | None = None, buckets: int = 64) -> None:
    """Append to the table at ``path`` the first row of each key of ``batch`` that it does not hold yet.

    The table lies in folders by a hash of the key. Only the folders that the batch's keys fall into are read, of them only the keys,
    and of these only those whose bit is set in the batch's filter of the bucket (4 KB each, so the broadcast is bounded by the
    number of buckets) go on to the anti join. ``batch`` must read the same twice. Writing the same batch again adds nothing.
    """
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = first_per_key(batch, key, order or [c for c in batch.columns if c != key]).withColumn("bucket", place)
    bits = batch.select(place.alias("bucket"), _bit(key).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    touched = [r["bucket"] for r in bits.select("bucket").collect()]
    held = batch.sparkSession.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    byte = F.conv(F.hex(F.substring("bits", F.floor(_bit(key) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = held.join(F.broadcast(bits), "bucket").where(byte.bitwiseAND(F.pow(F.lit(2), _bit(key) % 8).cast("int")) != 0)
    new = fresh.join(maybe.select("bucket", key), ["bucket", key], "left_anti").select(*batch.columns, "bucket")
    new.write.mode("append").partitionBy("bucket").parquet(path)


def profile_lookup(events: DataFrame, snapshot: DataFrame, key: str = "user_id") -> DataFrame:
    """Attach the stored profile; an unknown user gets the empty profile."""
    defaults = {
        "tx_count": F.lit(0).cast("bigint"), "avg_amount": F.lit(0.0), "std_dev_amount": F.lit(0.0),
        "tx_last_10min": F.lit(0).cast("bigint"), "tx_last_hour": F.lit(0).cast("bigint"),
        "last_country": F.lit(""), "last_timestamp": F.lit(""),
    }
    cols = [c for c in defaults if c in snapshot.columns]
    joined = events.join(snapshot.select(key, *cols), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), defaults[c]) for c in cols})


def profile_upsert(snapshot: DataFrame, updates: DataFrame, key: str = "user_id", version: str = "version") -> DataFrame:
    """One row per user: the one with the highest version wins."""
    both = snapshot.unionByName(updates, allowMissingColumns=True)
    return (
        both.groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(F.struct(*both.columns), version).alias("_row"))
        .select("_row.*")
    )
