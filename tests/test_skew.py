"""The segmented route for hot accounts must equal the plain one, with NULL keys, times and ties."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import history, profiles
from riskloom.operators.skew import hot_keys
from tests.conftest import SF


def txn(spark, rows=None):
    e = spark.read.parquet(f"{SF}/events.parquet")
    i = F.col("event_id")
    # Two thirds of the rows belong to one account, a tenth to the NULL account.
    return e.select(
        F.concat(F.lit("ev_"), i.cast("string")).alias("transaction_id"), i.alias("transaction_order"),
        F.when(i % 50 != 3, F.col("ts")).alias("transaction_timestamp"),
        F.when(i < 670, "hot").when(i < 770, F.lit(None)).otherwise(F.col("user_id").cast("string")).alias("name_orig"),
        F.when((i > 100) & (i < 400), " ").when(i % 3 > 0, F.concat(F.lit("d"), (i * 7 % 5).cast("string"))).alias("name_dest"),
        F.when(i % 17 > 0, F.col("value")).alias("amount"), (i % 2).cast("int").alias("is_fraud"),
    )


def same(plain, hot, key="transaction_order"):
    a, b = (x.orderBy(key).toPandas() for x in (plain, hot))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("limit", [30, 200])
def test_behavioral_features(spark, limit):
    t = txn(spark)
    assert hot_keys(t, "name_orig", limit)[0] is not None
    same(history.behavioral_features(t), history.behavioral_features(t, hot_rows=limit))


def test_sequences(spark):
    t = txn(spark)
    text = lambda d: d.withColumn("x_seq", F.to_json("x_seq")).withColumn("x_current", F.to_json("x_current"))
    same(text(history.sequence_dataset(t)), text(history.sequence_dataset(t, hot_rows=50)))


def test_risk_context_and_burst(spark):
    t = txn(spark)
    order = ["transaction_timestamp", "transaction_order"]
    for fn in (
        lambda h: history.risk_context(t, "name_orig", "transaction_timestamp", order, hot_rows=h),
        lambda h: history.recent_burst_count(t, "name_orig", "transaction_timestamp", order, hot_rows=h),
    ):
        same(fn(10**9), fn(40))


def test_profiles(spark):
    t = txn(spark).select(
        "transaction_order", "transaction_id", F.col("name_orig").alias("user_id"), F.col("transaction_timestamp").alias("event_time"), "amount",
        F.col("name_dest").alias("destination"), (F.col("transaction_order") % 4).cast("string").alias("country"),
    )
    order = ["transaction_order"]
    same(profiles.as_of_profile(t, order=order), profiles.as_of_profile(t, order=order, hot_rows=40))
    by_time = ["event_time", "transaction_order"]
    same(profiles.as_of_profile(t, order=by_time), profiles.as_of_profile(t, order=by_time, hot_rows=40))
    same(profiles.profile_snapshot(t, order=order), profiles.profile_snapshot(t, order=order, hot_rows=40), "user_id")


def test_segments_grow_with_the_rows_not_with_the_bound():
    from riskloom.operators.skew import segments_for

    assert segments_for(300, 40) == 16 and segments_for(20_000_000, 5_000_000) == 9
    assert segments_for(36_000_000, 150) == 720 and segments_for(6_000_000, 150) == 120 and segments_for(100_000, 150) == 64
