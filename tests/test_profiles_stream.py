"""The streaming fold, the batch windows and a plain sequential fold agree."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import profiles
from riskloom.streaming.profiles import EMPTY, fold_events, with_profile
from tests.conftest import SF

FIELDS = ["tx_count", "avg_amount", "std_dev_amount", "tx_last_10min", "tx_last_hour", "last_country", "country_is_new", "channel_is_new", "destination_is_new"]


def sequential(rows):
    """One event at a time, straight from the definition."""
    n, mean, m2, c10, c60, last, country = 0, 0.0, 0.0, 0, 0, None, ""
    known = {"country": set(), "channel": set(), "destination": set()}
    out = []
    for r in rows:
        out.append((n, mean, math.sqrt(m2 / n) if n else 0.0, c10, c60, country, *[r[k] not in known[k] for k in known]))
        amount = 0.0 if pd.isna(r["amount"]) else r["amount"]
        n += 1
        delta = amount - mean
        mean += delta / n
        m2 += delta * (amount - mean)
        now = None if pd.isna(r["micros"]) else r["micros"]
        if now is None:
            c10, c60 = c10 + 1, c60 + 1
        elif last is None or now - last > 3600e6:
            c10, c60 = 1, 1
        elif now - last > 600e6:
            c10, c60 = 1, c60 + 1
        else:
            c10, c60 = c10 + 1, c60 + 1
        last, country = now, r["country"]
        for k in known:
            known[k].add(r[k])
    return pd.DataFrame(out, columns=FIELDS)


def sample():
    gaps = [0, 600, 601, 3600, 3601, 5, 5, -300, 7200, 1, 599, 1, 1, 4000]
    micros, t = [], 1_700_000_000
    for g in gaps * 3:
        t += g
        micros.append(t * 1_000_000)
    frame = pd.DataFrame({"micros": pd.array(micros, dtype="Int64")})
    frame.loc[[0, 7, 20], "micros"] = pd.NA
    frame["amount"] = [float(i * 37 % 101) if i % 9 else None for i in range(len(frame))]
    for k, m in (("country", 3), ("channel", 2), ("destination", 7)):
        frame[k] = [f"{k}{i * i % m}" if i % 11 else "" for i in range(len(frame))]
    return frame


@pytest.mark.parametrize("parts", [1, 3, 10, 42])
def test_fold_in_batches(parts):
    frame = sample()
    state, pieces = EMPTY, []
    size = -(-len(frame) // parts)
    for start in range(0, len(frame), size):
        got, state = fold_events(state, frame.iloc[start:start + size].reset_index(drop=True))
        pieces.append(got)
    got = pd.concat(pieces, ignore_index=True)[FIELDS]
    pd.testing.assert_frame_equal(got, sequential(frame.to_dict("records")), check_dtype=False, rtol=1e-9)


def test_batch_windows_equal_sequential(spark):
    frame = sample()
    frame["arrival"] = range(len(frame))
    frame["user_id"] = "u"
    df = spark.createDataFrame(frame.astype({"micros": "float64"})).withColumn("event_time", F.when(~F.isnan("micros"), F.timestamp_micros(F.col("micros").cast("bigint")))).withColumn("amount", F.nanvl("amount", F.lit(None).cast("double")))
    want = sequential(sample().to_dict("records"))
    for hot in (10**9, 5):
        got = profiles.as_of_profile(df, order=["arrival"], hot_rows=hot).orderBy("arrival").toPandas()
        got["last_country"] = got["last_country"].fillna("")
        pd.testing.assert_frame_equal(got[FIELDS], want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, folder, files):
    e = spark.read.parquet(f"{SF}/events.parquet")
    events = e.select(
        F.format_string("e%08d", "event_id").alias("transaction_id"), (F.col("user_id") % 3).cast("string").alias("user_id"), F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("country"), F.lit("web").alias("channel"), (F.col("event_id") % 9).cast("string").alias("destination"),
        F.ntile(files).over(__import__("pyspark.sql.window").sql.Window.orderBy("ts")).alias("part"),
    )
    for i in range(files):
        events.where(F.col("part") == i + 1).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = with_profile(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").orderBy("transaction_id").toPandas()
    want = profiles.as_of_profile(events.drop("part")).orderBy("transaction_id").toPandas()
    want["last_country"] = want["last_country"].fillna("")
    pd.testing.assert_frame_equal(got[FIELDS], want[FIELDS], check_dtype=False, rtol=1e-9, atol=1e-9)
