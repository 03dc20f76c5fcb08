"""Profiles carried from batch to batch against one pass over all events, and the bucketed insert."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.profiles import as_of_profile
from riskloom.sources.sinks import insert_bucketed
from riskloom.streaming.state import ProfileStore

COLUMNS = ["tx_count", "avg_amount", "std_dev_amount", "tx_last_10min", "tx_last_hour", "last_country", "country_is_new", "channel_is_new", "destination_is_new"]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows, at = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        at += dt.timedelta(seconds=rng.choice([5, 60, 400, 4000]))
        user = "busy" if rng.random() < 0.4 else f"u{rng.randrange(25)}"
        rows.append((f"t{i:04d}", user, rng.choice([None, 10.0, 250.5, 3.25]), None if rng.random() < 0.02 else at, f"c{rng.randrange(4)}", rng.choice(["web", "app"]), f"d{rng.randrange(6)}", i))
    schema = "transaction_id string, user_id string, amount double, event_time timestamp, country string, channel string, destination string, place int"
    return spark.createDataFrame(rows, schema)


def values(df):
    got = df.select("transaction_id", *COLUMNS).collect()
    return {r[0]: tuple(r[1:]) for r in got}


def same(found, want):
    assert found.keys() == want.keys()
    for k, row in found.items():
        for a, b in zip(row, want[k], strict=True):
            assert a == pytest.approx(b, abs=1e-9) if isinstance(a, float) else a == b


@pytest.mark.parametrize("hot_rows", [5_000_000, 15])
def test_batches_equal_one_pass(spark, events, tmp_path, hot_rows):
    # Events without a usable time come last of their batch, so the whole is compared where there are none.
    timed = events.where("event_time is not null")
    store = ProfileStore(f"file://{tmp_path}/store", buckets=5, compact_every=2, hot_rows=hot_rows)
    found = {}
    for batch in range(5):
        part = timed.where(F.floor(F.col("place") / 120) == batch)
        found |= values(store.attach(part, batch))
        if batch in (1, 2):  # a replay finds what the batch found first
            again = values(store.attach(part, batch))
            same(again, {k: found[k] for k in again})
    whole = as_of_profile(timed).withColumn("last_country", F.coalesce("last_country", F.lit("")))
    same(found, values(whole))
    left = sorted(p.name for p in (tmp_path / "store" / "state").iterdir())
    assert left == ["batch=2", "batch=3", "batch=4", "upto=2", "upto=4"]


def test_unusable_times_and_empty_batches(spark, events, tmp_path):
    store = ProfileStore(f"file://{tmp_path}/store", buckets=3)
    first = events.where("place < 300")
    found = values(store.attach(first, 0))
    same(found, values(as_of_profile(first).withColumn("last_country", F.coalesce("last_country", F.lit("")))))
    assert store.attach(events.limit(0), 1).count() == 0
    later = values(store.attach(events.where("place >= 300"), 2))
    assert len(later) == 300 and all(v[0] >= 0 for v in later.values()) and max(v[0] for v in later.values()) > 200


def test_insert_reads_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    schema = "transaction_id string, n int"
    batch = lambda ids, n: spark.createDataFrame([(i, n + k) for k, i in enumerate(ids)], schema)
    spark.createDataFrame([], schema).write.parquet(path)
    ids = [f"t{i}" for i in range(400)]
    insert_bucketed(batch(ids, 0), path, buckets=16)
    insert_bucketed(batch(ids, 1000), path, buckets=16)
    insert_bucketed(batch([*ids[:50], "new", "new", None], 2000), path, buckets=16)
    held = {r.transaction_id: r.n for r in spark.read.schema(schema).parquet(path).collect()}
    assert held == {**{i: k for k, i in enumerate(ids)}, "new": 2050, None: 2052}
    assert spark.read.schema(schema).parquet(path).count() == 402
    files = {p.parent.name for p in (tmp_path / "table").rglob("*.parquet") if p.parent.name.startswith("bucket")}
    assert len(files) > 8
    insert_bucketed(batch(["only"], 1), path, buckets=16)
    # A table whose other buckets cannot even be read serves a batch that does not touch them.
    mine = spark.range(1).select(F.pmod(F.xxhash64(F.lit("only")), F.lit(16))).first()[0]
    for p in (tmp_path / "table").rglob("*.parquet"):
        if p.parent.name not in (f"bucket={mine}", "table"):
            p.write_bytes(b"unreadable")
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    insert_bucketed(batch(["only"], 5), path, buckets=16)
    assert [r.n for r in spark.read.schema(schema).parquet(f"{path}/bucket={mine}").where("transaction_id = 'only'").collect()] == [1]
