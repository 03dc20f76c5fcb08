"""Readers, writers, sinks and the online stream."""

import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import cleaning
from riskloom.plans import online_queries
from riskloom.sources import files, sinks
from riskloom.streaming import process as online
from tests.conftest import SF


def test_raw_csv_and_rows_in_file_order(spark, folder):
    path = pathlib.Path(folder, "raw")
    path.mkdir()
    for name, rows in (("a.csv", ["1, x ,NA", "2,,3.5", "3,null,n/a"]), ("b.csv", ["9,y,7"])):
        (path / name).write_text("TransactionID,nameOrig,amount\n" + "\n".join(rows) + "\n")
    df = files.read_raw_csv(spark, str(path / "a.csv"), positions=True)
    assert [f.dataType.simpleString() for f in df.schema.fields][:3] == ["string"] * 3
    frames = {n: files.read_raw_csv(spark, str(path / n), positions=True) for n in ("a.csv", "b.csv")}
    got = cleaning.trim_all(cleaning.union_sources(frames, files.FILE_POSITION)).orderBy("source_file", "source_row_number").collect()
    assert [(r.source_file, r.source_row_number, r.transaction_id, r.name_orig, r.amount) for r in got] == [
        ("a.csv", 1, "1", "x", None), ("a.csv", 2, "2", None, "3.5"), ("a.csv", 3, "3", None, None), ("b.csv", 1, "9", "y", "7")
    ]
    assert files.read_scoring_dataset(spark, str(path / "b.csv")).first()["amount"] == 7
    assert files.resolve_pair(["/x/train_identity.csv", "/x/train_transaction.csv"]) == ("/x/train_transaction.csv", "/x/train_identity.csv")
    assert files.resolve_pair(["/x/a.csv"]) is None
    assert [p.rsplit("/", 1)[1] for p in files.list_files(spark, str(path))] == ["a.csv", "b.csv"]


def test_formats(spark, folder):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    files.write_table(df, f"{folder}/t.parquet")
    assert files.read_scoring_dataset(spark, f"{folder}/t.parquet").first()["t"] == "a"
    files.write_jsonl(df, f"{folder}/j")
    assert files.read_jsonl(spark, f"{folder}/j", "k int, t string").collect() == df.collect()
    files.write_report(spark.createDataFrame([(2, None, 1)], "b int, c string, a int"), f"{folder}/r")
    text = "".join(p.read_text() for p in pathlib.Path(folder, "r").glob("part-*.json"))
    assert list(json.loads(text)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        files.read_scoring_dataset(spark, f"{folder}/x.txt")
    with pytest.raises(ValueError):
        files.predictions_from(df)


def test_checksums(spark, folder):
    for name, data in (("a", b"abc"), ("b", b"abc"), (".hidden", b"x"), ("c", b"c")):
        pathlib.Path(folder, name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in files.file_checksums(spark, folder).collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in (("a", b"abc"), ("b", b"abc"), ("c", b"c"))}
    big = spark.createDataFrame([(f"file://{folder}/a", 3)], "path string, size_bytes bigint")
    chunked = big.mapInPandas(files._hash_in_chunks, "path string, size_bytes bigint, sha256 string").first()
    assert chunked.sha256 == hashlib.sha256(b"abc").hexdigest()
    twice = files.duplicate_content(files.file_checksums(spark, folder)).first()
    assert twice.n == 2 and twice.first_path.endswith("/a") and twice.last_path.endswith("/b")


def test_insert_and_audit(spark, folder):
    batch = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 1, "r"), ("z", 1, "s")], "transaction_id string, n int, t string")
    target = spark.createDataFrame([("y", 0, "old")], batch.schema)
    got = sinks.insert_if_absent(batch, target, "transaction_id", ["n"]).orderBy("transaction_id").collect()
    assert [(r.transaction_id, r.n, r.t) for r in got] == [("x", 1, "p"), ("z", 1, "s")]
    events = spark.createDataFrame([("a", "2024-03-05 23:59:59"), ("b", "2024-12-31 00:00:00")], "id string, at string").select("id", F.col("at").cast("timestamp").alias("processed_at"))
    sinks.audit_sink(events, f"{folder}/audit")
    assert sorted(p.relative_to(f"{folder}/audit").as_posix() for p in pathlib.Path(folder, "audit").glob("year=*/month=*/day=*")) == ["year=2024/month=03/day=05", "year=2024/month=12/day=31"]


def test_stages_can_be_cleared(spark):
    before = len(session._STAGES)
    kept = session.stage(spark.range(3), "kept")
    with session.staged(spark.range(5), "short") as short:
        assert short.count() == 5 and kept.count() == 3
    path = session._STAGES[-1]
    assert pathlib.Path(path.removeprefix("file:")).exists()
    session.clear_stages(spark, before)
    assert not pathlib.Path(path.removeprefix("file:")).exists()


def test_online_stream_is_replayable(spark):
    base = online_queries.run_stream(spark, SF)
    table = spark.read.schema(online.DECISION_SCHEMA).parquet(f"{base}/decisions")
    n = table.count()
    assert n == table.select("transaction_id").distinct().count() > 700
    audit = spark.read.json(f"{base}/audit")
    assert audit.count() == n and {"year", "month", "day", "country_is_new", "metadata_labels"} <= set(audit.columns)
    # The same events again, as a new query: every id is already there.
    stream = spark.readStream.schema(online.EVENT_SCHEMA).parquet(f"{base}/in")
    online.process_stream(stream, online_queries.SPEC, f"{base}/decisions", f"{base}/audit2", f"{base}/checkpoint2").awaitTermination()
    assert spark.read.schema(online.DECISION_SCHEMA).parquet(f"{base}/decisions").count() == n
    dead = online.dead_letters(spark.read.schema(online.EVENT_SCHEMA).parquet(f"{base}/in"))
    assert dead.count() == spark.read.parquet(f"{base}/in").count() - n


def test_checksums_list_empty_files(spark, folder):
    pathlib.Path(folder, "deep").mkdir()
    pathlib.Path(folder, "deep", "none").write_bytes(b"")
    pathlib.Path(folder, "one").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in files.file_checksums(spark, folder).collect()}
    assert got == {"none": (0, hashlib.sha256().hexdigest()), "one": (1, hashlib.sha256(b"1").hexdigest())}


def test_checksums_list_all_names(spark, folder):
    for name in ("_a", "b", ".c", "_under/x y", "deep/er/50% ü", ".hidden/d"):
        pathlib.Path(folder, name).parent.mkdir(parents=True, exist_ok=True)
        pathlib.Path(folder, name).write_bytes(b"1" * len(name))
    pathlib.Path(folder, "e").write_bytes(b"")
    pathlib.Path(folder, "none").mkdir()
    got = {r.path.split(folder + "/", 1)[1]: (r.size_bytes, r.sha256) for r in files.file_checksums(spark, folder).collect()}
    names = ("_a", "b", "_under/x y", "deep/er/50% ü", ".hidden/d")
    assert got == {n: (len(n), hashlib.sha256(b"1" * len(n)).hexdigest()) for n in names} | {"e": (0, hashlib.sha256().hexdigest())}


def test_line_breaks_in_quoted_fields(spark, folder):
    pathlib.Path(folder, "a.csv").write_text('transaction_id,note\n1,"two\nlines, ""quoted"""\n2,x\n')
    got = files.read_raw_csv(spark, f"{folder}/a.csv", line_breaks=True).collect()
    assert [tuple(r) for r in got] == [("1", 'two\nlines, "quoted"'), ("2", "x")]
