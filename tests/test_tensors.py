"""The data source of sequence data sets."""

import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.sources import tensors


def rows(spark, n, start=0, parts=3):
    made = spark.range(start, start + n, 1, parts)
    return made.select(
        F.concat(F.lit("t"), "id").alias("current_transaction_id"), F.timestamp_seconds(F.col("id")).alias("at"),
        F.array(*[F.array(*[(F.col("id") * 6 + 2 * i + j).cast("float") for j in range(2)]) for i in range(3)]).alias("x_seq"),
        F.when(F.col("id") % 5 != 0, F.struct(F.col("id").cast("float").alias("amount"), F.lit(None).cast("float").alias("step"))).alias("x_current"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2).cast("int")).alias("y"),
    )


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("piece, task", [(65_536, 65_536), (1_000, 300), (9_000, 8_500)])
def test_rows_come_back_whatever_the_pieces_and_tasks(spark, folder, piece, task):
    df = rows(spark, 20_000)
    tensors.write_sequences(df, f"{folder}/s", rows_per_piece=piece)
    back = tensors.read_sequences(spark, f"{folder}/s", rows_per_task=task)
    assert [f.simpleString() for f in back.schema] == [f.simpleString() for f in df.schema]
    assert back.count() == 20_000 and back.exceptAll(df).isEmpty()


def test_pieces_are_plain_files_in_step(spark, folder):
    tensors.write_sequences(rows(spark, 50, parts=1), f"{folder}/s", rows_per_piece=20)
    found = sorted(pathlib.Path(folder, "s").glob("*.npy"))
    x = [np.load(f) for f in found]
    assert [a.shape for a in x] == [(20, 3, 2), (20, 3, 2), (10, 3, 2)] and x[0].dtype == np.float32
    assert np.concatenate(x).ravel().tolist() == list(range(300))
    meta = spark.read.parquet(*[str(f).replace("x_seq.npy", "meta.parquet") for f in found])
    assert meta.columns == ["current_transaction_id", "at"] and meta.count() == 50


def test_ranges_of_rows_are_cut_from_the_manifest(spark, folder):
    tensors.write_sequences(rows(spark, 100, parts=4), f"{folder}/s", rows_per_piece=11)
    everything = [r.current_transaction_id for r in tensors.read_sequences(spark, f"{folder}/s").collect()]
    for first, last in ((0, 7), (20, 70), (95, None), (100, None), (30, 30)):
        got = [r.current_transaction_id for r in tensors.read_sequences(spark, f"{folder}/s", first, last, rows_per_task=4).collect()]
        assert got == everything[first:last]


def test_append_and_overwrite_leave_one_data_set(spark, folder):
    path = f"{folder}/s"
    tensors.write_sequences(rows(spark, 30), path)
    tensors.write_sequences(rows(spark, 10, 30), path, "append")
    assert same(tensors.read_sequences(spark, path), rows(spark, 40))
    tensors.write_sequences(rows(spark, 5, 90), path)
    assert same(tensors.read_sequences(spark, path), rows(spark, 5, 90))
    named = {p[0] for p in json.loads(pathlib.Path(path, "manifest.json").read_text())["parts"]}
    assert {f.name.split("-")[0] for f in pathlib.Path(path).glob("*-*")} == named
    with pytest.raises(Exception, match="another schema or shape"):
        tensors.write_sequences(rows(spark, 3).withColumn("x_seq", F.slice("x_seq", 1, 2)), path, "append")
    assert same(tensors.read_sequences(spark, path), rows(spark, 5, 90))


def test_leftovers_of_lost_tasks_are_not_read(spark, folder):
    path = f"{folder}/s"
    tensors.write_sequences(rows(spark, 6), path)
    lost = tensors.SequenceWriter(f"file:{path}", rows(spark, 0).schema, False, 4)
    lost.write(iter(rows(spark, 9, 50).drop("x_current").toArrow().to_batches()))  # never committed
    assert tensors.read_sequences(spark, path).count() == 6


def test_a_failed_write_keeps_the_former_rows(spark, folder):
    path = f"{folder}/s"
    tensors.write_sequences(rows(spark, 6), path)
    odd = rows(spark, 9).withColumn("x_seq", F.when(F.col("y") == 1, F.slice("x_seq", 1, 2)).otherwise(F.col("x_seq")))
    for bad in (odd, rows(spark, 9).withColumn("x_seq", F.when(F.col("y") == 1, F.col("x_seq")))):
        with pytest.raises(Exception, match="must have"):
            tensors.write_sequences(bad, path)
    assert same(tensors.read_sequences(spark, path), rows(spark, 6))


def test_empty_tables_and_tables_of_few_columns(spark, folder):
    tensors.write_sequences(rows(spark, 0), f"{folder}/a")
    back = tensors.read_sequences(spark, f"{folder}/a")
    assert back.count() == 0 and back.columns == rows(spark, 0).columns
    few = spark.createDataFrame([([[1.0, 2.0]],), ([[3.0, 4.0]],)], "x_seq array<array<float>>")
    tensors.write_sequences(few, f"{folder}/b")
    assert same(tensors.read_sequences(spark, f"{folder}/b"), few)
    flat = spark.createDataFrame([("t", [])], "id string, x_seq array<array<float>>")
    tensors.write_sequences(flat, f"{folder}/c")
    assert same(tensors.read_sequences(spark, f"{folder}/c"), flat)
    with pytest.raises(Exception, match="no sequence data set"):
        tensors.read_sequences(spark, f"{folder}/none")
