"""Readers and writers. All reads are lazy; uniqueness and column checks fail loudly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import NA_TOKENS, null_tokens
from riskloom.session import stage
from riskloom.sources.places import place, qualified

FILE_POSITION = ("_file", "_block", "_pos")


def read_raw_csv(
    spark: SparkSession, path: str | Sequence[str], na_tokens: Sequence[str] = NA_TOKENS, positions: bool = False, line_breaks: bool = False
) -> DataFrame:
    """CSV with every field as text; the missing-value tokens become NULL.

    With ``positions`` the columns of FILE_POSITION order the rows as they stand in their file.
    ``line_breaks`` allows them in quoted fields; each file is then read by one task, so it is off by default.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    raw = reader.option("multiLine", line_breaks).option("escape", '"' if line_breaks else "\\").csv(path)
    fields = [null_tokens(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns]
    if positions:
        fields += [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
        ]
    return raw.select(*fields)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of any number of text files, blank ones left out: ``line`` and the columns of FILE_POSITION, in one scan."""
    lines = spark.read.text(list(path) if not isinstance(path, str) else path)
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos")]
    return lines.select(F.col("value").alias("line"), *where).where(F.trim("line") != "")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_scoring_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported data set format: {path}")


def predictions_from(df: DataFrame, required: Sequence[str] = ("transaction_id", "is_fraud", "score")) -> DataFrame:
    """Check the required columns; id to text, label to int (NULL is 0), score to double."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"prediction table lacks {missing}")
    typed = {
        "transaction_id": F.col("transaction_id").cast("string"),
        "is_fraud": F.coalesce(F.col("is_fraud").try_cast("int"), F.lit(0)),
        "score": F.col("score").try_cast("double"),
    }
    return df.withColumns({c: e for c, e in typed.items() if c in df.columns})


def read_predictions(spark: SparkSession, path: str, required: Sequence[str] = ("transaction_id", "is_fraud", "score")) -> DataFrame:
    return predictions_from(spark.read.parquet(path), required)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with the keys in sorted order; reports hold a handful of rows."""
    report.select(*sorted(report.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


# --- checksums --------------------------------------------------------------------------

def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size_bytes, sha256`` of every file below ``folder`` but those whose name begins with a dot; empty files count.

    Spark's own file scan passes over names with an underscore and over empty files, so folders are listed here, those of one depth by the
    tasks of one job. Files are hashed in chunks where they lie, whatever their size.
    """
    level, files = spark.createDataFrame([(qualified(spark, folder),)], "path string"), None
    while True:
        entries = stage(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_entries, "path string, size_bytes bigint, is_folder boolean"), "entries")
        here = entries.where(~F.col("is_folder") & ~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path", "size_bytes")
        files = here if files is None else files.unionByName(here)
        level = entries.where("is_folder").select("path")
        if level.isEmpty():
            return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_hash_in_chunks, "path string, size_bytes bigint, sha256 string")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for path in batch["path"]:
            system, inner = place(path)
            found = system.get_file_info(fs.FileSelector(inner))
            rows = [(f"{path.rstrip('/')}/{i.base_name}", i.size if i.is_file else 0, i.type == fs.FileType.Directory) for i in found]
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "is_folder"])


def _hash_in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, inner = place(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def verify_checksums(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, status`` with status ok, missing, unexpected or mismatch."""
    e = expected.select("path", F.col("sha256").alias("_want"))
    a = actual.select("path", F.col("sha256").alias("_have"))
    status = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unexpected")
        .when(F.col("_want") != F.col("_have"), "mismatch")
        .otherwise("ok")
    )
    return e.join(a, "path", "full_outer").select("path", status.alias("status"))


def duplicate_content(checksums: DataFrame) -> DataFrame:
    """Contents that occur under several paths: count, first path, last path."""
    return (
        checksums.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .where(F.col("n") > 1)
    )


def resolve_pair(paths: Sequence[str], main: str = "train_transaction.csv", side: str = "train_identity.csv") -> tuple[str, str | None] | None:
    """Find the transaction file and its optional identity file among ``paths``."""
    by_name = {PurePosixPath(p).name: p for p in paths}
    return (by_name[main], by_name.get(side)) if main in by_name else None


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """File paths directly below ``folder``; only the listing is read, no content."""
    rows = spark.read.format("binaryFile").load(folder).select("path").orderBy("path").collect()
    return [r.path for r in rows]
