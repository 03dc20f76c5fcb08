"""Token counts of documents in flat token files, found by scanning for the separator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import stage_root

#: Where the public tokenizer's vocabulary is by default; any other SentencePiece model can be given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class TokenConfig:
    model: str = DEFAULT_MODEL
    #: End-of-document id, written after each document. Its bytes must be ASCII (ids below 128, or with both bytes below 128).
    separator: int = 2
    dtype: str = "<u2"
    #: Bytes after which a writer begins the next file, at the end of a document.
    file_bytes: int = 64 << 20
    #: Identifiers of a block of the scan.
    block_ids: int = 1 << 20


# --- flat files ----------------------------------------------------------------------------------------


#: Stands for a null key in a key file.
NULL_KEY = -(1 << 63)


def _encoder(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _pack(config: TokenConfig, tail: int):
    """Documents -> chunks of file content (kind, file, bytes): identifiers, and in step with them the documents' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(config.model)
        stop = np.array([config.separator], config.dtype).tobytes()
        task, number, size = TaskContext.get().partitionId(), 0, 0

        def chunk(parts: list[bytes], keys: list[int | None]) -> pa.RecordBatch:
            # The writer ends each row with the separator's last bytes, so they are left out here.
            ids = b"".join(parts)
            marks = np.array([len(keys), *(NULL_KEY if k is None else k for k in keys)], "<i8").tobytes() + bytes(8 - tail)
            name = f"{task:06d}-{number:06d}"
            return pa.RecordBatch.from_arrays([pa.array(["ids", "keys"]), pa.array([name, name]), pa.array([ids[: len(ids) - tail], marks], pa.binary())], ["kind", "file", "content"])

        parts: list[bytes] = []
        keys: list[int | None] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [x or "" for x in some.column(1).to_pylist()]
                for key, ids in zip(some.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    codes = np.array(ids, config.dtype)
                    if (codes == config.separator).any():
                        raise ValueError("a text encodes to the separator; choose another")
                    parts += [codes.tobytes(), stop]
                    keys.append(key)
                    held += len(parts[-2]) + len(stop)
                    if held >= 1 << 20:
                        yield chunk(parts, keys)
                        size += held
                        parts, keys, held = [], [], 0
                        if size >= config.file_bytes:
                            number, size = number + 1, 0
        if keys:
            yield chunk(parts, keys)

    return run


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", config: TokenConfig | None = None) -> None:
    """Tokenise whole texts into flat files of identifiers, each document followed by the separator, without any index.

    ``path/kind=ids`` holds the identifiers and nothing else; ``path/kind=keys`` the keys of the documents in the same order,
    as 8-byte numbers. One task writes a file of each kind from the rows it reads; nothing is shuffled. The files are written by
    Spark's text writer, with the separator as its end of line, so they can be in any store and a task that runs again
    replaces its files. Null texts are empty documents; a null key is kept.
    """
    config = config or TokenConfig()
    stop = np.array([config.separator], config.dtype).tobytes()
    if max(stop) > 127 or min(stop) < 0:
        raise ValueError("the separator's bytes must be below 128")
    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_pack(config, len(stop)), "kind string, file string, content binary")
    # Spark's cast of binary to text keeps the bytes as they are, and the text writer writes them as they are.
    rows.withColumn("content", F.col("content").cast("string")).write.partitionBy("kind", "file").option("lineSep", stop.decode("ascii")).text(path)


# --- separator scan ------------------------------------------------------------------------------------


def _scan(config: TokenConfig):
    """Whole files -> one row for each block: how many identifiers, which documents end in it, and what stands open at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), config.dtype, len(content.as_buffer()) // np.dtype(config.dtype).itemsize)
                for block, at in enumerate(range(0, max(len(ids), 1), config.block_ids)):
                    part = ids[at : at + config.block_ids]
                    ends = np.flatnonzero(part == config.separator)
                    # From one separator to the next; the first reaches back to the block's start.
                    inside = np.diff(ends, prepend=-1) - 1
                    tail = len(part) - (int(ends[-1]) + 1 if len(ends) else 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([tail], pa.int64()), pa.array([inside.tolist()], pa.list_(pa.int64()))],
                        ["path", "block", "ends", "tail", "inside"],
                    )

    return run


def count_tokens(spark: SparkSession, path: str, config: TokenConfig | None = None, pattern: str = "*") -> DataFrame:
    """``(path, ordinal, n_tokens, terminated)`` of each document in the flat files under ``path``.

    Separators are searched in whole blocks; then a scan over the blocks of a file adds up how many documents ended before a
    block, and what identifiers the blocks before left open, which the block's first document begins with. What stands open at
    the end of a file is a last document without separator. Two separators in a row enclose an empty document; an empty file
    has none. Files may have up to the 2 GB that Spark reads as one cell.
    """
    config = config or TokenConfig()
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    blocks = files.mapInArrow(_scan(config), "path string, block long, ends long, tail long, inside array<long>")
    in_file = W.partitionBy("path").orderBy("block")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    # A block is a new run if the one before it has a separator: its open end is all that is carried on.
    run = F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before), F.lit(0))
    blocks = blocks.withColumn("run", run).withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # Tails of the same run come from the last block with a separator, which has the run before, and from those without.
    open_run = F.col("run") + F.when(F.col("ends") > 0, 1).otherwise(0)
    blocks = blocks.withColumn("open", open_run).withColumn("left", F.sum("tail").over(W.partitionBy("path", "open").orderBy("block")))
    blocks = blocks.withColumn("carried", F.coalesce(F.lag("left").over(in_file), F.lit(0))).withColumn("last", F.lead("block").over(in_file).isNull())
    documents = F.transform("inside", lambda n, i: F.struct((F.col("first") + i).alias("ordinal"), (n + F.when(i == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated")))
    rest = F.struct((F.col("first") + F.col("ends")).alias("ordinal"), F.col("left").alias("n_tokens"), F.lit(False).alias("terminated"))
    kind = "array<struct<ordinal:bigint,n_tokens:bigint,terminated:boolean>>"
    documents = F.concat(documents.cast(kind), F.when(F.col("last") & (F.col("left") > 0), F.array(rest)).otherwise(F.array()).cast(kind))
    return blocks.select("path", F.explode(documents).alias("d")).select("path", "d.ordinal", "d.n_tokens", "d.terminated")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = np.frombuffer(content.as_buffer(), "<i8", len(content.as_buffer()) // 8)
            parts, at = [], 0
            while at < len(words):
                parts.append(words[at + 1 : at + 1 + words[at]])
                at += 2 + int(words[at])
            keys = np.concatenate(parts) if parts else words
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.arange(len(keys))), pa.array(keys, mask=keys == NULL_KEY)], ["path", "ordinal", "key"])


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """``(path, ordinal, key)`` of the key files that were written beside the identifiers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_unpack, "path string, ordinal long, key long")


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", config: TokenConfig | None = None) -> DataFrame:
    """``(<key>, n_tokens)`` of each row of ``docs``: its texts as flat token files in the shared folder, scanned, and joined with the keys in step.

    Null and empty texts have 0 tokens. Repeated rows come as often as they are; an empty table gives an empty result.
    """
    config = config or TokenConfig()
    spark, path = docs.sparkSession, f"{stage_root(docs.sparkSession)}/token-files/{uuid.uuid4().hex}"
    write_token_files(docs, path, key, text, config)
    if not _exists(spark, f"{path}/kind=ids"):
        return spark.createDataFrame([], f"{key} long, n_tokens long")
    name = F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file")
    counts = count_tokens(spark, f"{path}/kind=ids", config).select(name, "ordinal", "n_tokens")
    keys = read_keys(spark, f"{path}/kind=keys").select(name, "ordinal", F.col("key").alias(key))
    return keys.join(counts, ["file", "ordinal"]).select(key, "n_tokens")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
