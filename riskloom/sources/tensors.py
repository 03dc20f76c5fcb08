"""A data source for sequence data sets: tensors as ``npy`` pieces, the other columns beside them in Parquet.

A task writes pieces of at most ``rowsPerPiece`` rows. A piece is four files in step, row by row: ``x_seq.npy`` (float32, rows x length x
features), ``x_current.parquet``, ``y.parquet`` and ``meta.parquet``. A piece counts once the manifest names it; the manifest is put in place
by one rename at the commit, so a lost or repeated task leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from riskloom.sources.places import place, qualified

FORMAT = "riskloom_sequences"
MANIFEST = "manifest.json"
TENSOR = "x_seq"
#: Side tables with their columns; meta has all others.
SIDES = {"x_current": ("x_current",), "y": ("y",), "meta": ()}
ROWS_PER_PIECE, ROWS_PER_GROUP = 65_536, 8_192


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    """What a task has written: all its pieces but the last have the same number of rows."""

    name: str
    rows: int
    shape: tuple[int, int] | None


@dataclass(frozen=True)
class Piece(InputPartition):
    """Rows ``start`` to ``stop`` of a piece."""

    name: str
    start: int
    stop: int


def _side_columns(names: Sequence[str]) -> dict[str, list[str]]:
    taken = {TENSOR, *(c for columns in SIDES.values() for c in columns)}
    return {side: [c for c in names if c in columns or (side == "meta" and c not in taken)] for side, columns in SIDES.items()}


def _loose_json(schema):
    """A schema as JSON in which everything may be null, as Spark's own file formats keep it."""
    if isinstance(schema, list):
        return [_loose_json(s) for s in schema]
    if isinstance(schema, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else v if k == "metadata" else _loose_json(v) for k, v in schema.items()}
    return schema


def _loose(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(_loose(kind.key_type), _loose(kind.item_type))
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _loose(kind.value_type)))
    return kind


def _tensor(column: pa.ListArray) -> np.ndarray:
    """Rows x length x features; every row must have the same of both, and no nulls at any depth."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    steps = column.flatten()
    values = steps.flatten()
    if column.null_count or steps.null_count or values.null_count:
        raise ValueError(f"{TENSOR} must have no nulls")
    lengths, widths = np.unique(column.value_lengths()), np.unique(steps.value_lengths())
    if len(lengths) > 1 or len(widths) > 1:
        raise ValueError(f"{TENSOR} must have one shape, found lengths {lengths.tolist()} and widths {widths.tolist()}")
    length, width = (int(a[0]) if len(a) else 0 for a in (lengths, widths))
    return values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), length, width)


def _lists(tensor: np.ndarray) -> pa.ListArray:
    n, length, width = tensor.shape
    steps = pa.ListArray.from_arrays(pa.array(np.arange(n * length + 1, dtype=np.int32) * width), pa.array(tensor.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), steps)


class SequenceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, rows_per_piece: int):
        self.path, self.schema, self.overwrite, self.rows_per_piece = path, schema, overwrite, rows_per_piece

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows, held, pieces = uuid.uuid4().hex, 0, [], 0
        shape = None
        for batch in iterator:
            while batch.num_rows:
                some = batch.slice(0, self.rows_per_piece - sum(b.num_rows for b in held))
                batch = batch.slice(some.num_rows)
                held.append(some)
                rows += some.num_rows
                if rows == (pieces + 1) * self.rows_per_piece:
                    shape = self._piece(name, pieces, held, shape)
                    held, pieces = [], pieces + 1
        if held:
            shape = self._piece(name, pieces, held, shape)
        return Written(name, rows, shape)

    def _piece(self, name: str, number: int, batches: list[pa.RecordBatch], shape: tuple[int, int] | None) -> tuple[int, int]:
        table = pa.Table.from_batches(batches)
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        tensor = _tensor(table.column(TENSOR))
        if shape is not None and tensor.shape[1:] != shape:
            raise ValueError(f"{TENSOR} must have one shape, found {shape} and {tensor.shape[1:]}")
        with system.open_output_stream(f"{folder}/{name}-{number:06d}.{TENSOR}.npy") as out:
            np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(tensor))
            out.write(memoryview(np.ascontiguousarray(tensor)).cast("B") if tensor.size else b"")
        table = table.drop_columns(TENSOR)
        # A null struct has null fields, also where its fields are declared without nulls.
        table = table.cast(pa.schema([pa.field(f.name, _loose(f.type)) for f in table.schema]))
        for side, columns in _side_columns(table.column_names).items():
            if columns:
                pq.write_table(table.select(columns), f"{folder}/{name}-{number:06d}.{side}.parquet", row_group_size=ROWS_PER_GROUP, filesystem=system)
        return tensor.shape[1:]

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None and m.rows]
        old = None if self.overwrite else read_manifest(self.path)
        parts = [*(old["parts"] if old else []), *([m.name, m.rows, self.rows_per_piece] for m in done)]
        shapes = {tuple(m.shape) for m in done} | ({tuple(old["shape"])} if old and old["shape"] else set())
        schema = _loose_json(json.loads(self.schema.json()))
        if len(shapes) > 1 or (old and old["schema"] != schema):
            self.abort(messages)
            raise ValueError(f"{self.path}: rows of another schema or shape cannot stand in one data set: {sorted(shapes)}")
        content = {"schema": schema, "shape": list(shapes.pop()) if shapes else None, "parts": parts}
        before = {p[0] for p in (read_manifest(self.path) or {"parts": []})["parts"]}
        fresh = f"{folder}/.{uuid.uuid4().hex}.json"
        with system.open_output_stream(fresh) as out:
            out.write(json.dumps(content).encode())
        system.move(fresh, f"{folder}/{MANIFEST}")
        # Only what the former manifest named is deleted, and only now that no manifest names it.
        self._delete(before - {p[0] for p in parts})

    def abort(self, messages: list[Written | None]) -> None:
        self._delete({m.name for m in messages if m is not None})

    def _delete(self, names: set[str]) -> None:
        from pyarrow import fs

        system, folder = place(self.path)
        if names:
            for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if file.base_name.split("-", 1)[0] in names:
                    system.delete_file(file.path)


class SequenceReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, first: int, last: int | None, rows_per_task: int):
        self.path, self.schema, self.first, self.last, self.rows_per_task = path, schema, first, last, rows_per_task

    def partitions(self) -> list[Piece]:
        """Ranges of rows of the pieces, in the order of the manifest; of rows ``first`` to ``last`` of the data set only."""
        out, at = [], 0
        for name, rows, size in read_manifest(self.path)["parts"]:
            for number, lo in enumerate(range(0, rows, size)):
                n = min(size, rows - lo)
                begin, end = max(self.first - at, 0), n if self.last is None else min(self.last - at, n)
                out += [Piece(f"{name}-{number:06d}", a, min(a + self.rows_per_task, end)) for a in range(begin, end, self.rows_per_task)]
                at += n
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        system, folder = place(self.path)
        stem = f"{folder}/{partition.name}"
        sides = {side: (columns, pq.ParquetFile(f"{stem}.{side}.parquet", filesystem=system)) for side, columns in _side_columns(self.schema.names).items() if columns}
        with system.open_input_file(f"{stem}.{TENSOR}.npy") as file:
            np.lib.format.read_magic(file)
            (_, length, width), _, kind = np.lib.format.read_array_header_1_0(file)
            begin, row = file.tell(), length * width * kind.itemsize
            for group in range(partition.start // ROWS_PER_GROUP, -(-partition.stop // ROWS_PER_GROUP)):
                base = group * ROWS_PER_GROUP
                lo, hi = max(partition.start, base), min(partition.stop, base + ROWS_PER_GROUP)
                file.seek(begin + lo * row)
                tensor = np.frombuffer(file.read((hi - lo) * row), kind).reshape(hi - lo, length, width)
                found = {TENSOR: _lists(tensor)}
                for columns, side in sides.values():
                    table = side.read_row_group(group, columns=columns).slice(lo - base, hi - lo)
                    found |= {c: table.column(c).combine_chunks() for c in columns}
                yield pa.RecordBatch.from_arrays([found[c] for c in self.schema.names], self.schema.names)


def read_manifest(path: str) -> dict | None:
    from pyarrow import fs

    system, folder = place(path)
    if system.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


class SequenceSource(DataSource):
    """Options: ``rowsPerPiece`` when writing; ``firstRow``, ``lastRow`` (exclusive) and ``rowsPerTask`` when reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        manifest = read_manifest(self.options["path"])
        if manifest is None:
            raise ValueError(f"{self.options['path']} has no sequence data set")
        return T.StructType.fromJson(manifest["schema"])

    def reader(self, schema: T.StructType) -> SequenceReader:
        o = self.options
        last = o.get("lastRow")
        return SequenceReader(o["path"], schema, int(o.get("firstRow", 0)), None if last is None else int(last), int(o.get("rowsPerTask", ROWS_PER_PIECE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> SequenceWriter:
        return SequenceWriter(self.options["path"], schema, overwrite, int(self.options.get("rowsPerPiece", ROWS_PER_PIECE)))


def write_sequences(df: DataFrame, path: str, mode: str = "overwrite", rows_per_piece: int = ROWS_PER_PIECE) -> None:
    """Write a table with a column ``x_seq`` (array of arrays, one shape, no nulls); ``mode`` is overwrite or append.

    Other columns may be missing or null. An empty table gives an empty data set with its schema.
    """
    df.sparkSession.dataSource.register(SequenceSource)
    df.write.format(FORMAT).mode(mode).option("rowsPerPiece", rows_per_piece).save(qualified(df.sparkSession, path))


def read_sequences(spark: SparkSession, path: str, first: int = 0, last: int | None = None, rows_per_task: int = ROWS_PER_PIECE) -> DataFrame:
    """The rows of a sequence data set, or those from place ``first`` to before ``last`` in the order of its manifest."""
    spark.dataSource.register(SequenceSource)
    reader = spark.read.format(FORMAT).option("firstRow", first).option("rowsPerTask", rows_per_task)
    return (reader if last is None else reader.option("lastRow", last)).load(qualified(spark, path))
