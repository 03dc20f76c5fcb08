"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import stage


@dataclass(frozen=True)
class AnnConfig:
    #: Tables of buckets, projections of each, and width of a cell; vectors are hashed at length 1.
    tables: int = 3
    hashes: int = 6
    width: float = 2.0
    #: Buckets that a query visits in each table, in the order of their estimated success.
    probes: int = 128
    k: int = 5
    seed: int = 17
    #: Bounds of a block of vectors and of a block of queries that meet in one step.
    block_rows: int = 1024
    block_queries: int = 1024


def usable(vector: Column) -> Column:
    """Vectors that take part: finite in every component, and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _cells(unit: np.ndarray, config: AnnConfig) -> np.ndarray:
    """Where each vector lies on each projection of each table, in cells."""
    rng = np.random.default_rng((config.seed, unit.shape[1]))
    lines = rng.standard_normal((unit.shape[1], config.tables * config.hashes))
    return ((unit @ lines) / config.width + rng.random(config.tables * config.hashes)).reshape(len(unit), config.tables, config.hashes)


def _bucket(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of a table; two buckets that share it only add candidates."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        out = out * np.uint64(1_000_003) + cells[..., j].astype(np.int64).view(np.uint64)
    return (out >> np.uint64(1)).astype(np.int64)


def _probes(place: np.ndarray, config: AnnConfig) -> np.ndarray:
    """Buckets to visit for places of shape (rows, hashes): the own one and perturbed ones.

    A step over the border of a cell costs the squared distance to it, and a set of steps their sum: the smaller it is, the
    likelier a near vector lies there.
    """
    base = np.floor(place)
    down = place - base
    steps = np.array(sorted(itertools.product((0, -1, 1), repeat=config.hashes), key=lambda s: sum(map(abs, s))))
    cost = (down**2) @ (steps == -1).T.astype(float) + ((1 - down) ** 2) @ (steps == 1).T.astype(float)
    order = np.argsort(cost, axis=1, kind="stable")[:, : config.probes]
    return _bucket(base[:, None, :] + steps[order])


def _hashed(config: AnnConfig, probing: bool):
    """Rows (dim, table, bucket, rid) of vectors, one for each table; of queries, one for each bucket to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, size = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for some in np.array_split(at, -(-len(at) // 256)):
                    vectors = batch.column(1).take(pa.array(some))
                    x = _matrix(vectors)
                    place = _cells(x / np.linalg.norm(x, axis=1)[:, None], config)
                    for t in range(config.tables):
                        code = _probes(place[:, t], config) if probing else _bucket(np.floor(place[:, t]))[:, None]
                        n = code.shape[1]
                        rows = np.repeat(np.arange(len(some)), n)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(code.ravel()), pa.array(rid[some][rows]), batch.column(2).take(pa.array(some[rows])), vectors.take(pa.array(rows))],
                            ["dim", "t", "bucket", "rid", "vec_id", "v"],
                        )

    return run


# --- exact distances in blocks -------------------------------------------------------------------------


def _nearest(q: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(query rid, candidate rid, candidate id, cosine) of the k nearest of a block, ties to the smaller id."""
    (qid, qx), (rid, vid, vx) = q, v
    # Of equal vectors no query needs more than k, and one more where a query is one of them.
    _, same = np.unique(vx, axis=0, return_inverse=True)
    order = np.lexsort((rid, vid, same))
    run = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    keep = np.sort(order[run <= k])
    rid, vid, vx = rid[keep], vid[keep], vx[keep]
    qn, vn = np.sqrt((qx * qx).sum(1)), np.sqrt((vx * vx).sum(1))
    rough = (qx / qn[:, None]) @ (vx / vn[:, None]).T
    rough[qid[:, None] == rid[None, :]] = -np.inf
    last = min(k, rough.shape[1]) - 1
    bar = -np.partition(-rough, last, axis=1)[:, last]
    i, j = np.nonzero((rough >= np.where(np.isfinite(bar), bar, -2.0)[:, None] - 1e-9) & np.isfinite(rough))
    # The product of matrices may round equal vectors differently; the measure itself does not.
    score = (qx[i] * vx[j]).sum(1) / (qn[i] * vn[j])
    return _best(qid[i], rid[j], vid[j], score, k)


def _best(qid: np.ndarray, rid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((rid, vid, -score, qid))
    qid, rid, vid, score = qid[order], rid[order], vid[order], score[order]
    new = np.ones(len(qid), bool)
    new[1:] = (qid[1:] != qid[:-1]) | (rid[1:] != rid[:-1])
    qid, rid, vid, score = qid[new], rid[new], vid[new], score[new]
    top = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[top], rid[top], vid[top], score[top]


def _meet(k: int):
    """Blocks come sorted, queries before vectors; one block is held at a time, and the best so far of the partition's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                best = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["q", "rid", "vec_id", "score"])
                found.clear()

        for part in _groups(batches):
            query = part.column("is_query").to_numpy(zero_copy_only=False)
            if not query.any() or query.all():
                continue
            rid, vid = part.column("rid").to_numpy(), part.column("vec_id").to_numpy()
            x = _matrix(part.column("v").combine_chunks())
            got = _nearest((rid[query], x[query]), (rid[~query], vid[~query], x[~query]), k)
            found.append(got)
            size += len(got[0])
            if size > 500_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "t", "bucket", "vs", "qs")])
        cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]))
        for a, b in itertools.pairwise(cut.tolist()):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _search(vectors: DataFrame, queries: DataFrame, config: AnnConfig) -> DataFrame:
    """Hashed vectors and queries -> (q, rid, vec_id, score), for each query the best of each partition it met.

    A bucket is cut into blocks of bounded rows by its counts, so no bucket is one task's, however many rows or queries share it.
    """
    key = ["dim", "t", "bucket"]
    sizes = vectors.groupBy(*key).agg(F.ceil(F.count("*") / config.block_rows).cast("int").alias("nv"))
    asked = queries.groupBy(*key).agg(F.ceil(F.count("*") / config.block_queries).cast("int").alias("nq"))
    # Buckets with rows and queries; others have nothing to compare.
    both = sizes.join(asked, key)

    def spread(rows: DataFrame, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        rows = rows.join(both, key)
        return rows.withColumn(own, F.pmod(F.xxhash64("rid"), own_n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    v = spread(vectors, "vs", "qs", "nv", "nq").withColumn("is_query", F.lit(False))
    q = spread(queries, "qs", "vs", "nq", "nv").withColumn("is_query", F.lit(True))
    columns = [*key, "vs", "qs", "is_query", "rid", "vec_id", "v"]
    block = [*key, "vs", "qs"]
    rows = v.select(*columns).union(q.select(*columns)).repartition(*block).sortWithinPartitions(*block)
    return rows.mapInArrow(_meet(config.k), "q long, rid long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, id_: str = "vec_id", vector: str = "embedding", config: AnnConfig | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows by cosine that each query row finds, ties to the smaller id.

    Rows are told apart by their place, so a repeated row may find its twin but never itself. Vectors that are null, empty,
    zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors of different lengths are not
    compared. A query whose buckets hold fewer than k rows is compared with all rows in blocks, so it has k unless there are
    fewer. Empty tables give an empty result; other columns are ignored.
    """
    config = config or AnnConfig()
    kept = vectors.where(usable(F.col(vector)) & F.col(id_).isNotNull())
    rows = stage(kept.select(F.monotonically_increasing_id().alias("rid"), F.col(vector).alias("v"), F.col(id_).cast("long").alias("vec_id"), is_query.alias("asks")), "ann-rows")
    kind = f"dim int, t int, bucket long, rid long, vec_id long, v {rows.schema['v'].dataType.simpleString()}"
    asks = rows.where("asks").select("rid", "v", "vec_id")
    index = rows.select("rid", "v", "vec_id").mapInArrow(_hashed(config, probing=False), kind)
    found = _top(_search(index, asks.mapInArrow(_hashed(config, probing=True), kind), config), config.k)
    found = stage(found, "ann-found")
    # Queries with too few finds, of which any table of some size has none.
    short = asks.join(found.where(F.col("rank") == config.k).select(F.col("q").alias("rid")), "rid", "left_anti")
    short = stage(short.select(F.size("v").alias("dim"), F.lit(-1).alias("t"), F.lit(0).cast("long").alias("bucket"), "rid", "vec_id", "v"), "ann-short")
    if not short.isEmpty():
        every = rows.select(F.size("v").alias("dim"), F.lit(-1).alias("t"), F.lit(0).cast("long").alias("bucket"), "rid", "vec_id", "v")
        rest = _top(_search(every, short, config), config.k)
        found = found.join(short.select(F.col("rid").alias("q")), "q", "left_anti").unionByName(rest)
    names = asks.select(F.col("rid").alias("q"), F.col("vec_id").alias("query_id"))
    return found.join(names, "q").select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's finds; a query has k of each partition at most."""
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "rid")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
