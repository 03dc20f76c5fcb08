"""Hard negatives by exact inner products: length buckets with sorted coordinate lists prune what is verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_ordinal
from riskloom.session import stage


@dataclass(frozen=True)
class NegativesConfig:
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these percentages of the positive's.
    low: int = 30
    high: int = 90
    #: Rows of a length bucket, and anchors that meet a bucket in one step (twice as many at most, but for chance).
    bucket_rows: int = 1024
    block_anchors: int = 256
    #: Runs of buckets that one task keeps the best of; more rows make longer runs.
    runs: int = 4096
    #: Coordinates of an anchor whose feasible ranges are intersected.
    focus: int = 4


LIMIT = (1 << 63) - 1
_INDEX = "dim int, bucket long, ids binary, rids binary, labels binary, x binary, lengths binary, lists binary"
_BLOCK = "dim int, block long, ids binary, rids binary, labels binary, x binary, bars binary"


# --- index ---------------------------------------------------------------------------------------------


def _packed(member: pa.Array, dim: int) -> tuple[list[bytes], np.ndarray]:
    """Ids, places and labels of the members as bytes, and their vectors."""
    flat = [member.field(n).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for n in ("vec_id", "rid", "label")]
    x = member.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(member), dim)
    return flat, x


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where they fit."""
    return (x.astype(np.float32) if np.abs(x).max(initial=0) <= 1 << 24 else x).tobytes()


def _numbers(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * dim else np.float64
    return np.frombuffer(data, kind).astype(float).reshape(rows, dim)


def _directions(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return x / np.where(lengths > 0, lengths, 1.0)[:, None]


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=0)
    scale = np.where(top > 0, top, 1.0)
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(1))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket -> its arrays, with the order of the rows along each coordinate of their directions."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            dim, bucket = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            flat, x = _packed(batch.column(2)[i].values, dim)
            lengths = _lengths(x)
            lists = np.argsort(_directions(x, lengths), axis=0, kind="stable").T.astype(np.int32)
            out.append((dim, bucket, *flat, _bytes(x), lengths.tobytes(), np.ascontiguousarray(lists).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], ["dim", "bucket", "ids", "rids", "labels", "x", "lengths", "lists"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a block -> its arrays, with the scores of their positives where they have come with them."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            dim, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            member = batch.column(2)[i].values
            flat, x = _packed(member, dim)
            bars = member.field("bars")
            sizes = bars.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out.append((dim, block, *flat, _bytes(x), np.concatenate((sizes, bars.flatten().to_numpy(zero_copy_only=False).astype(np.int64))).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], ["dim", "block", "ids", "rids", "labels", "x", "bars"])


# --- search --------------------------------------------------------------------------------------------


class _Bucket:
    def __init__(self, row: dict):
        self.ids, self.rids, self.labels = (np.frombuffer(row[n], np.int64) for n in ("v_ids", "v_rids", "v_labels"))
        self.dim, n = row["dim"], len(self.ids)
        self.x = _numbers(row["v_x"], n, self.dim)
        self.lengths = np.frombuffer(row["v_lengths"])
        self.lists = np.frombuffer(row["v_lists"], np.int32).reshape(self.dim, n)
        self.longest = self.lengths.max()
        self.top = np.abs(self.x).max(initial=0)
        self._sorted: dict[int, np.ndarray] = {}

    def along(self, coordinate: int) -> np.ndarray:
        """A coordinate of the directions, ascending."""
        if coordinate not in self._sorted:
            at = self.lists[coordinate]
            self._sorted[coordinate] = self.x[at, coordinate] / np.where(self.lengths[at] > 0, self.lengths[at], 1.0)
        return self._sorted[coordinate]

    def candidates(self, q: np.ndarray, length: float, least: float, focus: int) -> np.ndarray | None:
        """Rows whose inner product with ``q`` can reach ``least``; None where that may be any row.

        A row's cosine must reach ``least`` over both lengths. Given one coordinate of the anchor's direction, that leaves a range
        for the row's: the product of the coordinates plus that of the two rests, which is at most the product of their lengths.
        """
        if least <= 0 or length <= 0:
            return None
        cosine = least / (length * self.longest) - 1e-9 if self.longest > 0 else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= 0:
            return None
        unit = q / length
        met = None
        for f in np.argsort(-np.abs(unit))[:focus].tolist():
            mid, half = unit[f] * cosine, np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] ** 2)))
            # Beyond the anchor's own angle to the axis the range is open, up to the end of the axis.
            high = 1.0 if unit[f] >= cosine else mid + half
            low = -1.0 if -unit[f] >= cosine else mid - half
            at = self.along(f)
            a, b = np.searchsorted(at, low - 1e-9, "left"), np.searchsorted(at, high + 1e-9, "right")
            if b - a < len(at):
                rows = self.lists[f, a:b]
                if met is None:
                    met = np.zeros(len(at), bool)
                    met[rows] = True
                else:
                    also = np.zeros(len(at), bool)
                    also[rows] = True
                    met &= also
        return None if met is None else np.flatnonzero(met)

    def scores(self, q: np.ndarray, least: np.ndarray, focus: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact inner products of anchors with rows, and which have been taken: all that reach each anchor's ``least``."""
        out, taken = np.zeros((len(q), len(self.ids)), np.int64), np.zeros((len(q), len(self.ids)), bool)
        lengths, whole = _lengths(q), []
        for i in range(len(q)):
            rows = self.candidates(q[i], lengths[i], float(least[i]), focus)
            if rows is None or 4 * len(rows) > len(self.ids):
                whole.append(i)
            else:
                out[i, rows], taken[i, rows] = self._products(q[i : i + 1], rows)[0], True
        if whole:
            out[whole], taken[whole] = self._products(q[whole], slice(None)), True
        return out, taken

    def _products(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        x = self.x[rows]
        if float(np.abs(q).max(initial=0)) * self.top * self.dim < 1 << 53:
            return np.rint(q @ x.T).astype(np.int64)  # sums of whole numbers below 2**53 are exact
        exact = np.vectorize(int, otypes=[object])
        return np.clip(exact(q).dot(exact(x).T), -LIMIT, LIMIT).astype(np.int64)


class _Best:
    """The ``k`` best of an anchor: higher scores first, ties by smaller id."""

    def __init__(self, k: int, low: int = -LIMIT, high: int = LIMIT):
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        fit = (score >= self.low) & (score <= self.high)
        score, ids = score[fit], ids[fit]
        if not len(score):
            return
        if len(score) > self.k:
            good = score >= np.partition(score, -self.k)[-self.k]
            score, ids = score[good], ids[good]
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.low = max(self.low, int(self.score[-1]))


class _Anchors:
    def __init__(self, row: dict, config: NegativesConfig, same: bool):
        self.block = (row["dim"], row["run"], row["block"])
        self.ids, self.rids, self.labels = (np.frombuffer(row[n], np.int64) for n in ("ids", "rids", "labels"))
        self.x = _numbers(row["x"], len(self.ids), row["dim"])
        self.config, self.same = config, same
        if same:
            self.best = [[_Best(config.positives)] for _ in self.ids]
        else:
            bars = np.frombuffer(row["bars"], np.int64)
            sizes, flat = bars[: len(self.ids)], bars[len(self.ids) :].tolist()
            ends = np.cumsum(sizes).tolist()
            self.best = [[_Best(config.negatives, -(-config.low * p // 100), config.high * p // 100) for p in flat[e - n : e]] for e, n in zip(ends, sizes.tolist(), strict=True)]

    def meet(self, bucket: _Bucket) -> None:
        for label in np.unique(self.labels):
            mine = np.flatnonzero(self.labels == label)
            least = np.array([min((b.low for b in self.best[i] if b.low <= b.high), default=LIMIT) for i in mine])
            fit = (bucket.labels == label) == self.same
            if not fit.any():
                continue
            score, taken = bucket.scores(self.x[mine], least, self.config.focus)
            taken &= fit
            for i, s, t in zip(mine.tolist(), score, taken, strict=True):
                rows = np.flatnonzero(t & (bucket.rids != self.rids[i]))
                s, ids = s[rows], bucket.ids[rows]
                for best in self.best[i]:
                    if best.low <= best.high:
                        best.add(s, ids)

    def found(self) -> pa.RecordBatch:
        rows = [(int(self.rids[i]), j, b.id, b.score) for i, all_ in enumerate(self.best) for j, b in enumerate(all_) if len(b.id)]
        size = [len(r[2]) for r in rows]
        cols = [np.repeat(np.array([r[c] for r in rows], np.int64), size) for c in (0, 1)]
        cols += [np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rid", "place", "vec_id", "score"])


def _search(config: NegativesConfig, same: bool):
    """Blocks of anchors with one bucket after the other of a run; what a block has found so far raises its bars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = bucket = seen = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if anchors is None or anchors.block != (row["dim"], row["run"], row["block"]):
                    if anchors is not None:
                        yield anchors.found()
                    anchors = _Anchors(row, config, same)
                if seen != (row["dim"], row["bucket"]):
                    seen, bucket = (row["dim"], row["bucket"]), _Bucket(row)
                anchors.meet(bucket)
        if anchors is not None:
            yield anchors.found()

    return run


def _visit(anchors: DataFrame, index: DataFrame, runs: DataFrame, config: NegativesConfig, same: bool) -> DataFrame:
    """``anchors(dim, rid, vec_id, label, v, bars)`` in blocks against all buckets -> ``(rid, place, vec_id, score)``, the best of each run."""
    sizes = anchors.groupBy("dim").agg(F.ceil(F.count("*") / config.block_anchors).alias("blocks"))
    dealt = anchors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    member = F.struct("vec_id", "rid", "label", "v", "bars")
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(member).alias("members")).mapInArrow(_gather, _BLOCK)
    asked = stage(blocks, "negatives-blocks").join(runs, "dim")
    met = asked.hint("merge").join(index, ["dim", "run"])
    return stage(met.mapInArrow(_search(config, same), "rid long, place long, vec_id long, score long"), "negatives-found")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("rid", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- operator ------------------------------------------------------------------------------------------


def whole_vector(vector: Column) -> Column:
    """Vectors that take part: not null, and finite in every component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_: str = "vec_id", vector: str = "embedding", config: NegativesConfig | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for each anchor and each of its positives.

    A component x counts as floor(256 x); a score is the inner product of two such vectors, a whole number (held at the ends of a
    long beyond them), higher first, ties by smaller id. An anchor's positives are its first other rows of the same ``label``; a positive's
    negatives are the first rows of another label whose score lies within the percentages of the positive's. Rows with a null id,
    label or vector, or a null or non-finite component, take no part; vectors of different lengths never meet. Zero and empty vectors
    score 0. Rows are told apart by their place, so a repeated row may be its twin's positive, never its own, and repeated anchors
    each bring their rows. An anchor or positive without partners has no row. Other columns are ignored; empty tables give none.

    Rows are ordered by length and cut into buckets that are indexed by coordinate; every block of anchors meets every bucket. Nothing
    is left out but by a bound on the inner product, so the result is exact.
    """
    config = config or NegativesConfig()
    # floor() gives whole numbers as longs, which end before doubles do; beyond 2**53 each double is whole.
    v = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) < float(1 << 44), F.floor(256.0 * x.cast("double")).cast("double")).otherwise(256.0 * x.cast("double")))
    kept = rows.where(whole_vector(F.col(vector)) & F.col(id_).isNotNull() & label.isNotNull())
    kept = kept.select(F.monotonically_increasing_id().alias("rid"), F.col(id_).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    kept = stage(kept.withColumns({"dim": F.size("v"), "down": -length}), "negatives-rows")
    placed = global_ordinal(kept.drop("asks"), ["dim", "down", "vec_id", "rid"])
    bucket = F.floor((F.col("ordinal") - 1) / config.bucket_rows).alias("bucket")
    members = F.sort_array(F.collect_list(F.struct("vec_id", "rid", "label", "v"))).alias("members")
    built = stage(placed.groupBy("dim", bucket).agg(members).mapInArrow(_build, _INDEX), "negatives-index")
    buckets = built.agg(F.max("bucket")).first()[0] or 0
    run = F.floor(F.col("bucket") / (buckets // config.runs + 1)).alias("run")
    index = built.select("dim", run, "bucket", *[F.col(n).alias(f"v_{n}") for n in ("ids", "rids", "labels", "x", "lengths", "lists")])
    runs = built.select("dim", run).distinct()
    asks = kept.where("asks").select("dim", "rid", "vec_id", "label", "v")
    none = F.array().cast("array<bigint>").alias("bars")
    positives = _top(_visit(asks.withColumn("bars", none), index, runs, config, same=True), config.positives)
    positives = stage(positives.select("rid", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    bars = positives.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("bars"))
    negatives = _top(_visit(asks.join(bars, "rid").select("dim", "rid", "vec_id", "label", "v", "bars"), index, runs, config, same=False), config.negatives)
    negatives = negatives.select("rid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asks.select("rid", F.col("vec_id").alias("anchor_id"))
    joined = negatives.join(positives.withColumn("place", F.col("place").cast("long")), ["rid", "place"]).join(names, "rid")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(table: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id 100 divides; where 7 divides it, the label first becomes the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM kept a JOIN kept c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.arid = p.arid AND NOT s.same
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 10
"""
