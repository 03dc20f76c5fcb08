"""Isotonic regression of any size: blocks are pooled inside ranges of the score, then across their borders.

Pooling adjacent violators gives the same blocks whether it starts from the points or from blocks that were pooled before, so
ranges pool on their own and only their borders remain. The fit stays a table of knots and is applied by an ordered merge.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.operators.ordering import global_ordinal
from riskloom.session import stage

#: Blocks of one range; a task pools that many at a time.
RANGE_BLOCKS = 65_536

_BLOCK = "g string, lo double, hi double, s double, w double"


@dataclass(frozen=True)
class KnotTable:
    """Knots ``(g, x, y)``, ascending in ``x`` and strictly so within a group ``g`` (empty without groups)."""

    table: DataFrame

    def of(self, group: str) -> KnotTable:
        return KnotTable(self.table.where(F.col("g") == group))


def _pooled(lo: list, hi: list, s: list, w: list) -> tuple[list, list, list, list]:
    """Blocks whose means strictly increase. Means are compared by products of whole sums, so equal ones are found exactly."""
    whole = all(float(x).is_integer() for x in s) and all(float(x).is_integer() for x in w)
    out: list[list] = []
    for a, b, y, n in zip(lo, hi, map(int, s) if whole else s, map(int, w) if whole else w, strict=True):
        while out and out[-1][2] * n >= y * out[-1][3]:
            last = out.pop()
            a, y, n = last[0], y + last[2], n + last[3]
        out.append([a, b, y, n])
    return tuple(map(list, zip(*out, strict=True)))


def _pool_range(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("lo")
    lo, hi, s, w = _pooled(*(frame[c].tolist() for c in ("lo", "hi", "s", "w")))
    return pd.DataFrame({"g": frame["g"].iloc[0], "lo": lo, "hi": hi, "s": pd.Series(s, dtype=float), "w": pd.Series(w, dtype=float), "chunk": frame["chunk"].iloc[0]})


def pool_blocks(points: DataFrame, range_blocks: int | None = None) -> DataFrame:
    """``points(g, lo, hi, s, w)`` (sums and weights of disjoint intervals) -> the blocks of the isotonic fit of each group.

    Each round numbers the blocks, pools runs of ``range_blocks`` of them and looks at the borders between runs. While a border
    violates the order, the next round's runs are shifted by half, so that border lies inside one; each round thus removes it. Rounds
    grow with the number of ranges that one block of the result spans, not with the table.
    """
    size = range_blocks or RANGE_BLOCKS
    now, shift = stage(points.select("g", "lo", "hi", "s", "w"), "isotonic"), 0
    while True:
        placed = global_ordinal(now, ["g", "lo"]).withColumn("chunk", F.floor((F.col("ordinal") - 1 + shift) / size))
        now = stage(placed.drop("ordinal").groupBy("g", "chunk").applyInPandas(_pool_range, _BLOCK + ", chunk long"), "isotonic")
        block = F.struct("s", "w")
        ends = now.groupBy("g", "chunk").agg(F.min_by(block, "lo").alias("first"), F.max_by(block, "lo").alias("last"))
        # One row per range and group.
        before = F.lag("last").over(W.partitionBy("g").orderBy("chunk"))
        borders = ends.withColumn("before", before).where(F.col("before.s") * F.col("first.w") >= F.col("first.s") * F.col("before.w"))
        if borders.isEmpty():
            return now.drop("chunk")
        shift = size // 2 - shift


def fit_knots(points: DataFrame, range_blocks: int | None = None) -> KnotTable:
    """Knots of ``points(g, x, s, w)``, one row per group and value: both ends of each block with its mean."""
    blocks = pool_blocks(points.select("g", F.col("x").alias("lo"), F.col("x").alias("hi"), "s", "w"), range_blocks)
    mean = F.col("s") / F.col("w")
    ends = F.array_distinct(F.array("lo", "hi"))
    return KnotTable(stage(blocks.select("g", F.explode(ends).alias("x"), mean.alias("y")), "knots"))


def apply_knots(df: DataFrame, knots: KnotTable, score: str, out: str, group: str | None = None) -> DataFrame:
    """``df`` with ``out``: clamped outside the knots of the row's group, interpolated between them.

    NULL and NaN scores, and those of a group without knots, have no value. The distinct scores are merged with the knots in
    one range-partitioned order, in which every partition is handed the nearest knots of those around it; neither side is collected.
    """
    g = F.col(group).cast("string") if group else F.lit("")
    keyed = df.withColumns({"_g": g, "_x": F.col(score).cast("double")})
    asked = keyed.where(F.col("_x").isNotNull() & ~F.isnan("_x")).select(F.col("_g").alias("g"), F.col("_x").alias("x"))
    both = knots.table.unionByName(asked.distinct().withColumn("y", F.lit(None).cast("double"))).groupBy("g", "x").agg(F.max("y").alias("y"))
    placed = stage(both.repartitionByRange("g", "x").withColumn("_pid", F.spark_partition_id()), "knots-merge")
    knot = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    # One row per group and range partition: the outermost knots, if there are any, and those of the partitions around.
    sums = placed.groupBy("g", "_pid").agg(F.min(knot).alias("low"), F.max(knot).alias("high"))
    along = W.partitionBy("g").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy("g").orderBy(F.desc("_pid")).rowsBetween(W.unboundedPreceding, -1)
    around = sums.select("g", "_pid", F.last("high", True).over(along).alias("before"), F.last("low", True).over(back).alias("after"))
    up = W.partitionBy("g", "_pid").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("g", "_pid").orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = placed.join(around, ["g", "_pid"]).select(
        "g", "x", F.coalesce(F.last(knot, True).over(up), "before").alias("a"), F.coalesce(F.last(knot, True).over(down), "after").alias("b")
    )
    part = (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    inside = F.when(F.col("a.x") < F.col("b.x"), F.col("a.y") + part * (F.col("b.y") - F.col("a.y"))).otherwise(F.col("a.y"))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(inside)
    known = near.select(F.col("g").alias("_g"), F.col("x").alias("_x"), value.alias(out))
    return keyed.drop(out).join(known, ["_g", "_x"], "left").drop("_g", "_x")
