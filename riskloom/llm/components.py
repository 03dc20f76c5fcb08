"""Connected components of an edge table by alternating star contractions, all state in shuffled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its neighbours to the smallest of them.

    ``large`` hands over the larger neighbours only, else the node itself and its smaller ones.
    The minimum is combined before the shuffle and joined back, so no node's neighbours meet in one group.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = side.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> one row ``(node, root)`` for each node with a link; the root is the smallest.

    Loops and repeated edges are allowed; rows with a null end are ignored. An empty table gives an empty table.
    Each round is written to the shared folder, so an executor lost later costs no more than its own round.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(mark)
        now = stage(_star(_star(now, large=True), large=False), "cc")
