"""Windows over per-account history that stay balanced when one account holds most of the rows.

A window partitioned by account puts each account into one task. That is the cheapest plan as
long as no account is huge, so it is the default. Accounts above ``hot_rows`` take another
route: their rows are range-partitioned on (account, order), each range partition is a segment
of bounded size, and every segment receives the last few rows of the segments before it (a
"halo") so that look-back frames see exactly the rows they would have seen in one big group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import non_empty
from riskloom.operators.ordering import nulls_last
from riskloom.session import stage

HOT_ROWS = 5_000_000
#: Segments are not cut smaller than this once there are ``FEW_SEGMENTS``, however low the bound of a hot key: each is a task, and
#: range bounds, task results and carried rows grow with their number.
SEGMENT_ROWS = 50_000
FEW_SEGMENTS = 64

Step = Callable[[list[str], list[Column]], dict[str, Column]]


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, int]:
    """All keys with more than ``hot_rows`` rows as a staged table, and their total row count.

    There may be any number of them; only the total comes to the driver.
    """
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    total = counts.agg(F.sum("_rows")).first()[0]
    return (stage(counts, "hot-keys").select("_hot"), total) if total else (None, 0)


def split_hot(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, hot rows); a NULL key is a key like any other. How to join is the planner's choice."""
    match = df[key].eqNullSafe(keys["_hot"])
    return df.join(keys, match, "left_anti"), df.join(keys, match, "left_semi")


def segment(df: DataFrame, key: str, order: Sequence[str], segments: int) -> DataFrame:
    """Range-partition on (key, order), number the partitions ``_seg`` and the rows ``_rid``."""
    placed = df.repartitionByRange(segments, *nulls_last([key, *order])).withColumns(
        {"_seg": F.spark_partition_id(), "_rid": F.monotonically_increasing_id()}
    )
    return stage(placed, "segments")


def segments_for(rows: int, hot_rows: int) -> int:
    return max(2, min(2 * rows // max(hot_rows, 1) + 1, max(FEW_SEGMENTS, rows // SEGMENT_ROWS)))


def _last(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def halo_rows(placed: DataFrame, key: str, order: Sequence[str], depth: int, sparse: str | None) -> DataFrame:
    """Rows each segment must see from earlier ones: the last ``depth`` of the key, and the last
    ``depth`` with a non-blank ``sparse`` value. Size: at most 2 x depth x (keys x segments)."""
    newest_first = W.partitionBy(key, "_seg").orderBy(*[F.col(c).desc_nulls_first() for c in order], F.desc("_rid"))
    filled = non_empty(sparse) if sparse else F.lit(False)
    row = F.struct(*[c for c in placed.columns if c != "_seg"])
    marked = placed.withColumns(
        {
            "_back": F.row_number().over(newest_first),
            "_filled": filled,
            "_filled_back": F.sum(filled.cast("int")).over(newest_first.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    recent = F.col("_back") <= depth
    recent_filled = F.col("_filled") & (F.col("_filled_back") <= depth)
    aged = F.struct((-F.col("_back")).alias("age"), row.alias("row"))

    def oldest_first(keep: Column) -> Column:
        by_age = F.array_sort(F.collect_list(F.when(keep, aged)), lambda a, b: (a["age"] - b["age"]).cast("int"))
        return F.transform(by_age, lambda x: x["row"])

    tails = (
        marked.where(recent | recent_filled)
        .groupBy(key, "_seg")
        .agg(oldest_first(recent).alias("_tail"), oldest_first(recent_filled).alias("_filled_tail"))
        .withColumn("_filled_tail", F.when(F.size("_filled_tail") > 0, F.col("_filled_tail")))
    )
    along = W.partitionBy(key).orderBy("_seg")
    along_filled = W.partitionBy(key, F.col("_filled_tail").isNull()).orderBy("_seg").rowsBetween(-depth, 0)
    carried = tails.withColumns(
        {
            # Every (key, segment) holds at least one row, so ``depth`` earlier segments suffice.
            "_rows_in": _last(F.flatten(F.collect_list("_tail").over(along.rowsBetween(-depth, -1))), depth),
            "_filled_upto": F.when(
                F.col("_filled_tail").isNotNull(),
                _last(F.flatten(F.collect_list("_filled_tail").over(along_filled)), depth),
            ),
        }
    ).withColumn("_filled_in", F.last("_filled_upto", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)))
    both = F.when(F.col("_filled_in").isNull(), F.col("_rows_in")).otherwise(F.concat("_rows_in", "_filled_in"))
    return (
        carried.select("_seg", F.explode(both).alias("r"))
        .select("_seg", "r.*")
        .dropDuplicates(["_seg", "_rid"])
    )


def _apply(df: DataFrame, keys: list[str], order: Sequence[str], steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step(keys, nulls_last(order)))
    return df


def over_history(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    steps: Sequence[Step],
    depth: int = 10,
    sparse: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the window columns of ``steps``; frames may reach back at most ``depth`` rows
    (or ``depth`` non-blank values of ``sparse``).

    ``order`` must be total within a key: rows that tie in all of it have no defined order on either route. Callers with ties add an id to it."""
    keys, rows = hot_keys(df, key, hot_rows)
    if keys is None:
        return _apply(df, [key], order, steps)
    cold, hot = split_hot(df, key, keys)
    placed = segment(hot, key, order, segments_for(rows, hot_rows))
    halo = halo_rows(placed, key, order, depth, sparse)
    seen = placed.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    balanced = _apply(seen, [key, "_seg"], [*order, "_rid"], steps).where(~F.col("_halo"))
    done = _apply(cold, [key], order, steps)
    return done.unionByName(balanced.select(*done.columns))
