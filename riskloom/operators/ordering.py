"""Global order, running totals and exact quantiles without a single-task sort.

All helpers range-partition on the sort key, stage the partition number once, and combine
per-partition totals (one row per partition) with positions inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.session import stage


#: Rows of a run that meet it under one key.
RUN_ROWS = 1 << 16


def nulls_last(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def running_before(column: str) -> Column:
    """Sum over the partitions before this one; the window sees one row per partition."""
    frame = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def global_ordinal(df: DataFrame, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Append 1..N in the given order (NULLs last). ``order`` must end in a unique tie-breaker."""
    return _ordinal(df, nulls_last(order), out)


def ordinal_within(df: DataFrame, group: str, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Append 1..N in the given order (NULLs last) in each group; rows of a NULL group are left out.

    A group is a run of range partitions. The rows meet the table of these runs by group, partition and block of ``RUN_ROWS`` positions,
    so that the keys are many and about equal however few groups there are; the runs are staged, so the planner knows whether they are
    few enough to broadcast.
    """
    placed = _placed(df, nulls_last([group, *order])).withColumn("_block", F.floor(F.col("_pos") / RUN_ROWS))
    before = W.partitionBy(group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    runs = placed.groupBy(group, "_pid").agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from") + 1
    blocks = F.sequence(F.floor(F.col("_from") / RUN_ROWS), F.floor((F.col("_from") + F.col("_rows") - 1) / RUN_ROWS))
    # Two steps: the window must see a run once.
    shifted = runs.select(group, "_pid", shift.alias("_shift"), blocks.alias("_blocks"))
    runs = stage(shifted.select(group, "_pid", "_shift", F.explode("_blocks").alias("_block")), "runs")
    return placed.join(runs, [group, "_pid", "_block"]).withColumn(out, F.col("_pos") + F.col("_shift")).drop("_mid", "_pid", "_pos", "_block", "_shift")


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    # After the range exchange and the local sort the lower 33 bits of the generated id are the
    # position inside the partition and the upper bits the partition, so one exchange is enough.
    return stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ordinal",
    ).withColumns({"_pid": F.shiftright("_mid", 33), "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})


def _ordinal(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    placed = _placed(df, order)
    offsets = (
        placed.groupBy("_pid").agg((F.max("_pos") + 1).alias("_rows"))
        .select("_pid", running_before("_rows").alias("_offset"))
    )
    # One row per range partition: far below any broadcast limit whatever the table size.
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_offset") + F.col("_pos") + 1)
        .drop("_mid", "_pid", "_pos", "_offset")
    )


def place(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Range-partition on (by, value), number the partitions ``_pid`` and stage the result."""
    order = [*[F.col(b) for b in by], F.col(value).desc() if descending else F.col(value).asc()]
    return stage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "totals")


def totals_along(placed: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Running totals over a table of :func:`place`."""
    # One struct key per group: equal also when a grouping value is NULL, and the join below and the
    # window inside share its partitioning, so the rows move once.
    placed = placed.withColumn("_g", F.struct(*[F.col(b) for b in by]) if by else F.lit(0))
    per_part = placed.groupBy("_g", "_pid").agg(*[F.sum(s).alias(f"_part_{s}") for s in sums])
    whole = W.partitionBy("_g")
    before = whole.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        "_g",
        "_pid",
        *[F.coalesce(F.sum(f"_part_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_part_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per range partition
    direction = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy("_g", "_pid").orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(offsets, ["_g", "_pid"]).withColumns(
        {f"cum_{s}": F.col(f"_before_{s}") + F.sum(s).over(inside) for s in sums}
    ).drop("_g", "_pid", *[f"_before_{s}" for s in sums])


def running_totals(
    df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """Inclusive running totals ``cum_<s>`` and overall ``total_<s>`` along ``value`` in each ``by`` group.

    ``df`` must hold one row per (by, value), that is, be pre-aggregated.
    """
    return totals_along(place(df, value, by, descending), value, sums, by, descending)


def quantile_grid(bins: int) -> list[float]:
    """0, 1/bins, ..., 1 as i * (1/bins): the doubles the edge definitions are based on."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group: ``samples, q0, q1, ...``.

    Works on distinct values with counts, so no task ever holds a whole group.
    """
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    counts = finite.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(running_totals(counts, "_v", ["n"], by, descending=False), "_v", probabilities, by)


def quantiles_of_counts(curve: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles from an ascending curve of :func:`running_totals` over counts ``n``."""
    last_rank = F.col("cum_n") - 1
    first_rank = F.col("cum_n") - F.col("n")
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first_rank <= rank) & (rank <= last_rank), F.col(value))).alias(f"_{side}{i}"))
    picked = curve.groupBy(*by).agg(F.max("total_n").alias("samples"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("samples") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        part = at - F.floor(at)
        # Step from the nearer neighbour, so that an exact rank returns its value bit for bit.
        out.append(F.when(part < 0.5, lo + (hi - lo) * part).otherwise(hi - (hi - lo) * (1 - part)).alias(f"q{i}"))
    return picked.select(*by, "samples", *out)


def evenly_spaced(position: Column, size: Column, take: Column) -> Column:
    """True when the 0-based ``position`` is one of ``take`` evenly spaced positions of ``size``.

    The i-th position is floor(i * (size-1)/(take-1)) with the last pinned to size-1. Instead of
    generating positions and joining, invert the formula and test the neighbouring candidates.
    """
    step = (size - 1).cast("double") / F.greatest(take - 1, F.lit(1)).cast("double")
    guess = F.round(position / F.when(step > 0, step)).cast("bigint")

    def hits(i: Column) -> Column:
        place = F.when(i == take - 1, F.when(take > 1, size - 1).otherwise(F.lit(0))).otherwise(F.floor(i * step))
        return (i >= 0) & (i < take) & (place == position)

    near = hits(guess - 1) | hits(guess) | hits(guess + 1)
    return (
        F.when(take >= size, F.lit(True))
        .when(take <= 0, F.lit(False))
        .when(take == 1, position == 0)
        .otherwise(F.coalesce(near, F.lit(False)))
    )


def even_take(df: DataFrame, take: int, order: Sequence[str]) -> DataFrame:
    """Keep ``take`` evenly spaced rows of the ordered table."""
    ranked = global_ordinal(df, order, "_ordinal")
    size = ranked.agg(F.max("_ordinal")).scalar()
    keep = evenly_spaced(F.col("_ordinal") - 1, size, F.lit(int(take)))
    return ranked.where(keep).drop("_ordinal")
