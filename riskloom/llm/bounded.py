"""Bounded takes from tables of any size. A plain ordered limit sends that many rows of every task to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 62


def hash_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows of ``df``: those with the smallest hashes of ``keys``, ties by the keys.

    A count first bounds the hashes, so that little more than ``limit`` rows of the whole table are ordered.
    """
    n = df.count()
    draw = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(7)).bitwiseAND(F.lit(_SPAN - 1))
    kept = df if n <= limit else df.where(draw < int(_SPAN * min(1.0, 1.1 * limit / n + 64 / n)))
    return kept.orderBy(draw, *keys).limit(limit)


def top_counts(df: DataFrame, limit: int, count: str = "c") -> DataFrame:
    """The rows of ``df`` with the largest counts, as many as there are without exceeding ``limit``; equal counts stay together.

    The bar is found by counting: each aggregate cuts the interval that it must lie in into 32 parts.
    """
    top = df.agg(F.max(count)).first()[0] or 0
    low, high = 1, top + 1  # at ``high`` and above there are at most ``limit`` rows
    while low < high:
        step = max(1, -(-(high - low) // 32))
        bars = list(range(low, high, step))
        sizes = df.agg(*[F.count_if(F.col(count) >= b).alias(f"b{i}") for i, b in enumerate(bars)]).first()
        fitting = [b for b, n in zip(bars, sizes, strict=True) if n <= limit]
        best = min(fitting, default=high)
        failing = [b for b in bars if b < best]
        low, high = (max(failing) + 1 if failing else best), best
    return df.where(F.col(count) >= high)
