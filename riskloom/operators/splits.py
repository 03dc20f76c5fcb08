"""Chronological splits and deterministic class balancing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.history import HISTORY_ORDER, derive_transaction_id
from riskloom.operators.joins import assert_unique, semi_join_ids
from riskloom.operators.ordering import evenly_spaced, global_ordinal


@dataclass(frozen=True)
class SplitStrategy:
    mode: str = "proportions"
    proportions: Mapping[str, float] | None = None
    cutoffs: Mapping[str, Any] | None = None


def canonical_frame(features: DataFrame, sequence_ids: DataFrame, out: str = "ordinal") -> DataFrame:
    """Feature rows that have a sequence, with unique ids, numbered in time order."""
    id_name = "current_transaction_id"
    kept = semi_join_ids(derive_transaction_id(features, id_name), sequence_ids.select(id_name), id_name)
    if not assert_unique(kept, id_name).isEmpty():
        raise ValueError("transaction ids must be unique before splitting")
    order = [c for c in HISTORY_ORDER if c in kept.columns] + [id_name]
    ranked = global_ordinal(kept, order, out)
    if ranked.isEmpty():
        raise ValueError("no transaction id is in both the feature and the sequence table")
    return ranked


def split_by_proportions(df: DataFrame, train: float = 0.7, valid: float = 0.15, test: float = 0.15, ordinal: str = "ordinal") -> DataFrame:
    """Label rows by ordinal: the first floor(N*train), the next floor(N*valid), the rest."""
    if abs(train + valid + test - 1.0) > 1e-9:
        raise ValueError("split proportions must sum to 1")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.floor(total * F.lit(float(train)))
    second = first + F.floor(total * F.lit(float(valid)))
    name = F.when(F.col(ordinal) <= first, "train").when(F.col(ordinal) <= second, "valid").otherwise("test")
    return df.withColumn("split", name)


def split_by_cutoffs(df: DataFrame, order_col: str, train_end: Any, valid_end: Any) -> DataFrame:
    """Up to ``train_end``, up to ``valid_end``, later; rows without an order value are in no split."""
    if train_end is None or valid_end is None:
        raise ValueError("both cut-offs are required")
    c = F.col(order_col)
    name = F.when(c <= F.lit(train_end), "train").when(c <= F.lit(valid_end), "valid").when(c > F.lit(valid_end), "test")
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def split(df: DataFrame, strategy: SplitStrategy, order_col: str = "transaction_timestamp", ordinal: str = "ordinal") -> DataFrame:
    if strategy.mode == "proportions":
        p = dict(strategy.proportions or {})
        if set(p) != {"train", "valid", "test"}:
            raise ValueError("proportions need exactly train, valid and test")
        return split_by_proportions(df, p["train"], p["valid"], p["test"], ordinal)
    if strategy.mode == "cutoffs":
        c = dict(strategy.cutoffs or {})
        return split_by_cutoffs(df, order_col, c.get("train_end"), c.get("valid_end"))
    raise ValueError(f"unsupported split mode: {strategy.mode}")


def split_report(df: DataFrame, order_col: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(order_col).alias("min_order"), F.max(order_col).alias("max_order")
    )


def downsample_majority(df: DataFrame, ratio: float, order: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """All positives and evenly spaced negatives, at most ``ratio`` per positive.

    A table with a single class passes unchanged, rows with another label then included.
    """
    if ratio <= 0:
        raise ValueError("ratio must be greater than 0")
    sizes = df.agg(
        F.count_if(F.col(label).cast("int") == 1).alias("p"), F.count_if(F.col(label).cast("int") == 0).alias("n")
    ).first()
    if sizes["p"] == 0 or sizes["n"] == 0:
        return df
    positives = df.where(F.col(label).cast("int") == 1)
    negatives = global_ordinal(df.where(F.col(label).cast("int") == 0), order, "_ordinal")
    take = min(sizes["n"], int(sizes["p"] * ratio))
    keep = evenly_spaced(F.col("_ordinal") - 1, F.lit(sizes["n"]), F.lit(take))
    return positives.unionByName(negatives.where(keep).drop("_ordinal"))


def importance_sample(df: DataFrame, max_rows: int, label: str = "is_fraud", key: str = "transaction_id", seed: int = 7) -> DataFrame:
    """All positives plus negatives in the order of a seeded hash up to ``max_rows`` rows."""
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).cast("int") == 1).alias("p")).first()
    if sizes["n"] <= max_rows:
        return df
    is_positive = F.coalesce(F.col(label).cast("int") == 1, F.lit(False))
    if sizes["p"] >= max_rows:
        ranked = global_ordinal(df.where(is_positive), [key], "_ordinal")
        return ranked.where(F.col("_ordinal") <= max_rows).drop("_ordinal")
    hashed = df.where(~is_positive).withColumn("_draw", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = global_ordinal(hashed, ["_draw", key], "_ordinal").where(F.col("_ordinal") <= max_rows - sizes["p"])
    return df.where(is_positive).unionByName(ranked.drop("_draw", "_ordinal"))
