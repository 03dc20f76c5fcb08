"""Key checks, id subsets and the 1:1 join of several models' predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators.ordering import global_ordinal
from riskloom.session import stage


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once with their counts; empty means unique."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)
    return counts.withColumnRenamed("_copies", "n" if key != "n" else "copies")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows whose id occurs in ``ids``; repeated ids collapse before they are shuffled."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str = "transaction_id", position: str = "position") -> DataFrame:
    """Rows of ``df`` for every id of ``ids`` with the position of the id; raises when an id is absent."""
    absent = ids.join(df.select(key), key, "left_anti").limit(1).collect()
    if absent:
        raise KeyError(f"ids without a row, for example {absent[0][key]}")
    return df.join(ids.select(key, position), key)


def branches_by_id(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per id with, for each branch in turn, its number of rows, least and largest label, score and predicted label.

    All branches are one tagged table, grouped once: every check and the wide row come from this one shuffle.
    """
    tagged = None
    for i, frame in enumerate(frames.values()):
        part = frame.select(
            F.col("transaction_id").cast("string").alias("transaction_id"), F.lit(i).alias("_b"), "is_fraud",
            *[F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("predicted_label", "int"))],
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    columns = []
    for i in range(len(frames)):
        mine = F.col("_b") == i
        columns += [
            F.count_if(mine).alias(f"_n{i}"), F.min(F.when(mine, F.col("is_fraud"))).alias(f"_low{i}"), F.max(F.when(mine, F.col("is_fraud"))).alias(f"_high{i}"),
            F.max(F.when(mine, F.col("score"))).alias(f"_score{i}"), F.max(F.when(mine, F.col("predicted_label"))).alias(f"_label{i}"),
        ]
    return tagged.groupBy("transaction_id").agg(*columns)


def _disagrees(i: int) -> Column:
    """The branch lacks the base's label or contradicts it."""
    return F.col(f"_low{i}").isNull() | ~F.col(f"_low{i}").eqNullSafe(F.col("_low0")) | ~F.col(f"_high{i}").eqNullSafe(F.col("_high0"))


def join_branches(frames: Mapping[str, DataFrame], check: bool = True) -> DataFrame:
    """One wide row per transaction from the prediction tables of several branches.

    The first branch is the base; ids must be unique in each and complete against the base, labels
    must agree. The grouped table is staged, checked in one aggregate and returned.
    """
    names = list(frames)
    wide = branches_by_id(frames)
    if check:
        wide = stage(wide, "branches")
        others = range(1, len(names))
        wrong = wide.agg(
            *[F.count_if(F.col(f"_n{i}") > 1).alias(f"d{i}") for i in range(len(names))],
            F.count_if((F.col("_n0") > 0) & C.any_of([_disagrees(i) for i in others])).alias("labels") if others else F.lit(0).alias("labels"),
        ).first()
        for i, name in enumerate(names):
            if wrong[f"d{i}"]:
                raise ValueError(f"{name} has duplicate transaction ids")
        if wrong["labels"]:
            raise ValueError("labels differ between branches or are missing")
    columns = [F.col(f"_{kind}{i}").alias(f"{n}_{suffix}") for i, n in enumerate(names) for kind, suffix in (("score", "score"), ("label", "predicted_label"))]
    return wide.where("_n0 > 0").select("transaction_id", F.col("_low0").alias("is_fraud"), *columns)


def label_consistency(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Base ids whose label another branch lacks or contradicts."""
    names = list(frames)
    if len(names) < 2:
        raise ValueError("two branches at least are needed")
    found = [
        F.when(_disagrees(i), F.struct(F.lit(n).alias("branch"), F.col("_low0").alias("base_label"), F.col(f"_low{i}").alias("other_label")))
        for i, n in enumerate(names) if i
    ]
    rows = branches_by_id(frames).where("_n0 > 0").select("transaction_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return rows.select("transaction_id", "x.branch", "x.base_label", "x.other_label")


def id_diagnostics(frames: Mapping[str, DataFrame], samples: int = 5) -> DataFrame:
    """Ids missing from and extra in each branch against the base: counts and the first few."""
    names = list(frames)
    kinds, found = [], []
    for i, name in enumerate(names[1:], 1):
        for kind, where in (("missing", (F.col("_n0") > 0) & (F.col(f"_n{i}") == 0)), ("extra", (F.col("_n0") == 0) & (F.col(f"_n{i}") > 0))):
            label = F.struct(F.lit(name).alias("branch"), F.lit(kind).alias("kind"))
            kinds.append(label)
            found.append(F.when(where, label))
    odd = branches_by_id(frames).select("transaction_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    first = odd.withColumn("_rank", F.row_number().over(W.partitionBy("x").orderBy("transaction_id"))).where(F.col("_rank") <= samples)
    listed = first.groupBy("x").agg(F.array_join(F.array_sort(F.collect_list("transaction_id")), ",").alias("samples"))
    counts = odd.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    every = frames[names[0]].sparkSession.range(1).select(F.explode(F.array(*kinds)).alias("x"))
    return every.join(counts, "x", "left").join(listed, "x", "left").select("x.branch", "x.kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """NULL count of each column, all in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def assert_disjoint(split_ids: DataFrame) -> DataFrame:
    """Ids that fall into more than one split; empty means disjoint."""
    return (
        split_ids.groupBy("transaction_id")
        .agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select("transaction_id", F.col("_a").alias("first_split"), F.col("_b").alias("last_split"))
    )


def with_position(ids: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    return global_ordinal(ids, order, out)
