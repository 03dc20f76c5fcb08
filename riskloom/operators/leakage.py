"""Checks that catch label leakage and evaluation mistakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.joins import assert_disjoint
from riskloom.operators.prep import COLUMNS_PER_PASS
from riskloom.operators.schema import is_numeric


def leakage_correlations(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id", threshold: float = 0.98) -> DataFrame:
    """Features with an absolute Pearson correlation to the label at or above the threshold."""
    names = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in (label, key)]
    y = F.col(label).cast("int").cast("double")
    out = None
    for start in range(0, len(names), COLUMNS_PER_PASS):
        part = names[start:start + COLUMNS_PER_PASS]
        aggs = []
        for i, c in enumerate(part):
            x = F.col(c).cast("int").cast("double") if df.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("double")
            aggs += [_correlation(x, y).alias(f"c{i}"), (F.min(x) < F.max(x)).alias(f"v{i}")]
        items = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(f"c{i}").alias("absolute_correlation"), F.col(f"v{i}").alias("varies")) for i, c in enumerate(part)])
        rows = df.agg(*aggs).select(F.explode(items).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    suspicious = F.col("varies") & (F.col("absolute_correlation") >= threshold)
    return out.where(suspicious).select("feature", "absolute_correlation").orderBy(F.desc("absolute_correlation"), "feature")


def _correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL where a side is constant (``corr`` would raise)."""
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def implausible_performance(metrics: DataFrame, f1: float = 0.995, ap: float = 0.999, split: str = "split") -> DataFrame:
    """Warnings for valid/test splits that look too good: ``type, split``."""
    high = (F.coalesce("f1", F.lit(0.0)) >= f1) | (F.coalesce("average_precision", F.lit(0.0)) >= ap)
    perfect = (F.col("fp") == 0) & (F.col("fn") == 0)
    kinds = F.array(F.when(high, F.lit("implausibly_high_performance")), F.when(perfect, F.lit("perfect_confusion_matrix")))
    return (
        metrics.where(F.col(split).isin("valid", "test"))
        .select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("type"), F.col(split).alias("split"))
    )


def leakage_checks(split_ids: DataFrame, train: DataFrame, metrics: DataFrame) -> DataFrame:
    """Raise on overlapping splits; else all warnings as ``type, subject``."""
    if not assert_disjoint(split_ids).isEmpty():
        raise ValueError("train, valid and test overlap")
    correlated = leakage_correlations(train).select(
        F.lit("suspicious_feature_target_correlation").alias("type"), F.col("feature").alias("subject")
    )
    return correlated.unionByName(implausible_performance(metrics).select("type", F.col("split").alias("subject")))
