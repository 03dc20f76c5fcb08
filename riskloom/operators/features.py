"""Row-level (base) features and the feature registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import balance_delta, bounded, safe_ratio, signed_log1p

# Names of the derived columns and the inputs each needs.
DELTAS = {
    "balance_delta_org": ("newbalance_orig", "oldbalance_org"),
    "balance_delta_dest": ("newbalance_dest", "oldbalance_dest"),
}
RATIOS = {
    "amount_to_oldbalance_ratio": "oldbalance_org",
    "amount_to_newbalance_ratio": "newbalance_orig",
    "amount_to_dest_oldbalance_ratio": "oldbalance_dest",
    "amount_to_dest_newbalance_ratio": "newbalance_dest",
}
LOGGED = ("amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest")


def base_features(df: DataFrame) -> DataFrame:
    """Balance deltas, amount ratios, signed logs and bounded ratios, as far as their inputs exist."""
    have = set(df.columns)
    first = {n: balance_delta(F.col(a).cast("double"), F.col(b).cast("double")) for n, (a, b) in DELTAS.items() if {a, b} <= have}
    first |= {
        n: safe_ratio(F.col("amount").cast("double"), F.col(b).cast("double"))
        for n, b in RATIOS.items() if {"amount", b} <= have
    }
    logs = [c for c in LOGGED if c in have] + [d for d in DELTAS if d in first]
    second = {f"{c}_log1p": signed_log1p(F.col(c).cast("double")) for c in logs}
    second |= {f"{r}_bounded": bounded(r) for r in RATIOS if r in first}
    return df.withColumns(first).withColumns(second)


def feature_registry(
    df: DataFrame, dataset: str, source_columns: Sequence[str], descriptions: Mapping[str, str] | None = None
) -> DataFrame:
    """One metadata row per column, from the schema alone."""
    descriptions = descriptions or {}
    rows = []
    for i, f in enumerate(df.schema.fields):
        source = f.name in source_columns
        text = descriptions.get(f.name) or (
            "Source column kept for later joins." if source else "Engineered from the account's earlier rows or this row."
        )
        rows.append((dataset, i, f.name, "source" if source else "derived", f.dataType.simpleString(),
                     "source" if source else "engineered", True, text))
    return df.sparkSession.createDataFrame(
        rows,
        "dataset string, position int, name string, group string, dtype string, source string, "
        "point_in_time_safe boolean, description string",
    )
