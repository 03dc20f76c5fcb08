"""The ordered feature contract and its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.joins import assert_unique
from riskloom.operators.prep import COLUMNS_PER_PASS


# The texts of the checks below are part of the result.


@dataclass(frozen=True)
class Contract:
    features: tuple[str, ...]
    id: str = "transaction_id"
    label: str = "is_fraud"

    @property
    def columns(self) -> list[str]:
        return [self.id, self.label, *self.features]


def build_contract(train: DataFrame, valid: DataFrame, test: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """``name, index, dtype, nullable, role`` per feature; the three tables must agree in columns and order."""
    for name, frame in (("valid", valid), ("test", test)):
        if frame.columns != train.columns:
            raise ValueError(f"{name} columns do not match the train columns")
    fields = [f for f in train.schema.fields if f.name not in ("transaction_id", "is_fraud")]
    nulls = train.agg(*[F.coalesce(F.bool_or(F.col(f.name).isNull()), F.lit(False)).alias(f.name) for f in fields])
    items = F.array(*[
        F.struct(
            F.lit(f.name).alias("name"), F.lit(i).alias("index"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f.name).alias("nullable"), F.lit((roles or {}).get(f.name, "derived")).alias("role"),
        )
        for i, f in enumerate(fields)
    ])
    return nulls.select(F.explode(items).alias("r")).select("r.*")


def contract_roles(contract: DataFrame) -> DataFrame:
    return contract.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def check_layout(columns: Sequence[str], contract: Contract, allow_extra: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) from the column names."""
    expected, actual = contract.columns, list(columns)
    missing = [c for c in expected if c not in actual]
    extra = [c for c in actual if c not in expected]
    errors, warnings = [], []
    if missing:
        errors.append(f"missing required columns: {missing}")
    if extra and not allow_extra:
        errors.append(f"unexpected extra columns: {extra}")
    if missing and extra:
        warnings.append("column order not checked because required columns are missing")
    if not missing and [c for c in actual if c in expected] != expected:
        errors.append("column order differs from the contract")
    return errors, warnings


def _error_rows(counts: DataFrame, checks: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``error`` for every count column that is above zero."""
    named = F.array(*[F.when(F.col(c) > 0, F.lit(text)) for c, text in checks])
    return counts.select(F.explode(F.filter(named, lambda e: e.isNotNull())).alias("error"))


def check_ids(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    text = F.col(key).cast("string")
    plain = _error_rows(
        df.agg(F.count_if(text.isNull()).alias("nulls"), F.count_if(F.length(text) == 0).alias("empty")),
        [("nulls", f"{key} contains null values"), ("empty", f"{key} contains empty string values")],
    )
    twice = assert_unique(df, key).limit(1).select(F.lit(f"{key} contains duplicate values").alias("error"))
    return plain.unionByName(twice)


def check_labels(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    number = F.col(label).cast("string").try_cast("double") if not isinstance(df.schema[label].dataType, T.BooleanType) else F.col(label).cast("int").cast("double")
    # Truncated towards zero, as an integer cast does.
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    bad = number.isNull() | ~whole.isin(0, 1)
    if isinstance(df.schema[label].dataType, T.BooleanType):
        bad = F.lit(False)
    return _error_rows(
        df.agg(F.count_if(F.col(label).isNull()).alias("nulls"), F.count_if(bad).alias("bad")),
        [("nulls", f"{label} contains null values"), ("bad", f"{label} is not boolean or 0/1 integer-like")],
    )


def check_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null or non-numeric values, else non-finite ones; conditional counts of all features together."""
    out = None
    for start in range(0, len(features), COLUMNS_PER_PASS):
        part = [f for f in features[start:start + COLUMNS_PER_PASS] if f in df.columns]
        aggs, checks = [], []
        for i, f in enumerate(part):
            x = F.col(f).cast("string").try_cast("double") if isinstance(df.schema[f].dataType, T.StringType) else F.col(f).cast("double")
            bad = x.isNull() | F.isnan(x)
            aggs += [F.count_if(bad).alias(f"b{i}"), F.count_if(F.abs(x) == float("inf")).alias(f"_i{i}")]
            checks += [(f"b{i}", f"{f} contains null or non-numeric values"), (f"i{i}", f"{f} contains non-finite values")]
        counts = df.agg(*aggs).withColumns({
            f"i{i}": F.when(F.col(f"b{i}") == 0, F.col(f"_i{i}")).otherwise(F.lit(0)) for i in range(len(part))
        })
        rows = _error_rows(counts, checks)
        out = rows if out is None else out.unionByName(rows)
    return out


def validate_contract(df: DataFrame, contract: Contract, allow_extra: bool = False) -> DataFrame:
    """One row: ``valid, checked_rows, checked_columns, errors, warnings``."""
    errors, warnings = check_layout(df.columns, contract, allow_extra)
    spark = df.sparkSession
    rows = spark.createDataFrame([(e,) for e in errors], "error string")
    if contract.id in df.columns:
        rows = rows.unionByName(check_ids(df, contract.id))
    if contract.label in df.columns:
        rows = rows.unionByName(check_labels(df, contract.label))
    present = [f for f in contract.features if f in df.columns]
    if present:
        rows = rows.unionByName(check_features(df, present))
    one = F.lit(1).alias("_one")
    # At most a few errors per column.
    found = rows.agg(F.array_sort(F.collect_list("error")).alias("errors"), one)
    size = df.agg(F.count(F.lit(1)).alias("checked_rows"), one)
    return found.join(size, "_one").select(
        (F.size("errors") == 0).alias("valid"), "checked_rows", F.lit(len(df.columns)).alias("checked_columns"), "errors",
        F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"),
    )


def contract_check_batch(records: DataFrame, features: Sequence[str], request: str = "request_id") -> DataFrame:
    """Per request the sorted distinct missing features; one incomplete record rejects the request.

    Missing names are counted per (request, name) first, so a request with very many records
    shuffles at most one row per feature and task.
    """
    want = F.array(*[F.lit(f) for f in features])
    gone = F.array_except(want, F.coalesce(F.map_keys("features"), F.array().cast("array<string>")))
    names = (
        records.select(request, F.explode_outer(gone).alias("name")).groupBy(request, "name").agg(F.count(F.lit(1)).alias("n"))
    )
    message = F.when(F.col("name").isNotNull(), F.concat(F.lit("missing required feature: "), F.col("name")))
    listed = names.groupBy(request).agg(F.array_sort(F.collect_list(message)).alias("errors"))
    return listed.select(request, (F.size("errors") == 0).alias("valid"), "errors")
