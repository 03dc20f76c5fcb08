"""Model inputs: engineered features, scaling, selection."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import non_empty
from riskloom.operators.history import HISTORY_ORDER, transaction_id_column
from riskloom.operators.schema import POSITION_COLUMNS, is_numeric
from riskloom.operators.splits import downsample_majority
from riskloom.session import stage

HASH_BUCKETS = 4096
TRACE_COLUMNS = ("transaction_id", "current_transaction_id", "is_fraud")
EXCLUDED_COLUMNS = ("split", "previous_transaction_timestamp", *POSITION_COLUMNS)
COLUMNS_PER_PASS = 100


def blake2_bucket(buckets: int):
    """64-bit BLAKE2b of the text, little endian; for bit parity with models trained elsewhere."""

    @F.pandas_udf("bigint")
    def bucket(text: pd.Series) -> pd.Series:
        digests = {
            v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % buckets
            for v in text.dropna().unique()
        }
        return text.map(digests).fillna(0).astype("int64")

    return bucket


def hash_bucket(c: str, buckets: int = HASH_BUCKETS, method: str = "md5") -> Column:
    text = F.trim(F.col(c).cast("string"))
    if method == "blake2b":
        value = blake2_bucket(buckets)(text)
    else:
        value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % buckets
    return F.when(non_empty(c), value).otherwise(F.lit(0).cast("bigint"))


def string_features(cols: Sequence[str], buckets: int = HASH_BUCKETS, method: str = "md5") -> list[Column]:
    out = []
    for c in cols:
        out.append(hash_bucket(c, buckets, method).cast("double").alias(f"{c}__hash_bucket"))
        out.append((~non_empty(c)).cast("double").alias(f"{c}__missing"))
    return out


def timestamp_features(cols: Sequence[str]) -> list[Column]:
    out = []
    for c in cols:
        seconds = F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
        out.append(F.coalesce(seconds, F.lit(0.0)).alias(f"{c}__unix_seconds"))
        out.append(F.col(c).isNull().cast("double").alias(f"{c}__missing"))
    return out


def engineer_features(df: DataFrame, keep: Sequence[str] = ("transaction_id", "is_fraud"), method: str = "md5", exclude: Sequence[str] = EXCLUDED_COLUMNS) -> DataFrame:
    """Numeric columns as they are (NULL is 0), text hashed, times as seconds; one projection."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name in TRACE_COLUMNS or f.name in exclude:
            continue
        if is_numeric(f.dataType):
            value = F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
            number = value.cast("double")
            out.append(F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out += timestamp_features([f.name])
        elif isinstance(f.dataType, T.StringType):
            out += string_features([f.name], method=method)
    if not out:
        raise ValueError("no feature column remains")
    return df.select(*[c for c in keep if c in df.columns], *out)


def wide_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``column, position, n, total, squares, mean, std, low, high`` per column (and group); NULL is 0.

    All columns go through one vector aggregate, so hundreds of features cost one pass and one small
    row per group; nothing is exploded before it is aggregated.
    """
    if not cols:
        raise ValueError("at least one feature column is required")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)]
    packed = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_v").transform(df.select(*by, *numbers))
    summary = Summarizer.metrics("count", "sum", "normL2", "mean", "variance", "min", "max").summary(F.col("_v"))
    row = packed.groupBy(*by).agg(summary.alias("s"))
    part = lambda name: vector_to_array(F.col(f"s.{name}")).alias(name)
    arrays = row.select(
        *by, F.col("s.count").alias("n"), F.array(*[F.lit(c) for c in cols]).alias("column"), *[part(m) for m in ("sum", "normL2", "mean", "variance", "min", "max")]
    )
    zipped = F.posexplode(F.arrays_zip("column", "sum", "normL2", "mean", "variance", "min", "max")).alias("position", "r")
    # The library's variance divides by n-1, the scaler by n.
    population = F.sqrt(F.col("r.variance") * (F.col("n") - 1) / F.greatest("n", F.lit(1)))
    return arrays.select(*by, "n", zipped).select(
        *by, "r.column", "position", "n", F.col("r.sum").alias("total"), (F.col("r.normL2") * F.col("r.normL2")).alias("squares"),
        F.col("r.mean").alias("mean"), population.alias("std"), F.col("r.min").alias("low"), F.col("r.max").alias("high"),
    )


def scale_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column; a constant column gets scale 1."""
    return wide_stats(df, cols).select(
        "column", "position", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("std"), "low", "high"
    )


def scale_apply(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise with fitted stats; they arrive as literals (one pair per feature)."""
    return df.withColumns({
        r["column"]: (F.col(r["column"]).cast("double") - F.lit(r["mean"])) / F.lit(r["std"]) for r in stats.collect()
    })


def variance_filter(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that are not constant, in their order."""
    rows = wide_stats(df, cols).where(F.col("low") < F.col("high")).orderBy("position").collect()
    return [r["column"] for r in rows]


def anova_scores(df: DataFrame, cols: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """One-way F statistic of each feature over the label classes: ``column, position, f``."""
    per_class = wide_stats(df.where(F.col(label).isNotNull()), cols, [label])
    sums = per_class.groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("_mean"), F.collect_list(F.struct("n", "mean")).alias("_classes"),
        # From the deviations of each class: squares of large values would cancel.
        F.sum(F.col("n") * F.col("std") * F.col("std")).alias("_within"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    # One entry for each class; deviations of means, not differences of squares.
    spread = F.aggregate("_classes", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["mean"] - F.col("_mean")) * (c["mean"] - F.col("_mean")))
    between = F.try_divide(spread, F.col("k") - 1)
    # As many rows as classes leave nothing within them: the score is then infinite.
    within = F.coalesce(F.try_divide("_within", F.col("n") - F.col("k")), F.lit(0.0))
    usable = (F.col("k") > 1) & (F.col("low") < F.col("high"))
    f = F.when(usable & (within > 0), between / within).when(usable, F.lit(float("inf")))
    return sums.select("column", "position", "k", (F.col("low") < F.col("high")).alias("varies"), f.alias("f"))


def anova_select(df: DataFrame, cols: Sequence[str], label: str = "is_fraud", top_k: int | None = None) -> DataFrame:
    """``column, position, f, selected``: constant columns out, then the k highest F; among equal F
    the later column first. With a single class only the constant columns drop out."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    scored = anova_scores(df, cols, label)
    ordered = F.row_number().over(_few_rows().orderBy(F.col("varies").desc(), F.col("f").desc_nulls_last(), F.desc("position")))
    limit = F.lit(len(cols) if top_k is None else top_k)
    return scored.withColumn("_rank", ordered).select(
        "column", "position", "f",
        (F.col("varies") & ((F.col("k") < 2) | (F.col("_rank") <= limit))).alias("selected"),
    )


def _few_rows():
    """Window over one row per feature."""
    from pyspark.sql import Window

    return Window.partitionBy()


def model_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Id, label (NULL is 0) and float features (NULL is 0)."""
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.coalesce(F.col("is_fraud").cast("int"), F.lit(0)).alias("is_fraud"),
        *[F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")).alias(f) for f in features],
    )


@dataclass(frozen=True)
class TabularResult:
    train: DataFrame
    valid: DataFrame
    test: DataFrame
    stats: DataFrame
    selection: DataFrame
    report: DataFrame
    features: tuple[str, ...]


def prepare_tabular(df: DataFrame, split_ids: DataFrame, ratio: float = 10.0, top_k: int | None = None) -> TabularResult:
    """Engineer, balance (train only), scale and select; scaler and selector see balanced train only."""
    keyed = df.withColumn("transaction_id", transaction_id_column(df))
    order = [c for c in HISTORY_ORDER if c in keyed.columns] + ["transaction_id"]
    # The features are expensive (windows) and read several times from here on: written once.
    tagged = stage(keyed.drop("split").join(split_ids.select("transaction_id", "split"), "transaction_id"), "tabular")
    part = {name: tagged.where(F.col("split") == name).drop("split") for name in ("train", "valid", "test")}
    engineered = {
        "train": stage(engineer_features(downsample_majority(part["train"], ratio, order)), "balanced"),
        "valid": engineer_features(part["valid"]),
        "test": engineer_features(part["test"]),
    }
    names = [c for c in engineered["train"].columns if c not in ("transaction_id", "is_fraud")]
    stats = scale_fit(engineered["train"], names)
    fitted = df.sparkSession.createDataFrame(stats.collect(), stats.schema)
    scaled = {k: scale_apply(v, fitted) for k, v in engineered.items()}
    selection = anova_select(scaled["train"], names, top_k=top_k)
    chosen = selection.collect()
    selection = df.sparkSession.createDataFrame(chosen, selection.schema)
    features = tuple(r["column"] for r in sorted(chosen, key=lambda r: r["position"]) if r["selected"])
    out = {k: v.select("transaction_id", "is_fraud", *features) for k, v in scaled.items()}
    report = None
    for name in ("train", "valid", "test"):
        row = out[name].agg(
            F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_fraud").cast("int") == 1).alias("positives"),
            F.lit(len(names)).alias("candidate_features"), F.lit(len(features)).alias("selected_features"),
        )
        report = row if report is None else report.unionByName(row)
    return TabularResult(out["train"], out["valid"], out["test"], fitted, selection, report, features)
