"""Score calibration: Platt scaling, isotonic regression, calibration error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clamp01, clip_probability, sigmoid
from riskloom.operators.fusion import fit_balanced_logistic, predictions
from riskloom.operators.isotonic import KnotTable, apply_knots, fit_knots
from riskloom.operators.metrics import LABEL, PREDICTED, SCORE, evaluate, match_keys, resolve_threshold
from riskloom.session import side_by_side

SELECTION_METRICS = ("brier_score", "log_loss", "expected_calibration_error")


@dataclass(frozen=True)
class CalibrationConfig:
    methods: tuple[str, ...] = ("platt", "isotonic")
    metric: str = "brier_score"
    threshold: float = 0.5
    threshold_strategy: str = "validation_f1"


@dataclass(frozen=True)
class Platt:
    coefficient: float
    intercept: float

    def column(self, score: Column) -> Column:
        return sigmoid(score * F.lit(self.coefficient) + F.lit(self.intercept))


@dataclass(frozen=True)
class Knots:
    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def column(self, score: Column) -> Column:
        return clamp01(isotonic_apply(score, self))


def distinct_scores(df: DataFrame) -> DataFrame:
    """(score, label) with counts: what both fits need, far smaller than the table."""
    y = F.coalesce(F.col(LABEL).cast("double"), F.lit(0.0))
    return df.groupBy(F.col(SCORE).cast("double").alias(SCORE), y.alias(LABEL)).agg(F.count(F.lit(1)).cast("double").alias("w"))


def platt_fit(df: DataFrame, c: float = 1.0) -> Platt:
    coefficients, intercept = fit_balanced_logistic(distinct_scores(df), [SCORE], c, 500, weight="w")
    return Platt(coefficients[0], intercept)


def platt_apply(score: Column, model: Platt) -> Column:
    return model.column(score)


def isotonic_fit(df: DataFrame, by: str | None = None) -> KnotTable:
    """Non-decreasing fit, of each value of ``by`` if given; tied scores enter once with their mean label and count.

    Scores that are NULL, NaN or infinite take no part; a table without others has no knots.
    """
    x = F.col(SCORE).cast("double")
    y = F.coalesce(F.col(LABEL).cast("double"), F.lit(0.0))
    group = (F.col(by).cast("string") if by else F.lit("")).alias("g")
    points = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy(group, x.alias("x")).agg(F.sum(y).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    return fit_knots(points)


def isotonic_apply(score: Column | str, knots: Knots) -> Column:
    """Clamp outside some given knots, interpolate inside, identity without knots; NULL and NaN stay without a value.

    For knots that are part of a scoring specification; fitted ones are a table, see :func:`apply_calibrators`.
    """
    s = F.col(score) if isinstance(score, str) else score
    if not knots.xs or len(knots.xs) != len(knots.ys):
        return s
    xs, ys = np.asarray(knots.xs, float), np.asarray(knots.ys, float)

    @F.pandas_udf("double")
    def interpolate(score: pd.Series) -> pd.Series:
        x = score.to_numpy(dtype=float)
        # The first knot not below the score; on repeated knots so the first of them decides.
        upper = np.clip(np.searchsorted(xs, x, side="left"), 1, max(len(xs) - 1, 1))
        upper = np.minimum(upper, len(xs) - 1)
        lower = np.maximum(upper - 1, 0)
        gap = xs[upper] - xs[lower]
        share = np.divide(x - xs[lower], gap, out=np.ones_like(x), where=gap != 0)
        inside = ys[lower] + share * (ys[upper] - ys[lower])
        out = np.where(x <= xs[0], ys[0], np.where(x >= xs[-1], ys[-1], inside))
        return pd.Series(out).where(~np.isnan(x))

    return interpolate(s)


def expected_calibration_error(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Share-weighted gap between mean score and observed rate over equal-width bins.

    The bin edges are literal doubles: floor(p * bins) misplaces scores that sit on an edge.
    """
    p = clamp01(F.col(SCORE).cast("double"))
    edges = np.linspace(0.0, 1.0, bins + 1)
    index = F.lit(0)
    for e in edges[1:-1]:
        index = index + (p >= F.lit(float(e))).cast("int")
    per_bin = df.groupBy(*by, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(LABEL).cast("double")).alias("observed")
    )
    gap = F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")
    return per_bin.groupBy(*by).agg(gap.alias("expected_calibration_error"))


def calibration_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All scalar metrics at 0.5 plus the calibration error, scores clipped to (1e-7, 1-1e-7)."""
    clipped = df.withColumn(SCORE, clip_probability(SCORE, 1e-7)).withColumn(PREDICTED, (F.col(SCORE) >= 0.5).cast("int"))
    return match_keys(evaluate(clipped, by), expected_calibration_error(clipped, 10, by), by)


def selection_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Only what a calibrator is selected on: Brier, log loss, calibration error. No score curve."""
    p = clip_probability(SCORE, 1e-7)
    clipped = df.withColumn(SCORE, p)
    y = F.col(LABEL).cast("int")
    loss = -F.when(y == 1, F.ln(SCORE)).otherwise(F.ln(1.0 - F.col(SCORE)))
    flat = clipped.groupBy(*by).agg(F.avg((F.col(SCORE) - y) * (F.col(SCORE) - y)).alias("brier_score"), F.avg(loss).alias("log_loss"))
    return match_keys(flat, expected_calibration_error(clipped, 10, by), by)


Calibrator = Platt | Knots | KnotTable


def apply_calibrators(df: DataFrame, models: Mapping[str, Calibrator | None], by: str, score: str = SCORE, out: str = SCORE) -> DataFrame:
    """``df`` with the calibrated ``out`` of each row, by the model of its value of ``by``; a value without model keeps its score.

    Fitted knots of all groups are merged with the scores in one pass.
    """
    raw = F.col(score).cast("double")
    plain = raw
    for g, model in models.items():
        if model is not None and not isinstance(model, KnotTable):
            plain = F.when(F.col(by) == g, model.column(raw)).otherwise(plain)
    tables = {g: m.table for g, m in models.items() if isinstance(m, KnotTable)}
    if not tables:
        return df.withColumn(out, plain)
    knots = KnotTable(reduce(DataFrame.unionByName, [t.withColumn("g", F.lit(g)) for g, t in tables.items()]))
    stepped = F.col(by).isin(list(tables))
    merged = apply_knots(df.withColumns({"_plain": plain, "_group": F.when(stepped, F.col(by))}), knots, score, "_stepped", "_group")
    return merged.withColumn(out, F.when(stepped, F.when(F.col("_stepped").isNotNull(), clamp01(F.col("_stepped")))).otherwise(F.col("_plain"))).drop("_plain", "_group", "_stepped")


def apply_calibrator(df: DataFrame, model: Calibrator, score: str = SCORE, out: str = SCORE) -> DataFrame:
    return apply_calibrators(df.withColumn("_model", F.lit("")), {"": model}, "_model", score, out).drop("_model")


def select_calibrators(
    frames: Mapping[str, DataFrame], cfg: CalibrationConfig = CalibrationConfig()
) -> tuple[dict[str, tuple[str, Platt | KnotTable]], DataFrame]:
    """Choose a calibrator for each named table of scores.

    The isotonic fits of all tables are one table of knots, and all fitted calibrators of all tables are compared in one pass.
    Returns the choice per table and the comparison table.
    """
    if not cfg.methods:
        raise ValueError("at least one calibration method is required")
    if cfg.metric not in SELECTION_METRICS:
        raise ValueError(f"unsupported selection metric: {cfg.metric}")
    for method in cfg.methods:
        if method not in ("platt", "isotonic"):
            raise ValueError(f"unsupported calibration method: {method}")
    spark = next(iter(frames.values())).sparkSession
    stacked = reduce(DataFrame.unionByName, [df.select(F.lit(g).alias("grp"), LABEL, SCORE) for g, df in frames.items()])
    fitted: dict[tuple[str, str], Platt | KnotTable] = {}
    if "platt" in cfg.methods:
        fitted |= zip([(g, "platt") for g in frames], side_by_side(spark, [partial(platt_fit, df) for df in frames.values()]), strict=True)
    if "isotonic" in cfg.methods:
        knots = isotonic_fit(stacked, "grp")
        fitted |= {(g, "isotonic"): knots.of(g) for g in frames}
    tried = stacked.withColumn("method", F.explode(F.array(*[F.lit(m) for m in cfg.methods]))).withColumn("_try", F.concat_ws("/", "grp", "method"))
    scored = apply_calibrators(tried, {f"{g}/{m}": fitted[(g, m)] for g, m in fitted}, "_try")
    rows = selection_metrics(scored, ["grp", "method"]).collect()
    value = {(r["grp"], r["method"]): r[cfg.metric] for r in rows}
    chosen = {g: min(cfg.methods, key=lambda m: value[(g, m)]) for g in frames}  # first method wins ties
    comparison = spark.createDataFrame(
        [(r["grp"], r["method"], r["brier_score"], r["log_loss"], r["expected_calibration_error"], chosen[r["grp"]] == r["method"]) for r in rows],
        "grp string, method string, brier_score double, log_loss double, expected_calibration_error double, selected boolean",
    )
    return {g: (m, fitted[(g, m)]) for g, m in chosen.items()}, comparison


def select_calibrator(valid: DataFrame, methods: Sequence[str] = ("platt", "isotonic"), metric: str = "brier_score") -> tuple[str, Platt | KnotTable, DataFrame]:
    picks, table = select_calibrators({"all": valid}, CalibrationConfig(tuple(methods), metric))
    return picks["all"][0], picks["all"][1], table.drop("grp")


@dataclass(frozen=True)
class CalibrationResult:
    valid: DataFrame
    test: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    method: str
    model: Platt | KnotTable
    threshold: float


def calibrate(valid: DataFrame, test: DataFrame, cfg: CalibrationConfig = CalibrationConfig()) -> CalibrationResult:
    """Select a calibrator and a threshold on validation, apply both to validation and test."""
    method, model, comparison = select_calibrator(valid, cfg.methods, cfg.metric)
    scored = {k: predictions(apply_calibrator(d, model), SCORE, cfg.threshold, clip=True) for k, d in (("valid", valid), ("test", test))}
    threshold = resolve_threshold(scored["valid"], cfg.threshold_strategy, cfg.threshold).first()["threshold"]
    final = {k: predictions(d, SCORE, threshold, clip=True) for k, d in scored.items()}
    both = final["valid"].withColumn("split", F.lit("valid")).unionByName(final["test"].withColumn("split", F.lit("test")))
    metrics = match_keys(evaluate(both, ["split"]), expected_calibration_error(both, 10, ["split"]), ["split"])
    return CalibrationResult(final["valid"], final["test"], metrics, comparison, method, model, threshold)


def calibrator_payload(models: Mapping[str, Calibrator], knots_at: Mapping[str, str] | None = None) -> dict:
    """Plain dictionaries for storing fitted calibrators as JSON; a table of knots is named by the path it was written to."""
    return {
        k: {"type": "platt", "coefficient": m.coefficient, "intercept": m.intercept} if isinstance(m, Platt)
        else {"type": "isotonic", "xs": list(m.xs), "ys": list(m.ys)} if isinstance(m, Knots)
        else {"type": "isotonic", "knots": (knots_at or {})[k]}
        for k, m in models.items()
    }
