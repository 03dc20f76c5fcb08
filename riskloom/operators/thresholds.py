"""Operating points: alert budgets and precision targets chosen on validation, applied to test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import any_of, ratio_or_zero
from riskloom.operators.metrics import LABEL, SCORE, score_curve, threshold_curve, with_prf


@dataclass(frozen=True)
class BudgetConfig:
    alerts_per_1k: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0, 20.0)
    precision_targets: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5)


def _targets(df: DataFrame, values: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(float(v),) for v in values], "target double")


def alert_budget_threshold(df: DataFrame, alerts_per_1k: Sequence[float], curve: DataFrame | None = None) -> DataFrame:
    """``target, threshold``: the k-th largest score with k = ceil(a/1000 * n) within 1..n; 1.0 when empty."""
    curve = score_curve(df) if curve is None else curve
    picks = []
    for i, a in enumerate(alerts_per_1k):
        k = F.greatest(F.lit(1), F.least(F.ceil(F.lit(a / 1000.0) * F.col("total_n").cast("double")), F.col("total_n")))
        picks.append(F.coalesce(F.max(F.when(F.col("cum_n") >= k, F.col(SCORE))), F.lit(1.0)).alias(f"t{i}"))
    rows = F.array(*[F.struct(F.lit(float(a)).alias("target"), F.col(f"t{i}").alias("threshold")) for i, a in enumerate(alerts_per_1k)])
    return curve.agg(*picks).select(F.explode(rows).alias("r")).select("r.*")


def precision_target_threshold(df: DataFrame, targets: Sequence[float], curve: DataFrame | None = None) -> DataFrame:
    """``target, feasible, threshold``: highest recall, then threshold, among points meeting the precision."""
    points = threshold_curve(df, curve=curve)
    picks = [
        F.max_by(SCORE, F.when(F.col("precision") + 1e-12 >= t, F.struct("recall", SCORE))).alias(f"t{i}")
        for i, t in enumerate(targets)
    ]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"t{i}").alias("threshold")) for i, t in enumerate(targets)])
    best = points.agg(*picks).select(F.explode(rows).alias("r")).select("r.*")
    return best.select("target", F.col("threshold").isNotNull().alias("feasible"), "threshold")


def metrics_at_thresholds(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Operating metrics at every threshold: one aggregate, conditional counts per threshold."""
    y = F.col(LABEL).cast("int")
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(y == 1).alias("positives")]
    for i, t in enumerate(thresholds):
        flagged = F.col(SCORE) >= F.lit(float(t))
        aggs += [F.count_if(flagged).alias(f"a{i}"), F.count_if(flagged & (y == 1)).alias(f"tp{i}")]
    items = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("alerts"), F.col(f"tp{i}").alias("tp"))
        for i, t in enumerate(thresholds)
    ])
    long = df.groupBy(*by).agg(*aggs).select(*by, "rows", "positives", F.explode(items).alias("r")).select(*by, "r.threshold", "rows", "positives", "r.alerts", "r.tp")
    counted = long.withColumns({"fp": F.col("alerts") - F.col("tp"), "fn": F.col("positives") - F.col("tp")})
    rate = ratio_or_zero("alerts", "rows")
    return with_prf(counted).withColumns({"alerts_per_1k": F.lit(1000.0) * rate, "alert_rate": rate})


def operating_points(valid: DataFrame, test: DataFrame, cfg: BudgetConfig = BudgetConfig()) -> DataFrame:
    """One row per budget and precision target with valid and test metrics and the recommended ones marked."""
    curve = score_curve(valid)
    budgets = alert_budget_threshold(valid, cfg.alerts_per_1k, curve).collect()
    targets = precision_target_threshold(valid, cfg.precision_targets, curve).collect()
    rows = [("alert_budget", r["target"], True, r["threshold"]) for r in budgets]
    rows += [("precision_target", r["target"], r["feasible"], r["threshold"]) for r in targets]
    points = valid.sparkSession.createDataFrame(
        rows, "selection_type string, selection_value double, feasible boolean, threshold double"
    )
    distinct = sorted({r[3] for r in rows if r[3] is not None})
    for side, frame in (("valid", valid), ("test", test)):
        m = metrics_at_thresholds(frame, distinct)
        m = m.select("threshold", *[F.col(c).alias(f"{side}_{c}") for c in m.columns if c != "threshold"])
        points = points.join(m, "threshold", "left")
    return _mark_recommended(points)


def _mark_recommended(points: DataFrame) -> DataFrame:
    budget = F.when(F.col("selection_type") == "alert_budget", F.struct("valid_f1", "valid_precision", -F.col("selection_value")))
    target = F.when((F.col("selection_type") == "precision_target") & F.col("feasible"), F.struct("valid_recall", "selection_value"))
    best = points.agg(F.max_by("selection_value", budget).alias("_b"), F.max_by("selection_value", target).alias("_t"), F.lit(1).alias("_one"))
    joined = points.withColumn("_one", F.lit(1)).join(best, "_one")
    chosen = any_of([
        (F.col("selection_type") == "alert_budget") & F.col("selection_value").eqNullSafe(F.col("_b")),
        (F.col("selection_type") == "precision_target") & F.col("selection_value").eqNullSafe(F.col("_t")),
    ])
    return joined.withColumn("recommended", chosen).drop("_one", "_b", "_t")


def operating_table(points: DataFrame) -> DataFrame:
    """Flat table; an infeasible target keeps its row with NULL metrics."""
    return points.select(
        "selection_type", "selection_value", "threshold",
        *[f"{s}_{c}" for s in ("valid", "test") for c in ("precision", "recall", "f1")], "test_alerts_per_1k",
    )
