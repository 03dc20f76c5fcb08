"""Drift, latency, data quality and rollback checks on scoring logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import severity
from riskloom.operators.metrics import SCORE, evaluate, match_keys
from riskloom.operators.ordering import exact_quantiles, place, quantile_grid, quantiles_of_counts, totals_along


@dataclass(frozen=True)
class DriftConfig:
    fields: tuple[str, ...] = ("raw_fused_score", "calibrated_score")
    warning: float = 0.1
    critical: float = 0.25
    bins: int = 10


FEATURE_DRIFT = DriftConfig(("amount", "c1", "c14", "v258", "v201", "id_02"), 0.15, 0.3)


@dataclass(frozen=True)
class LatencyConfig:
    p50_ms: float = 25.0
    p95_ms: float = 75.0
    p99_ms: float = 150.0
    critical_p99_ms: float = 300.0


@dataclass(frozen=True)
class QualityConfig:
    max_contract_mismatch_rate: float = 0.005
    max_rebuild_rate: float = 0.05
    max_missing_feature_rate: float = 0.001
    duplicate_transaction_ids: int = 0


@dataclass(frozen=True)
class RetrainingConfig:
    psi: float = 0.25
    precision_drop: float = 0.08
    recall_drop: float = 0.08
    brier_increase: float = 0.02
    contract_mismatch_rate: float = 0.01
    volume_growth_ratio: float = 1.25
    minimum_new_rows: int = 50_000
    label_coverage: float = 0.9


ROLLBACK_DROPS: Mapping[str, float] = {"average_precision": 0.05, "f1": 0.05, "roc_auc": 0.03}


def _value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, n`` of the finite values: grouped before anything else happens."""
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    long = df.select(F.explode(items).alias("_i")).select("_i.*")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def psi_by_field(ref: DataFrame, cur: DataFrame, fields: Sequence[str], bins: int = 10) -> DataFrame:
    """``field, psi``: shares between the reference's distinct quantile edges; current values outside
    the reference range are dropped, shares floored at 1e-9, 0 when there is nothing to compare."""
    placed = place(_value_counts(ref, fields), "value", ["field"], descending=False)
    curve = totals_along(placed, "value", ["n"], ["field"], descending=False)
    q = quantiles_of_counts(curve, "value", quantile_grid(bins), ["field"])
    edges = q.select("field", F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)]))).alias("edges"))
    # The staged table already holds the reference counts: each side is read and grouped once.
    none = F.lit(0).cast("bigint")
    both = placed.select("field", "value", F.col("n").alias("ref"), none.alias("cur")).unionByName(
        _value_counts(cur, fields).select("field", "value", none.alias("ref"), F.col("n").alias("cur"))
    )
    # Edges hold one short array per configured field.
    located = both.join(F.broadcast(edges), "field")
    inside = (F.size("edges") > 1) & (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1)
    hist = located.groupBy("field", F.when(inside, at).otherwise(0).alias("bin")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    # At most bins + 1 rows per field. A bin that is empty on both sides adds nothing, so it may be absent.
    inner = lambda side: F.sum(F.when(F.col("bin") > 0, F.col(side)))
    per_field = hist.groupBy("field").agg(
        inner("ref").alias("_r"), inner("cur").alias("_c"), F.sum("cur").alias("_any"),
        F.collect_list(F.when(F.col("bin") > 0, F.struct("ref", "cur"))).alias("_bins"),
    )

    def term(b):
        r, c = (F.greatest(b[side] / F.greatest(F.col(total), F.lit(1)), F.lit(1e-9)) for side, total in (("ref", "_r"), ("cur", "_c")))
        return (c - r) * F.ln(c / r)

    value = F.aggregate(F.transform("_bins", term), F.lit(0.0), lambda acc, x: acc + x)
    # No current value at all means nothing to compare, not total drift.
    found = per_field.select("field", F.when(F.col("_any") > 0, value).otherwise(F.lit(0.0)).alias("psi"))
    named = ref.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return named.join(F.broadcast(found), "field", "left").select("field", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi(ref: DataFrame, cur: DataFrame, column: str, bins: int = 10) -> DataFrame:
    return psi_by_field(ref, cur, [column], bins).select("psi")


def score_drift(ref: DataFrame, cur: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    found = psi_by_field(ref, cur, cfg.fields, cfg.bins)
    return found.withColumn("severity", severity("psi", cfg.warning, cfg.critical))


def feature_drift(ref: DataFrame, cur: DataFrame, cfg: DriftConfig = FEATURE_DRIFT) -> DataFrame:
    """As score drift; a tracked feature that one side lacks has severity ``missing`` and no value."""
    present = [f for f in cfg.fields if f in ref.columns and f in cur.columns]
    absent = [(f, None, "missing") for f in cfg.fields if f not in present]
    schema = "feature string, psi double, severity string"
    out = ref.sparkSession.createDataFrame(absent, schema)
    if present:
        found = score_drift(ref, cur, DriftConfig(tuple(present), cfg.warning, cfg.critical, cfg.bins))
        out = found.withColumnRenamed("field", "feature").unionByName(out)
    return out


def latency_report(df: DataFrame, column: str = "latency_ms", cfg: LatencyConfig = LatencyConfig(), by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Exact p50/p95/p99 and severity; ``approximate`` trades exactness for a single pass."""
    if approximate:
        parts = F.percentile_approx(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10_000)
        q = df.groupBy(*by).agg(F.count(column).alias("samples"), parts.alias("_p")).select(
            *by, "samples", *[F.col("_p")[i].alias(f"q{i}") for i in range(3)]
        )
    else:
        q = exact_quantiles(df, column, (0.5, 0.95, 0.99), by)
    named = q.select(*by, "samples", F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"), F.col("q2").alias("p99_ms"))
    slow = (F.col("p50_ms") >= cfg.p50_ms) | (F.col("p95_ms") >= cfg.p95_ms) | (F.col("p99_ms") >= cfg.p99_ms)
    level = F.when(F.col("p99_ms") >= cfg.critical_p99_ms, "critical").when(slow, "warning").otherwise("ok")
    return named.withColumn("severity", level)


def data_quality(log: DataFrame, cfg: QualityConfig = QualityConfig(), key: str = "transaction_id") -> DataFrame:
    """Rates over a scoring log with flags ``contract_mismatch, rebuilt`` and ``missing_features, is_fraud``.

    Ids are counted per id first, so duplicates need no global distinct.
    """
    per_id = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("contract_mismatch").alias("cm"), F.count_if("rebuilt").alias("rb"),
        F.sum("missing_features").alias("mf"), F.count_if(F.col("is_fraud").isNull()).alias("nl"),
    )
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_scored"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cm", "rb", "mf", "nl")],
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_transaction_id_count"),
    )
    rate = lambda c: F.col(c) / F.greatest("rows_scored", F.lit(1))
    out = totals.select(
        "rows_scored", rate("cm").alias("contract_mismatch_rate"), rate("rb").alias("rebuild_rate"),
        rate("mf").alias("missing_feature_rate"), "duplicate_transaction_id_count", rate("nl").alias("null_label_rate"),
    )
    limits = {
        "contract_mismatch_rate": cfg.max_contract_mismatch_rate, "rebuild_rate": cfg.max_rebuild_rate,
        "missing_feature_rate": cfg.max_missing_feature_rate, "duplicate_transaction_id_count": cfg.duplicate_transaction_ids,
    }
    breaches = F.filter(F.array(*[F.when(F.col(c) > limit, F.lit(c)) for c, limit in limits.items()]), lambda b: b.isNotNull())
    return out.withColumn("breaches", breaches).withColumn("severity", F.when(F.size("breaches") > 0, "critical").otherwise("ok"))


def rollback_check(active_log: DataFrame, baseline_log: DataFrame, thresholds: Mapping[str, float] = ROLLBACK_DROPS) -> DataFrame:
    """``metric, active, baseline, drop, breached`` from two logs of labelled, scored transactions."""
    both = active_log.select("is_fraud", SCORE, "predicted_label", F.lit("active").alias("side")).unionByName(
        baseline_log.select("is_fraud", SCORE, "predicted_label", F.lit("baseline").alias("side"))
    )
    m = evaluate(both, ["side"])
    wide = m.agg(*[F.max(F.when(F.col("side") == s, F.col(k))).alias(f"{s}_{k}") for s in ("active", "baseline") for k in thresholds])
    rows = F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(f"active_{k}").alias("active"), F.col(f"baseline_{k}").alias("baseline"), F.lit(float(t)).alias("limit"))
        for k, t in thresholds.items()
    ])
    long = wide.select(F.explode(rows).alias("r")).select("r.*").where(F.col("active").isNotNull() & F.col("baseline").isNotNull())
    return long.withColumn("drop", F.col("baseline") - F.col("active")).withColumn("breached", F.col("drop") >= F.col("limit")).drop("limit")


# --- declared in configuration only: extensions, not parity ---------------------------------

def windowed_monitoring(log: DataFrame, ts: str = "processed_at", minutes: int = 60, consecutive: int = 2, latency: str = "latency_ms", limit: float = 75.0) -> DataFrame:
    """Extension. Mean latency per window; critical when ``consecutive`` adjacent windows breach."""
    return breach_severity(latency_windows(log.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")), ts, minutes, latency, limit), minutes, consecutive)


def latency_windows(log: DataFrame, ts: str, minutes: int, latency: str, limit: float) -> DataFrame:
    """``window_start, n, mean_latency_ms, breach`` of a table or a stream with a watermark."""
    windows = log.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency_ms"))
    return windows.select(F.col("w.start").alias("window_start"), "n", "mean_latency_ms", (F.col("mean_latency_ms") >= limit).alias("breach"))


def breach_severity(rows: DataFrame, minutes: int = 60, consecutive: int = 2) -> DataFrame:
    # One row per window: bounded by time, not by traffic. A window without traffic ends a run.
    step = minutes * 60
    along = W.orderBy(F.unix_seconds("window_start")).rangeBetween(-step * (consecutive - 1), 0)
    run = F.count_if("breach").over(along)
    level = F.when(run >= consecutive, "critical").when(F.col("breach"), "warning").otherwise("ok")
    return rows.withColumn("severity", level)


def retraining_triggers(reference_log: DataFrame, current_log: DataFrame, cfg: RetrainingConfig = RetrainingConfig(), field_name: str = "calibrated_score") -> DataFrame:
    """Extension. ``trigger, value, limit, fired`` from a reference and a current scoring log."""
    drift = psi(reference_log, current_log, field_name).select(F.col("psi").alias("score_drift_psi"))
    flat = lambda df: df.select("is_fraud", SCORE, "predicted_label")
    stacked = flat(reference_log).withColumn("side", F.lit("ref")).unionByName(flat(current_log).withColumn("side", F.lit("cur")))
    m = evaluate(stacked, ["side"])
    at = lambda s, k: F.max(F.when(F.col("side") == s, F.col(k)))
    changes = m.agg(
        (at("ref", "precision") - at("cur", "precision")).alias("precision_drop_absolute"),
        (at("ref", "recall") - at("cur", "recall")).alias("recall_drop_absolute"),
        (at("cur", "brier_score") - at("ref", "brier_score")).alias("brier_score_increase_absolute"),
        (at("cur", "n") / at("ref", "n")).alias("data_volume_growth_ratio"),
        at("cur", "n").cast("double").alias("minimum_new_rows"),
    )
    quality = current_log.agg(
        F.avg(F.col("contract_mismatch").cast("double")).alias("contract_mismatch_rate"),
        F.avg(F.col("is_fraud").isNotNull().cast("double")).alias("label_coverage_ratio"),
    )
    row = match_keys(match_keys(drift, changes, ()), quality, ())
    limits = {
        "score_drift_psi": cfg.psi, "precision_drop_absolute": cfg.precision_drop, "recall_drop_absolute": cfg.recall_drop,
        "brier_score_increase_absolute": cfg.brier_increase, "contract_mismatch_rate": cfg.contract_mismatch_rate,
        "data_volume_growth_ratio": cfg.volume_growth_ratio, "minimum_new_rows": float(cfg.minimum_new_rows),
        "label_coverage_ratio": cfg.label_coverage,
    }
    items = F.array(*[F.struct(F.lit(k).alias("trigger"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit")) for k, v in limits.items()])
    return row.select(F.explode(items).alias("r")).select("r.*").withColumn("fired", F.col("value") >= F.col("limit"))

