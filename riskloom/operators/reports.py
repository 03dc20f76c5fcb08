"""Reporting queries over the decisions table and over load-test results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.ordering import exact_quantiles

# Report columns and the spellings each counts. The online path writes "challenged".
DECISION_LABELS: Mapping[str, tuple[str, ...]] = {
    "allowed": ("allowed",), "challenge": ("challenge", "challenged"), "blocked": ("blocked",),
}
STRICT_LABELS: Mapping[str, tuple[str, ...]] = {"allowed": ("allowed",), "challenge": ("challenge",), "blocked": ("blocked",)}


def decision_stats(df: DataFrame, labels: Mapping[str, Sequence[str]] = DECISION_LABELS) -> DataFrame:
    text = F.lower(F.trim("decision"))
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"), *[F.count_if(text.isin(*names)).alias(k) for k, names in labels.items()]
    )


def clamp_limit(limit: int | str | None, default: int = 20, top: int = 100) -> int:
    try:
        number = int(limit)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        number = default
    return max(1, min(number, top))


def recent_transactions(df: DataFrame, limit: int | str | None = 20) -> DataFrame:
    """Latest first; each task keeps only its own top rows before they are merged."""
    return df.orderBy(F.desc_nulls_last("processed_at"), F.desc("transaction_id")).limit(clamp_limit(limit))


def recent_transactions_json(df: DataFrame, limit: int | str | None = 20) -> DataFrame:
    """One JSON text per row: times as UTC with a trailing Z, decimals as numbers, NULLs kept."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            micros = F.date_format(c, "SSSSSS")
            base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            c = F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        fields.append(c.alias(f.name))
    top = recent_transactions(df, limit)
    return top.select("transaction_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def distribution_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``metric, count, min, max, mean, p50, p95, p99`` per column (and group); zeros when empty."""
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*").where(F.col("value").isNotNull())
    keys = [*by, "metric"]
    flat = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    q = exact_quantiles(long, "value", (0.5, 0.95, 0.99), keys).select(
        *keys, F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99")
    )
    out = flat.join(q, keys, "left")
    if not by:
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "metric string")
        out = names.join(out, "metric", "left")
    return out.fillna(0, ["count", "min", "max", "mean", "p50", "p95", "p99"])


def scenario_audit(results: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Per scenario: expected decision, requests, matches, decision counts, score summary.

    Requests count with their errors; matches, decisions and scores leave them out. ``plans``
    (``index, scenario, expected_decision``) defaults to the results themselves.
    """
    plans = results if plans is None else plans
    expected = plans.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.min_by("expected_decision", F.when(F.coalesce(F.col("expected_decision"), F.lit("")) != "", F.col("index"))).alias("expected_decision"),
    )
    good = results.where(F.coalesce(F.col("error"), F.lit("")) == "")
    decided = good.groupBy("scenario", "decision").agg(F.count(F.lit(1)).alias("n"))
    joined = decided.join(expected.select("scenario", F.col("expected_decision").alias("_want")), "scenario")
    counts = joined.groupBy("scenario").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("decision_counts"),
        F.sum(F.when(F.col("decision") == F.col("_want"), F.col("n")).otherwise(0)).alias("matched_count"),
    )
    scores = distribution_summary(good, ["calibrated_score"], ["scenario"])
    scores = scores.select("scenario", *[F.col(c).alias(f"score_{c}") for c in ("count", "min", "max", "mean", "p50", "p95", "p99")])
    out = expected.join(counts, "scenario", "left").join(scores, "scenario", "left")
    matched = F.coalesce("matched_count", F.lit(0))
    return out.withColumns({
        "matched_count": matched, "matched_rate": matched / F.col("request_count"),
        "expected_decision": F.coalesce("expected_decision", F.lit("")),
    }).fillna(0, [f"score_{c}" for c in ("count", "min", "max", "mean", "p50", "p95", "p99")])


RESULT_METRICS = ("client_rtt_ms", "server_total_ms", "profile_lookup_ms", "scoring_ms", "profile_update_ms", "calibrated_score")


def run_summary(plans: DataFrame, results: DataFrame) -> DataFrame:
    """Long form ``section, name, value``: request and error counts, decisions, scenarios, timings.

    Round-trip times count every result, the server-side ones only results without an error.
    """
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    count = lambda section, df, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")
    totals = results.agg(F.count(F.lit(1)).cast("double").alias("requests"), F.count_if(~ok).cast("double").alias("errors"))
    rows = F.array(*[F.struct(F.lit("run").alias("section"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("requests", "errors")])
    out = totals.select(F.explode(rows).alias("r")).select("r.*")
    out = out.unionByName(count("decision", results.where(ok), "decision")).unionByName(count("scenario", plans, "scenario"))
    kept = results.withColumns({c: F.when(ok, F.col(c)) for c in RESULT_METRICS if c != "client_rtt_ms" and c in results.columns})
    timings = distribution_summary(kept, [c for c in RESULT_METRICS if c in results.columns])
    if "feature_count" in plans.columns:
        timings = timings.unionByName(distribution_summary(plans, ["feature_count"]))
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in ("count", "min", "max", "mean", "p50", "p95", "p99")])
    flat = timings.select("metric", F.explode(stats).alias("s")).select(F.col("metric").alias("section"), F.col("s.stat").alias("name"), F.col("s.value").alias("value"))
    return out.unionByName(flat)
