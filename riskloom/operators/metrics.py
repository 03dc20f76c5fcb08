"""Classifier metrics of (is_fraud, score, predicted_label) tables, optionally per group.

Rank metrics work on distinct scores with counts and running totals along the score, so neither
the table nor one group is ever sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import clip_probability, ratio_or_zero
from riskloom.operators.ordering import exact_quantiles, quantile_grid, running_totals

LABEL = "is_fraud"
SCORE = "score"
PREDICTED = "predicted_label"


def _label() -> Column:
    return F.col(LABEL).cast("int")


def match_keys(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``right``, one row per group, to ``left``; without groups that is a single row."""
    if by:
        return left.join(right, list(by), how)
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(F.broadcast(right.select("*", one)), "_one", how).drop("_one")


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    y, p = _label(), F.col(PREDICTED).cast("int")
    counts = df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.avg(y.cast("double")).alias("positive_rate"),
    )
    return with_prf(counts)


def with_prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 on empty denominators."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    })


def _log_loss(p: Column) -> Column:
    q = clip_probability(p, 1e-7)
    return F.avg(-F.when(_label() == 1, F.ln(q)).otherwise(F.ln(1.0 - q)))


def accuracy_log_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = ((F.col(SCORE) >= 0.5).cast("int") == _label()).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), _log_loss(F.col(SCORE)).alias("log_loss"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    miss = F.col(SCORE) - _label()
    return df.groupBy(*by).agg(F.avg(miss * miss).alias("brier_score"))


def score_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first: counts ``n, pos`` with running and overall totals."""
    counts = df.groupBy(*by, SCORE).agg(F.count(F.lit(1)).alias("n"), F.sum(_label().cast("bigint")).alias("pos"))
    return running_totals(counts, SCORE, ["n", "pos"], by)


def rank_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC AUC from a score curve; AUC is NULL with a single class."""
    neg = F.col("n") - F.col("pos")
    ap = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    # A negative is outranked by the positives above it and ties with half of those at its score.
    wins = F.sum(neg * (F.col("cum_pos") - F.col("pos") / F.lit(2.0)))
    total_pos, total_neg = F.max("total_pos"), F.max(F.col("total_n") - F.col("total_pos"))
    return curve.groupBy(*by).agg(
        F.coalesce(F.when(total_pos > 0, ap / total_pos), F.lit(0.0)).alias("average_precision"),
        F.when((total_pos > 0) & (total_neg > 0), wins / (total_pos.cast("double") * total_neg)).alias("roc_auc"),
    )


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(score_curve(df, by), by).select(*by, "average_precision")


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(score_curve(df, by), by).select(*by, "roc_auc")


def quantile_calibration_bins(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and observed rate in bins between exact score quantiles; empty bins are absent."""
    edges = exact_quantiles(df, SCORE, quantile_grid(n), by)
    inner = edges.select(*by, F.array(*[f"q{i}" for i in range(1, n)]).alias("_edges"))
    # Scores collapse to distinct values first; the edges are one row per group.
    counts = df.groupBy(*by, SCORE).agg(F.count(F.lit(1)).alias("n"), F.sum(_label().cast("bigint")).alias("pos"))
    binned = match_keys(counts, inner, by).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col(SCORE))).cast("bigint")
    )
    return binned.groupBy(*by, "bin").agg(
        (F.sum(F.col(SCORE) * F.col("n")) / F.sum("n")).alias("mean_predicted_probability"),
        (F.sum("pos") / F.sum("n")).alias("observed_positive_rate"),
        F.sum("n").alias("n"),
    )


def threshold_curve(df: DataFrame, by: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 when everything at or above each distinct score is flagged."""
    curve = score_curve(df, by) if curve is None else curve
    p = F.col("cum_pos") / F.col("cum_n")
    r = F.when(F.col("total_pos") > 0, F.col("cum_pos") / F.col("total_pos")).otherwise(F.lit(1.0))
    out = curve.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def best_f1_threshold(df: DataFrame, by: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """Exact search over the distinct scores; F1 ties within 1e-12 go to higher precision, then threshold."""
    points = threshold_curve(df, by, curve)
    best = points.groupBy(*by).agg(F.max("f1").alias("_best"))
    tied = match_keys(points, best, by).where(F.col("f1") >= F.col("_best") - 1e-12)
    pick = F.max_by(F.struct(F.col(SCORE).alias("threshold"), F.col("_best").alias("f1"), "precision", "recall"), F.struct("precision", SCORE))
    chosen = tied.groupBy(*by).agg(pick.alias("r"))
    if by:
        return chosen.select(*by, "r.*")
    default = F.struct(F.lit(0.5).alias("threshold"), *[F.lit(0.0).alias(c) for c in ("f1", "precision", "recall")])
    return chosen.select(F.coalesce("r", default).alias("r")).select("r.*")


def resolve_threshold(df: DataFrame, strategy: str = "validation_f1", fixed: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    if strategy == "validation_f1":
        return best_f1_threshold(df, by).withColumn("strategy", F.lit(strategy))
    if strategy == "fixed":
        groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
        return groups.select(*by, F.lit(float(fixed)).alias("threshold"), F.lit(strategy).alias("strategy"))
    raise ValueError(f"unsupported threshold strategy: {strategy}")


def apply_threshold(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add predicted labels from one threshold row per group."""
    chosen = thresholds.select(*by, F.col("threshold").alias("_thr"))
    return match_keys(df, chosen, by).withColumn(PREDICTED, (F.col(SCORE) >= F.col("_thr")).cast("int")).drop("_thr")


def evaluate(df: DataFrame, by: Sequence[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """All scalar metrics: two passes over the data, one aggregate and one score curve."""
    y, p, s = _label(), F.col(PREDICTED).cast("int"), F.col(SCORE)
    hit = ((s >= 0.5).cast("int") == y).cast("double")
    miss = s - y
    flat = with_prf(df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.avg(y.cast("double")).alias("positive_rate"), F.avg(hit).alias("accuracy"),
        _log_loss(s).alias("log_loss"), F.avg(miss * miss).alias("brier_score"),
    ))
    ranked = rank_metrics(score_curve(df, by) if curve is None else curve, by)
    return match_keys(flat, ranked, by, "left")


def score_summary(pred: DataFrame) -> DataFrame:
    return pred.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.min(SCORE).alias("min_score"), F.max(SCORE).alias("max_score"),
        F.avg(SCORE).alias("mean_score"), F.sum(F.col(PREDICTED).cast("bigint")).alias("positive_predictions"),
        (F.count(LABEL) > 0).alias("labels_available"),
    )


def stack_scores(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("transaction_id", LABEL), into: str = "branch", suffix: str = "_score") -> DataFrame:
    """Wide branch scores to rows (branch, score)."""
    items = F.array(*[F.struct(F.lit(n).alias(into), F.col(f"{n}{suffix}").cast("double").alias(SCORE)) for n in names])
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def stack_columns(df: DataFrame, scores: Mapping[str, Column], keep: Sequence[str | Column], into: str) -> DataFrame:
    """Named score expressions to rows (name, score).

    The expressions become columns first: inside the generator they would leave code generation.
    """
    wide = df.select(*keep, *[e.cast("double").alias(f"_c{i}") for i, e in enumerate(scores.values())])
    items = F.array(*[F.struct(F.lit(n).alias(into), F.col(f"_c{i}").alias(SCORE)) for i, n in enumerate(scores)])
    kept = [c for c in wide.columns if not c.startswith("_c")]
    return wide.select(*kept, F.explode(items).alias("_i")).select(*kept, "_i.*")


def top_errors(pred: DataFrame, n: int = 50) -> DataFrame:
    """Worst false positives (highest score) and false negatives (lowest score), ties by id."""
    y, p = F.col(LABEL).cast("int"), F.col(PREDICTED).cast("int")
    sides = (
        ("false_positive", (y == 0) & (p == 1), F.desc(SCORE)),
        ("false_negative", (y == 1) & (p == 0), F.asc(SCORE)),
    )
    parts = []
    for kind, which, direction in sides:
        top = pred.where(which).orderBy(direction, "transaction_id").limit(n)
        rank = F.row_number().over(W.orderBy(direction, "transaction_id"))
        parts.append(top.select(F.lit(kind).alias("kind"), rank.cast("bigint").alias("rank"), "transaction_id", LABEL, SCORE, PREDICTED))
    return reduce(DataFrame.unionByName, parts)


def usefulness_report(metrics: DataFrame, split: str = "split") -> DataFrame:
    """One row: valid and test F1 and AP; useful when test AP >= 0.1 and test F1 >= 0.05."""
    at = lambda name, c: F.coalesce(F.max(F.when(F.col(split) == name, F.col(c))), F.lit(0.0)).alias(f"{name}_{c}")
    row = metrics.agg(*[at(s, c) for s in ("valid", "test") for c in ("f1", "average_precision")])
    return row.withColumn("useful", (F.col("test_average_precision") >= 0.1) & (F.col("test_f1") >= 0.05))


def branch_report(pred: DataFrame, strategy: str = "validation_f1", fixed: float = 0.5, split: str = "split") -> DataFrame:
    """Per split the metrics at the threshold chosen on ``valid`` and at 0.5."""
    threshold = resolve_threshold(pred.where(F.col(split) == "valid"), strategy, fixed).first()["threshold"]
    modes = F.array(
        F.struct(F.lit("selected").alias("mode"), F.lit(threshold).alias("threshold")),
        F.struct(F.lit("baseline").alias("mode"), F.lit(0.5).alias("threshold")),
    )
    both = (
        pred.withColumn("_m", F.explode(modes)).select("*", "_m.*").drop("_m")
        .withColumn(PREDICTED, (F.col(SCORE) >= F.col("threshold")).cast("int"))
    )
    return evaluate(both, [split, "mode", "threshold"])
