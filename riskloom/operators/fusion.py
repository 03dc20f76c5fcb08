"""Fusing the scores of several models, and choosing the fusion on validation data.

Every candidate is a column expression, so all candidates are scored in one pass: they are
stacked to rows and ranked by one grouped score curve. Only per-branch and per-candidate numbers
reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators.metrics import LABEL, PREDICTED, SCORE, average_precision, evaluate, rank_metrics, resolve_threshold, score_curve, stack_columns, stack_scores

SCORE_SUFFIX = "_score"
CANDIDATES = ("best_branch", "mean_top_k", "geometric_mean_top_k", "ap_weighted_average", "logistic_meta", "bayesian_reliability")


@dataclass(frozen=True)
class FusionConfig:
    mode: str = "auto_select"
    threshold: float = 0.5
    threshold_strategy: str = "validation_f1"
    weights: Mapping[str, float] | None = None
    logistic_c: float = 1.0
    logistic_max_iter: int = 500
    alpha_prior: float = 1.0
    beta_prior: float = 1.0
    metric: str = "average_precision"
    complexity_penalty: float = 2.5e-4
    min_branch_ap: float = 1.0e-3
    max_branches: int = 3
    candidates: tuple[str, ...] = CANDIDATES


@dataclass(frozen=True)
class FusionRecipe:
    """A stored way to fuse: candidate name, branches, one weight per branch, intercept."""

    candidate: str
    branches: tuple[str, ...]
    weights: tuple[float, ...] = ()
    intercept: float = 0.0
    metric: float | None = None
    selection_score: float | None = None

    def column(self) -> Column:
        cols = [f"{b}{SCORE_SUFFIX}" for b in self.branches]
        if self.candidate == "best_branch":
            return F.col(cols[0])
        if self.candidate == "mean_top_k":
            return C.mean_top_k(cols)
        if self.candidate == "geometric_mean_top_k":
            return C.geometric_mean(cols)
        if self.candidate in ("ap_weighted_average", "weighted_average"):
            return C.weighted_average(cols, self.weights or None)
        if self.candidate == "logistic_meta":
            return C.linear_probability(cols, self.weights, self.intercept)
        if self.candidate == "bayesian_reliability":
            return C.reliability_weighted(cols, self.weights)
        raise ValueError(f"unsupported fusion candidate: {self.candidate}")


def branch_names(df: DataFrame) -> list[str]:
    names = [c[: -len(SCORE_SUFFIX)] for c in df.columns if c.endswith(SCORE_SUFFIX)]
    if not names:
        raise ValueError("no branch score column")
    return names


def branch_ap(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return average_precision(stack_scores(df, names or branch_names(df)), ["branch"])


def rank_branches(ap: DataFrame) -> DataFrame:
    """Best first by (AP, name) descending."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("average_precision"), F.desc("branch"))  # one row per branch
    return ap.withColumn("rank", F.row_number().over(order).cast("bigint"))


def branch_pool(ap: DataFrame, min_ap: float = 1e-3, max_branches: int = 3) -> DataFrame:
    """Branches at or above ``min_ap`` (else the best one), at most ``max_branches``."""
    ranked = rank_branches(ap)
    return ranked.where((F.col("average_precision") >= min_ap) | (F.col("rank") == 1)).where(F.col("rank") <= max(1, max_branches))


def _ap_by_branch(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    return {r["branch"]: r["average_precision"] for r in branch_ap(df, names).collect()}


def _pool(ap: Mapping[str, float], cfg: FusionConfig) -> list[str]:
    ranked = sorted(ap, key=lambda b: (ap[b], b), reverse=True)
    good = [b for b in ranked if ap[b] >= cfg.min_branch_ap] or ranked[:1]
    return good[: max(1, cfg.max_branches)]


def fit_balanced_logistic(df: DataFrame, cols: Sequence[str], c: float = 1.0, max_iter: int = 500, weight: str | None = None, balanced: bool = True) -> tuple[list[float], float]:
    """L2 logistic regression with (optionally) balanced class weights: coefficients and intercept."""
    base = df.select(F.coalesce(F.col(LABEL).cast("double"), F.lit(0.0)).alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *[F.col(x).cast("double").alias(x) for x in cols])
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.sum("_w").alias("n")).collect()}
    total = sum(sizes.values())
    scale = F.lit(1.0)
    if balanced:
        for label, n in sizes.items():
            scale = F.when(F.col("label") == label, F.lit(total / (len(sizes) * n))).otherwise(scale)
    weighted = base.withColumn("weight", F.col("_w") * scale)
    ready = VectorAssembler(inputCols=list(cols), outputCol="features").transform(weighted)
    # Weights sum to the row count in both cases, which turns C into MLlib's regParam.
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9
    ).fit(ready.select("label", "weight", "features"))
    return [float(v) for v in model.coefficients], float(model.intercept)


def logistic_meta(train: DataFrame, branches: Sequence[str], c: float = 1.0, max_iter: int = 500) -> FusionRecipe:
    coefficients, intercept = fit_balanced_logistic(train, [f"{b}{SCORE_SUFFIX}" for b in branches], c, max_iter)
    return FusionRecipe("logistic_meta", tuple(branches), tuple(coefficients), intercept)


def branch_reliability(valid: DataFrame, names: Sequence[str] | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """``branch, alpha, beta, posterior_mean, average_entropy, reliability_weight`` from one aggregate."""
    long = stack_scores(valid, names or branch_names(valid))
    hit = ((C.clip_probability(SCORE, 1e-9) >= 0.5).cast("int") == F.coalesce(F.col(LABEL).cast("int"), F.lit(0))).cast("bigint")
    per = long.groupBy("branch").agg(
        F.sum(hit).alias("correct"), F.count(F.lit(1)).alias("n"), F.avg(C.binary_entropy(SCORE)).alias("average_entropy")
    )
    a, b = F.lit(float(alpha)) + F.col("correct"), F.lit(float(beta)) + F.col("n") - F.col("correct")
    return (
        per.withColumns({"alpha": a, "beta": b})
        .withColumn("posterior_mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        .withColumn("reliability_weight", F.col("posterior_mean") / F.greatest("average_entropy", F.lit(1e-9)))
        .select("branch", "alpha", "beta", "posterior_mean", "average_entropy", "reliability_weight")
    )


def reliability_recipe(valid: DataFrame, branches: Sequence[str], cfg: FusionConfig) -> FusionRecipe:
    rows = branch_reliability(valid, branches, cfg.alpha_prior, cfg.beta_prior).collect()
    by_name = {r["branch"]: r["reliability_weight"] for r in rows}
    return FusionRecipe("bayesian_reliability", tuple(branches), tuple(by_name[b] for b in branches))


def candidate_recipes(valid: DataFrame, pool: Sequence[str], ap: Mapping[str, float], cfg: FusionConfig) -> list[FusionRecipe]:
    """The candidates for one branch pool; with one branch only ``best_branch``."""
    wanted = set(cfg.candidates)
    pool = tuple(pool)
    best = FusionRecipe("best_branch", pool[:1])
    if len(pool) == 1:
        return [best]
    makers = {
        "best_branch": lambda: best,
        "mean_top_k": lambda: FusionRecipe("mean_top_k", pool),
        "geometric_mean_top_k": lambda: FusionRecipe("geometric_mean_top_k", pool),
        "ap_weighted_average": lambda: FusionRecipe("ap_weighted_average", pool, tuple(ap[b] for b in pool)),
        "logistic_meta": lambda: logistic_meta(valid, pool, cfg.logistic_c, cfg.logistic_max_iter),
        "bayesian_reliability": lambda: reliability_recipe(valid, pool, cfg),
    }
    names = [n for n in CANDIDATES if n in wanted] or list(CANDIDATES)
    return [makers[n]() for n in names]


def rank_recipes(valid: DataFrame, groups: Mapping[str, Sequence[FusionRecipe]], cfg: FusionConfig) -> dict[str, list[FusionRecipe]]:
    """Score the recipes of all groups in one pass; each group's list comes back best first."""
    if cfg.metric not in ("average_precision", "roc_auc"):
        raise ValueError(f"unsupported selection metric: {cfg.metric}")
    distinct = list(dict.fromkeys(r for recipes in groups.values() for r in recipes))
    long = stack_columns(valid, {str(i): r.column() for i, r in enumerate(distinct)}, [LABEL], "entry")
    rows = rank_metrics(score_curve(long, ["entry"]), ["entry"]).collect()
    found = {distinct[int(r["entry"])]: r[cfg.metric] for r in rows}
    out: dict[str, list[FusionRecipe]] = {}
    for g, recipes in groups.items():
        out[g] = []
        for r in recipes:
            value = found[r] if found[r] is not None else float("nan")
            extra = len(r.branches) - 1
            out[g].append(replace(r, metric=value, selection_score=value - cfg.complexity_penalty * extra))
        out[g].sort(key=lambda r: (r.selection_score, r.metric, -len(r.branches)), reverse=True)
    return out


def leaderboard_frame(like: DataFrame, recipes: Sequence[FusionRecipe]) -> DataFrame:
    return like.sparkSession.createDataFrame(
        [(i + 1, r.candidate, ",".join(r.branches), len(r.branches), r.metric, r.selection_score, i == 0) for i, r in enumerate(recipes)],
        "rank bigint, candidate string, branches string, branch_count bigint, validation_metric double, selection_score double, selected boolean",
    )


def auto_select(valid: DataFrame, target: DataFrame, cfg: FusionConfig = FusionConfig()) -> tuple[DataFrame, DataFrame, FusionRecipe]:
    """(target with ``raw_fused_score``, leaderboard, selected recipe)."""
    ap = _ap_by_branch(valid, branch_names(valid))
    ranked = rank_recipes(valid, {"all": candidate_recipes(valid, _pool(ap, cfg), ap, cfg)}, cfg)["all"]
    return apply_fusion(target, ranked[0]), leaderboard_frame(valid, ranked), ranked[0]


def fit_recipe(valid: DataFrame, cfg: FusionConfig) -> FusionRecipe:
    names = branch_names(valid)
    if cfg.mode == "auto_select":
        ap = _ap_by_branch(valid, names)
        return rank_recipes(valid, {"all": candidate_recipes(valid, _pool(ap, cfg), ap, cfg)}, cfg)["all"][0]
    if cfg.mode == "weighted_average":
        w = tuple(float((cfg.weights or {}).get(n, 0.0)) for n in names) if cfg.weights is not None else ()
        return FusionRecipe("weighted_average", tuple(names), w)
    if cfg.mode == "logistic_meta":
        return logistic_meta(valid, names, cfg.logistic_c, cfg.logistic_max_iter)
    if cfg.mode == "bayesian_reliability":
        return reliability_recipe(valid, names, cfg)
    raise ValueError(f"unsupported fusion mode: {cfg.mode}")


def fuse(valid: DataFrame, target: DataFrame, cfg: FusionConfig = FusionConfig()) -> tuple[DataFrame, FusionRecipe]:
    recipe = fit_recipe(valid, cfg)
    return apply_fusion(target, recipe), recipe


def apply_fusion(df: DataFrame, recipe: FusionRecipe, out: str = "raw_fused_score") -> DataFrame:
    return df.withColumn(out, recipe.column())


def predictions(df: DataFrame, score: str, threshold: float, clip: bool = False) -> DataFrame:
    """Traceable prediction table; the label is 1 at or above the threshold."""
    value = F.col(score).cast("double")
    value = C.clamp01(value) if clip else value
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.coalesce(F.col(LABEL).cast("int"), F.lit(0)).alias(LABEL),
        value.alias(SCORE),
        (value >= threshold).cast("int").alias(PREDICTED),
    )


@dataclass(frozen=True)
class FusionResult:
    valid: DataFrame
    test: DataFrame
    metrics: DataFrame
    recipe: FusionRecipe
    threshold: float
    extra: dict = field(default_factory=dict)


def train_fusion(valid: DataFrame, test: DataFrame, cfg: FusionConfig = FusionConfig()) -> FusionResult:
    """Fit on validation, fuse both splits, choose the threshold on validation, evaluate both."""
    recipe = fit_recipe(valid, cfg)
    scored = {k: predictions(apply_fusion(d, recipe), "raw_fused_score", cfg.threshold) for k, d in (("valid", valid), ("test", test))}
    threshold = resolve_threshold(scored["valid"], cfg.threshold_strategy, cfg.threshold).first()["threshold"]
    final = {k: predictions(d, SCORE, threshold) for k, d in scored.items()}
    both = final["valid"].withColumn("split", F.lit("valid")).unionByName(final["test"].withColumn("split", F.lit("test")))
    return FusionResult(final["valid"], final["test"], evaluate(both, ["split"]), recipe, threshold)
