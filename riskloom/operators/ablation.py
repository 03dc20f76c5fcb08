"""Ablations: the whole fuse-calibrate-threshold chain with one part left out.

The variants are columns over the same tables, so they run together: one pass ranks the fusion
candidates of all variants, one compares all calibrators, one evaluates all variants and splits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import clamp01
from riskloom.operators.calibration import CalibrationConfig, apply_calibrators, select_calibrators
from riskloom.operators.fusion import FusionConfig, FusionRecipe, _ap_by_branch, _pool, branch_names, candidate_recipes, rank_recipes
from riskloom.operators.metrics import LABEL, PREDICTED, SCORE, best_f1_threshold, evaluate, score_curve, stack_columns
from riskloom.session import side_by_side

# The leave-one-out variants and the branch each removes.
LEAVE_OUT = {
    "no_vae": "vae_nystrom",
    "no_tree_branch": "tree_branch",
    "no_boosted_branch": "boosted_branch",
    "no_gru": "gru_branch",
}


@dataclass(frozen=True)
class AblationConfig:
    fusion: FusionConfig = replace(FusionConfig(), complexity_penalty=3.5e-4, max_branches=2)
    calibration: CalibrationConfig = CalibrationConfig()
    leave_out: Mapping[str, str] | None = None
    standalone: str | None = None


def ablations(valid: DataFrame, test: DataFrame, cfg: AblationConfig = AblationConfig()) -> DataFrame:
    """One row per variant with validation and test metrics and the threshold chosen on validation."""
    names = branch_names(valid)
    leave_out = dict(LEAVE_OUT if cfg.leave_out is None else cfg.leave_out)
    ap = _ap_by_branch(valid, names)
    sets = {"full": names} | {v: [n for n in names if n != b] for v, b in leave_out.items()}
    pool_of = {v: tuple(_pool({n: ap[n] for n in kept}, cfg.fusion)) for v, kept in sets.items()}
    pools = list(dict.fromkeys(pool_of.values()))
    fits = [partial(candidate_recipes, valid, pool, ap, cfg.fusion) for pool in pools]
    made = dict(zip(pools, side_by_side(valid.sparkSession, fits)))
    groups = {v: made[pool] for v, pool in pool_of.items()}
    chosen = {v: ranked[0] for v, ranked in rank_recipes(valid, groups, cfg.fusion).items()}
    best = cfg.standalone or max(ap, key=lambda n: (ap[n], n))

    # Variants that chose the same fusion share its calibrator.
    recipe_of = {v: (r.candidate, r.branches, r.weights, r.intercept) for v, r in chosen.items()}
    recipe_of["no_fusion"] = ("best_branch", (best,), (), 0.0)
    columns = {key: clamp01(FusionRecipe(*key).column().cast("double")) for key in recipe_of.values()}
    names_of = {key: f"r{i}" for i, key in enumerate(columns)}
    label = F.coalesce(F.col(LABEL).cast("int"), F.lit(0)).alias(LABEL)
    picks, _ = select_calibrators(
        {names_of[key]: valid.select(label, e.alias(SCORE)) for key, e in columns.items()}, cfg.calibration
    )
    picked = {v: picks[names_of[key]] for v, key in recipe_of.items()}
    fused = {v: columns[key] for v, key in recipe_of.items()} | {"no_calibration": columns[recipe_of["full"]]}
    raw = _stack(valid, fused).withColumn("split", F.lit("valid")).unionByName(_stack(test, fused).withColumn("split", F.lit("test")))
    both = apply_calibrators(raw, {v: model for v, (_, model) in picked.items()}, "variant").withColumn(SCORE, clamp01(F.col(SCORE)))
    curve = score_curve(both, ["variant", "split"])
    if cfg.calibration.threshold_strategy == "fixed":
        limits = {v: cfg.calibration.threshold for v in fused}
    else:
        on_valid = curve.where(F.col("split") == "valid")
        limits = {r["variant"]: r["threshold"] for r in best_f1_threshold(both, ["variant"], on_valid).collect()}
    limit = F.element_at(F.create_map(*[F.lit(x) for v, t in limits.items() for x in (v, t)]), F.col("variant"))
    flagged = both.withColumn(PREDICTED, (F.col(SCORE) >= limit).cast("int"))
    metrics = evaluate(flagged, ["variant", "split"], curve)

    meta = [
        (v, _describe(v, leave_out), v != "no_fusion", v != "no_calibration", leave_out.get(v),
         chosen[v].candidate if v in chosen else None, picked[v][0] if v in picked else None, float(limits[v]))
        for v in fused
    ]
    info = valid.sparkSession.createDataFrame(
        meta,
        "variant string, description string, uses_fusion boolean, uses_calibration boolean, branch_removed string, "
        "fusion_candidate string, calibrator string, threshold double",
    )
    values = ("average_precision", "roc_auc", "brier_score", "f1")
    wide = metrics.groupBy("variant").agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("valid", "test") for m in values
    ])
    return info.join(wide, "variant")


def _stack(df: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    label = F.coalesce(F.col(LABEL).cast("int"), F.lit(0)).alias(LABEL)
    return stack_columns(df, scores, ["transaction_id", label], "variant")


def _describe(variant: str, leave_out: Mapping[str, str]) -> str:
    if variant in leave_out:
        return f"fusion without {leave_out[variant]}"
    return {"full": "fusion and calibration", "no_fusion": "best single branch, calibrated"}.get(variant, "fusion without calibration")


def ablation_summary(results: DataFrame) -> DataFrame:
    """Best test average precision first, then by name."""
    return results.orderBy(F.desc("test_average_precision"), "variant")


def recommend_variant(results: DataFrame) -> DataFrame:
    """The variant with the best validation F1; ties by AP, Brier, then the more complete set-up."""
    key = F.struct(
        "valid_f1", "valid_average_precision", -F.col("valid_brier_score"), F.col("uses_fusion").cast("int"),
        F.col("uses_calibration").cast("int"), F.col("branch_removed").isNull().cast("int"), (F.col("variant") == "full").cast("int"),
    )
    return results.agg(F.max_by("variant", key).alias("recommended"))
