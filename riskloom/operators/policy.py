"""Rules, decision policy and decision labels: expressions built at plan time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule weights and decision limits.
WEIGHTS = {"amount": 30, "country": 25, "velocity": 35, "destination": 10}
BLOCK_AT, CHALLENGE_AT = 70, 40
VELOCITY_LIMIT = 3


@dataclass(frozen=True)
class ActionRange:
    name: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Policy:
    # Score bands of the shipped policy.
    actions: tuple[ActionRange, ...] = (ActionRange("allow", None, 0.15), ActionRange("review", 0.15, 0.55), ActionRange("block", 0.55, None))
    on_missing_score: str = "review"
    on_contract_mismatch: str = "review"


def unknown_to(value: str, known: str) -> Column:
    """The value is not in a non-empty known list."""
    items = F.coalesce(F.col(known), F.array().cast("array<string>"))
    return (F.size(items) > 0) & ~F.array_contains(items, F.col(value))


def rule_score(
    df: DataFrame, country_unknown: Column, destination_unknown: Column, amount: str = "amount",
    avg: str = "avg_amount", std: str = "std_dev_amount", recent: str = "tx_last_10min",
) -> DataFrame:
    """Four flags, their weighted score and the decision."""
    flags = {
        "flag_amount": (F.col(std) != 0) & (F.col(amount) > F.col(avg) + 2 * F.col(std)),
        "flag_country": country_unknown,
        "flag_velocity": F.col(recent) >= VELOCITY_LIMIT,
        "flag_destination": destination_unknown,
    }
    df = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    score = sum((F.when(F.col(f"flag_{k}"), w).otherwise(0) for k, w in WEIGHTS.items()), F.lit(0))
    df = df.withColumn("rule_score", score)
    decision = F.when(F.col("rule_score") >= BLOCK_AT, "blocked").when(F.col("rule_score") >= CHALLENGE_AT, "challenged").otherwise("allowed")
    return df.withColumn("rule_decision", decision)


def rule_score_as_of(df: DataFrame) -> DataFrame:
    """Rules over the columns of ``profiles.as_of_profile``."""
    seen = F.col("tx_count") > 0
    return rule_score(df, seen & F.col("country_is_new"), seen & F.col("destination_is_new"))


def validate_policy_ranges(policy: Policy) -> None:
    """Ranges must be non-empty, ordered and must not overlap."""
    top = None
    for a in policy.actions:
        if a.low is not None and a.high is not None and a.low >= a.high:
            raise ValueError(f"empty range for action {a.name}")
        if top is not None and a.low is not None and a.low < top:
            raise ValueError("action ranges overlap or are out of order")
        top = a.high if a.high is not None else top


def policy_action(score: Column | str, contract_ok: Column | bool = True, policy: Policy = Policy()) -> Column:
    """First range [low, high) that holds the score; fallbacks for a broken contract or no score;
    a score outside all ranges raises at run time."""
    validate_policy_ranges(policy)
    s = F.col(score) if isinstance(score, str) else score
    ok = F.lit(contract_ok) if isinstance(contract_ok, bool) else contract_ok
    out = F.when(~ok, policy.on_contract_mismatch).when(s.isNull(), policy.on_missing_score)
    for a in policy.actions:
        inside = F.lit(True)
        if a.low is not None:
            inside = inside & (s >= a.low)
        if a.high is not None:
            inside = inside & (s < a.high)
        out = out.when(inside, a.name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no action range for score "), s.cast("string"))).cast("string"))


def policy_reason(score: Column | str, contract_ok: Column | bool = True) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    ok = F.lit(contract_ok) if isinstance(contract_ok, bool) else contract_ok
    return F.when(~ok, "contract_mismatch_fallback").when(s.isNull(), "missing_score_fallback").otherwise("score_range")


def decision_label(action: Column | str, score: Column | str) -> tuple[Column, Column]:
    """(decision text, score as a whole number 0..100, halves rounded away from zero)."""
    a = F.col(action) if isinstance(action, str) else action
    s = F.col(score) if isinstance(score, str) else score
    decision = F.when(a == "allow", "allowed").when(a == "block", "blocked").otherwise("challenged")
    return decision, F.round(s * 100).cast("int")
