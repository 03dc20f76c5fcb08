"""Column expressions: text typing, validation predicates, row-level features, score arithmetic.

Everything here is a plain JVM expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted boolean spellings and text treated as missing by the CSV reader.
TRUE_TOKENS = ("1", "true", "t", "yes", "y", "found")
FALSE_TOKENS = ("0", "false", "f", "no", "n", "notfound", "not_found")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
EPOCH_2017_12_01 = 1512086400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# --- validation predicates -------------------------------------------------------------

def non_empty(c: Column | str) -> Column:
    """True when the text is neither NULL nor blank."""
    return F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False))


def parse_failure(raw: Column | str, parsed: Column | str) -> Column:
    """A value was there and the typed column lost it."""
    return non_empty(raw) & col(parsed).isNull()


def missing_required(cols: Sequence[Column | str]) -> Column:
    return any_of([~non_empty(c) for c in cols])


def negative_value(c: Column | str) -> Column:
    return F.coalesce(col(c) < 0, F.lit(False))


def negative_any(cols: Sequence[Column | str]) -> Column:
    return any_of([negative_value(c) for c in cols])


# --- text to typed values --------------------------------------------------------------

def null_tokens(c: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    return F.when(~col(c).isin(*tokens), col(c))


def coerce_numeric(c: Column | str) -> Column:
    """Text to DOUBLE; anything that is not a plain decimal number becomes NULL."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def coerce_integer(c: Column | str) -> Column:
    """Text to BIGINT for integral values only ("3.0" is 3, "3.5" is NULL)."""
    number = coerce_numeric(c)
    return F.when((F.abs(number) < 9.2e18) & (number % 1 == 0), number.try_cast("bigint"))


def coerce_boolean(c: Column | str) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin(*TRUE_TOKENS), True).when(text.isin(*FALSE_TOKENS), False)


def coerce_timestamp(c: Column | str) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(DATE_TEXT), text.try_cast("timestamp"))


def offset_to_timestamp(seconds: Column | str, epoch: int = EPOCH_2017_12_01) -> Column:
    return F.timestamp_seconds(F.lit(epoch) + col(seconds))


def compose_entity_id(names: Sequence[str], fallback: str | None = None) -> Column:
    """``a=1|b=2`` from the non-blank columns; else the fallback value; else NULL."""
    parts = [
        F.when(non_empty(n), F.concat(F.lit(f"{n}="), F.trim(F.col(n).cast("string")))) for n in names
    ]
    joined = F.nullif(F.concat_ws("|", *parts), F.lit("")) if parts else F.lit(None).cast("string")
    if fallback is None:
        return joined
    return F.coalesce(joined, F.when(non_empty(fallback), F.trim(F.col(fallback).cast("string"))))


# --- row-level features ----------------------------------------------------------------

def balance_delta(new: Column | str, old: Column | str) -> Column:
    return col(new) - col(old)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    return F.when(col(den) != 0, col(num) / col(den))


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    """Metric ratio: 0 on an empty denominator."""
    return F.coalesce(F.when(col(den) > 0, col(num) / col(den)), F.lit(0.0))


def signed_log1p(c: Column | str) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def bounded(c: Column | str, lower: float = -10.0, upper: float = 10.0) -> Column:
    """Clamp; NULL stays NULL (bare greatest/least would return the bound)."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), col(c))))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


# --- score arithmetic ------------------------------------------------------------------

def weighted_average(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = [1.0] * len(cols) if weights is None else [float(w) for w in weights]
    total = sum(weights)
    if any(w < 0 for w in weights):
        raise ValueError("fusion weights must not be negative")
    if abs(total) <= 1e-8:
        raise ValueError("fusion weights must not sum to zero")
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w / total) for c, w in zip(cols, weights)])


def mean_top_k(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))


def geometric_mean(cols: Sequence[str]) -> Column:
    logs = [F.ln(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col(c)))) for c in cols]
    return F.exp(reduce(lambda a, b: a + b, logs) / F.lit(float(len(cols))))


def clip_probability(c: Column | str, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), col(c)))


def binary_entropy(c: Column | str, eps: float = 1e-9) -> Column:
    p = clip_probability(c, eps)
    return -(p * F.ln(p) + (F.lit(1.0) - p) * F.ln(F.lit(1.0) - p))


def reliability_weighted(cols: Sequence[str], weights: Sequence[float], eps: float = 1e-9) -> Column:
    """Global reliability times local confidence (inverse entropy), normalised per row."""
    shares = [F.lit(float(w)) / F.greatest(binary_entropy(c, eps), F.lit(eps)) for c, w in zip(cols, weights)]
    top = reduce(lambda a, b: a + b, [s * clip_probability(c, eps) for s, c in zip(shares, cols)])
    return top / F.greatest(reduce(lambda a, b: a + b, shares), F.lit(eps))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def linear_probability(cols: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    return sigmoid(reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in zip(cols, coefficients)]) + F.lit(intercept))


def severity(value: Column | str, warning: float, critical: float) -> Column:
    return (
        F.when(col(value) >= critical, "critical").when(col(value) >= warning, "warning").otherwise("ok")
    )
