"""Point-in-time history features: every frame ends one row before the current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.functions.columns import clamp01, non_empty
from riskloom.operators.schema import (
    COUNTERPARTY_PREFERENCES,
    ENTITY_PREFERENCES,
    HISTORY_ORDER,
    TRANSACTION_IDS,
    choose_column,
    select_feature_columns,
    SEQUENCE_EXCLUDED,
    CURRENT_EXCLUDED,
)
from riskloom.operators.skew import HOT_ROWS, Step, over_history

WINDOWS = (5, 10)


def _w(keys: Sequence[str], order: Sequence[Column]):
    return W.partitionBy(*keys).orderBy(*order)


def seconds_between(later: Column, earlier: Column) -> Column:
    as_micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (as_micros(later) - as_micros(earlier)) / F.lit(1e6)


# --- steps: window columns for given partition keys and order ---------------------------

def prior_count_step(sizes: Sequence[int] = WINDOWS) -> Step:
    return lambda keys, order: {
        f"prior_{k}_transaction_count": F.count(F.lit(1)).over(_w(keys, order).rowsBetween(-k, -1)) for k in sizes
    }


def previous_amount_step(amount: str = "amount") -> Step:
    return lambda keys, order: {"previous_transaction_amount": F.lag(amount).over(_w(keys, order))}


def prior_stats_step(amount: str = "amount", sizes: Sequence[int] = WINDOWS) -> Step:
    def step(keys, order):
        out = {}
        for k in sizes:
            frame = _w(keys, order).rowsBetween(-k, -1)
            out[f"prior_{k}_{amount}_sum"] = F.sum(amount).over(frame)
            out[f"prior_{k}_{amount}_mean"] = F.avg(amount).over(frame)
            out[f"prior_{k}_{amount}_std"] = F.stddev_pop(amount).over(frame)
        return out

    return step


def previous_gap_step(ts: str = "transaction_timestamp") -> Step:
    def step(keys, order):
        before = F.lag(ts).over(_w(keys, order))
        return {
            "previous_transaction_timestamp": before,
            "seconds_since_previous_transaction": seconds_between(F.col(ts), before),
        }

    return step


def prior_unique_steps(value: str = "name_dest", sizes: Sequence[int] = WINDOWS) -> list[Step]:
    """Distinct counterparties among the last k non-blank ones.

    The first step numbers the non-blank values seen so far; the second takes a value-range frame
    over that number, so blanks do not consume a slot and no distinct window is needed.
    """

    def number(keys, order):
        clean = F.when(non_empty(value), F.col(value))
        return {
            "_value": clean,
            "_seen": F.count(clean).over(_w(keys, order).rowsBetween(W.unboundedPreceding, -1)),
        }

    def count(keys, order):
        return {
            f"prior_{k}_unique_{value}_count": F.size(
                F.collect_set("_value").over(W.partitionBy(*keys).orderBy("_seen").rangeBetween(-k, -1))
            ).cast("bigint")
            for k in sizes
        }

    return [number, count]


def history_order(df: DataFrame) -> list[str]:
    order = [c for c in HISTORY_ORDER if c in df.columns]
    if not order:
        raise ValueError("history needs at least one order column")
    return order


# --- public operators -------------------------------------------------------------------

def prior_count(df, key, order, sizes=WINDOWS, hot_rows=HOT_ROWS) -> DataFrame:
    return over_history(df, key, order, [prior_count_step(sizes)], max(sizes), hot_rows=hot_rows)


def previous_amount(df, key, order, amount="amount", hot_rows=HOT_ROWS) -> DataFrame:
    return over_history(df, key, order, [previous_amount_step(amount)], 1, hot_rows=hot_rows)


def prior_stats(df, key, order, amount="amount", sizes=WINDOWS, hot_rows=HOT_ROWS) -> DataFrame:
    return over_history(df, key, order, [prior_stats_step(amount, sizes)], max(sizes), hot_rows=hot_rows)


def previous_gap(df, key, order, ts="transaction_timestamp", hot_rows=HOT_ROWS) -> DataFrame:
    return over_history(df, key, order, [previous_gap_step(ts)], 1, hot_rows=hot_rows)


def prior_unique(df, value, key, order, sizes=WINDOWS, hot_rows=HOT_ROWS) -> DataFrame:
    out = over_history(df, key, order, prior_unique_steps(value, sizes), max(sizes), value, hot_rows)
    return out.drop("_value", "_seen")


def behavioral_features(
    df: DataFrame, entity: str | None = None, counterparty: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All history features of one account in one pass over one shuffle and sort."""
    entity = entity or choose_column(df, ENTITY_PREFERENCES)
    counterparty = counterparty or choose_column(df, [c for c in COUNTERPARTY_PREFERENCES if c != entity], optional=True)
    if "amount" not in df.columns:
        raise ValueError("history features need an amount column")
    typed = df.withColumn("amount", F.col("amount").try_cast("double"))
    has_time = "transaction_timestamp" in df.columns

    def shared(keys, order):
        out = {**previous_amount_step()(keys, order), **prior_count_step()(keys, order), **prior_stats_step()(keys, order)}
        if has_time:
            out.update(previous_gap_step()(keys, order))
        return out

    steps: list[Step] = [shared]
    if counterparty:
        number, count = prior_unique_steps(counterparty)
        steps = [lambda k, o: {**shared(k, o), **number(k, o)}, count]
    out = over_history(typed, entity, history_order(df), steps, max(WINDOWS), counterparty, hot_rows)
    if not has_time:
        out = out.withColumns(
            {
                "previous_transaction_timestamp": F.lit(None).cast("timestamp"),
                "seconds_since_previous_transaction": F.lit(None).cast("double"),
            }
        )
    return out.drop("_value", "_seen")


def history_sequence(
    df: DataFrame, features: Sequence[str], entity: str, order: Sequence[str], length: int = 10, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``x_seq``: the previous ``length`` feature vectors, oldest first, zero-padded on the left;
    ``history_length``: how many of them are real."""
    vector = F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) for f in features])
    zero = F.array(*[F.lit(0.0).cast("float") for _ in features])

    def step(keys, order_cols):
        past = F.collect_list(vector).over(_w(keys, order_cols).rowsBetween(-length, -1))
        return {
            "x_seq": F.concat(F.array_repeat(zero, F.lit(length) - F.size(past)), past),
            "history_length": F.size(past).cast("bigint"),
        }

    return over_history(df, entity, order, [step], length, hot_rows=hot_rows)


def sequence_meta(df: DataFrame, entity: str, order: Sequence[str], length: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Id, entity and order columns with the history length capped at ``length``."""
    counted = over_history(
        df, entity, order,
        [lambda k, o: {"history_length": F.count(F.lit(1)).over(_w(k, o).rowsBetween(-length, -1))}],
        length, hot_rows=hot_rows,
    )
    return counted.select(
        transaction_id_column(df).alias("current_transaction_id"), entity, *order,
        F.lit(length).alias("sequence_length"), "history_length",
    )


def transaction_id_column(df: DataFrame) -> Column:
    """The first id column present, else one derived from the transaction order or row number."""
    for name in TRANSACTION_IDS:
        if name in df.columns:
            return F.col(name).cast("string")
    for name in ("transaction_order", "source_row_number"):
        if name in df.columns:
            return F.concat(F.lit("txn_"), F.col(name).cast("bigint").cast("string"))
    raise ValueError("no transaction id can be derived")


def derive_transaction_id(df: DataFrame, out: str = "current_transaction_id") -> DataFrame:
    return df.withColumn(out, transaction_id_column(df))


def sequence_dataset(df: DataFrame, length: int = 10, include_positions: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per transaction: sequence, current-row features, target and meta, all keyed by id."""
    entity = choose_column(df, ENTITY_PREFERENCES)
    order = history_order(df)
    if "is_fraud" not in df.columns:
        raise ValueError("sequence data set needs a target column")
    seq = select_feature_columns(df.schema, SEQUENCE_EXCLUDED, include_positions)
    cur = select_feature_columns(df.schema, CURRENT_EXCLUDED, include_positions)
    built = history_sequence(derive_transaction_id(df), seq, entity, order, length, hot_rows)
    return built.select(
        "current_transaction_id",
        entity,
        *order,
        F.lit(length).alias("sequence_length"),
        "history_length",
        "x_seq",
        F.struct(*[F.col(c).cast("float").alias(c) for c in cur]).alias("x_current"),
        F.col("is_fraud").alias("y"),
    )


def recent_burst_count(
    df: DataFrame, key: str, ts: str, order: Sequence[str], seconds: int = 600, cap: int = 20, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Earlier events less than ``seconds`` old among the last ``cap`` of the account."""

    def step(keys, order_cols):
        past = F.collect_list(F.unix_micros(F.col(ts).cast("timestamp"))).over(_w(keys, order_cols).rowsBetween(-cap, -1))
        floor = F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(seconds * 1_000_000)
        return {"recent_burst_count": F.size(F.filter(past, lambda x: x > floor)).cast("bigint")}

    return over_history(df, key, order, [step], cap, hot_rows=hot_rows)


def normalized_amount(amount: Column, baseline: Column, std: Column) -> Column:
    base = F.when(baseline > 0, baseline).otherwise(F.lit(1.0))
    spread = F.when(std > 0, std).otherwise(F.greatest(base * 0.2, F.lit(1.0)))
    return clamp01((amount - base + spread) / (base + F.lit(3.0) * spread))


def risk_context(
    df: DataFrame, key: str, ts: str, order: Sequence[str], amount: str = "amount",
    destination: str = "name_dest", baseline: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Amount change, velocity, destination shift and history statistics of each event against its past."""
    base = F.col(baseline).cast("double") if baseline else F.lit(0.0)

    def step(keys, order_cols):
        w = _w(keys, order_cols)
        value = F.col(amount)
        before = F.lag(amount).over(w)
        # One row back at most: a first event has no row number below it.
        is_new = F.row_number().over(w) == 1
        gap = F.when(is_new, F.lit(86400.0)).otherwise(
            F.greatest(seconds_between(F.col(ts), F.lag(ts).over(w)), F.lit(1.0))
        )
        previous = F.coalesce(before, F.lit(0.0))
        past = F.collect_list(F.unix_micros(F.col(ts).cast("timestamp"))).over(w.rowsBetween(-20, -1))
        floor = F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(600_000_000)
        burst = F.size(F.filter(past, lambda x: x > floor)).cast("bigint")
        ratio = (
            F.when(previous > 0, value / F.when(previous > 0, previous))
            .when(base > 0, value / F.when(base > 0, base))
            .otherwise(F.lit(1.0))
        )
        out = {
            "new_user": is_new,
            "previous_amount": F.round(previous, 3),
            "seconds_since_previous": F.round(gap, 3),
            "amount_delta": F.round(value - previous, 3),
            "amount_ratio": F.round(ratio, 3),
            "recent_burst_count": burst,
            "velocity_score": F.round(clamp01(burst / F.lit(6.0) + F.lit(60.0) / F.greatest(gap, F.lit(60.0))), 3),
            "is_destination_shift": ~is_new & ~F.col(destination).eqNullSafe(F.lag(destination).over(w)),
        }
        for k in WINDOWS:
            frame = w.rowsBetween(-k, -1)
            zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3)
            out[f"prior_{k}_count"] = F.count(F.lit(1)).over(frame)
            out[f"prior_{k}_amount_sum"] = zero(F.sum(amount).over(frame))
            out[f"prior_{k}_amount_mean"] = zero(F.avg(amount).over(frame))
            out[f"prior_{k}_amount_std"] = zero(F.stddev_pop(amount).over(frame))
        std = F.coalesce(F.stddev_pop(amount).over(w.rowsBetween(-10, -1)), F.lit(0.0))
        mean = F.coalesce(F.avg(amount).over(w.rowsBetween(-10, -1)), F.lit(0.0))
        centre = base if baseline else mean
        out["normalized_amount"] = F.round(normalized_amount(value, centre, std), 3)
        return out

    return over_history(df, key, order, [step], 20, hot_rows=hot_rows)
