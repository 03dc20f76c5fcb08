"""Keyed profile state for Structured Streaming.

Each micro-batch brings the new events of a user; the state holds the running profile. Within a
batch the fold is vectorised, so a busy user costs array operations, not a Python loop per event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.profiles import HOUR, TEN_MINUTES

KINDS = ("country", "channel", "destination")
STATE_SCHEMA = (
    "tx_count bigint, avg_amount double, m2 double, tx_last_10min bigint, tx_last_hour bigint, last_micros bigint, "
    "last_country string, countries array<string>, channels array<string>, destinations array<string>"
)
EMPTY = (0, 0.0, 0.0, 0, 0, None, "", [], [], [])
PROFILE_FIELDS = (
    ("tx_count", T.LongType()), ("avg_amount", T.DoubleType()), ("std_dev_amount", T.DoubleType()),
    ("tx_last_10min", T.LongType()), ("tx_last_hour", T.LongType()), ("last_country", T.StringType()),
    ("country_is_new", T.BooleanType()), ("channel_is_new", T.BooleanType()), ("destination_is_new", T.BooleanType()),
)


def _counter(cut: np.ndarray, start: int) -> np.ndarray:
    """Counter after each event: restarts at 1 on a cut, else grows from ``start``."""
    at = np.arange(len(cut))
    last_cut = np.maximum.accumulate(np.where(cut, at, -1))
    return np.where(last_cut >= 0, at - last_cut + 1, start + at + 1)


def fold_events(state: tuple, events: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    """Profile before each event (events in time order) and the state after all of them.

    Needs the columns ``amount, micros`` (nullable) and the known-value columns.
    """
    count, mean, m2, in_10min, in_hour, last_micros, last_country, *known = state
    n = len(events)
    amount = events["amount"].fillna(0.0).to_numpy(dtype=float)
    before = count + np.arange(n)
    # Shift by the first relevant mean so that the squared sums stay small.
    pivot = mean if count else (amount[0] if n else 0.0)
    s1 = count * (mean - pivot) + np.concatenate([[0.0], np.cumsum(amount - pivot)])
    s2 = m2 + count * (mean - pivot) ** 2 + np.concatenate([[0.0], np.cumsum((amount - pivot) ** 2)])
    totals = count + np.arange(n + 1)
    safe = np.maximum(totals, 1)
    means = np.where(totals > 0, pivot + s1 / safe, 0.0)
    squares = np.maximum(s2 - s1 * s1 / safe, 0.0)

    micros = events["micros"].to_numpy(dtype=float, na_value=np.nan)
    previous = np.concatenate([[np.nan if last_micros is None else float(last_micros)], micros[:-1]])[:n]
    gap = (micros - previous) / 1e6
    usable = ~np.isnan(micros)
    after_10min = _counter(usable & (np.isnan(previous) | (gap > TEN_MINUTES)), in_10min)
    after_hour = _counter(usable & (np.isnan(previous) | (gap > HOUR)), in_hour)

    out = pd.DataFrame({
        "tx_count": before,
        "avg_amount": means[:n],
        "std_dev_amount": np.sqrt(squares[:n] / safe[:n]),
        "tx_last_10min": np.concatenate([[in_10min], after_10min[:-1]])[:n],
        "tx_last_hour": np.concatenate([[in_hour], after_hour[:-1]])[:n],
        "last_country": np.concatenate([[last_country], events["country"].fillna("").to_numpy(dtype=object)[:-1]])[:n],
    }, index=events.index)
    sets = []
    for kind, values in zip(KINDS, known):
        seen = events[kind].fillna("").astype(str)
        new = ~seen.isin(set(values)) & ~seen.duplicated()
        out[f"{kind}_is_new"] = new
        sets.append(list(values) + seen[new].tolist())
    if not n:
        return out, state
    end = micros[-1]
    after = (
        int(count + n), float(means[-1]), float(squares[-1]), int(after_10min[-1]), int(after_hour[-1]),
        None if np.isnan(end) else int(end), str(events["country"].fillna("").iloc[-1]), *sets,
    )
    return out, after


def with_profile(events: DataFrame, key: str = "user_id", tie: str = "transaction_id") -> DataFrame:
    """Stream of events to stream of events with the profile as it stood before each of them.

    Needs ``key, tie, amount, event_time, country, channel, destination``; other columns pass through.
    """
    prepared = events.withColumn("micros", F.unix_micros(F.col("event_time").cast("timestamp")))
    names = events.columns
    schema = T.StructType([*events.schema.fields, *[T.StructField(n, t) for n, t in PROFILE_FIELDS]])

    def update(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else EMPTY
        current = (*current[:5], None if current[5] is None or pd.isna(current[5]) else int(current[5]), current[6], *[list(x) if x is not None else [] for x in current[7:]])
        batch = pd.concat(list(frames), ignore_index=True)
        batch = batch.sort_values(["micros", tie], kind="stable", na_position="last").reset_index(drop=True)
        profile, after = fold_events(current, batch)
        state.update(after)
        yield pd.concat([batch[names], profile], axis=1)

    return prepared.groupBy(key).applyInPandasWithState(update, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
