"""Running user profiles in batch: what the profile held just before each event, and after all.

Ordinary users: one window per user. Hot users (see ``skew``): their rows are cut into range
segments; each segment summarises itself in one row, a window over those summaries carries
counts, moments and counters forward, and the rows combine the carry with their in-segment value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.operators.history import seconds_between
from riskloom.operators.ordering import nulls_last
from riskloom.operators.skew import HOT_ROWS, halo_rows, hot_keys, segment, segments_for, split_hot

TEN_MINUTES, HOUR = 600, 3600
KNOWN = ("country", "channel", "destination")
#: Column of :func:`as_of_profile` with a key's state before all of its events.
START = "_start"
CARRY = ("_rows", "_values", "_mean", "_m2", "_break_10min", "_break_hour")


def _w(keys: Sequence[str], order: Sequence[Column]):
    return W.partitionBy(*keys).orderBy(*order)


def _order_key(order: Sequence[str]) -> Column:
    """Struct that compares like ascending, NULLs last."""
    return F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])


def _look_back(df: DataFrame, keys, order, ts: str, carried: Sequence[str]) -> DataFrame:
    w = _w(keys, order)
    before = {"_prev_ts": F.lag(ts).over(w), **{f"last_{c}": F.lag(c).over(w) for c in carried}}
    if START not in df.columns:
        return df.withColumns(before)
    # Of the rows that stay, only a key's first event is the first of its window.
    first, start = F.row_number().over(w) == 1, F.col(START)
    known = {"_prev_ts": start["last_ts"], **{f"last_{c}": start[f"last_{c}"] for c in carried}}
    return df.withColumns({n: F.when(first, known[n]).otherwise(e) for n, e in before.items()})


def _add_start(df: DataFrame) -> DataFrame:
    """The carry of each row with what its key had before all of these events."""
    if START not in df.columns:
        return df
    s = F.col(START)
    n = F.coalesce(s["n"], F.lit(0))
    total = n + F.col("_values")
    share = F.when(total > 0, F.col("_values") / total).otherwise(0.0)
    delta = F.col("_mean") - F.coalesce(s["mean"], F.lit(0.0))
    return df.withColumns({
        "_rows": F.col("_rows") + n, "_values": total,
        "_mean": F.coalesce(s["mean"], F.lit(0.0)) + delta * share, "_m2": F.col("_m2") + F.coalesce(s["m2"], F.lit(0.0)) + delta * delta * n * share,
        "_break_10min": F.coalesce(F.col("_break_10min") + n, n - s["in_10min"] + 1),
        "_break_hour": F.coalesce(F.col("_break_hour") + n, n - s["in_hour"] + 1),
    })


def _breaks(df: DataFrame, ts: str) -> DataFrame:
    """A counter restarts when the gap is too long or the previous time is unusable; an unusable
    current time never restarts it."""
    gap = seconds_between(F.col(ts), F.col("_prev_ts"))
    restart = lambda limit: F.col(ts).isNotNull() & (F.col("_prev_ts").isNull() | F.coalesce(gap > limit, F.lit(False)))
    return df.withColumns({"_cut_10min": restart(TEN_MINUTES), "_cut_hour": restart(HOUR)})


def _in_group(df: DataFrame, keys, order, amount: str, cold: bool) -> DataFrame:
    """Profile-before columns inside one group, combined with the carry columns of the group."""
    w = _w(keys, order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    if cold:
        df = df.withColumns({
            "_rows": F.lit(0).cast("bigint"), "_values": F.lit(0).cast("bigint"), "_mean": F.lit(0.0), "_m2": F.lit(0.0),
            "_break_10min": F.lit(None).cast("bigint"), "_break_hour": F.lit(None).cast("bigint"),
        })
    df = _add_start(df)
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    df = df.withColumns({
        "_pos": F.col("_rows") + F.row_number().over(w),
        "_n": F.count(F.lit(1)).over(before),
        "_avg": F.coalesce(F.avg(value).over(before), F.lit(0.0)),
        "_var": F.coalesce(F.var_pop(value).over(before), F.lit(0.0)),
    })
    n = F.col("_values") + F.col("_n")
    delta = F.col("_avg") - F.col("_mean")
    share = F.when(n > 0, F.col("_n") / n).otherwise(F.lit(0.0))
    m2 = F.col("_m2") + F.col("_var") * F.col("_n") + delta * delta * F.col("_values") * share
    df = df.withColumns({
        "tx_count": F.col("_pos") - 1,
        "avg_amount": F.col("_mean") + delta * share,
        "std_dev_amount": F.when(n > 0, F.sqrt(m2 / F.when(n > 0, n))).otherwise(F.lit(0.0)),
        "_after_10min": F.col("_pos") - F.coalesce(F.max(F.when(F.col("_cut_10min"), F.col("_pos"))).over(upto), F.col("_break_10min"), F.lit(1)) + 1,
        "_after_hour": F.col("_pos") - F.coalesce(F.max(F.when(F.col("_cut_hour"), F.col("_pos"))).over(upto), F.col("_break_hour"), F.lit(1)) + 1,
    })
    carried = lambda at: F.when(F.col("_rows") > 0, F.col("_rows") - F.coalesce(F.col(at), F.lit(1)) + 1).otherwise(F.lit(0))
    return df.withColumns({
        "tx_last_10min": F.coalesce(F.lag("_after_10min").over(w), carried("_break_10min")),
        "tx_last_hour": F.coalesce(F.lag("_after_hour").over(w), carried("_break_hour")),
    })


def _segment_carry(df: DataFrame, key: str, order, amount: str) -> DataFrame:
    """One row per (key, segment): totals of all earlier segments of the key."""
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    inside = W.partitionBy(key, "_seg").orderBy(*order)
    summary = (
        df.withColumn("_p", F.row_number().over(inside)).groupBy(key, "_seg").agg(
            F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("m2"),
            F.max(F.when(F.col("_cut_10min"), F.col("_p"))).alias("b10"), F.max(F.when(F.col("_cut_hour"), F.col("_p"))).alias("b60"),
        )
    )
    along = W.partitionBy(key).orderBy("_seg")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    rows = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    # Moments are summed around the key's first segment mean, which keeps the subtraction harmless.
    pivot = F.first("mean").over(along.rowsBetween(W.unboundedPreceding, 0))
    shifted = summary.withColumns({"_rows": rows, "_pivot": pivot}).withColumn("_d", F.col("mean") - F.col("_pivot"))
    s1 = F.coalesce(F.sum(F.col("n") * F.col("_d")).over(earlier), F.lit(0.0))
    s2 = F.coalesce(F.sum(F.col("m2") + F.col("n") * F.col("_d") * F.col("_d")).over(earlier), F.lit(0.0))
    some = F.when(F.col("_rows") > 0, F.col("_rows"))
    return shifted.withColumns({"_s1": s1, "_s2": s2}).select(
        F.col(key).alias("_key"), F.col("_seg").alias("_seg_no"), "_rows", F.col("_rows").alias("_values"),
        F.coalesce(F.col("_pivot") + F.col("_s1") / some, F.lit(0.0)).alias("_mean"),
        F.greatest(F.coalesce(F.col("_s2") - F.col("_s1") * F.col("_s1") / some, F.lit(0.0)), F.lit(0.0)).alias("_m2"),
        F.last(F.col("_rows") + F.col("b10"), ignorenulls=True).over(earlier).alias("_break_10min"),
        F.last(F.col("_rows") + F.col("b60"), ignorenulls=True).over(earlier).alias("_break_hour"),
    )


def _novelty_cold(df: DataFrame, key: str, order, values: Sequence[str]) -> DataFrame:
    # Hash partitioning on the key also clusters (key, value): a second sort, no second shuffle.
    return df.withColumns({f"{v}_is_new": F.row_number().over(W.partitionBy(key, v).orderBy(*order)) == 1 for v in values})


def _novelty_hot(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First occurrence per (key, value) by a grouped minimum (combines before the shuffle), marked
    on the rows by their unique id, so no task holds all rows of one (key, value)."""
    for v in values:
        firsts = df.groupBy(key, v).agg(F.min_by("_rid", _order_key([*order, "_rid"])).alias("_rid")).select("_rid", F.lit(True).alias(f"{v}_is_new"))
        df = df.join(firsts, "_rid", "left").withColumn(f"{v}_is_new", F.coalesce(f"{v}_is_new", F.lit(False)))
    return df


def as_of_profile(
    events: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount",
    ts: str = "event_time", known: Sequence[str] = KNOWN, carried: Sequence[str] = ("country",), hot_rows: int = HOT_ROWS,
    start: DataFrame | None = None, seen: DataFrame | None = None,
) -> DataFrame:
    """Append the profile as it stood strictly before each event.

    ``tx_count, avg_amount, std_dev_amount, tx_last_10min, tx_last_hour, last_<carried>,
    <known>_is_new`` (the value was not seen before). ``start`` holds one row ``(<key>, n, mean, m2, in_10min, in_hour, last_ts,
    last_<carried>)`` for keys that had events before these, and ``seen`` their known values ``(<key>, kind, value)``. ``order`` must be
    total within a key, as in :func:`riskloom.operators.skew.over_history`.
    """
    names = events.columns
    if start is not None:
        events = events.join(start.select(key, F.struct(*[c for c in start.columns if c != key]).alias(START)), key, "left")
    known = [k for k in known if k in events.columns]
    carried = [c for c in carried if c in events.columns]
    keys, rows = hot_keys(events, key, hot_rows)

    def cold_path(df: DataFrame) -> DataFrame:
        cols = nulls_last(order)
        out = _in_group(_breaks(_look_back(df, [key], cols, ts, carried), ts), [key], cols, amount, cold=True)
        return _novelty_cold(out, key, cols, known)

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(
            *names, *([START] if start is not None else []), "tx_count", "avg_amount", "std_dev_amount", "tx_last_10min", "tx_last_hour",
            F.col("_after_10min").alias("tx_last_10min_after"), F.col("_after_hour").alias("tx_last_hour_after"),
            *[f"last_{c}" for c in carried], *[f"{k}_is_new" for k in known],
        )

    def unseen(df: DataFrame) -> DataFrame:
        for k in known if seen is not None else []:
            had = seen.where(F.col("kind") == k).select(key, F.col("value").alias(k), F.lit(True).alias("_had"))
            df = df.join(had, [key, k], "left").withColumn(f"{k}_is_new", F.col(f"{k}_is_new") & F.col("_had").isNull()).drop("_had")
        return df

    if keys is None:
        return unseen(tidy(cold_path(events)))
    cold, hot = split_hot(events, key, keys)
    placed = segment(hot, key, order, segments_for(rows, hot_rows))
    full_order = [*order, "_rid"]
    cols = nulls_last(full_order)
    halo = halo_rows(placed, key, order, 1, None).withColumn("_halo", F.lit(True))
    with_halo = placed.withColumn("_halo", F.lit(False)).unionByName(halo)
    marked = _breaks(_look_back(with_halo, [key, "_seg"], cols, ts, carried), ts).where(~F.col("_halo"))
    carry = _segment_carry(marked, key, cols, amount)
    joined = marked.join(carry, marked[key].eqNullSafe(carry["_key"]) & (marked["_seg"] == carry["_seg_no"]))
    combined = _in_group(joined, [key, "_seg"], cols, amount, cold=False)
    return unseen(tidy(cold_path(cold)).unionByName(tidy(_novelty_hot(combined, key, order, known))))


def state_after(profiled: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount", ts: str = "event_time", carried: Sequence[str] = ("country",)) -> DataFrame:
    """The ``start`` that the rows of :func:`as_of_profile`, called with one, leave behind: one row for each of their keys."""
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    last = _order_key(order)
    per = profiled.groupBy(key).agg(
        F.max(START).alias("s"), F.count(F.lit(1)).alias("c"), F.avg(value).alias("a"), (F.var_pop(value) * F.count(F.lit(1))).alias("v"),
        F.max_by("tx_last_10min_after", last).alias("in_10min"), F.max_by("tx_last_hour_after", last).alias("in_hour"), F.max_by(ts, last).alias("last_ts"),
        *[F.max_by(x, last).alias(f"last_{x}") for x in carried],
    )
    n, mean = F.coalesce("s.n", F.lit(0)), F.coalesce("s.mean", F.lit(0.0))
    total, delta = n + F.col("c"), F.col("a") - mean
    return per.select(
        key, total.alias("n"), (mean + delta * F.col("c") / total).alias("mean"), (F.coalesce("s.m2", F.lit(0.0)) + F.col("v") + delta * delta * n * F.col("c") / total).alias("m2"),
        "in_10min", "in_hour", "last_ts", *[f"last_{x}" for x in carried],
    )


def profile_fold(events: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount", ts: str = "event_time", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running count, mean and population standard deviation before each event."""
    full = as_of_profile(events, key, order, amount, ts, (), (), hot_rows)
    return full.select(*events.columns, "tx_count", "avg_amount", "std_dev_amount")


def velocity(events: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount", ts: str = "event_time", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gap-reset counters before and after each event."""
    full = as_of_profile(events, key, order, amount, ts, (), (), hot_rows)
    return full.select(*events.columns, "tx_last_10min", "tx_last_hour", "tx_last_10min_after", "tx_last_hour_after")


def novelty(events: DataFrame, value: str, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount", ts: str = "event_time", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``is_new`` and ``known_before``: the value is new, and others were known before."""
    full = as_of_profile(events, key, order, amount, ts, (value,), (), hot_rows)
    return full.select(*events.columns, F.col(f"{value}_is_new").alias("is_new"), (F.col("tx_count") > 0).alias("known_before"))


def profile_snapshot(
    events: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), amount: str = "amount",
    ts: str = "event_time", known: Sequence[str] = KNOWN, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The profile of each user after all events. Known values come as counts here and as rows from
    :func:`known_values`: a list per user would not be bounded."""
    known = [k for k in known if k in events.columns]
    full = as_of_profile(events, key, order, amount, ts, known, (), hot_rows)
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    last = _order_key(order)
    return full.groupBy(key).agg(
        F.count(F.lit(1)).alias("tx_count"), F.avg(value).alias("avg_amount"), F.stddev_pop(value).alias("std_dev_amount"),
        F.max_by("tx_last_10min_after", last).alias("tx_last_10min"), F.max_by("tx_last_hour_after", last).alias("tx_last_hour"),
        *[F.count_if(f"{k}_is_new").alias(f"known_{k}_count") for k in known],
        *([F.max_by("country", last).alias("last_country")] if "country" in events.columns else []),
        F.max_by(ts, last).alias("last_timestamp"),
    )


def known_values(events: DataFrame, key: str = "user_id", order: Sequence[str] = ("event_time", "transaction_id"), known: Sequence[str] = KNOWN) -> DataFrame:
    """``key, kind, value`` with the first event's order columns: the known sets as rows."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in known if k in events.columns])
    long = events.select(key, *order, F.explode(kinds).alias("_k")).select(key, *order, "_k.*")
    return long.groupBy(key, "kind", "value").agg(F.min(F.struct(*order)).alias("first")).select(key, "kind", "value", "first.*")
