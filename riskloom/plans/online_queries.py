"""Queries over profiles, rules, scoring, monitoring, reports, models and the streaming path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import history, models, monitoring, policy, profiles, reports, scoring
from riskloom.operators.calibration import Knots, isotonic_fit
from riskloom.operators.contract import Contract
from riskloom.operators.fusion import FusionRecipe
from riskloom.operators.ordering import quantile_grid
from riskloom.operators.prep import prepare_tabular
from riskloom.plans import adapters as A
from riskloom.plans.data_queries import _split_txn
from riskloom.plans.model_queries import AP, AUC, FLAT, PRF, curve_cte
from riskloom.plans.registry import as_text, query, rounded, with_ctes
from riskloom.session import stage_root
from riskloom.streaming import monitor
from riskloom.streaming import process as online

GEO_W = "PARTITION BY user_id ORDER BY event_time, transaction_id"
CLICK_ORDER = ["arrival"]
CLICK_W = "PARTITION BY user_id ORDER BY arrival"


# --- profiles ---------------------------------------------------------------------------

_FOLD = """fold AS (SELECT *, row_number() OVER (W) - 1 AS tx_count, coalesce(avg(amount) OVER (W ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avg_amount,
  coalesce(stddev_pop(amount) OVER (W ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS std_dev_amount FROM SRC)"""


def _fold(src: str, w: str) -> str:
    return _FOLD.replace("(W", f"({w}").replace("SRC", src)


def _velocity(src: str, w: str) -> str:
    """CTEs cuts, islands, counters, velocity for a source and window."""
    gap = "(epoch_us(event_time) - epoch_us(prev_ts)) / 1000000.0"
    return f"""gaps AS (SELECT *, lag(event_time) OVER ({w}) AS prev_ts, row_number() OVER ({w}) AS rn FROM {src}),
cuts AS (SELECT *, CASE WHEN event_time IS NOT NULL AND (prev_ts IS NULL OR {gap} > 600) THEN 1 ELSE 0 END AS c10, CASE WHEN event_time IS NOT NULL AND (prev_ts IS NULL OR {gap} > 3600) THEN 1 ELSE 0 END AS c60 FROM gaps),
islands AS (SELECT *, sum(c10) OVER ({w}) AS i10, sum(c60) OVER ({w}) AS i60 FROM cuts),
counters AS (SELECT *, row_number() OVER (PARTITION BY user_id, i10 ORDER BY rn) AS after10, row_number() OVER (PARTITION BY user_id, i60 ORDER BY rn) AS after60 FROM islands),
velocity AS (SELECT *, coalesce(lag(after10) OVER ({w}), 0) AS tx_last_10min, coalesce(lag(after60) OVER ({w}), 0) AS tx_last_hour FROM counters)"""


def _nudged():
    """Means of cent amounts often end exactly between two roundings: both engines step off the tie."""
    return [(F.col(c) + 1e-7).alias(c) for c in ("avg_amount", "std_dev_amount")]


@query("n1_profile_fold", with_ctes(A.GEO, _fold("geo", GEO_W)) + "SELECT transaction_id, tx_count, round(avg_amount + 1e-7, 4) AS avg_amount, round(std_dev_amount + 1e-7, 4) AS std_dev_amount FROM fold")
def n1(spark, d):
    out = profiles.profile_fold(A.geo(spark, d))
    return rounded(out.select("transaction_id", "tx_count", *_nudged()), "avg_amount", "std_dev_amount", digits=4)


@query("n2_velocity", with_ctes(A.CLICKS, _velocity("clicks", CLICK_W)) + "SELECT transaction_id, tx_last_10min, tx_last_hour, after10 AS tx_last_10min_after, after60 AS tx_last_hour_after FROM velocity")
def n2(spark, d):
    out = profiles.velocity(A.clicks(spark, d), order=CLICK_ORDER)
    return out.select("transaction_id", "tx_last_10min", "tx_last_hour", "tx_last_10min_after", "tx_last_hour_after")


@query("n3_novelty", with_ctes(A.GEO) + f"""
SELECT transaction_id, row_number() OVER (PARTITION BY user_id, destination ORDER BY event_time, transaction_id) = 1 AS is_new, row_number() OVER ({GEO_W}) > 1 AS known_before FROM geo""")
def n3(spark, d):
    return profiles.novelty(A.geo(spark, d), "destination").select("transaction_id", "is_new", "known_before")


@query("n3_known_values", with_ctes(A.GEO) + " UNION ALL ".join(
    f"SELECT user_id, '{k}' AS kind, {k} AS value, arg_min(transaction_id, struct_pack(t := event_time, i := transaction_id)) AS transaction_id FROM geo GROUP BY user_id, {k}" for k in ("country", "channel", "destination")))
def n3_values(spark, d):
    return profiles.known_values(A.geo(spark, d)).select("user_id", "kind", "value", "transaction_id")


@query("n4_profile_snapshot", with_ctes(A.CLICKS, _velocity("clicks", CLICK_W)) + """
SELECT user_id, count(*) AS tx_count, round(avg(amount), 6) AS avg_amount, round(stddev_pop(amount), 6) AS std_dev_amount, arg_max(after10, arrival) AS tx_last_10min, arg_max(after60, arrival) AS tx_last_hour,
       count(DISTINCT country) AS known_country_count, count(DISTINCT destination) AS known_destination_count, arg_max(country, arrival) AS last_country FROM velocity GROUP BY user_id""")
def n4(spark, d):
    out = profiles.profile_snapshot(A.clicks(spark, d), order=CLICK_ORDER)
    out = out.select("user_id", "tx_count", "avg_amount", "std_dev_amount", "tx_last_10min", "tx_last_hour", "known_country_count", "known_destination_count", "last_country")
    return rounded(out, "avg_amount", "std_dev_amount")


_ASOF = f"""before_event AS (SELECT v.*, f.tx_count, f.avg_amount, f.std_dev_amount, lag(v.country) OVER (PARTITION BY v.user_id ORDER BY v.arrival) AS last_country,
  row_number() OVER (PARTITION BY v.user_id, v.country ORDER BY v.arrival) = 1 AS country_is_new, row_number() OVER (PARTITION BY v.user_id, v.destination ORDER BY v.arrival) = 1 AS destination_is_new
  FROM velocity v JOIN fold f ON v.transaction_id = f.transaction_id)"""
_ASOF_ALL = with_ctes(A.CLICKS, _velocity("clicks", CLICK_W), _fold("clicks", CLICK_W), _ASOF)


@query("d11_as_of_profile", _ASOF_ALL + """
SELECT transaction_id, tx_count, round(avg_amount + 1e-7, 4) AS avg_amount, round(std_dev_amount + 1e-7, 4) AS std_dev_amount, tx_last_10min, tx_last_hour, last_country, country_is_new, destination_is_new FROM before_event""")
def d11(spark, d):
    out = profiles.as_of_profile(A.clicks(spark, d), order=CLICK_ORDER)
    out = out.select("transaction_id", "tx_count", *_nudged(), "tx_last_10min", "tx_last_hour", "last_country", "country_is_new", "destination_is_new")
    return rounded(out, "avg_amount", "std_dev_amount", digits=4)


@query("d11_as_of_profile_hot", _ASOF_ALL + """
SELECT transaction_id, tx_count, round(avg_amount + 1e-7, 4) AS avg_amount, round(std_dev_amount + 1e-7, 4) AS std_dev_amount, tx_last_10min, tx_last_hour, last_country, country_is_new, destination_is_new FROM before_event""")
def d11_hot(spark, d):
    """All users above the bound: segments with carried state."""
    out = profiles.as_of_profile(A.clicks(spark, d), order=CLICK_ORDER, hot_rows=150)
    out = out.select("transaction_id", "tx_count", *_nudged(), "tx_last_10min", "tx_last_hour", "last_country", "country_is_new", "destination_is_new")
    return rounded(out, "avg_amount", "std_dev_amount", digits=4)


@query("m1_rule_score", _ASOF_ALL + """
, flags AS (SELECT transaction_id, std_dev_amount <> 0 AND amount > avg_amount + 2 * std_dev_amount AS flag_amount, tx_count > 0 AND country_is_new AS flag_country, tx_last_10min >= 3 AS flag_velocity, tx_count > 0 AND destination_is_new AS flag_destination FROM before_event),
s AS (SELECT *, CASE WHEN flag_amount THEN 30 ELSE 0 END + CASE WHEN flag_country THEN 25 ELSE 0 END + CASE WHEN flag_velocity THEN 35 ELSE 0 END + CASE WHEN flag_destination THEN 10 ELSE 0 END AS rule_score FROM flags)
SELECT *, CASE WHEN rule_score >= 70 THEN 'blocked' WHEN rule_score >= 40 THEN 'challenged' ELSE 'allowed' END AS rule_decision FROM s""")
def m1(spark, d):
    out = policy.rule_score_as_of(profiles.as_of_profile(A.clicks(spark, d), order=CLICK_ORDER))
    return out.select("transaction_id", "flag_amount", "flag_country", "flag_velocity", "flag_destination", "rule_score", "rule_decision")


# --- scoring --------------------------------------------------------------------------------

def leaf(value):
    return {"is_leaf": True, "value": value}


def node(feature, threshold, left, right, missing_left):
    return {"feature_idx": feature, "threshold": threshold, "left": left, "right": right, "missing_go_to_left": missing_left}


TREES = scoring.TreeModel(-0.4, (
    (node(0, 50.0, 1, 2, True), leaf(-0.3), node(1, 5.0, 3, 4, False), leaf(0.2), leaf(0.9)),
    (node(1, 2.0, 1, 2, False), leaf(-0.6), leaf(0.35)),
    (node(2, 1.0, 1, 2, True), node(0, 120.0, 3, 4, False), leaf(0.5), leaf(-0.1), leaf(0.75)),
))
_TREE_RAW = """-0.4::DOUBLE + CASE WHEN f0 IS NULL OR f0 <= 50 THEN -0.3::DOUBLE WHEN f1 <= 5 THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END
  + CASE WHEN f1 <= 2 THEN -0.6::DOUBLE ELSE 0.35::DOUBLE END + CASE WHEN f2 IS NULL OR f2 <= 1 THEN CASE WHEN f0 <= 120 THEN -0.1::DOUBLE ELSE 0.75::DOUBLE END ELSE 0.5::DOUBLE END"""
_TREE_SRC = f"""inputs AS (SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN value END AS f0, CASE WHEN event_id % 19 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 END AS f1, CASE WHEN event_id % 23 <> 0 THEN CAST(event_id % 3 AS DOUBLE) END AS f2 FROM events),
tree AS (SELECT *, 1 / (1 + exp(-({_TREE_RAW}))) AS s FROM inputs)"""
_KNOT_SQL = "CASE WHEN s <= 0.2::DOUBLE THEN 0.05::DOUBLE WHEN s >= 0.8::DOUBLE THEN 0.9::DOUBLE WHEN s <= 0.5::DOUBLE THEN 0.05 + (s - 0.2) / 0.3 * 0.25 ELSE 0.3 + (s - 0.5) / 0.3 * 0.6 END"
SPEC = scoring.ScoringSpec(("amount", "k", "step"), TREES, Knots((0.2, 0.5, 0.8), (0.05, 0.3, 0.9)), threshold=0.4)


def _tree_inputs(spark, d):
    e = A.table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "ts", F.when(~A.every(17), F.col("value")).alias("amount"),
        F.when(~A.every(19), F.get_json_object("props", "$.k").cast("double") / 10).alias("k"), F.when(~A.every(23), (F.col("event_id") % 3).cast("double")).alias("step"),
        "event_type",
    )


@query("m2_score_trees", "WITH " + _TREE_SRC + " SELECT event_id, round(s, 6) AS score FROM tree")
def m2(spark, d):
    out = scoring.score_trees(_tree_inputs(spark, d), TREES, ["amount", "k", "step"])
    return rounded(out.select("event_id", "score"), "score")


def _feature_map(df):
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in ("amount", "k", "step")])
    return df.withColumn("features", F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())))


@query("m3_score_events", "WITH " + _TREE_SRC + f""", cal AS (SELECT event_id, s, {_KNOT_SQL} AS c FROM tree)
SELECT event_id, round(s, 6) AS raw_fused_score, round(c, 6) AS calibrated_score, CASE WHEN c >= 0.4::DOUBLE THEN 1 ELSE 0 END AS predicted_label,
  CASE WHEN c < 0.15::DOUBLE THEN 'allowed' WHEN c < 0.55::DOUBLE THEN 'challenged' ELSE 'blocked' END AS decision, CAST(round(c * 100) AS INTEGER) AS score FROM cal""")
def m3(spark, d):
    out = scoring.score_events(_feature_map(_tree_inputs(spark, d)), SPEC)
    return rounded(out.select("event_id", "raw_fused_score", "calibrated_score", "predicted_label", "decision", "score"), "raw_fused_score", "calibrated_score")


@query("m4_policy_action", with_ctes(A.BRANCHES) + """
SELECT transaction_id, CASE WHEN scenario = 'view' THEN 'review' WHEN scenario = 'click' THEN 'review' WHEN branch_a_score < 0.15::DOUBLE THEN 'allow' WHEN branch_a_score < 0.55::DOUBLE THEN 'review' ELSE 'block' END AS action,
  CASE WHEN scenario = 'view' THEN 'contract_mismatch_fallback' WHEN scenario = 'click' THEN 'missing_score_fallback' ELSE 'score_range' END AS reason FROM branches""")
def m4(spark, d):
    b = A.branches(spark, d)
    score = F.when(F.col("scenario") != "click", F.col("branch_a_score"))
    ok = F.col("scenario") != "view"
    return b.select("transaction_id", policy.policy_action(score, ok).alias("action"), policy.policy_reason(score, ok).alias("reason"))


@query("m6_decision_label", with_ctes(A.DECISIONS) + "SELECT transaction_id, lower(trim(decision)) AS decision, score FROM decisions")
def m6(spark, d):
    b = A.branches(spark, d).withColumn("action", policy.policy_action("branch_a_score"))
    decision, score = policy.decision_label("action", "branch_a_score")
    return b.select("transaction_id", decision.alias("decision"), score.alias("score"))


def _requests(spark, d):
    """One JSON request for each 64 consecutive events."""
    t = _feature_map(_tree_inputs(spark, d))
    record = F.struct(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "click", "2").alias("is_fraud"),
        "features", F.create_map(F.lit("channel"), F.col("event_type")).alias("metadata"),
    )
    return t.groupBy(F.floor(F.col("event_id") / 64).alias("block")).agg(F.collect_list(record).alias("records")).select(
        F.to_json(F.struct(F.concat(F.lit("r"), F.col("block").cast("string")).alias("request_id"), "records")).alias("payload")
    )


@query("m10_parse_score_requests", "WITH " + _TREE_SRC + """
SELECT concat('r', CAST(e.event_id // 64 AS VARCHAR)) AS request_id, concat('ev_', CAST(e.event_id AS VARCHAR)) AS transaction_id, CASE WHEN event_type = 'error' THEN 1 END AS is_fraud,
       round(f0, 6) AS amount, round(f1, 6) AS k, event_type AS channel FROM inputs i JOIN events e ON i.event_id = e.event_id""")
def m10(spark, d):
    out = scoring.parse_score_requests(_requests(spark, d), ["amount", "k"])
    out = out.select("request_id", "transaction_id", "is_fraud", "amount", "k", F.col("metadata")["channel"].alias("channel"))
    return rounded(out, "amount", "k")


@query("c11_validate_score_records", "WITH " + _TREE_SRC + """
SELECT concat('ev_', CAST(e.event_id AS VARCHAR)) AS transaction_id, array_to_string(list_filter([CASE WHEN f0 IS NULL AND f1 IS NULL AND f2 IS NULL THEN 'features must not be empty' END,
  CASE WHEN event_type = 'click' THEN 'label must be 0, 1 or a boolean' END], lambda x: x IS NOT NULL), ',') AS errors FROM inputs i JOIN events e ON i.event_id = e.event_id""")
def c11(spark, d):
    out = scoring.validate_score_records(scoring.parse_score_requests(_requests(spark, d)))
    return as_text(out.select("transaction_id", "errors"), "errors")


@query("m11_score_response")
def m11(spark, d):
    parsed = scoring.parse_score_requests(_requests(spark, d))
    scored = scoring.score_events(parsed, SPEC).withColumn("boosted_branch_score", F.col("branch_score"))
    meta = parsed.select("request_id", "transaction_id", "record_index", "metadata")
    return scoring.score_response(scored, ["boosted_branch"], meta)


def _events(spark, d):
    """Nested online events; some parts are left out to exercise the checks."""
    e = _feature_map(_tree_inputs(spark, d))
    i = F.col("event_id")
    s = i.cast("string")
    trace = F.struct(
        F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("rq_"), s)).alias("request_id"), F.when(i % 31 != 0, "gateway").otherwise("").alias("source_system"),
        F.lit("checkout").alias("source_component"), F.lit("south").alias("source_region"),
    )
    tx = F.struct(
        F.when(i % 37 == 0, "").otherwise(F.concat(F.lit("ev_"), s)).alias("transaction_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.lit("p").alias("person_id"), F.lit("a").alias("account_id"), F.concat(F.lit("d"), (i % 9).cast("string")).alias("destination_account"), F.lit("ARS").alias("currency"),
        F.col("event_type").alias("country"), F.lit("web").alias("channel"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"),
    )
    return e.select(
        F.when(i % 41 != 0, trace).alias("trace"), F.when(i % 43 != 0, tx).alias("transaction"), F.when(i % 47 != 0, F.col("features")).alias("features"),
        F.create_map(F.lit("scenario"), F.col("event_type")).alias("metadata_labels"), "event_id",
    )


_REQUEST_ERRORS = """
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 41 = 0 AND event_id % 43 = 0 AND event_id % 47 = 0 THEN 'request is required' END, CASE WHEN event_id % 41 = 0 THEN 'trace is required' END,
  CASE WHEN event_id % 41 <> 0 AND event_id % 29 = 0 THEN 'trace.request_id is required' END, CASE WHEN event_id % 41 <> 0 AND event_id % 31 = 0 THEN 'trace.source_system is required' END,
  CASE WHEN event_id % 43 = 0 THEN 'transaction is required' END, CASE WHEN event_id % 43 <> 0 AND event_id % 37 = 0 THEN 'transaction.transaction_id is required' END,
  CASE WHEN event_id % 47 = 0 OR (event_id % 17 = 0 AND event_id % 19 = 0 AND event_id % 23 = 0) THEN 'features must not be empty' END], lambda x: x IS NOT NULL), ',') AS errors FROM events"""


@query("c10_validate_request", _REQUEST_ERRORS)
def c10(spark, d):
    return as_text(scoring.validate_request(_events(spark, d)).select("event_id", "errors"), "errors")


# --- streaming ---------------------------------------------------------------------------------

def _run_dir(spark, name):
    return f"{stage_root(spark)}/riskloom-streams/{name}-{uuid.uuid4().hex}"


def run_stream(spark, d, store=None):
    """Write the events in three folders in the order of time, run the online query over one after the other, return its folders."""
    base = _run_dir(spark, "online")
    events = _events(spark, d)
    at = A.table(spark, d, "events").select(F.col("event_id").alias("_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    timed = events.join(at, events["event_id"] == at["_id"])
    cuts = at.agg(F.percentile_approx("_at", [1 / 3, 2 / 3])).first()[0]
    third = F.when(F.col("_at") <= cuts[0], 0).when(F.col("_at") <= cuts[1], 1).otherwise(2)
    for part in range(3):
        timed.where(third == part).drop("event_id", "_id", "_at").write.mode("append").parquet(f"{base}/in")
        # The checkpoint goes on where it was, and the store and the table with it.
        online.process_stream(online.read_events(spark, f"{base}/in"), SPEC, f"{base}/decisions", f"{base}/audit", f"{base}/checkpoint", store=store and store(f"{base}/profiles")).awaitTermination()
    return base


@query("n5_process_stream", "WITH " + _TREE_SRC + f""", cal AS (SELECT event_id, {_KNOT_SQL} AS c FROM tree),
ok AS (SELECT i.*, e.ts AS event_time, concat('ev_', CAST(i.event_id AS VARCHAR)) AS transaction_id, coalesce(f0, 0) AS amount, event_type AS country, concat('d', CAST(i.event_id % 9 AS VARCHAR)) AS destination
  FROM inputs i JOIN events e ON i.event_id = e.event_id WHERE i.event_id % 29 <> 0 AND i.event_id % 31 <> 0 AND i.event_id % 37 <> 0 AND i.event_id % 41 <> 0 AND i.event_id % 43 <> 0 AND i.event_id % 47 <> 0
  AND NOT (i.event_id % 17 = 0 AND i.event_id % 19 = 0 AND i.event_id % 23 = 0)),
""" + _velocity("ok", GEO_W) + ", " + _fold("ok", GEO_W) + f""", before_event AS (SELECT v.*, f.tx_count, f.avg_amount, f.std_dev_amount,
  row_number() OVER (PARTITION BY v.user_id, v.country ORDER BY v.event_time) = 1 AS country_is_new, row_number() OVER (PARTITION BY v.user_id, v.destination ORDER BY v.event_time) = 1 AS destination_is_new
  FROM velocity v JOIN fold f ON v.transaction_id = f.transaction_id)
SELECT transaction_id, round(amount, 2)::DOUBLE AS amount, CASE WHEN c < 0.15::DOUBLE THEN 'allowed' WHEN c < 0.55::DOUBLE THEN 'challenged' ELSE 'blocked' END AS decision, round(c, 6) AS calibrated_score,
  CAST(tx_last_10min AS INTEGER) AS profile_tx_last_10min,
  std_dev_amount <> 0 AND amount > avg_amount + 2 * std_dev_amount AS flag_amount, tx_count > 0 AND country_is_new AS flag_country, tx_last_10min >= 3 AS flag_velocity, tx_count > 0 AND destination_is_new AS flag_destination
FROM before_event a JOIN cal ON a.event_id = cal.event_id""")
def n5(spark, d):
    base = run_stream(spark, d)
    out = spark.read.schema(online.DECISION_SCHEMA).parquet(f"{base}/decisions")
    return out.select(
        "transaction_id", F.col("amount").cast("double"), "decision", F.col("calibrated_score").cast("double"), "profile_tx_last_10min",
        "flag_amount", "flag_country", "flag_velocity", "flag_destination",
    )


@query("n5_dead_letters", """
SELECT CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '' ELSE concat('rq_', CAST(event_id AS VARCHAR)) END AS request_id,
  CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '' ELSE concat('ev_', CAST(event_id AS VARCHAR)) END AS transaction_id, errors FROM (""" + _REQUEST_ERRORS + """) WHERE errors <> ''""")
def n5_dead_letters(spark, d):
    base = _run_dir(spark, "rejects")
    _events(spark, d).drop("event_id").write.parquet(f"{base}/in")
    online.reject_stream(online.read_events(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    kept = spark.read.schema("trace struct<request_id:string>, transaction struct<transaction_id:string>, errors array<string>").json(f"{base}/out")
    return as_text(kept.select("trace.request_id", "transaction.transaction_id", "errors"), "errors")


@query("n6_dedupe_stream", "SELECT DISTINCT event_id AS transaction_id FROM events")
def n6(spark, d):
    base = _run_dir(spark, "dedupe")
    e = A.table(spark, d, "events").select(F.col("event_id").alias("transaction_id"), F.col("ts").cast("timestamp").alias("event_time"))
    e.unionByName(e).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("transaction_id bigint, event_time timestamp").parquet(f"{base}/in")
    out = online.dedupe_stream(stream, delay="60 days")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("transaction_id bigint, event_time timestamp").parquet(f"{base}/out").select("transaction_id")


# --- monitoring -----------------------------------------------------------------------------------

def psi_sql(ref: str, cur: str, field: str, name: str) -> str:
    q = ", ".join(f"{p!r}::DOUBLE" for p in quantile_grid(10))
    b = "least(len(list_filter(e, lambda x: x <= v)), len(e) - 1)"
    return f"""{name}_e AS (SELECT list_sort(list_distinct(quantile_cont({field}, [{q}]))) AS e FROM {ref}),
{name}_h AS (SELECT side, {b} AS bin, count(*) AS n FROM (SELECT 'ref' AS side, {field} AS v FROM {ref} UNION ALL SELECT 'cur', {field} FROM {cur}) CROSS JOIN {name}_e WHERE v >= e[1] AND v <= e[len(e)] GROUP BY side, bin),
{name}_b AS (SELECT bin, coalesce(sum(n) FILTER (side = 'ref'), 0) AS r, coalesce(sum(n) FILTER (side = 'cur'), 0) AS c FROM {name}_h GROUP BY bin),
{name}_s AS (SELECT greatest(r / greatest(sum(r) OVER (), 1)::DOUBLE, 1e-9) AS r, greatest(c / greatest(sum(c) OVER (), 1)::DOUBLE, 1e-9) AS c FROM {name}_b),
{name} AS (SELECT sum((c - r) * ln(c / r)) AS psi FROM {name}_s)"""


_PARTS = ["ref AS (SELECT * FROM decisions WHERE split = 'valid')", "cur AS (SELECT * FROM decisions WHERE split = 'test')"]


def _drift_parts(spark, d):
    x = A.decisions(spark, d)
    return x.where(F.col("split") == "valid"), x.where(F.col("split") == "test")


@query("o1_psi", with_ctes(A.DECISIONS, *_PARTS, psi_sql("ref", "cur", "latency_ms", "p")) + "SELECT round(psi, 6) AS psi FROM p")
def o1(spark, d):
    return rounded(monitoring.psi(*_drift_parts(spark, d), "latency_ms"), "psi")


@query("o2_severity", with_ctes(A.BRANCHES) + "SELECT transaction_id, CASE WHEN branch_c_score >= 0.75::DOUBLE THEN 'critical' WHEN branch_c_score >= 0.25::DOUBLE THEN 'warning' ELSE 'ok' END AS severity FROM branches")
def o2(spark, d):
    from riskloom.functions.columns import severity

    return A.branches(spark, d).select("transaction_id", severity("branch_c_score", 0.25, 0.75).alias("severity"))


_SEV = "CASE WHEN psi >= {c} THEN 'critical' WHEN psi >= {w} THEN 'warning' ELSE 'ok' END AS severity"


@query("o3_score_drift", with_ctes(A.DECISIONS, *_PARTS, psi_sql("ref", "cur", "raw_fused_score", "p"), psi_sql("ref", "cur", "calibrated_score", "q")) + f"""
SELECT 'raw_fused_score' AS field, round(psi, 6) AS psi, {_SEV.format(w=0.1, c=0.25)} FROM p UNION ALL SELECT 'calibrated_score', round(psi, 6), {_SEV.format(w=0.1, c=0.25)} FROM q""")
def o3(spark, d):
    return rounded(monitoring.score_drift(*_drift_parts(spark, d)), "psi")


@query("o4_feature_drift", with_ctes(A.DECISIONS, *_PARTS, psi_sql("ref", "cur", "latency_ms", "p"), psi_sql("ref", "cur", "index", "q")) + f"""
SELECT 'latency_ms' AS feature, round(psi, 6) AS psi, {_SEV.format(w=0.15, c=0.3)} FROM p UNION ALL SELECT 'index', round(psi, 6), {_SEV.format(w=0.15, c=0.3)} FROM q UNION ALL SELECT 'v258', NULL, 'missing'""")
def o4(spark, d):
    cfg = monitoring.DriftConfig(("latency_ms", "index", "v258"), 0.15, 0.3)
    return rounded(monitoring.feature_drift(*_drift_parts(spark, d), cfg), "psi")


@query("o5_latency_report", """
SELECT event_type AS scenario, count(*) AS samples, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50_ms, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95_ms, round(quantile_cont(value, 0.99::DOUBLE), 6) AS p99_ms,
  CASE WHEN quantile_cont(value, 0.99::DOUBLE) >= 300 THEN 'critical' WHEN quantile_cont(value, 0.5::DOUBLE) >= 25 OR quantile_cont(value, 0.95::DOUBLE) >= 75 OR quantile_cont(value, 0.99::DOUBLE) >= 150 THEN 'warning' ELSE 'ok' END AS severity
FROM events GROUP BY event_type""")
def o5(spark, d):
    return rounded(monitoring.latency_report(A.branches(spark, d), by=["scenario"]), "p50_ms", "p95_ms", "p99_ms")


def _log(spark, d):
    e = A.table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        F.when(i % 101 == 0, F.lit(0)).otherwise(i).alias("transaction_id"), (i % 300 == 0).alias("contract_mismatch"), (i % 15 == 0).alias("rebuilt"),
        F.when(i % 400 == 0, 2).otherwise(0).alias("missing_features"), F.when(i % 9 != 0, 1).alias("is_fraud"),
    )


@query("o6_data_quality", """
WITH log AS (SELECT CASE WHEN event_id % 101 = 0 THEN 0 ELSE event_id END AS id, event_id FROM events),
r AS (SELECT count(*) AS rows_scored, count(*) FILTER (event_id % 300 = 0) / count(*)::DOUBLE AS cm, count(*) FILTER (event_id % 15 = 0) / count(*)::DOUBLE AS rb, 2 * count(*) FILTER (event_id % 400 = 0) / count(*)::DOUBLE AS mf,
  count(*) - count(DISTINCT id) AS dup, count(*) FILTER (event_id % 9 = 0) / count(*)::DOUBLE AS nl FROM log)
SELECT rows_scored, round(cm, 6) AS contract_mismatch_rate, round(rb, 6) AS rebuild_rate, round(mf, 6) AS missing_feature_rate, dup AS duplicate_transaction_id_count, round(nl, 6) AS null_label_rate,
  array_to_string(list_filter([CASE WHEN cm > 0.005 THEN 'contract_mismatch_rate' END, CASE WHEN rb > 0.05 THEN 'rebuild_rate' END, CASE WHEN mf > 0.001 THEN 'missing_feature_rate' END, CASE WHEN dup > 0 THEN 'duplicate_transaction_id_count' END], lambda x: x IS NOT NULL), ',') AS breaches,
  'critical' AS severity FROM r""")
def o6(spark, d):
    out = as_text(monitoring.data_quality(_log(spark, d)), "breaches")
    return rounded(out, "contract_mismatch_rate", "rebuild_rate", "missing_feature_rate", "null_label_rate")


_LOGS = """logs AS (SELECT 'active' AS side, is_fraud, branch_b_score AS score, CASE WHEN branch_b_score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS predicted_label FROM branches
  UNION ALL SELECT 'baseline', is_fraud, branch_a_score, CASE WHEN branch_a_score >= 0.5::DOUBLE THEN 1 ELSE 0 END FROM branches)"""


def _log_of(spark, d, branch):
    s = F.col(f"{branch}_score")
    return A.branches(spark, d).select("transaction_id", "is_fraud", s.alias("score"), (s >= 0.5).cast("int").alias("predicted_label"))


@query("o7_rollback_check", with_ctes(
    A.BRANCHES, _LOGS, f"flat AS (SELECT *, {PRF} FROM (SELECT side, {FLAT} FROM logs GROUP BY side))", curve_cte("logs", "side"),
    f"ranks AS (SELECT side, {AP} AS ap, {AUC} AS auc FROM curve GROUP BY side)",
    "m AS (SELECT max(ap) FILTER (side = 'active') AS a1, max(ap) FILTER (side = 'baseline') AS b1, max(f1) FILTER (side = 'active') AS a2, max(f1) FILTER (side = 'baseline') AS b2, max(auc) FILTER (side = 'active') AS a3, max(auc) FILTER (side = 'baseline') AS b3 FROM flat JOIN ranks USING (side))",
    "rows AS (SELECT 'average_precision' AS metric, a1 AS a, b1 AS b, 0.05 AS t FROM m UNION ALL SELECT 'f1', a2, b2, 0.05 FROM m UNION ALL SELECT 'roc_auc', a3, b3, 0.03 FROM m)",
) + "SELECT metric, round(a, 6) AS active, round(b, 6) AS baseline, round(b - a, 6) AS \"drop\", b - a >= t AS breached FROM rows")
def o7(spark, d):
    out = monitoring.rollback_check(_log_of(spark, d, "branch_b"), _log_of(spark, d, "branch_a"))
    return rounded(out, "active", "baseline", "drop")


_WINDOWED = with_ctes(A.DECISIONS) + """
, w AS (SELECT time_bucket(INTERVAL 60 MINUTE, processed_at) AS t, count(*) AS n, avg(latency_ms) AS mean_latency_ms FROM decisions WHERE processed_at IS NOT NULL GROUP BY 1),
b AS (SELECT *, mean_latency_ms >= 75 AS breach FROM w), p AS (SELECT b.*, coalesce(q.breach, false) AS before FROM b LEFT JOIN b q ON q.t = b.t - INTERVAL 60 MINUTE)
SELECT CAST(epoch(t) AS BIGINT) AS window_start, n, round(mean_latency_ms, 6) AS mean_latency_ms, breach, CASE WHEN breach AND before THEN 'critical' WHEN breach THEN 'warning' ELSE 'ok' END AS severity FROM p"""


@query("o9_windowed_monitoring", _WINDOWED)
def o9(spark, d):
    out = monitoring.windowed_monitoring(A.decisions(spark, d))
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), "mean_latency_ms")


@query("o9_monitoring_stream", _WINDOWED)
def o9_stream(spark, d):
    """The log in four batches by time, some rows up to 50 minutes late, and at the end one row far ahead that closes the last windows."""
    base = _run_dir(spark, "monitor")
    log = A.decisions(spark, d).select("processed_at", "latency_ms", "transaction_id").where("processed_at is not null")
    at = F.unix_seconds(F.col("processed_at").cast("timestamp"))
    arrives = at + F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(7)) == 0, 3000).otherwise(0)
    low, high = log.agg(F.min(arrives), F.max(arrives)).first()
    part = F.least(F.floor((arrives - low) * 4 / (high - low + 1)), F.lit(3))
    schema = "processed_at timestamp, latency_ms double"
    for i in range(5):
        rows = log.where(part == i).select(F.col("processed_at").cast("timestamp").alias("processed_at"), F.col("latency_ms").cast("double").alias("latency_ms"))
        if i == 4:
            rows = spark.range(1).select(F.timestamp_seconds(F.lit(high + 10 * 86_400)).alias("processed_at"), F.lit(0.0).alias("latency_ms"))
        rows.write.mode("append").parquet(f"{base}/in")
        monitor.monitor_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema(monitor.WINDOW_SCHEMA).parquet(f"{base}/out").drop("batch")
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), "mean_latency_ms")


def _retraining_sql() -> str:
    limits = {
        "score_drift_psi": 0.25, "precision_drop_absolute": 0.08, "recall_drop_absolute": 0.08, "brier_score_increase_absolute": 0.02,
        "contract_mismatch_rate": 0.01, "data_volume_growth_ratio": 1.25, "minimum_new_rows": 50_000.0, "label_coverage_ratio": 0.9,
    }
    side = """SELECT count(*)::DOUBLE AS n, avg(CASE WHEN calibrated_score >= 0.5::DOUBLE THEN is_fraud::DOUBLE END) AS precision,
      avg(CASE WHEN is_fraud = 1 THEN (calibrated_score >= 0.5::DOUBLE)::INTEGER::DOUBLE END) AS recall, avg((calibrated_score - is_fraud) * (calibrated_score - is_fraud)) AS brier,
      avg((index % 300 = 0)::INTEGER::DOUBLE) AS mismatch, avg((is_fraud IS NOT NULL)::INTEGER::DOUBLE) AS coverage FROM decisions WHERE split = """
    values = {
        "score_drift_psi": "psi", "precision_drop_absolute": "coalesce(a.precision, 0) - coalesce(b.precision, 0)", "recall_drop_absolute": "coalesce(a.recall, 0) - coalesce(b.recall, 0)",
        "brier_score_increase_absolute": "b.brier - a.brier", "contract_mismatch_rate": "b.mismatch", "data_volume_growth_ratio": "b.n / a.n", "minimum_new_rows": "b.n", "label_coverage_ratio": "b.coverage",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS trigger, round(({values[k]})::DOUBLE, 6) AS value, {limits[k]}::DOUBLE AS \"limit\", ({values[k]}) >= {limits[k]}::DOUBLE AS fired FROM a, b, p" for k in limits)
    return with_ctes(A.DECISIONS, *_PARTS, psi_sql("ref", "cur", "calibrated_score", "p"), f"a AS ({side}'valid')", f"b AS ({side}'test')") + rows


@query("o10_retraining_triggers", _retraining_sql())
def o10(spark, d):
    x = A.decisions(spark, d).select(
        "transaction_id", "is_fraud", "calibrated_score", F.col("calibrated_score").alias("score"), (F.col("calibrated_score") >= 0.5).cast("int").alias("predicted_label"),
        (F.col("index") % 300 == 0).alias("contract_mismatch"), "split",
    )
    return rounded(monitoring.retraining_triggers(x.where(F.col("split") == "valid"), x.where(F.col("split") == "test")), "value")


# --- reports ----------------------------------------------------------------------------------------

@query("p1_decision_stats", with_ctes(A.DECISIONS) + """
SELECT count(*) AS total_transactions, count(*) FILTER (lower(trim(decision)) = 'allowed') AS allowed, count(*) FILTER (lower(trim(decision)) IN ('challenge', 'challenged')) AS challenge,
       count(*) FILTER (lower(trim(decision)) = 'blocked') AS blocked FROM decisions""")
def p1(spark, d):
    return reports.decision_stats(A.decisions(spark, d))


@query("p1_decision_stats_strict", with_ctes(A.DECISIONS) + """
SELECT count(*) AS total_transactions, count(*) FILTER (lower(trim(decision)) = 'allowed') AS allowed, count(*) FILTER (lower(trim(decision)) = 'challenge') AS challenge,
       count(*) FILTER (lower(trim(decision)) = 'blocked') AS blocked FROM decisions""")
def p1_strict(spark, d):
    return reports.decision_stats(A.decisions(spark, d), reports.STRICT_LABELS)


@query("d12_recent_transactions", with_ctes(A.DECISIONS) + "SELECT transaction_id, decision, score, CAST(epoch_us(processed_at) AS BIGINT) AS micros FROM decisions ORDER BY processed_at DESC NULLS LAST, transaction_id DESC LIMIT 100")
def d12(spark, d):
    rows = A.decisions(spark, d).select("transaction_id", "decision", "score", "processed_at")
    return reports.recent_transactions(rows, 250).select("transaction_id", "decision", "score", F.unix_micros(F.col("processed_at").cast("timestamp")).alias("micros"))


@query("p2_recent_transactions_json", with_ctes(A.DECISIONS) + """
SELECT transaction_id, concat('{"transaction_id":"', transaction_id, '","score":', CAST(score AS VARCHAR), ',"processed_at":"', strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z"}') AS json
FROM decisions ORDER BY processed_at DESC NULLS LAST, transaction_id DESC LIMIT 20""")
def p2(spark, d):
    return reports.recent_transactions_json(A.decisions(spark, d).select("transaction_id", "score", "processed_at"))


_RESULTS = A.DECISIONS + """,
results AS (SELECT index, scenario, lower(trim(decision)) AS decision, calibrated_score, latency_ms AS client_rtt_ms, latency_ms / 2 AS server_total_ms, CASE WHEN index % 20 = 0 THEN 'timeout' ELSE '' END AS error,
  CASE scenario WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'allowed' ELSE 'challenged' END AS expected_decision, CAST(1 + index % 4 AS DOUBLE) AS feature_count FROM decisions)"""


def _results(spark, d):
    return A.decisions(spark, d).select(
        "index", "scenario", F.lower(F.trim("decision")).alias("decision"), "calibrated_score", F.col("latency_ms").alias("client_rtt_ms"), (F.col("latency_ms") / 2).alias("server_total_ms"),
        F.when(F.col("index") % 20 == 0, "timeout").otherwise("").alias("error"),
        F.when(F.col("scenario") == "error", "blocked").when(F.col("scenario") == "view", "allowed").otherwise("challenged").alias("expected_decision"),
        (1 + F.col("index") % 4).cast("double").alias("feature_count"),
    )


_Q = "round(quantile_cont({0}, 0.5::DOUBLE), 6) AS p50, round(quantile_cont({0}, 0.95::DOUBLE), 6) AS p95, round(quantile_cont({0}, 0.99::DOUBLE), 6) AS p99"


@query("q1_scenario_audit", with_ctes(_RESULTS) + f"""
, good AS (SELECT * FROM results WHERE error = ''),
dc AS (SELECT scenario, string_agg(concat(decision, '=', CAST(n AS VARCHAR)), ',' ORDER BY decision) AS decision_counts FROM (SELECT scenario, decision, count(*) AS n FROM good GROUP BY ALL) GROUP BY scenario),
sc AS (SELECT scenario, count(*) FILTER (decision = expected_decision) AS matched_count, round(avg(calibrated_score), 6) AS score_mean, {_Q.format('calibrated_score')} FROM good GROUP BY scenario),
rq AS (SELECT scenario, min(expected_decision) AS expected_decision, count(*) AS request_count FROM results GROUP BY scenario)
SELECT scenario, expected_decision, request_count, matched_count, round(matched_count / request_count::DOUBLE, 6) AS matched_rate, decision_counts, score_mean, p50 AS score_p50, p95 AS score_p95, p99 AS score_p99
FROM rq JOIN sc USING (scenario) JOIN dc USING (scenario)""")
def q1(spark, d):
    out = reports.scenario_audit(_results(spark, d))
    text = F.array_join(F.transform(F.map_entries("decision_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    out = out.withColumn("decision_counts", text).drop("score_count", "score_min", "score_max")
    return rounded(out, "matched_rate", "score_mean", "score_p50", "score_p95", "score_p99")


@query("q2_distribution_summary", """
SELECT 'value' AS metric, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, """ + _Q.format("value") + """ FROM events UNION ALL
SELECT 'user_id', count(*), min(user_id)::DOUBLE, max(user_id)::DOUBLE, round(avg(user_id), 6), """ + _Q.format("user_id").replace("quantile_cont(user_id", "quantile_cont(user_id::DOUBLE") + " FROM events")
def q2(spark, d):
    return rounded(reports.distribution_summary(A.table(spark, d, "events"), ["value", "user_id"]), "mean", "p50", "p95", "p99")


def _summary_sql() -> str:
    parts = [
        "SELECT 'run' AS section, 'requests' AS name, count(*)::DOUBLE AS value FROM results", "SELECT 'run', 'errors', count(*) FILTER (error <> '')::DOUBLE FROM results",
        "SELECT 'decision', decision, count(*)::DOUBLE FROM good GROUP BY decision", "SELECT 'scenario', scenario, count(*)::DOUBLE FROM results GROUP BY scenario",
    ]
    for metric, src in (("client_rtt_ms", "results"), ("server_total_ms", "good"), ("calibrated_score", "good"), ("feature_count", "results")):
        for stat, expr in (("count", f"count({metric})::DOUBLE"), ("min", f"min({metric})"), ("max", f"max({metric})"), ("mean", f"avg({metric})"), ("p50", f"quantile_cont({metric}, 0.5::DOUBLE)"),
                           ("p95", f"quantile_cont({metric}, 0.95::DOUBLE)"), ("p99", f"quantile_cont({metric}, 0.99::DOUBLE)")):
            parts.append(f"SELECT '{metric}', '{stat}', round({expr}, 6) FROM {src}")
    return " UNION ALL ".join(parts)


@query("q3_run_summary", with_ctes(_RESULTS, "good AS (SELECT * FROM results WHERE error = '')") + _summary_sql())
def q3(spark, d):
    r = _results(spark, d)
    return rounded(reports.run_summary(r, r), "value")


# --- models --------------------------------------------------------------------------------------------

FEATURES = ("branch_b_score", "branch_c_score", "latency_ms")


def _model_data(spark, d):
    b = A.branches(spark, d).select("transaction_id", "is_fraud", *FEATURES, "split")
    return b.where(F.col("split") == "valid").drop("split"), b.where(F.col("split") == "test").drop("split")




def _fit_and_score(spark, d, fit):
    train, test = _model_data(spark, d)
    return models.score_with(fit(train, FEATURES), test, FEATURES).select("transaction_id", "is_fraud", "score", "predicted_label")


@query("r1_fit_random_forest")
def r1(spark, d):
    return _fit_and_score(spark, d, lambda t, f: models.fit_random_forest(t, f))


@query("r2_fit_gbt")
def r2(spark, d):
    return _fit_and_score(spark, d, lambda t, f: models.fit_gbt(t, f))


@query("r3_fit_nystrom")
def r3(spark, d):
    return _fit_and_score(spark, d, lambda t, f: models.fit_nystrom(t, f))


@query("r4_train_branch")
def r4(spark, d):
    train, test = _model_data(spark, d)
    # A part of its own to validate on, by a hash of the id.
    kept = F.pmod(F.xxhash64("transaction_id"), F.lit(5)) > 0
    out = models.train_branch(train.where(kept), train.where(~kept), test, Contract(FEATURES), lambda t, f: models.fit_random_forest(t, f))
    return out.metrics


@query("l22_permutation_importance")
def l22(spark, d):
    train, test = _model_data(spark, d)
    return models.permutation_importance(models.fit_random_forest(train, FEATURES), test, FEATURES)


@query("l23_feature_importance_table")
def l23(spark, d):
    train, _ = _model_data(spark, d)
    return models.feature_importance_table(models.fit_random_forest(train, FEATURES), FEATURES, train)


def _bundle(spark, d):
    t = A.txn(spark, d)
    tab = prepare_tabular(history.behavioral_features(t), _split_txn(spark, d).select("transaction_id", "split"), ratio=2.0, top_k=6)
    forest = models.fit_random_forest(tab.train, tab.features)
    valid = models.score_with(forest, tab.valid, tab.features)
    return scoring.Bundle(Contract(tab.features), {"tree_branch": forest}, FusionRecipe("best_branch", ("tree_branch",)), isotonic_fit(valid), 0.5, tab.stats), t


@query("m7_align_features")
def m7(spark, d):
    bundle, t = _bundle(spark, d)
    out = scoring.align_features(history.behavioral_features(t), bundle.contract, bundle.scaler)
    return out.df.withColumn("source_stage", F.lit(out.source_stage))


@query("m8_score_branches")
def m8(spark, d):
    train, test = _model_data(spark, d)
    fitted = {"tree_branch": models.fit_random_forest(train, FEATURES), "boosted_branch": models.fit_gbt(train, FEATURES)}
    return scoring.score_branches(test, fitted, FEATURES).select(
        "transaction_id", "tree_branch_score", "tree_branch_predicted_label", "boosted_branch_score", "boosted_branch_predicted_label"
    )


@query("m9_batch_score")
def m9(spark, d):
    bundle, t = _bundle(spark, d)
    return scoring.batch_score(history.behavioral_features(t), bundle)[0]
