"""Views of the given tables in the shapes the operators expect, for Spark and for the SQL oracle.

Each adapter covers its whole table. Dirt (NULLs, blanks, unparsable text, copies) is derived from
the values, so both engines see the same.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2024-01-22 00:00:00"  # earlier events form the validation part, later ones the test part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, key: str = "event_id"):
    return F.col(key) % n == 0


# --- txn: clean transactions from events ---------------------------------------------------

def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.col("ts").alias("transaction_timestamp"),
        F.col("event_id").alias("transaction_order"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name_orig"),
        F.when(every(13), F.lit(None)).when(every(19), "").otherwise(F.concat(F.lit("d"), (k % 12).cast("string"))).alias("name_dest"),
        F.when(~every(17), F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
    )


TXN = """txn AS (
  SELECT concat('ev_', CAST(event_id AS VARCHAR)) AS transaction_id, ts AS transaction_timestamp, event_id AS transaction_order,
         event_type AS type, concat('u', CAST(user_id AS VARCHAR)) AS name_orig,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 19 = 0 THEN ''
              ELSE concat('d', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS VARCHAR)) END AS name_dest,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS amount,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud
  FROM events)"""


# --- ledger: transactions with balances from orders and customer -------------------------------

def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("transaction_order"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("oldbalance_org"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("c_acctbal") - F.col("o_totalprice") / 100).alias("newbalance_orig"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 7).alias("oldbalance_dest"),
        (F.col("c_acctbal") - 500).alias("newbalance_dest"),
    )


LEDGER = """ledger AS (
  SELECT o_orderkey AS transaction_order, o_totalprice AS amount, c_acctbal AS oldbalance_org,
         CASE WHEN o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) ELSE c_acctbal - o_totalprice / 100 END AS newbalance_orig,
         CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 7 END AS oldbalance_dest,
         c_acctbal - 500 AS newbalance_dest
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- dirty: two raw text sources ------------------------------------------------------------------

def dirty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source ``a.csv`` is all events as dirty text; ``b.csv`` repeats its sign-ups exactly."""
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    value = F.col("value").cast("string")
    a = e.select(
        F.when(every(7), F.concat(F.lit("  ev_"), text, F.lit(" "))).otherwise(F.concat(F.lit("ev_"), text)).alias("TransactionId"),
        F.when(every(41), "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("transaction timestamp"),
        F.when(every(43), F.concat(text, F.lit(".5"))).when(every(5), F.concat(text, F.lit(".0"))).otherwise(text).alias("step"),
        F.col("event_type").alias("type"),
        F.when(every(23), "abc").when(every(29), F.concat(F.lit("-"), value)).when(every(17), "").otherwise(value).alias("Amount"),
        F.when(every(31), "  ").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("nameOrig"),
        F.when(~every(13), F.concat(F.lit("d"), F.get_json_object("props", "$.k"))).alias("nameDest"),
        F.when(every(19), "x1").otherwise((F.col("event_id") % 1000).cast("string")).alias("oldbalanceOrg"),
        F.when(every(37), "-5").otherwise((F.col("event_id") % 700).cast("string")).alias("newbalanceOrig"),
        F.when(every(47), "maybe").when(F.col("event_type") == "error", "Yes").when(F.col("event_type") == "view", " found")
        .when(F.col("event_type") == "click", "0").otherwise(" NotFound ").alias("isFraud"),
        F.col("event_id").alias("_line"),
    )
    return {"a.csv": a, "b.csv": a.where(F.col("type") == "signup")}


_DIRTY_ROW = """
  SELECT CASE WHEN event_id % 7 = 0 THEN concat('  ev_', CAST(event_id AS VARCHAR), ' ') ELSE concat('ev_', CAST(event_id AS VARCHAR)) END AS transaction_id,
         CASE WHEN event_id % 41 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS transaction_timestamp,
         CASE WHEN event_id % 43 = 0 THEN concat(CAST(event_id AS VARCHAR), '.5') WHEN event_id % 5 = 0 THEN concat(CAST(event_id AS VARCHAR), '.0')
              ELSE CAST(event_id AS VARCHAR) END AS step,
         event_type AS type,
         CASE WHEN event_id % 23 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN concat('-', CAST(value AS VARCHAR)) WHEN event_id % 17 = 0 THEN ''
              ELSE CAST(value AS VARCHAR) END AS amount,
         CASE WHEN event_id % 31 = 0 THEN '  ' ELSE concat('u', CAST(user_id AS VARCHAR)) END AS name_orig,
         CASE WHEN event_id % 13 <> 0 THEN concat('d', json_extract_string(props, '$.k')) END AS name_dest,
         CASE WHEN event_id % 19 = 0 THEN 'x1' ELSE CAST(event_id % 1000 AS VARCHAR) END AS oldbalance_org,
         CASE WHEN event_id % 37 = 0 THEN '-5' ELSE CAST(event_id % 700 AS VARCHAR) END AS newbalance_orig,
         CASE WHEN event_id % 47 = 0 THEN 'maybe' WHEN event_type = 'error' THEN 'Yes' WHEN event_type = 'view' THEN ' found'
              WHEN event_type = 'click' THEN '0' ELSE ' NotFound ' END AS is_fraud,
         event_id AS line
  FROM events"""

# Trimmed text with provenance; then one row per distinct payload; then typed with reasons.
RAW = f"""dirty_rows AS ({_DIRTY_ROW}),
sources AS (
  SELECT 'a.csv' AS source_file, row_number() OVER (ORDER BY line) AS source_file_row_number, * FROM dirty_rows
  UNION ALL
  SELECT 'b.csv', row_number() OVER (ORDER BY line), * FROM dirty_rows WHERE type = 'signup'),
raw AS (
  SELECT source_file_row_number AS source_row_number, source_file, source_file_row_number, trim(transaction_id) AS transaction_id,
         trim(transaction_timestamp) AS transaction_timestamp, trim(step) AS step, trim(type) AS type, trim(amount) AS amount,
         trim(name_orig) AS name_orig, trim(name_dest) AS name_dest, trim(oldbalance_org) AS oldbalance_org,
         trim(newbalance_orig) AS newbalance_orig, trim(is_fraud) AS is_fraud
  FROM sources)"""
_NUM = "CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({0} AS DOUBLE) END"
TYPED = RAW + f""",
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id, transaction_timestamp, step, type, amount, name_orig, name_dest,
             oldbalance_org, newbalance_orig, is_fraud ORDER BY source_file, source_file_row_number) AS rn FROM raw) WHERE rn = 1),
typed AS (
  SELECT source_row_number, source_file, source_file_row_number, transaction_id, type, name_orig, name_dest,
         transaction_timestamp AS ts_text, step AS step_text, amount AS amount_text, oldbalance_org AS old_text, newbalance_orig AS new_text, is_fraud AS fraud_text,
         TRY_CAST(transaction_timestamp AS TIMESTAMP) AS transaction_timestamp,
         CASE WHEN {_NUM.format('step')} % 1 = 0 THEN CAST({_NUM.format('step')} AS BIGINT) END AS step,
         {_NUM.format('amount')} AS amount, {_NUM.format('oldbalance_org')} AS oldbalance_org, {_NUM.format('newbalance_orig')} AS newbalance_orig,
         CASE WHEN lower(is_fraud) IN ('1','true','t','yes','y','found') THEN true
              WHEN lower(is_fraud) IN ('0','false','f','no','n','notfound','not_found') THEN false END AS is_fraud
  FROM deduped),
flagged AS (
  SELECT *, list_filter([
      CASE WHEN coalesce(amount_text, '') <> '' AND amount IS NULL THEN 'invalid_amount' END,
      CASE WHEN coalesce(old_text, '') <> '' AND oldbalance_org IS NULL THEN 'invalid_oldbalance_org' END,
      CASE WHEN coalesce(new_text, '') <> '' AND newbalance_orig IS NULL THEN 'invalid_newbalance_orig' END,
      CASE WHEN coalesce(step_text, '') <> '' AND step IS NULL THEN 'invalid_step' END,
      CASE WHEN coalesce(fraud_text, '') <> '' AND is_fraud IS NULL THEN 'invalid_is_fraud' END,
      CASE WHEN coalesce(ts_text, '') <> '' AND transaction_timestamp IS NULL THEN 'invalid_transaction_timestamp' END,
      CASE WHEN coalesce(transaction_id, '') = '' OR coalesce(name_orig, '') = '' OR coalesce(name_dest, '') = '' THEN 'missing_required_id' END,
      CASE WHEN amount < 0 THEN 'negative_amount' END,
      CASE WHEN oldbalance_org < 0 OR newbalance_orig < 0 THEN 'negative_balance' END,
      CASE WHEN (coalesce(old_text, '') <> '' AND oldbalance_org IS NULL) OR (coalesce(new_text, '') <> '' AND newbalance_orig IS NULL) THEN 'malformed_balance' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM typed)"""


# --- geo: events with users, countries and destinations ------------------------------------------------

GEO_ORDER = ("event_time", "transaction_id")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(s, li["l_suppkey"] == s["s_suppkey"])
        .join(n, s["s_nationkey"] == n["n_nationkey"])
        .select(
            F.concat_ws(
                "-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"),
                F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.col("l_partkey").cast("string"),
                (F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
            ).alias("transaction_id"),
            F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
            F.col("l_shipdate").alias("event_time"),
            F.col("l_extendedprice").alias("amount"),
            F.col("n_name").alias("country"),
            F.col("l_returnflag").alias("channel"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("destination"),
        )
    )


GEO = """geo AS (
  SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), CAST(l_linenumber AS VARCHAR), lpad(CAST(l_suppkey AS VARCHAR), 10, '0'),
                   CAST(l_partkey AS VARCHAR), CAST(CAST(trunc(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS transaction_id,
         concat('u', CAST(o_custkey AS VARCHAR)) AS user_id, l_shipdate AS event_time, l_extendedprice AS amount, n_name AS country,
         l_returnflag AS channel, concat('s', CAST(l_suppkey AS VARCHAR)) AS destination
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


# --- clicks: second-level events per user, some without a usable time -----------------------------------

def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few users with many events each, so that ten-minute and one-hour gaps occur."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("user_id"),
        F.when(~every(61), F.col("ts")).alias("event_time"),
        F.col("event_id").alias("arrival"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("country"),
        F.col("event_type").alias("channel"),
        F.concat(F.lit("d"), (F.get_json_object("props", "$.k").cast("bigint") % 12).cast("string")).alias("destination"),
    )


CLICKS = """clicks AS (
  SELECT event_id AS transaction_id, concat('g', CAST(user_id % 5 AS VARCHAR)) AS user_id, CASE WHEN event_id % 61 <> 0 THEN ts END AS event_time,
         event_id AS arrival, value AS amount, event_type AS country, event_type AS channel,
         concat('d', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS VARCHAR)) AS destination
  FROM events)"""


# --- branches: pseudo-scores of three models ---------------------------------------------------------------

def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    lit = lambda x: F.lit(float(x))
    part = lambda m, n: ((F.col("event_id") * m) % n).cast("double") / lit(n)
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.when(error, 1).otherwise(0).alias("is_fraud"),
        (lit(0.7) * part(7919, 1000) + F.when(error, lit(0.3)).otherwise(lit(0))).alias("branch_a_score"),
        (lit(0.9) * part(6101, 997) + F.when(error, lit(0.1)).otherwise(lit(0))).alias("branch_b_score"),
        part(4241, 991).alias("branch_c_score"),
        F.when(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"), "valid").otherwise("test").alias("split"),
        F.col("ts"),
        F.col("event_type").alias("scenario"),
        F.col("value").alias("latency_ms"),
    )


BRANCHES = f"""branches AS (
  SELECT concat('ev_', CAST(event_id AS VARCHAR)) AS transaction_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
         CAST(0.7 AS DOUBLE) * (CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)) + CASE WHEN event_type = 'error' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS branch_a_score,
         CAST(0.9 AS DOUBLE) * (CAST((event_id * 6101) % 997 AS DOUBLE) / CAST(997 AS DOUBLE)) + CASE WHEN event_type = 'error' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS branch_b_score,
         CAST((event_id * 4241) % 991 AS DOUBLE) / CAST(991 AS DOUBLE) AS branch_c_score,
         CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'valid' ELSE 'test' END AS split, ts, event_type AS scenario, value AS latency_ms
  FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of branch a at threshold 0.5."""
    b = branches(spark, sf_dir)
    return b.select(
        "transaction_id", "is_fraud", F.col("branch_a_score").alias("score"), (F.col("branch_a_score") >= 0.5).cast("int").alias("predicted_label"), "split"
    )


SCORED = BRANCHES + """,
scored AS (SELECT transaction_id, is_fraud, branch_a_score AS score, CASE WHEN branch_a_score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS predicted_label, split FROM branches)"""


def branch_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = branches(spark, sf_dir)
    return {
        n: b.select("transaction_id", "is_fraud", F.col(f"{n}_score").alias("score"), (F.col(f"{n}_score") >= 0.5).cast("int").alias("predicted_label"))
        for n in ("branch_a", "branch_b", "branch_c")
    }


# --- decisions: the decisions table and scoring logs ------------------------------------------------------

def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.operators.policy import decision_label, policy_action

    b = branches(spark, sf_dir)
    e = b.withColumn("action", policy_action("branch_a_score"))
    decision, score = decision_label("action", "branch_a_score")
    number = F.regexp_extract("transaction_id", "([0-9]+)$", 1).cast("bigint")
    return e.select(
        "transaction_id", "is_fraud", F.col("branch_a_score").alias("calibrated_score"), F.col("branch_b_score").alias("raw_fused_score"), "action",
        F.when(number % 11 == 0, F.concat(F.lit(" "), F.upper(decision), F.lit(" "))).otherwise(decision).alias("decision"),
        score.alias("score"), F.when(number % 41 != 0, F.col("ts")).alias("processed_at"), "latency_ms", "scenario", "split", number.alias("index"),
    )


DECISIONS = BRANCHES + """,
acted AS (SELECT *, CASE WHEN branch_a_score < CAST(0.15 AS DOUBLE) THEN 'allow' WHEN branch_a_score < CAST(0.55 AS DOUBLE) THEN 'review' ELSE 'block' END AS action,
                 CAST(substr(transaction_id, 4) AS BIGINT) AS index FROM branches),
labelled AS (SELECT *, CASE action WHEN 'allow' THEN 'allowed' WHEN 'block' THEN 'blocked' ELSE 'challenged' END AS label FROM acted),
decisions AS (
  SELECT transaction_id, is_fraud, branch_a_score AS calibrated_score, branch_b_score AS raw_fused_score, action,
         CASE WHEN index % 11 = 0 THEN concat(' ', upper(label), ' ') ELSE label END AS decision,
         CAST(round(branch_a_score * 100) AS INTEGER) AS score, CASE WHEN index % 41 <> 0 THEN ts END AS processed_at, latency_ms, scenario, split, index
  FROM labelled)"""


@lru_cache(maxsize=1)
def all_sql() -> dict[str, str]:
    return {"txn": TXN, "ledger": LEDGER, "raw": RAW, "typed": TYPED, "geo": GEO, "clicks": CLICKS, "branches": BRANCHES, "scored": SCORED, "decisions": DECISIONS}
