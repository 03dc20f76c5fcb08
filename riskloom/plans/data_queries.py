"""Queries over sources, cleaning, joins, features, history, splits."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import cleaning, features, history, joins, ordering, splits
from riskloom.plans import adapters as A
from riskloom.plans.registry import ORACLES, as_text, query, rounded, with_ctes
from riskloom.session import stage_root
from riskloom.sources import files, sinks

ENTITY = "name_orig"
ORDER = ["transaction_timestamp", "transaction_order"]
TXN_W = "PARTITION BY name_orig ORDER BY transaction_timestamp NULLS LAST, transaction_order"


# --- sources ------------------------------------------------------------------------------

@query("a2_read_table", "SELECT event_id, user_id, event_type, value FROM events")
def a2(spark, d):
    return files.read_table(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("a3_read_scoring_dataset", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def a3(spark, d):
    return files.read_scoring_dataset(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("a4_read_predictions", with_ctes(A.BRANCHES) + """
SELECT transaction_id, CASE WHEN scenario = 'view' THEN 0 ELSE is_fraud END AS is_fraud, round(branch_a_score, 6) AS score FROM branches""")
def a4(spark, d):
    b = A.branches(spark, d)
    raw = b.select("transaction_id", F.when(F.col("scenario") != "view", F.col("is_fraud").cast("string")).alias("is_fraud"), F.col("branch_a_score").cast("string").alias("score"))
    return rounded(files.predictions_from(raw), "score")


@query("a5_join_side_table", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment
FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN (SELECT o_orderkey AS k, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F') ON o_orderkey = k""")
def a5(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    side = o.where(F.col("o_orderstatus") == "F").join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")
    return cleaning.join_side_table(o.select("o_orderkey", "o_custkey"), side, "o_orderkey")


@query("a6_union_sources", with_ctes(A.RAW) + """
SELECT source_file, source_row_number, source_file_row_number, line FROM (SELECT source_file, source_file_row_number AS source_row_number, source_file_row_number, line FROM sources)""")
def a6(spark, d):
    frames = {n: f.withColumn("line", F.col("_line")) for n, f in A.dirty(spark, d).items()}
    out = cleaning.union_sources(frames, ["_line"])
    return out.select("source_file", "source_row_number", "source_file_row_number", "line")


@query("a11_insert_if_absent", with_ctes(A.DECISIONS) + """
SELECT transaction_id, min(score) AS score FROM (SELECT * FROM decisions WHERE split = 'test' UNION ALL SELECT * FROM decisions)
WHERE transaction_id NOT IN (SELECT transaction_id FROM decisions WHERE scenario = 'view') GROUP BY transaction_id""")
def a11(spark, d):
    rows = A.decisions(spark, d).select("transaction_id", "score", "split", "scenario")
    batch = rows.where(F.col("split") == "test").unionByName(rows)
    target = rows.where(F.col("scenario") == "view")
    return sinks.insert_if_absent(batch, target, "transaction_id", ["score"]).select("transaction_id", "score")


_PROFILE_SQL = """profiles AS (SELECT user_id, count(*) AS tx_count, avg(amount) AS avg_amount, stddev_pop(amount) AS std_dev_amount FROM clicks WHERE country <> 'view' AND user_id <> 'g3' GROUP BY user_id)"""


def _profiles(spark, d):
    c = A.clicks(spark, d).where((F.col("country") != "view") & (F.col("user_id") != "g3"))
    return c.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("tx_count"), F.avg("amount").alias("avg_amount"), F.stddev_pop("amount").alias("std_dev_amount")
    )


@query("a13_profile_lookup", with_ctes(A.CLICKS, _PROFILE_SQL) + """
SELECT transaction_id, clicks.user_id, coalesce(tx_count, 0) AS tx_count, round(coalesce(avg_amount, 0), 6) AS avg_amount, round(coalesce(std_dev_amount, 0), 6) AS std_dev_amount
FROM clicks LEFT JOIN profiles ON clicks.user_id = profiles.user_id""")
def a13(spark, d):
    events = A.clicks(spark, d).select("transaction_id", "user_id")
    return rounded(sinks.profile_lookup(events, _profiles(spark, d)), "avg_amount", "std_dev_amount")


@query("a14_profile_upsert", with_ctes(A.CLICKS, _PROFILE_SQL) + """
SELECT user_id, CASE WHEN user_id IN ('g0', 'g1') THEN 2 ELSE 1 END AS version, CASE WHEN user_id IN ('g0', 'g1') THEN tx_count + 1 ELSE tx_count END AS tx_count FROM profiles""")
def a14(spark, d):
    stored = _profiles(spark, d).select("user_id", F.lit(1).alias("version"), "tx_count")
    updates = stored.where(F.col("user_id").isin("g0", "g1")).select("user_id", F.lit(2).alias("version"), (F.col("tx_count") + 1).alias("tx_count"))
    return sinks.profile_upsert(stored, updates)


@query("a15_file_checksums")
def a15(spark, d):
    sums = files.file_checksums(spark, d)
    return sums.select(F.element_at(F.split("path", "/"), -1).alias("path"), "size_bytes", "sha256")


_CHECK_SQL = """
expected AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, sha256(text) AS sha256 FROM documents WHERE lang <> 'de'),
actual AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, CASE WHEN source = 'web' THEN sha256(concat(text, '!')) ELSE sha256(text) END AS sha256 FROM documents WHERE lang <> 'fr')"""


@query("a16_verify_checksums", "WITH " + _CHECK_SQL + """
SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' WHEN e.sha256 <> a.sha256 THEN 'mismatch' ELSE 'ok' END AS status
FROM expected e FULL OUTER JOIN actual a ON e.path = a.path""")
def a16(spark, d):
    docs = A.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "lang", "source",
        F.sha2(F.concat("text", F.lit("!")), 256).alias("other"),
    )
    expected = docs.where(F.col("lang") != "de")
    actual = docs.where(F.col("lang") != "fr").select("path", F.when(F.col("source") == "web", F.col("other")).otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_checksums(expected, actual)


@query("a17_duplicate_content", """
SELECT sha256(text) AS sha256, count(*) AS n, min(concat('doc/', lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS first_path, max(concat('doc/', lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS last_path
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def a17(spark, d):
    docs = A.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.sha2("text", 256).alias("sha256")
    )
    return files.duplicate_content(docs)


# --- typing ------------------------------------------------------------------------------

def _raw(spark, d):
    return cleaning.union_sources(A.dirty(spark, d), ["_line"])


def _typed(spark, d):
    return cleaning.coerce_frame(cleaning.dedupe_exact_keep_first(cleaning.trim_all(_raw(spark, d)), sources=["a.csv", "b.csv"]))


@query("b3_trim_all", with_ctes(A.RAW) + "SELECT source_file, source_file_row_number, transaction_id, name_orig, is_fraud FROM raw")
def b3(spark, d):
    return cleaning.trim_all(_raw(spark, d)).select("source_file", "source_file_row_number", "transaction_id", "name_orig", "is_fraud")


_CARD = """card AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS is_fraud, CAST(event_id * 60 AS VARCHAR) AS transaction_dt,
         CAST(value AS VARCHAR) AS transaction_amt, event_type AS product_cd, CAST(user_id AS VARCHAR) AS card1, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS card2,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 90 AS VARCHAR) END AS addr1
  FROM events)"""


def _card(spark, d):
    e = A.table(spark, d, "events")
    s = lambda c: c.cast("string")
    return e.select(
        s(F.col("event_id")).alias("transaction_id"), F.when(F.col("event_type") == "error", "1").otherwise("0").alias("is_fraud"),
        s(F.col("event_id") * 60).alias("transaction_dt"), s(F.col("value")).alias("transaction_amt"), F.col("event_type").alias("product_cd"),
        s(F.col("user_id")).alias("card1"), F.when(A.every(3), "").otherwise("x").alias("card2"), F.when(~A.every(5), s(F.col("event_id") % 90)).alias("addr1"),
    )


@query("b4_canonicalize", with_ctes(_CARD) + """
SELECT transaction_id, transaction_amt AS amount, product_cd AS type, CAST(transaction_dt AS BIGINT) AS step, 1512086400 + CAST(transaction_dt AS BIGINT) AS unix_seconds,
       concat('card1=', card1, CASE WHEN card2 <> '' THEN '|card2=x' ELSE '' END) AS name_orig,
       concat('type=', product_cd, CASE WHEN addr1 IS NULL THEN '' ELSE concat('|addr1=', addr1) END) AS name_dest, false AS is_flagged_fraud FROM card""")
def b4(spark, d):
    out = cleaning.canonicalize(_card(spark, d))
    return out.select("transaction_id", "amount", "type", "step", F.unix_seconds("transaction_timestamp").alias("unix_seconds"), "name_orig", "name_dest", "is_flagged_fraud")


@query("b5_compose_entity_id", with_ctes(_CARD) + """
SELECT transaction_id, CASE WHEN card2 = '' AND addr1 IS NULL THEN transaction_id WHEN card2 = '' THEN concat('addr1=', addr1) WHEN addr1 IS NULL THEN concat('card2=', card2)
       ELSE concat('card2=', card2, '|addr1=', addr1) END AS entity FROM card""")
def b5(spark, d):
    return _card(spark, d).select("transaction_id", C.compose_entity_id(["card2", "addr1"], "transaction_id").alias("entity"))


_TEXTS = """texts AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN concat(' ', CAST(value AS VARCHAR), ' ') WHEN event_id % 10 = 1 THEN concat(CAST(event_id AS VARCHAR), 'd')
  WHEN event_id % 10 = 2 THEN 'nan' WHEN event_id % 10 = 3 THEN concat(CAST(event_id AS VARCHAR), '.0') WHEN event_id % 10 = 4 THEN concat(CAST(event_id AS VARCHAR), '.5')
  WHEN event_id % 10 = 5 THEN '1_000' WHEN event_id % 10 = 6 THEN concat('-', CAST(event_id AS VARCHAR)) WHEN event_id % 10 = 7 THEN '' WHEN event_id % 10 = 8 THEN NULL
  ELSE concat(CAST(event_id AS VARCHAR), 'e-2') END AS v,
  CASE WHEN event_id % 6 = 0 THEN ' Found' WHEN event_id % 6 = 1 THEN 'NOTFOUND' WHEN event_id % 6 = 2 THEN 'Y' WHEN event_id % 6 = 3 THEN 'n ' WHEN event_id % 6 = 4 THEN '2' END AS b,
  CASE WHEN event_id % 4 = 0 THEN 'soon' WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)"""
_N = "CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(v) AS DOUBLE) END"


def _texts(spark, d):
    e, i = A.table(spark, d, "events"), F.col("event_id")
    s = i.cast("string")
    at = lambda n, r: i % n == r
    v = (
        F.when(at(9, 0), F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(at(10, 1), F.concat(s, F.lit("d"))).when(at(10, 2), "nan")
        .when(at(10, 3), F.concat(s, F.lit(".0"))).when(at(10, 4), F.concat(s, F.lit(".5"))).when(at(10, 5), "1_000").when(at(10, 6), F.concat(F.lit("-"), s))
        .when(at(10, 7), "").when(at(10, 8), F.lit(None)).otherwise(F.concat(s, F.lit("e-2")))
    )
    b = F.when(at(6, 0), " Found").when(at(6, 1), "NOTFOUND").when(at(6, 2), "Y").when(at(6, 3), "n ").when(at(6, 4), "2")
    t = F.when(at(4, 0), "soon").when(at(4, 1), F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", v.alias("v"), b.alias("b"), t.alias("t"))


@query("b6_coerce_numeric", with_ctes(_TEXTS) + f"SELECT event_id, {_N} AS number FROM texts")
def b6(spark, d):
    return _texts(spark, d).select("event_id", C.coerce_numeric("v").alias("number"))


@query("b7_coerce_integer", with_ctes(_TEXTS) + f"SELECT event_id, CASE WHEN {_N} % 1 = 0 THEN CAST({_N} AS BIGINT) END AS number FROM texts")
def b7(spark, d):
    return _texts(spark, d).select("event_id", C.coerce_integer("v").alias("number"))


@query("b8_coerce_boolean", with_ctes(_TEXTS) + "SELECT event_id, CASE WHEN lower(trim(b)) IN ('found', 'y') THEN true WHEN lower(trim(b)) IN ('notfound', 'n') THEN false END AS flag FROM texts")
def b8(spark, d):
    return _texts(spark, d).select("event_id", C.coerce_boolean("b").alias("flag"))


@query("b9_coerce_timestamp", with_ctes(_TEXTS) + "SELECT event_id, CAST(epoch(TRY_CAST(t AS TIMESTAMP)) AS BIGINT) AS unix_seconds FROM texts")
def b9(spark, d):
    return _texts(spark, d).select("event_id", F.unix_seconds(C.coerce_timestamp("t")).alias("unix_seconds"))


_TYPED_COLS = "source_file, source_file_row_number, transaction_id, step, amount, oldbalance_org, newbalance_orig, is_fraud"


@query("b10_coerce_frame", with_ctes(A.TYPED) + f"""
SELECT {_TYPED_COLS}, CAST(epoch_us(transaction_timestamp) AS BIGINT) AS micros, list_contains(reasons, 'invalid_amount') AS invalid_amount,
       list_contains(reasons, 'invalid_step') AS invalid_step, list_contains(reasons, 'invalid_transaction_timestamp') AS invalid_transaction_timestamp FROM flagged""")
def b10(spark, d):
    return _typed(spark, d).select(
        *_TYPED_COLS.split(", "), F.unix_micros("transaction_timestamp").alias("micros"), "invalid_amount", "invalid_step", "invalid_transaction_timestamp"
    )


@query("b11_offset_to_timestamp", "SELECT event_id, strftime(to_timestamp(1512086400 + event_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM events")
def b11(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", F.date_format(C.offset_to_timestamp(F.col("event_id") * 60), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("b12_derive_transaction_id", "SELECT event_id AS transaction_order, concat('txn_', CAST(event_id AS VARCHAR)) AS current_transaction_id FROM events")
def b12(spark, d):
    return history.derive_transaction_id(A.txn(spark, d).drop("transaction_id")).select("transaction_order", "current_transaction_id")


# --- validation ----------------------------------------------------------------------------

@query("c1_non_empty", with_ctes(A.TXN) + "SELECT transaction_id, coalesce(trim(name_dest) <> '', false) AS filled FROM txn")
def c1(spark, d):
    return A.txn(spark, d).select("transaction_id", C.non_empty("name_dest").alias("filled"))


@query("c2_parse_failure", with_ctes(_TEXTS) + f"SELECT event_id, coalesce(trim(v), '') <> '' AND {_N} IS NULL AS failed FROM texts")
def c2(spark, d):
    return _texts(spark, d).select("event_id", C.parse_failure("v", C.coerce_numeric("v")).alias("failed"))


@query("c3_missing_required", with_ctes(A.TXN) + "SELECT transaction_id, coalesce(trim(name_dest), '') = '' OR coalesce(trim(name_orig), '') = '' AS missing FROM txn")
def c3(spark, d):
    return A.txn(spark, d).select("transaction_id", C.missing_required(["name_orig", "name_dest"]).alias("missing"))


@query("c4_negative_any", with_ctes(A.LEDGER) + "SELECT transaction_order, coalesce(newbalance_orig < 0, false) OR coalesce(oldbalance_dest < 0, false) OR newbalance_dest < 0 AS negative FROM ledger")
def c4(spark, d):
    return A.ledger(spark, d).select("transaction_order", C.negative_any(["newbalance_orig", "oldbalance_dest", "newbalance_dest"]).alias("negative"))


@query("c5_reject_reasons", with_ctes(A.TYPED) + "SELECT source_file, source_file_row_number, array_to_string(list_sort(reasons), ',') AS reasons FROM flagged")
def c5(spark, d):
    out = cleaning.reject_reasons(_typed(spark, d)).withColumn("reasons", F.array_sort("reasons"))
    return as_text(out.select("source_file", "source_file_row_number", "reasons"), "reasons")


@query("c6_count_reasons", with_ctes(A.TYPED) + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM flagged) GROUP BY reason")
def c6(spark, d):
    return cleaning.count_reasons(cleaning.reject_reasons(_typed(spark, d)))


@query("c7_quarantine", with_ctes(A.TYPED) + "SELECT CASE WHEN len(reasons) = 0 THEN 'clean' ELSE 'rejected' END AS part, transaction_id, type, name_orig FROM flagged")
def c7(spark, d):
    clean, rejected = cleaning.quarantine(cleaning.reject_reasons(_typed(spark, d)))
    pick = lambda df, n: df.select(F.lit(n).alias("part"), "transaction_id", "type", "name_orig")
    return pick(clean, "clean").unionByName(pick(rejected, "rejected"))


@query("c8_clean_transactions", with_ctes(A.TYPED) + """
SELECT transaction_id, amount, step, is_fraud, source_file, row_number() OVER (ORDER BY transaction_timestamp NULLS LAST, source_file, source_file_row_number) AS transaction_order
FROM flagged WHERE len(reasons) = 0""")
def c8(spark, d):
    out = cleaning.clean_transactions(A.dirty(spark, d), ["_line"]).clean
    return out.select("transaction_id", "amount", "step", "is_fraud", "source_file", "transaction_order")


def _dirty_lines(spark, d):
    """The dirty sources as CSV files of a folder each, read back as lines, and the source of a line's file."""
    base = f"{stage_root(spark)}/riskloom-files/dirty-{uuid.uuid4().hex}"
    for name, df in A.dirty(spark, d).items():
        df.orderBy("_line").drop("_line").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}")
    return files.read_lines(spark, [f"{base}/a.csv", f"{base}/b.csv"]), F.element_at(F.split("_file", "/"), -2)


@query("c8_clean_files", ORACLES["c8_clean_transactions"])
def c8_files(spark, d):
    return cleaning.clean_files(*_dirty_lines(spark, d)).clean.select("transaction_id", "amount", "step", "is_fraud", "source_file", "transaction_order")


@query("a6_union_files", ORACLES["a6_union_sources"])
def a6_files(spark, d):
    """The line number is the whole part of ``step``."""
    out = cleaning.union_files(*_dirty_lines(spark, d))
    return out.select("source_file", "source_row_number", "source_file_row_number", F.floor(F.col("step").cast("double")).alias("line"))


@query("c9_cleaning_report", with_ctes(A.TYPED) + """
SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT string_agg(concat(source_file, '=', CAST(n AS VARCHAR)), ',' ORDER BY source_file) FROM (SELECT source_file, count(*) AS n FROM raw GROUP BY 1)) AS input_row_counts,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM flagged) AS duplicate_rows_dropped, (SELECT count(*) FROM flagged WHERE len(reasons) > 0) AS invalid_rows_dropped,
       (SELECT count(*) FROM flagged WHERE len(reasons) = 0) AS rows_out,
       (SELECT string_agg(concat(reason, '=', CAST(n AS VARCHAR)), ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM flagged) GROUP BY 1)) AS drop_reasons""")
def c9(spark, d):
    report = cleaning.clean_transactions(A.dirty(spark, d), ["_line"]).report
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.drop("columns_out").withColumns({"input_row_counts": text("input_row_counts"), "drop_reasons": text("drop_reasons")})


# --- keys, joins, ordering ------------------------------------------------------------------

@query("d1_dedupe_exact", with_ctes(A.TYPED) + "SELECT source_file, source_file_row_number, transaction_id, name_orig, is_fraud FROM deduped")
def d1(spark, d):
    out = cleaning.dedupe_exact_keep_first(cleaning.trim_all(_raw(spark, d)), sources=["a.csv", "b.csv"])
    return out.select("source_file", "source_file_row_number", "transaction_id", "name_orig", "is_fraud")


@query("d2_transaction_order", with_ctes(A.TYPED) + """
SELECT source_file, source_file_row_number, row_number() OVER (ORDER BY transaction_timestamp NULLS LAST, source_file, source_file_row_number) AS transaction_order FROM typed""")
def d2(spark, d):
    return cleaning.assign_transaction_order(_typed(spark, d)).select("source_file", "source_file_row_number", "transaction_order")


@query("d3_duplicate_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def d3(spark, d):
    return joins.assert_unique(A.table(spark, d, "lineitem"), "l_orderkey")


@query("d4_semi_join_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def d4(spark, d):
    ids = A.table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.semi_join_ids(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("d5_subset_by_ids", with_ctes(A.BRANCHES) + """
SELECT transaction_id, round(branch_a_score, 6) AS branch_a_score, row_number() OVER (ORDER BY branch_c_score, transaction_id) AS position FROM branches WHERE split = 'valid'""")
def d5(spark, d):
    b = A.branches(spark, d)
    ids = joins.with_position(b.where(F.col("split") == "valid").select("transaction_id", "branch_c_score"), ["branch_c_score", "transaction_id"])
    return rounded(joins.subset_by_ids(b.select("transaction_id", "branch_a_score"), ids), "branch_a_score")


_WIDE = ", ".join(f"round({b}_score, 6) AS {b}_score, CASE WHEN {b}_score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS {b}_predicted_label" for b in ("branch_a", "branch_b", "branch_c"))


@query("d6_join_branches", with_ctes(A.BRANCHES) + f"SELECT transaction_id, is_fraud, {_WIDE} FROM branches")
def d6(spark, d):
    return rounded(joins.join_branches(A.branch_frames(spark, d)), "branch_a_score", "branch_b_score", "branch_c_score")


def _uneven(spark, d):
    f = A.branch_frames(spark, d)
    b = A.branches(spark, d)
    view = b.where(F.col("scenario") == "view").select("transaction_id")
    click = b.where(F.col("scenario") == "click").select("transaction_id")
    flipped = f["branch_c"].withColumn("is_fraud", F.when(F.col("score") > 0.95, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    return {"branch_a": f["branch_a"].join(click, "transaction_id", "left_anti"), "branch_b": f["branch_b"].join(view, "transaction_id", "left_anti"), "branch_c": flipped}


@query("d7_label_consistency", with_ctes(A.BRANCHES) + """
SELECT transaction_id, 'branch_b' AS branch, is_fraud AS base_label, CAST(NULL AS INTEGER) AS other_label FROM branches WHERE scenario = 'view'
UNION ALL SELECT transaction_id, 'branch_c', is_fraud, 1 - is_fraud FROM branches WHERE branch_c_score > 0.95::DOUBLE AND scenario <> 'click'""")
def d7(spark, d):
    return joins.label_consistency(_uneven(spark, d))


def _diag_sql():
    parts = []
    for branch, missing, extra in (("branch_b", "scenario = 'view'", "scenario = 'click'"), ("branch_c", "false", "scenario = 'click'")):
        for kind, cond in (("missing", missing), ("extra", extra)):
            parts.append(
                f"SELECT '{branch}' AS branch, '{kind}' AS kind, (SELECT count(*) FROM branches WHERE {cond}) AS n, "
                f"coalesce((SELECT string_agg(transaction_id, ',' ORDER BY transaction_id) FROM (SELECT transaction_id FROM branches WHERE {cond} ORDER BY transaction_id LIMIT 5)), '') AS samples"
            )
    return " UNION ALL ".join(parts)


@query("d8_id_diagnostics", with_ctes(A.BRANCHES) + _diag_sql())
def d8(spark, d):
    return joins.id_diagnostics(_uneven(spark, d))


@query("d9_missing_by_column", with_ctes(A.TXN) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n FROM txn" for c in ("transaction_id", "name_orig", "name_dest", "amount", "is_fraud")))
def d9(spark, d):
    return joins.missing_by_column(A.txn(spark, d).select("transaction_id", "name_orig", "name_dest", "amount", "is_fraud"))


@query("d10_disjoint", with_ctes(A.BRANCHES) + "SELECT transaction_id, 'test' AS first_split, 'valid' AS last_split FROM branches WHERE split = 'valid' AND scenario = 'signup'")
def d10(spark, d):
    b = A.branches(spark, d).select("transaction_id", "split", "scenario")
    again = b.where((F.col("split") == "valid") & (F.col("scenario") == "signup")).withColumn("split", F.lit("test"))
    return joins.assert_disjoint(b.unionByName(again).select("transaction_id", "split"))


# --- base features ----------------------------------------------------------------------------

_RATIOS = {"amount_to_oldbalance_ratio": "oldbalance_org", "amount_to_newbalance_ratio": "newbalance_orig",
           "amount_to_dest_oldbalance_ratio": "oldbalance_dest", "amount_to_dest_newbalance_ratio": "newbalance_dest"}
_BASE = ["round(newbalance_orig - oldbalance_org, 6) AS balance_delta_org", "round(newbalance_dest - oldbalance_dest, 6) AS balance_delta_dest"]
_BASE += [f"round(CASE WHEN {b} <> 0 THEN amount / {b} END, 6) AS {n}" for n, b in _RATIOS.items()]
_SLOG = "round(sign({0}) * ln(1 + abs({0})), 6) AS {1}_log1p"
_BASE += [_SLOG.format(c, c) for c in ("amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest")]
_BASE += [_SLOG.format("(newbalance_orig - oldbalance_org)", "balance_delta_org"), _SLOG.format("(newbalance_dest - oldbalance_dest)", "balance_delta_dest")]
_BASE += [f"round(CASE WHEN {b} <> 0 THEN CASE WHEN amount / {b} > 10 THEN 10 WHEN amount / {b} < -10 THEN -10 ELSE amount / {b} END END, 6) AS {n}_bounded" for n, b in _RATIOS.items()]


@query("e1_balance_delta", with_ctes(A.LEDGER) + f"SELECT transaction_order, {_BASE[0]}, {_BASE[1]} FROM ledger")
def e1(spark, d):
    df = A.ledger(spark, d).select("transaction_order", C.balance_delta("newbalance_orig", "oldbalance_org").alias("balance_delta_org"), C.balance_delta("newbalance_dest", "oldbalance_dest").alias("balance_delta_dest"))
    return rounded(df, "balance_delta_org", "balance_delta_dest")


@query("e2_safe_ratio", with_ctes(A.LEDGER) + f"SELECT transaction_order, {', '.join(_BASE[2:6])} FROM ledger")
def e2(spark, d):
    df = A.ledger(spark, d).select("transaction_order", *[C.safe_ratio("amount", b).alias(n) for n, b in _RATIOS.items()])
    return rounded(df, *_RATIOS)


@query("e3_signed_log1p", with_ctes(A.LEDGER) + f"SELECT transaction_order, {_SLOG.format('newbalance_dest', 'newbalance_dest')}, {_SLOG.format('amount', 'amount')} FROM ledger")
def e3(spark, d):
    df = A.ledger(spark, d).select("transaction_order", *[C.signed_log1p(c).alias(f"{c}_log1p") for c in ("newbalance_dest", "amount")])
    return rounded(df, "newbalance_dest_log1p", "amount_log1p")


@query("e4_bounded", with_ctes(A.LEDGER) + f"SELECT transaction_order, {_BASE[-1]} FROM ledger")
def e4(spark, d):
    r = C.safe_ratio("amount", "newbalance_dest")
    return rounded(A.ledger(spark, d).select("transaction_order", C.bounded(r).alias("amount_to_dest_newbalance_ratio_bounded")), "amount_to_dest_newbalance_ratio_bounded")


@query("e5_base_features", with_ctes(A.LEDGER) + f"SELECT transaction_order, {', '.join(_BASE)} FROM ledger")
def e5(spark, d):
    src = A.ledger(spark, d)
    out = features.base_features(src)
    new = [c for c in out.columns if c not in src.columns]
    return rounded(out.select("transaction_order", *new), *new)


# --- history ------------------------------------------------------------------------------------

def _frame(fn: str, k: int) -> str:
    return f"{fn} OVER ({TXN_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


_F1 = ", ".join(f"least(row_number() OVER ({TXN_W}) - 1, {k}) AS prior_{k}_transaction_count" for k in (5, 10))
_F2 = f"round(lag(amount) OVER ({TXN_W}), 6) AS previous_transaction_amount"
_F3 = ", ".join(
    f"round({_frame(f'{fn}(amount)', k)}, 6) AS prior_{k}_amount_{n}" for k in (5, 10) for fn, n in (("sum", "sum"), ("avg", "mean"), ("stddev_pop", "std"))
)
_F4 = f"CAST(epoch_us(lag(transaction_timestamp) OVER ({TXN_W})) AS BIGINT) AS previous_micros, round((epoch_us(transaction_timestamp) - epoch_us(lag(transaction_timestamp) OVER ({TXN_W}))) / 1000000.0, 6)::DOUBLE AS seconds_since_previous_transaction"
_F5_CTE = f"""numbered AS (SELECT *, nullif(trim(name_dest), '') AS v, count(nullif(trim(name_dest), '')) OVER ({TXN_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nn FROM txn)"""
_F5 = ", ".join(f"count(DISTINCT v) OVER (PARTITION BY name_orig ORDER BY nn RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING) AS prior_{k}_unique_name_dest_count" for k in (5, 10))
_STD = [f"prior_{k}_amount_{n}" for k in (5, 10) for n in ("sum", "mean", "std")]


@query("f1_prior_count", with_ctes(A.TXN) + f"SELECT transaction_id, {_F1} FROM txn")
def f1(spark, d):
    return history.prior_count(A.txn(spark, d), ENTITY, ORDER).select("transaction_id", "prior_5_transaction_count", "prior_10_transaction_count")


@query("f2_previous_amount", with_ctes(A.TXN) + f"SELECT transaction_id, {_F2} FROM txn")
def f2(spark, d):
    return rounded(history.previous_amount(A.txn(spark, d), ENTITY, ORDER).select("transaction_id", "previous_transaction_amount"), "previous_transaction_amount")


@query("f3_prior_stats", with_ctes(A.TXN) + f"SELECT transaction_id, {_F3} FROM txn")
def f3(spark, d):
    return rounded(history.prior_stats(A.txn(spark, d), ENTITY, ORDER).select("transaction_id", *_STD), *_STD)


@query("f4_previous_gap", with_ctes(A.TXN) + f"SELECT transaction_id, {_F4} FROM txn")
def f4(spark, d):
    out = history.previous_gap(A.txn(spark, d), ENTITY, ORDER)
    micros = F.unix_micros(F.col("previous_transaction_timestamp").cast("timestamp")).alias("previous_micros")
    return rounded(out.select("transaction_id", micros, "seconds_since_previous_transaction"), "seconds_since_previous_transaction")


@query("f5_prior_unique", with_ctes(A.TXN, _F5_CTE) + f"SELECT transaction_id, {_F5} FROM numbered")
def f5(spark, d):
    return history.prior_unique(A.txn(spark, d), "name_dest", ENTITY, ORDER).select("transaction_id", "prior_5_unique_name_dest_count", "prior_10_unique_name_dest_count")


@query("f6_behavioral_features", with_ctes(A.TXN, _F5_CTE) + f"SELECT transaction_id, {_F1}, {_F2}, {_F3}, {_F4}, {_F5} FROM numbered")
def f6(spark, d):
    out = history.behavioral_features(A.txn(spark, d))
    micros = F.unix_micros(F.col("previous_transaction_timestamp").cast("timestamp")).alias("previous_micros")
    doubles = ["previous_transaction_amount", *_STD, "seconds_since_previous_transaction"]
    counts = [f"prior_{k}_{n}_count" for k in (5, 10) for n in ("transaction", "unique_name_dest")]
    return rounded(out.select("transaction_id", micros, *doubles, *counts), *doubles)


_HOT_TXN = A.TXN.replace("concat('u', CAST(user_id AS VARCHAR)) AS name_orig", "CASE WHEN event_id % 10 < 7 THEN 'hot' ELSE concat('u', CAST(user_id AS VARCHAR)) END AS name_orig")


@query("f6_behavioral_features_hot", with_ctes(_HOT_TXN, _F5_CTE) + f"SELECT transaction_id, {_F1}, {_F2}, {_F3}, {_F4}, {_F5} FROM numbered")
def f6_hot(spark, d):
    """One account holds most rows and is above the bound: segments with a halo."""
    t = A.txn(spark, d).withColumn("name_orig", F.when(F.col("transaction_order") % 10 < 7, "hot").otherwise(F.col("name_orig")))
    out = history.behavioral_features(t, hot_rows=500)
    micros = F.unix_micros(F.col("previous_transaction_timestamp").cast("timestamp")).alias("previous_micros")
    doubles = ["previous_transaction_amount", *_STD, "seconds_since_previous_transaction"]
    counts = [f"prior_{k}_{n}_count" for k in (5, 10) for n in ("transaction", "unique_name_dest")]
    return rounded(out.select("transaction_id", micros, *doubles, *counts), *doubles)


def _seq_sql(length: int = 10) -> str:
    terms = []
    for k in range(length, 0, -1):
        a = f"lag(coalesce(amount, 0)) OVER ({TXN_W})" if k == 1 else f"lag(coalesce(amount, 0), {k}) OVER ({TXN_W})"
        terms.append(f"coalesce({a}, 0)")
    return terms


_SEQ_SUM = " + ".join(f"{i + 1} * {t}" for i, t in enumerate(_seq_sql()))


@query("f7_history_sequence", with_ctes(A.TXN) + f"""
SELECT transaction_id, round({_SEQ_SUM}, 2) AS weighted_amounts, least(row_number() OVER ({TXN_W}) - 1, 10) AS history_length, 10 AS steps FROM txn""")
def f7(spark, d):
    out = history.history_sequence(A.txn(spark, d), ["amount", "is_fraud"], ENTITY, ORDER)
    # Position-weighted sum of the first feature: catches order, padding and content in one number.
    amounts = F.transform("x_seq", lambda v, i: F.round(v[0].cast("double"), 2) * (i + 1))
    total = F.aggregate(amounts, F.lit(0.0), lambda acc, v: acc + v)
    return out.select("transaction_id", F.round(total, 2).alias("weighted_amounts"), "history_length", F.size("x_seq").alias("steps"))


@query("f8_sequence_meta", with_ctes(A.TXN) + f"SELECT transaction_id AS current_transaction_id, name_orig, transaction_order, 10 AS sequence_length, least(row_number() OVER ({TXN_W}) - 1, 10) AS history_length FROM txn")
def f8(spark, d):
    return history.sequence_meta(A.txn(spark, d), ENTITY, ORDER).drop("transaction_timestamp")


@query("f9_sequence_dataset", with_ctes(A.TXN) + f"""
SELECT transaction_id AS current_transaction_id, name_orig, least(row_number() OVER ({TXN_W}) - 1, 10) AS history_length, round({_SEQ_SUM}, 2) AS weighted_amounts,
       round(amount, 2) AS current_amount, is_fraud AS y FROM txn""")
def f9(spark, d):
    return sequence_digest(history.sequence_dataset(A.txn(spark, d)))


def sequence_digest(out):
    amounts = F.transform("x_seq", lambda v, i: F.round(v[0].cast("double"), 2) * (i + 1))
    total = F.aggregate(amounts, F.lit(0.0), lambda acc, v: acc + v)
    return out.select(
        "current_transaction_id", ENTITY, "history_length", F.round(total, 2).alias("weighted_amounts"),
        F.round(F.col("x_current.amount").cast("double"), 2).alias("current_amount"), "y",
    )


_BURST = """bursts AS (SELECT a.event_id, count(b.event_id) AS recent_burst_count
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS rn FROM events) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS rn FROM events) b
    ON a.user_id % 5 = b.user_id % 5 AND b.rn BETWEEN a.rn - 20 AND a.rn - 1 AND epoch_us(b.ts) > epoch_us(a.ts) - 600000000
  GROUP BY a.event_id)"""


@query("f10_recent_burst_count", "WITH " + _BURST + " SELECT event_id AS transaction_id, recent_burst_count FROM bursts")
def f10(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("transaction_id"), F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("user_id"), "ts")
    return history.recent_burst_count(e, "user_id", "ts", ["ts", "transaction_id"]).select("transaction_id", "recent_burst_count")


_RW = "PARTITION BY user_id % 5 ORDER BY ts, event_id"
_RISK = f"""risk AS (
  SELECT event_id, value, row_number() OVER ({_RW}) = 1 AS new_user, coalesce(lag(value) OVER ({_RW}), 0) AS prev,
         CASE WHEN row_number() OVER ({_RW}) = 1 THEN 86400.0::DOUBLE ELSE greatest((epoch_us(ts) - epoch_us(lag(ts) OVER ({_RW}))) / 1000000.0::DOUBLE, 1.0) END AS gap,
         k, lag(k) OVER ({_RW}) AS prev_k,
         count(*) OVER ({_RW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n10, coalesce(avg(value) OVER ({_RW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS m10,
         coalesce(stddev_pop(value) OVER ({_RW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS s10, coalesce(sum(value) OVER ({_RW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS sum5
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS k FROM events))"""


@query("f11_risk_context", "WITH " + _BURST + ",\n" + _RISK + """
SELECT r.event_id AS transaction_id, new_user, round(prev, 3) AS previous_amount, round(gap, 3) AS seconds_since_previous, round(value - prev, 3) AS amount_delta,
       round(CASE WHEN prev > 0 THEN value / prev ELSE 1 END, 3) AS amount_ratio, recent_burst_count,
       round(least(1.0, greatest(0.0, recent_burst_count / 6.0::DOUBLE + 60.0::DOUBLE / greatest(gap, 60.0))), 3) AS velocity_score,
       NOT new_user AND k <> prev_k AS is_destination_shift, n10 AS prior_10_count, round(m10, 3) AS prior_10_amount_mean, round(s10, 3) AS prior_10_amount_std, round(sum5, 3) AS prior_5_amount_sum
FROM risk r JOIN bursts b ON r.event_id = b.event_id""")
def f11(spark, d):
    e = A.table(spark, d, "events").select(
        F.col("event_id").alias("transaction_id"), (F.col("user_id") % 5).alias("user_id"), "ts", F.col("value").alias("amount"),
        (F.get_json_object("props", "$.k").cast("bigint") % 12).alias("name_dest"),
    )
    out = history.risk_context(e, "user_id", "ts", ["ts", "transaction_id"])
    return out.select(
        "transaction_id", "new_user", "previous_amount", "seconds_since_previous", "amount_delta", "amount_ratio", "recent_burst_count", "velocity_score",
        "is_destination_shift", "prior_10_count", "prior_10_amount_mean", "prior_10_amount_std", "prior_5_amount_sum",
    )


# --- splits ----------------------------------------------------------------------------------------

_ORD = "row_number() OVER (ORDER BY transaction_timestamp NULLS LAST, transaction_order)"


def _canonical(spark, d):
    t = A.txn(spark, d)
    ids = t.where(F.col("type") != "view").select(F.col("transaction_id").alias("current_transaction_id"))
    return splits.canonical_frame(t, ids)


_CANON = f"canon AS (SELECT *, {_ORD} AS ordinal, count(*) OVER () AS total FROM txn WHERE type <> 'view')"


@query("g1_canonical_frame", with_ctes(A.TXN, _CANON) + "SELECT transaction_id, ordinal FROM canon")
def g1(spark, d):
    return _canonical(spark, d).select("transaction_id", "ordinal")


@query("g2_split_by_proportions", with_ctes(A.TXN, _CANON) + """
SELECT transaction_id, CASE WHEN ordinal <= floor(total * 0.7::DOUBLE) THEN 'train' WHEN ordinal <= floor(total * 0.7::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM canon""")
def g2(spark, d):
    return splits.split_by_proportions(_canonical(spark, d)).select("transaction_id", "split")


TRAIN_END, VALID_END = dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 22)
_CUT = "CASE WHEN transaction_timestamp <= TIMESTAMP '2024-01-15' THEN 'train' WHEN transaction_timestamp <= TIMESTAMP '2024-01-22' THEN 'valid' ELSE 'test' END"


def _split_txn(spark, d):
    strategy = splits.SplitStrategy("cutoffs", cutoffs={"train_end": TRAIN_END, "valid_end": VALID_END})
    return splits.split(A.txn(spark, d), strategy)


@query("g3_split_by_cutoffs", with_ctes(A.TXN) + f"SELECT transaction_id, {_CUT} AS split FROM txn")
def g3(spark, d):
    return _split_txn(spark, d).select("transaction_id", "split")


@query("g5_split_report", with_ctes(A.TXN) + f"""
SELECT split, count(*) AS n, CAST(epoch_us(min(transaction_timestamp)) AS BIGINT) AS min_order, CAST(epoch_us(max(transaction_timestamp)) AS BIGINT) AS max_order
FROM (SELECT *, {_CUT} AS split FROM txn) GROUP BY split""")
def g5(spark, d):
    out = splits.split_report(_split_txn(spark, d), "transaction_timestamp")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("min_order", "max_order")})


_EVEN = """SELECT transaction_id FROM ranked WHERE rn - 1 IN (
  SELECT CASE WHEN i = {k} - 1 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / CAST({k} - 1 AS DOUBLE))) AS BIGINT) END
  FROM (SELECT unnest(range(CAST({k} AS BIGINT))) AS i) CROSS JOIN (SELECT count(*) AS n FROM ranked))"""


@query("g6_even_take", with_ctes(A.TXN) + ", ranked AS (SELECT transaction_id, row_number() OVER (ORDER BY transaction_timestamp, transaction_order) AS rn FROM txn) " + _EVEN.format(k=777))
def g6(spark, d):
    return ordering.even_take(A.txn(spark, d), 777, ORDER).select("transaction_id")


@query("g7_downsample_majority", with_ctes(A.TXN) + """, ranked AS (SELECT transaction_id, row_number() OVER (ORDER BY transaction_timestamp, transaction_order) AS rn FROM txn WHERE is_fraud = 0),
k AS (SELECT least((SELECT count(*) FROM ranked), CAST(floor(count(*) * 1.5::DOUBLE) AS BIGINT)) AS k FROM txn WHERE is_fraud = 1),
picks AS (SELECT CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / CAST(k - 1 AS DOUBLE))) AS BIGINT) END AS pos
  FROM (SELECT k, unnest(range(CAST(k AS BIGINT))) AS i FROM k) CROSS JOIN (SELECT count(*) AS n FROM ranked))
SELECT transaction_id, 0 AS is_fraud FROM ranked WHERE rn - 1 IN (SELECT pos FROM picks) UNION ALL SELECT transaction_id, 1 FROM txn WHERE is_fraud = 1""")
def g7(spark, d):
    return splits.downsample_majority(A.txn(spark, d), 1.5, ORDER).select("transaction_id", "is_fraud")


@query("g8_importance_sample")
def g8(spark, d):
    t = A.txn(spark, d)
    # Half of the table as the budget, so the sample grows with it.
    return splits.importance_sample(t, t.count() // 2).select("transaction_id", "is_fraud")
