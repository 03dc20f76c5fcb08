"""Plan shapes: what is shuffled, pushed down and pruned."""

import re

from pyspark.sql import functions as F

from riskloom.operators import cleaning, history, joins, metrics, ordering, scoring, thresholds
from riskloom.plans import adapters as A
from riskloom.sources import sinks
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_one_exchange(spark):
    text = plan(history.behavioral_features(A.txn(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_history_reads_only_needed_columns(spark):
    text = plan(history.prior_count(A.txn(spark, SF).select("transaction_id", "transaction_timestamp", "transaction_order", "name_orig"), "name_orig", ["transaction_timestamp", "transaction_order"]))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_filters_reach_the_scan(spark):
    text = plan(joins.semi_join_ids(spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey"), spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text


def test_thresholds_are_one_aggregate(spark):
    text = plan(thresholds.metrics_at_thresholds(A.scored(spark, SF), [0.1, 0.5, 0.9]))
    assert text.count("FileScan") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text


def test_insert_is_an_anti_join_on_the_key(spark):
    d = A.decisions(spark, SF).select("transaction_id", "score")
    text = plan(sinks.insert_if_absent(d, d, "transaction_id", ["score"]))
    assert "LeftAnti" in text


def test_metrics_combine_before_the_shuffle(spark):
    assert "partial_avg" in plan(metrics.brier(A.scored(spark, SF)))


def test_numbering_deals_no_source_to_one_task(spark):
    rows = spark.createDataFrame([("a.csv", i) for i in range(300)] + [("b.csv", i) for i in range(40)], "source_file string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cleaning.number_sources(rows.repartition(7), ["line"], drop_order=False)
        assert re.search(r"hashpartitioning\(source_file#\d+, _pid#\d+", plan(out)) and not re.search(r"hashpartitioning\(source_file#\d+, \d+\)", plan(out))
        assert all(r.source_row_number == r.source_file_row_number == r.line + 1 for r in out.collect()) and out.count() == 340
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbering_shares_a_source_by_blocks(spark, monkeypatch):
    """However few the runs, the rows meet them under many keys."""
    monkeypatch.setattr(ordering, "RUN_ROWS", 16)
    rows = spark.createDataFrame([("a.csv", i) for i in range(1000)] + [("b.csv", i) for i in range(40)] + [("c.csv", 0)], "source_file string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cleaning.number_sources(rows.repartition(7), ["line"], drop_order=False)
        assert re.search(r"hashpartitioning\(source_file#\d+, _pid#\d+L?, _block#\d+", plan(out))
        assert out.count() == 1041 and all(r.source_row_number == r.line + 1 for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_do_not_carry_their_request(spark):
    text = '{"request_id": "r", "records": [{"transaction_id": "a", "features": {"f": 1.5}}, {"transaction_id": "b"}]}'
    rows = spark.createDataFrame([(text,), ("{}",), (None,)], "payload string").repartition(2)
    out = scoring.parse_score_requests(rows, ["f"])
    assert re.search(r"Generate posexplode\(_records#\d+\), \[request_id#\d+\]", plan(out))
    got = sorted(out.select("request_id", "record_index", "transaction_id", "f").collect(), key=str)
    assert [tuple(r) for r in got] == [("r", 0, "a", 1.5), ("r", 1, "b", None), (None, None, None, None), (None, None, None, None)]
