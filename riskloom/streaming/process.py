"""The online path as one streaming query: validate, score, attach the profile, decide, write.

Two sinks per micro-batch: the decisions table (first write per transaction id wins) and the
dated audit log. Both can be replayed: the insert ignores ids it already holds, and the audit
files of a batch are overwritten by the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.policy import rule_score_as_of
from riskloom.operators.scoring import ScoringSpec, score_events, validate_request
from riskloom.session import scratch, stage
from riskloom.sources.sinks import insert_bucketed
from riskloom.streaming.state import ProfileStore

EVENT_SCHEMA = (
    "trace struct<request_id:string,source_system:string,source_component:string,source_region:string>, "
    "transaction struct<transaction_id:string,user_id:string,person_id:string,account_id:string,destination_account:string,"
    "currency:string,country:string,channel:string,event_timestamp:string>, "
    "features map<string,double>, metadata_labels map<string,string>"
)
# The decisions table.
DECISION_SCHEMA = (
    "transaction_id string, user_id string, person_id string, account_id string, amount decimal(18,2), currency string, "
    "timestamp timestamp, channel string, destination_account string, country string, score int, decision string, "
    "flag_amount boolean, flag_country boolean, flag_velocity boolean, flag_destination boolean, "
    "profile_avg_amount decimal(18,2), profile_std_dev decimal(18,2), profile_typical_countries string, "
    "profile_tx_last_10min int, model_version string, calibrated_score decimal(10,6), processor_version string, "
    "processed_at timestamp"
)
PROCESSOR_VERSION = "1.0.0"


def flatten_events(scored: DataFrame) -> DataFrame:
    """Nested, scored events to flat columns; maps become JSON text so that they pass the state operator."""
    t, r = F.col("transaction"), F.col("trace")
    return scored.select(
        t["transaction_id"].alias("transaction_id"), r["request_id"].alias("request_id"), r["source_system"].alias("source_system"),
        r["source_component"].alias("source_component"), r["source_region"].alias("source_region"), F.coalesce(t["user_id"], F.lit("")).alias("user_id"),
        t["person_id"].alias("person_id"), t["account_id"].alias("account_id"),
        F.coalesce(F.col("features")["amount"], F.lit(0.0)).alias("amount"), t["currency"].alias("currency"),
        t["event_timestamp"].alias("timestamp"), t["event_timestamp"].try_cast("timestamp").alias("event_time"),
        F.coalesce(t["channel"], F.lit("")).alias("channel"), F.coalesce(t["destination_account"], F.lit("")).alias("destination"),
        F.coalesce(t["country"], F.lit("")).alias("country"), "decision", "score", "calibrated_score", "model_version",
        F.to_json("metadata_labels").alias("metadata_labels"),
    )


def accepted(events: DataFrame) -> DataFrame:
    return validate_request(events).where(F.size("errors") == 0).drop("errors")


def dead_letters(events: DataFrame) -> DataFrame:
    """Events that fail validation with their errors."""
    return validate_request(events).where(F.size("errors") > 0)


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the event files below ``path``; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def reject_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query that keeps what :func:`process_stream` leaves out: invalid events with their errors, each once."""
    writer = dead_letters(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def decision_rows(batch: DataFrame) -> DataFrame:
    values = {
        "timestamp": F.col("event_time"), "destination_account": F.col("destination"),
        "profile_avg_amount": F.col("avg_amount"), "profile_std_dev": F.col("std_dev_amount"),
        "profile_typical_countries": F.lit(""), "profile_tx_last_10min": F.col("tx_last_10min"),
        "processor_version": F.lit(PROCESSOR_VERSION),
    }
    fields = [f.strip().rsplit(" ", 1) for f in _split_ddl(DECISION_SCHEMA)]
    return batch.select(*[values.get(n, F.col(n)).try_cast(t).alias(n) for n, t in fields])


def _split_ddl(ddl: str) -> list[str]:
    return ddl.split(", ")


def process_stream(
    events: DataFrame, spec: ScoringSpec, table_path: str, audit_path: str, checkpoint: str, available_now: bool = True,
    store: ProfileStore | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Start the query. ``checkpoint`` and the profile store (beside the table unless given) belong on shared storage.

    Each micro-batch is a table: its profiles come from the batch operator, started from the store, so a user with any share of
    the events is cut into segments as in batch; the decisions lie in ``buckets`` folders by a hash of the id.
    """
    spark, store = events.sparkSession, store or ProfileStore(f"{table_path}-profiles")
    # No rows, only the schema, so that the first batch finds a table to compare with.
    spark.createDataFrame([], DECISION_SCHEMA).write.mode("ignore").parquet(table_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            flat = stage(flatten_events(score_events(batch, spec)), f"scored{batch_id}")
            flagged = rule_score_as_of(store.attach(flat, batch_id))
            # Written once: two sinks read it, and a second pass must not see another processing time.
            done = stage(flagged.withColumn("processed_at", F.current_timestamp()), f"batch{batch_id}")
            insert_bucketed(decision_rows(done), table_path, "transaction_id", ["timestamp"], buckets)
            _write_audit(done.withColumn("batch", F.lit(batch_id)), audit_path)

    writer = accepted(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _write_audit(batch: DataFrame, path: str) -> None:
    """Dated folders with the batch number innermost: a replayed batch overwrites its own files only."""
    stamp = F.col("processed_at")
    parts = {"year": F.date_format(stamp, "yyyy"), "month": F.date_format(stamp, "MM"), "day": F.date_format(stamp, "dd")}
    writer = batch.withColumns(parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year", "month", "day", "batch").json(path)


def dedupe_stream(stream: DataFrame, key: str = "transaction_id", delay: str = "1 hour", ts: str = "event_time") -> DataFrame:
    """One row per transaction id among events that arrive within ``delay`` of each other."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
