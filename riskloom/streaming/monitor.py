"""Latency monitoring as a stream: event-time windows close behind a watermark, runs of breaches go on from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.monitoring import breach_severity, latency_windows
from riskloom.streaming.state import exists

WINDOW_SCHEMA = "window_start timestamp, n bigint, mean_latency_ms double, breach boolean, severity string, batch bigint"


def monitor_stream(
    log: DataFrame, out_path: str, checkpoint: str, ts: str = "processed_at", delay: str = "1 hour", minutes: int = 60,
    consecutive: int = 2, latency: str = "latency_ms", limit: float = 75.0, available_now: bool = True,
) -> StreamingQuery:
    """Start the query: each window is written once, when no event of it can come any more, with the severity of its run of breaches.

    Events later than ``delay`` behind the newest are left out, those without a time too. Windows close in the order of time, so a run needs of
    the windows written before only the last ``consecutive - 1`` steps. A replayed batch sees the batches before it and overwrites its own folder.
    """

    def write(closed: DataFrame, batch_id: int) -> None:
        spark = closed.sparkSession
        first = closed.agg(F.min("window_start")).first()[0]
        if first is None:
            return
        rows = closed.withColumn("batch", F.lit(batch_id).cast("bigint"))
        if exists(spark, out_path):
            back = F.lit(first) - F.make_dt_interval(mins=F.lit(minutes * (consecutive - 1)))
            held = spark.read.schema(WINDOW_SCHEMA).parquet(out_path).where((F.col("batch") < batch_id) & (F.col("window_start") >= back))
            rows = rows.unionByName(held.select(*rows.columns))
        done = breach_severity(rows, minutes, consecutive).where(F.col("batch") == batch_id)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)

    timed = log.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    writer = latency_windows(timed, ts, minutes, latency, limit).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
