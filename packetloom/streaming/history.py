"""The history as streams. The analysed system re-reads its append-only log after each outcome;
these streams are an extension of that: they keep the same aggregates up to date."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table of the input as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = whole.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(whole).isDirectory()
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def outcome_windows(events: DataFrame, watermark: str | None = "30 days", length: str = "7 days") -> DataFrame:
    """Outcomes of each status per week of event time; events repeated whole count once, late ones within the watermark count.

    Without a watermark all events count, in any order; the ids of all outcomes then stay in the state.
    """
    timed = events.select("id", F.col("created_at").cast("timestamp").alias("at"), F.lower("event_type").alias("event_type"), F.lower("event_status").alias("event_status"))
    outcomes = timed.where("event_type = 'manual_outcome' AND at IS NOT NULL")
    once = (outcomes.withWatermark("at", watermark) if watermark else outcomes).dropDuplicates(["id", "at"])
    return once.groupBy(F.window("at", length).alias("week"), "event_status").agg(F.count(F.lit(1)).alias("outcomes"))


def matched_outcomes(runs: DataFrame, events: DataFrame, within: str = "60 days") -> DataFrame:
    """Stream join of runs with outcomes of their case that follow within a bounded time."""
    r = runs.select(F.col("id").alias("run_id"), "case_key", F.col("analyzed_at").cast("timestamp").alias("run_at")).where("run_at IS NOT NULL").withWatermark("run_at", "30 days")
    e = events.where(F.lower("event_type") == "manual_outcome").select(F.col("id").alias("event_id"), F.col("case_key").alias("event_case"), F.col("created_at").cast("timestamp").alias("event_at"), F.lower("event_status").alias("event_status")).where("event_at IS NOT NULL").withWatermark("event_at", "30 days")
    return r.join(e, F.expr(f"case_key = event_case AND event_at >= run_at AND event_at <= run_at + INTERVAL {within}")).select("run_id", "event_id", "event_at", "event_status")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Drive a stream over all that is there and return its result, written in the shared folder."""
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    if mode == "complete":
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def weekly_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per week and status, out of the event stream; the files of the table may come in any order."""
    out = run_to_end(spark, outcome_windows(stream_of(spark, sf_dir, "packet_events"), watermark=None), "complete")
    return out.select(F.col("week.start").cast("timestamp_ntz").alias("week_start"), "event_status", "outcomes")


QUERIES = {"stream_weekly_outcomes": weekly_outcomes}
ORACLES = {
    "stream_weekly_outcomes": """WITH e AS (SELECT DISTINCT id, created_at, lower(event_type) AS t, lower(event_status) AS event_status FROM packet_events WHERE created_at IS NOT NULL)
        SELECT TIMESTAMP '1970-01-01' + INTERVAL 7 DAY * floor(epoch(created_at) / 604800)::BIGINT AS week_start, event_status, count(*) AS outcomes FROM e WHERE t = 'manual_outcome' GROUP BY 1, 2"""
}
