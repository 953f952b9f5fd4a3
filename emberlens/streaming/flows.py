"""Streaming forms of segmentation and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_episodes(records: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Idle-gap episodes of a stream of records (flow_key, ts, call_site, level): a session window per
    flow, emitted once the watermark has passed it. Records an exact gap apart stay together."""
    d = records.withWatermark("ts", late)
    g = d.groupBy("flow_key", F.session_window("ts", gap)).agg(F.count("*").alias("n_records"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max(F.coalesce(F.upper("level") == "ERROR", F.lit(False))).alias("has_error"))
    return g.select("flow_key", "n_records", "start_ts", "end_ts", "has_error")


def stream_timeline(events: DataFrame, bucket: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Errors and warnings of a stream of events (ts, level) in even buckets."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", bucket)).agg(F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    return g.select(F.col("window.start").alias("bucket"), "errors", "warnings")


def deduplicated(records: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Records of which those that repeat a key within the watermark go."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
