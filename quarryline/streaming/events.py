"""Windows, sessions, de-duplication and enrichment of event streams.

Each function takes a batch or a streaming frame with ``ts``; streams get their
watermark here, a batch gives what a stream gives once all its windows have closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "2 hours"


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """``ts`` as an instant (UTC session), with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    by = timed(events).groupBy(F.window("ts", size), "event_type")
    return _flat(by.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents")))


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours") -> DataFrame:
    return _flat(timed(events).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    by = timed(events).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return _flat(by.agg(F.count("*").alias("n")))


def distinct_events(events: DataFrame) -> DataFrame:
    """First arrivals: one row per event id, within the watermark on a stream."""
    keyed = timed(events)
    return keyed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else keyed.dropDuplicates(["event_id"])


def enriched(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with their customer's segment: a stream joined to a snapshot."""
    dim = users.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return events.join(dim, "user_id", "left").select("event_id", "user_id", "event_type", "segment")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, to a memory table: for tests and small reports."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
