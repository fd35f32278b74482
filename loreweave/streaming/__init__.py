"""Structured Streaming feeds: activity, windows, sessions, deduplication and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``ts`` as an instant with a watermark; batch frames ignore the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """``start, event_type, n, total`` for each window and type."""
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "6 hours", step: str = "3 hours") -> DataFrame:
    w = events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Change events of a user gathered until a pause: ``user_id, start, end, n``."""
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def daily_activity(events: DataFrame) -> DataFrame:
    """First write wins: one row for each user, type and day."""
    keyed = events.withColumn("day", F.to_date("ts"))
    keep = ["user_id", "event_type", "day"]
    return (keyed.dropDuplicatesWithinWatermark(keep) if keyed.isStreaming else keyed.dropDuplicates(keep)).select(*keep)


def outbox(rows: DataFrame, key: list[str]) -> DataFrame:
    """At-least-once messages reduced to one for each key within the watermark."""
    return rows.dropDuplicatesWithinWatermark(key) if rows.isStreaming else rows.dropDuplicates(key)


def index_stream(changes: DataFrame, root: str, checkpoint: str, cfg=None):
    """Keep the chunk snapshots current from a stream of source versions; returns the query."""
    from loreweave.operators.maintain import Snapshots, maintain

    def apply(batch: DataFrame, _):
        spark = batch.sparkSession
        newest = batch.groupBy("source_type", "source_id").agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), "version").alias("r")).select("r.*")
        old = Snapshots(spark, root).read("corpus")
        merged = newest if old is None else old.join(newest.select("source_type", "source_id"), ["source_type", "source_id"], "left_anti").unionByName(newest)
        Snapshots(spark, root).write("corpus", merged)
        maintain(spark, root, Snapshots(spark, root).read("corpus"), cfg)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
