"""Streaming ingest: changed sources into the store, and windowed monitoring of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.operators.store import Store


def watch(stream: DataFrame, store: Store, chunk, checkpoint: str, now_ms: int = 0):
    """Start a query that ingests every micro-batch of ``stream(source, mtime, text)`` into ``store``.

    The upsert by source is idempotent, so a batch that runs again after a failure leaves the same store. Of several
    versions of a source in one batch the latest mtime stands.
    """
    def write(batch: DataFrame, _epoch: int) -> None:
        newest = batch.groupBy("source").agg(F.max_by(F.struct("mtime", "text"), "mtime").alias("x")).select("source", "x.*")
        store.ingest(newest, chunk, now_ms)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, <key>, n, users)`` per tumbling window; rows later than ``late`` behind the watermark are dropped in a stream."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), key, "n", "users")


def freshness(last_seen: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """``(source, fresh)``: is the last sighting younger than ``hours``?"""
    return last_seen.select("source", (F.lit(now_ms) - F.col("ingest_time") < hours * 3600 * 1000).alias("fresh"))
