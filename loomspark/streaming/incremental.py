"""Incremental ingest with Structured Streaming: new files of a folder, changes only, late events.

``ingest`` processes what has arrived since the last run (availableNow) and keeps its place in a checkpoint, so that
a lost executor or driver repeats at most one batch; keyed upserts make repeats harmless.  ``windowed_counts`` is an
extension for event tables: event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*.parquet") -> StreamingQuery:
    """Hand every new file's rows to handle(batch, batch_id); returns when all that was there is done."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    query = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def changed_files(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (rel_path, sha) that the cache lacks or has with another hash: only they are extracted again."""
    known = cache.select("rel_path", F.col("sha").alias("old"))
    return now.join(known, "rel_path", "left").filter(~F.col("sha").eqNullSafe(F.col("old"))).drop("old")


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total): counts by event time, of a stream or a table."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(span.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, n): runs of a user's events without a longer gap."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return s.select("user_id", F.col("s.start").alias("started"), "ended", "n")
