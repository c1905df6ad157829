"""Structured Streaming: the same matching over arriving responses, and windowed counts of events.

Matching keeps no state, so a batch of arrived responses runs through the batch operators inside ``foreachBatch``; the
sink writes each batch to its own folder, which makes a repeated batch harmless. Windowed counts keep state bounded by the
watermark. The reference semantics have no streams; this is an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def match_stream(spark: SparkSession, source: str, match: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run ``match`` over every batch of responses that arrive as Parquet files under ``source``; ends when all are read."""
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """(start, event_type, events, value): counts per window; rows later than ``late`` are dropped by the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    out = w.agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def run_window_counts(spark: SparkSession, source: str, sink: str, checkpoint: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """All windows of the events under ``source``: each batch writes the windows it changed, the last write of a window
    counts. Rows later than ``late`` are dropped, as the state of their windows is."""
    schema = spark.read.parquet(source).schema
    counts = window_counts(spark.readStream.schema(schema).parquet(source), late, size)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/part={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(sink)
    last = done.groupBy("start", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("x"))
    return last.select("start", "event_type", "x.*")
