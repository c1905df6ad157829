"""Queries that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lanthorn.operators import native
from lanthorn.plans import native_queries
from lanthorn.session import shared_folder, table
from lanthorn.streaming import matches

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _folder(spark) -> str:
    """A fresh folder in the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_event_windows(spark, d):
    base = _folder(spark)
    out = matches.run_window_counts(spark, f"{d}/events.parquet*", f"{base}/out", f"{base}/state")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events")


def stream_native_counts(spark, d):
    """Frameworks of responses that arrive as a stream, counted by name."""
    base, entries = _folder(spark), table(spark, d, "native_finger")
    q = matches.match_stream(spark, f"{d}/responses.parquet*", lambda r: native.frameworks(r, entries).select("resp_id", "name"), f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("name").agg(F.count("*").alias("responses"))


QUERIES["stream_event_windows"] = stream_event_windows
SQL["stream_event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1, 2"
QUERIES["stream_native_counts"] = stream_native_counts
SQL["stream_native_counts"] = native_queries.SQL["native_framework_counts"]
