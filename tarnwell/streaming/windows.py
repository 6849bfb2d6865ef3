"""Streaming forms: fixed-window rate limits and times to the first token, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limit_windows(stream: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """user_id, window, requests, allowed, rejected of each tumbling window. stream: user_id, ts."""
    rows = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("requests"))
    return rows.select("user_id", "window", "requests", F.least("requests", F.lit(limit)).alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def first_token(stream: DataFrame, late: str = "10 minutes", span: str = "10 minutes") -> DataFrame:
    """request_id, window, ttft_ms: from a request's first event to its first delta. stream: request_id, event, ts.

    A request lasts until nothing has come for ``span``; one that comes back later counts as another.
    """
    rows = stream.withWatermark("ts", late).groupBy("request_id", F.session_window("ts", span).alias("window"))
    return rows.agg(F.min("ts").alias("begin"), F.min(F.when(F.col("event") == "delta", F.col("ts"))).alias("first")).select(
        "request_id", "window", ((F.unix_micros("first") - F.unix_micros("begin")) / 1000).alias("ttft_ms")
    )
