"""Request metrics over a table or stream of requests.

Input: (ts TIMESTAMP, method, path, status INT, duration DOUBLE). Every function
is the same for a batch and a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The dashboard's windows.
RATE_WINDOW, RATE_SLIDE, DAY = "5 minutes", "1 minute", "24 hours"
RATE_SECONDS = 300

LATENESS = "10 minutes"


def _watermarked(requests: DataFrame) -> DataFrame:
    return requests.withWatermark("ts", LATENESS) if requests.isStreaming else requests


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests per (method, path, status) since the start."""
    return requests.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"))


def request_latency(requests: DataFrame) -> DataFrame:
    """Count, sum and maximum of the duration per (method, path)."""
    return requests.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("duration").alias("total_seconds"),
        F.max("duration").alias("max_seconds"),
    )


def windowed(
    requests: DataFrame,
    by: list[str],
    aggregates: dict[str, Column],
    window: str = RATE_WINDOW,
    slide: str | None = RATE_SLIDE,
    where: Column | None = None,
) -> DataFrame:
    """Aggregates per event-time window [start, end) and key. Sliding copies of a
    row are combined map-side, so a busy path does not make a hot task."""
    kept = _watermarked(requests)
    if where is not None:
        kept = kept.where(where)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        kept.groupBy(span.alias("span"), *by)
        .agg(*[value.alias(name) for name, value in aggregates.items()])
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            *by,
            *aggregates,
        )
    )


def request_rate(requests: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE,
                 seconds: int = RATE_SECONDS) -> DataFrame:
    """Requests per second by (method, path)."""
    rate = {"rate": F.count(F.lit(1)) / seconds}
    return windowed(requests, ["method", "path"], rate, window, slide)


def error_rate(requests: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE,
               seconds: int = RATE_SECONDS) -> DataFrame:
    """Server errors (status 5xx) per second by path."""
    rate = {"rate": F.count(F.lit(1)) / seconds}
    failed = (F.col("status") >= 500) & (F.col("status") < 600)
    return windowed(requests, ["path"], rate, window, slide, failed)


def latency_average(requests: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE) -> DataFrame:
    """Mean duration by path."""
    mean = {"latency": F.sum("duration") / F.count(F.lit(1))}
    return windowed(requests, ["path"], mean, window, slide)


def requests_per_day(requests: DataFrame) -> DataFrame:
    """Requests per tumbling 24 hours."""
    return windowed(requests, [], {"requests": F.count(F.lit(1))}, DAY, None)


def status_breakdown(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))
