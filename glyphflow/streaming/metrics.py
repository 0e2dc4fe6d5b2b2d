"""Request metrics per time window on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphflow.settings import REQUEST_BOUNDS


def stream_request_metrics(
    requests: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", bounds: list[float] = REQUEST_BOUNDS
) -> DataFrame:
    """Count, duration sum and cumulative buckets per window, endpoint, lang and status.

    Requests later than `delay` are dropped; totals are sums over the windows.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "endpoint", "lang", "status")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.sum("duration").alias("duration_sum"),
            *[F.count_if(F.col("duration") <= b).alias(f"bucket_{i}") for i, b in enumerate(bounds)],
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*")
        .drop("window")
    )
