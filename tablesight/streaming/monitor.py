"""Health and totals per event-time window; the same code serves a stream and a finished table.

Only the monitoring formulas are continuous: their inputs are counts and maxima, so a window's state is a
few numbers per key, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col, sum_or_zero
from tablesight.operators.monitor import LATENCY_THRESHOLD_MS, health_score, health_status


def _windowed(events: DataFrame, time: str, width: str, late: str, by: Sequence[str]):
    events = events.withColumn("_time", col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("_time", late)
    return events.groupBy(F.window("_time", width).alias("_window"), *[col(b) for b in by])


def _bounds() -> list[Column]:
    return [F.col("_window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("_window.end").cast("timestamp_ntz").alias("window_end")]


def windowed_health(events: DataFrame, time: str, latency: str, is_error: Column, by: Sequence[str] = (),
                    width: str = "1 day", late: str = "10 minutes",
                    threshold_ms: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """Per window and key: events, errors, slowest answer, health score and status."""
    counted = _windowed(events, time, width, late, by).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_error).alias("errors"),
        F.max(col(latency)).alias("latency_ms"))
    score = health_score(F.lit(1.0), F.col("latency_ms"), F.lit(float(threshold_ms)), F.lit(False), F.col("errors"))
    return counted.select(*_bounds(), *[col(b) for b in by], "events", "errors", "latency_ms",
                          score.alias("health_score")).withColumn("status", health_status(F.col("health_score")))


def windowed_totals(events: DataFrame, time: str, measure: str, by: Sequence[str] = (), width: str = "1 day",
                    late: str = "10 minutes") -> DataFrame:
    """Data of a line chart over time: the measure's total per window and key."""
    totals = _windowed(events, time, width, late, by).agg(
        F.count(F.lit(1)).alias("events"), sum_or_zero(col(measure)).alias("value"))
    return totals.select(*_bounds(), *[col(b) for b in by], "events", "value")
