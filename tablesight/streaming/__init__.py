"""Continuous forms of the monitoring operators."""

from tablesight.streaming.monitor import windowed_health, windowed_totals

__all__ = ["windowed_health", "windowed_totals"]
