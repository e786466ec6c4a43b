"""Units and shares of telemetry readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_to_gb(value: Column) -> Column:
    return F.bround(value / F.lit(float(1024**3)), 1)


def bytes_to_mb(value: Column) -> Column:
    return F.bround(value / F.lit(float(1024**2)), 1)


def uptime_hours(boot: Column, now: Column) -> Column:
    return F.bround((F.unix_micros(now) - F.unix_micros(boot)) / F.lit(3.6e9), 1)
