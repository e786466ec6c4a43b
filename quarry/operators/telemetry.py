"""Recorded host samples: latest values, disks, top processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import telemetry as U
from quarry.operators.ordering import top_k


def latest(samples: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Last sample per key."""
    rest = [c for c in samples.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def process_readings(samples: DataFrame) -> DataFrame:
    """Process rows in MB, nameless ones labelled, those below 1 MB dropped: host, pid, name, ram_bytes, cpu_percent."""
    return samples.select(
        "host", "pid",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unknown")).alias("name"),
        U.bytes_to_mb(F.coalesce("ram_bytes", F.lit(0))).alias("ram_mb"),
        F.coalesce("cpu_percent", F.lit(0.0)).alias("cpu_percent"),
    ).filter(F.col("ram_mb") >= 1)


def top_processes(samples: DataFrame, n: int = 5) -> DataFrame:
    """Per host the n processes with most memory and the n with most CPU: both ranks from one scan."""
    doubled = process_readings(samples).select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("ram").alias("by"), F.col("ram_mb").cast("double").alias("amount")),
                F.struct(F.lit("cpu").alias("by"), F.col("cpu_percent").cast("double").alias("amount")),
            )
        ).alias("m"),
    ).select("host", "pid", "name", "ram_mb", "cpu_percent", "m.*")
    return top_k(doubled, ["host", "by"], [F.desc("amount"), F.asc("pid")], n)


def disk_readings(samples: DataFrame) -> DataFrame:
    """Latest disk sizes per host and mount point in GB, small partitions dropped."""
    now = latest(samples, ["host", "mount_point"])
    return now.filter(F.col("total_bytes") >= fv.MIN_DISK_BYTES).select(
        "host", "mount_point",
        U.bytes_to_gb(F.col("total_bytes")).alias("total_gb"),
        U.bytes_to_gb(F.col("used_bytes")).alias("used_gb"),
        U.bytes_to_gb(F.col("total_bytes") - F.col("used_bytes")).alias("free_gb"),
        F.bround(F.col("used_bytes") * 100.0 / F.col("total_bytes"), 1).alias("percent"),
    )
