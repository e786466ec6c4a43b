"""Ordering, quotas and neighbours without unpartitioned windows or whole-group sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed: str | int, *ids: Column) -> Column:
    """Reproducible pseudo-random order key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def seeded_choice(seed: str | int, ids: Column, n: int) -> Column:
    """Reproducible pseudo-random integer in 0..n-1."""
    head = F.conv(F.substring(seeded_hash(seed, ids), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(n)).cast("int")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group.  Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def shuffle_rows(df: DataFrame, seed: str | int, id_col: str) -> DataFrame:
    """Reproducible shuffle: a range-partitioned sort by a hash, which cannot be skewed."""
    return df.withColumn("_h", seeded_hash(seed, F.col(id_col))).orderBy("_h", id_col).drop("_h")


def take_quota(df: DataFrame, by: list[str], key: str, quota: Column | int, tie: list[str]) -> DataFrame:
    """The ``quota`` rows with the smallest hex hash ``key`` in every group, exactly.

    A histogram over the first four hex digits finds the one bucket per group in
    which the quota runs out; only rows of that bucket are ranked to find the
    last row to keep.  Both steps read key columns only; the rows themselves are
    filtered in one pass, so neither a hot group nor a large quota ends in one
    task.
    """
    quota = F.lit(quota) if isinstance(quota, int) else quota
    if not by:
        return _take_quota_overall(df, key, quota, tie)
    rows = df.withColumn("_b", F.substring(key, 1, 4))
    place = F.struct(key, *tie)
    limits = quota_limits(df, by, key, quota, tie)
    keep = (
        F.col("_edge").isNull()
        | (F.col("_b") < F.col("_edge._b"))
        | ((F.col("_b") == F.col("_edge._b")) & F.coalesce(place <= F.col("_last"), F.lit(False)))
    )
    return rows.join(limits, by, "left").filter(keep).drop("_b", "_edge", "_last")


def quota_limits(df: DataFrame, by: list[str], key: str, quota: Column, tie: list[str]) -> DataFrame:
    """One row per group with more rows than its quota: the bucket where it runs out (``_edge._b``) and the last row to keep
    in that bucket (``_last``: key and ties; null where none of the bucket stays)."""
    rows = df.withColumn("_b", F.substring(key, 1, 4))
    histogram = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*by).orderBy("_b")
    edges = (
        histogram.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_left", quota - (F.col("_upto") - F.col("_n")))
        .filter(F.col("_upto") > quota)
        .groupBy(*by)
        .agg(F.min(F.struct("_b", "_left")).alias("_edge"))
    )
    ranked = Window.partitionBy(*by).orderBy(key, *tie)
    last = (
        rows.select(*by, "_b", key, *tie).join(edges, by).filter(F.col("_b") == F.col("_edge._b"))
        .withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") == F.col("_edge._left"))
        .select(*by, F.struct(key, *tie).alias("_last"))
    )
    return edges.join(last, by, "left")


def _take_quota_overall(df: DataFrame, key: str, quota: Column, tie: list[str]) -> DataFrame:
    """:func:`take_quota` without groups: the two limits are scalars, so no join is needed."""
    bucket = F.substring(key, 1, 4)
    histogram = df.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(F.lit(0)).orderBy("_b")  # at most 65536 rows
    edge = (
        histogram.withColumn("_upto", F.sum("_n").over(running)).filter(F.col("_upto") > quota)
        .agg(F.min(F.struct("_b", (quota - F.col("_upto") + F.col("_n")).alias("_left"))).alias("e")).first()["e"]
    )
    if edge is None:
        return df
    below = bucket < edge["_b"]
    if edge["_left"] < 1:
        return df.filter(below)
    at_edge = df.filter(bucket == edge["_b"]).select(key, *tie).orderBy(key, *tie).limit(edge["_left"])
    last = at_edge.agg(F.max(F.struct(key, *tie)).alias("m")).first()["m"]
    place = F.struct(*[F.lit(last[c]).alias(c) for c in (key, *tie)])
    return df.filter(below | ((bucket == edge["_b"]) & (F.struct(key, *tie) <= place)))


def with_successor(
    df: DataFrame, by: list[str], order: list[str], bucket: Column, carry: list[str], cyclic: bool = False,
    name: str = "successor",
) -> DataFrame:
    """Add the next row's ``carry`` columns (a struct) in the total order of each group.

    ``bucket`` must grow with the order.  Rows look for their successor inside
    their bucket; the last row of a bucket takes the head of the next one, so a
    hot group is spread over as many tasks as it has buckets.  ``cyclic`` gives
    the last row of a group its first row.
    """
    keys = [*by, "_b"]
    rows = df.withColumn("_b", bucket)
    item = F.struct(*carry)
    inside = Window.partitionBy(*keys).orderBy(*order)
    heads = rows.groupBy(*keys).agg(F.min_by(item, F.struct(*order)).alias("_head"))
    across = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    following = F.lead("_head").over(across)
    if cyclic:
        whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = F.coalesce(following, F.first("_head").over(whole))
    heads = heads.select(*keys, following.alias("_after"))
    return (
        rows.withColumn("_next", F.lead(item).over(inside))
        .join(heads, keys, "left")
        .withColumn(name, F.coalesce("_next", "_after"))
        .drop("_b", "_next", "_after")
    )
