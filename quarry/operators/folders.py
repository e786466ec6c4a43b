"""Folder tree: vectors and file counts aggregated bottom-up, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.vectors import mean_vector
from quarry.session import materialize


def folder_tree(files: DataFrame, dims: int, keep_levels: bool = True) -> DataFrame:
    """Every folder with the mean vector of its children (files and folders), file count and depth.

    ``files``: path, vector.  One aggregation per folder depth; each level is
    written once, because the next level reads it.
    """
    placed = files.select(P.parent(F.col("path")).alias("folder"), "vector", F.lit(1).cast("bigint").alias("n_files"))
    placed = placed.filter(F.col("folder") != "").withColumn("depth", F.size(F.split("folder", "/")))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    result, below = None, None
    for depth in range(deepest, 0, -1):
        children = placed.filter(F.col("depth") == depth).select("folder", "vector", "n_files")
        if below is not None:
            lifted = below.select(P.parent(F.col("folder")).alias("folder"), "vector", "n_files")
            children = children.unionByName(lifted.filter(F.col("folder") != ""))
        level = children.groupBy("folder").agg(
            mean_vector(F.col("vector"), dims).alias("vector"),
            F.sum("n_files").alias("n_files"),
            F.count("*").alias("n_children"),
        ).withColumn("depth", F.lit(depth))
        below = materialize(level, "folders") if keep_levels else level
        result = below if result is None else result.unionByName(below)
    return result
