"""Cluster tree over item vectors.

All nodes of one depth are split at the same time: k-means steps are an
assignment pass (centroids of the depth are shared with the tasks) and one
aggregation by (node, cluster).  Fan-out and depth are limited, so there are
never more than 10 * 15 * 15 * 15 centroids, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions.vectors import mean_vector
from quarry.operators.ordering import seeded_hash, top_k
from quarry.session import materialize


def _assign(items: DataFrame, centers: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add ``cluster``: nearest centroid of the item's node, -1 where the node is not split."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", cluster int"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster = np.full(len(batch), -1, dtype=np.int32)
            for node, where in batch.groupby("node", sort=False).indices.items():
                if node in centers:
                    ids, table = centers[node]
                    rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vector"].to_numpy()[where]])
                    distance = (table**2).sum(axis=1)[None, :] - 2.0 * rows @ table.T
                    cluster[where] = ids[np.round(distance, 9).argmin(axis=1)]
            yield batch.assign(cluster=cluster)

    return items.mapInPandas(nearest, schema)


def _centers(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    table = rows.toPandas().sort_values(["node", "cluster"])
    return {
        node: (part["cluster"].to_numpy(np.int32), np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]]))
        for node, part in table.groupby("node")
    }


def describe_nodes(items: DataFrame, dims: int, depth: int) -> DataFrame:
    """One row per node: mean vector, size and an order-free hash of the contents for change detection."""
    h = F.xxhash64("content")
    return items.groupBy("node").agg(
        F.count("*").alias("n_items"),
        mean_vector(F.col("vector"), dims).alias("vector"),
        F.sha2(
            F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"),
                        F.sum(h.cast("decimal(38,0)")).cast("string")), 256,
        ).alias("item_hash"),
    ).withColumn("depth", F.lit(depth))


def cluster_tree(
    items: DataFrame, dims: int, seed: str | int = 42, iterations: int = 5, max_depth: int = fv.CLUSTER_MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """(nodes, items with their leaf node).  ``items``: id, vector, content."""
    state = materialize(items.select("id", "vector", "content", F.lit("0").alias("node")), "items")
    nodes = describe_nodes(state, dims, 0)
    for depth in range(1, max_depth + 1):
        fanout = fv.CLUSTER_L1_FANOUT if depth == 1 else fv.CLUSTER_FANOUT
        sizes = state.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > fv.CLUSTER_MAX_LEAF)
        wanted = sizes.withColumn("k", F.least(F.lit(fanout), F.floor(F.col("n") / fv.CLUSTER_MIN_LEAF)).cast("int"))
        seeds = top_k(
            state.join(F.broadcast(wanted), "node").withColumn("_h", seeded_hash(seed, F.col("id"))),
            ["node"], [F.asc("_h"), F.asc("id")], fanout, "cluster",
        ).filter(F.col("cluster") <= F.col("k"))
        centers = _centers(seeds.select("node", (F.col("cluster") - 1).alias("cluster"), "vector"))
        if not centers:
            break
        for _ in range(iterations):
            moved = _assign(state, centers).filter(F.col("cluster") >= 0)
            centers = _centers(moved.groupBy("node", "cluster").agg(mean_vector(F.col("vector"), dims).alias("vector")))
        assigned = _assign(state, centers)
        node = F.when(F.col("cluster") >= 0, F.concat_ws(".", "node", F.col("cluster").cast("string"))).otherwise(
            F.col("node")
        )
        state = materialize(assigned.withColumn("node", node).drop("cluster"), "items")
        here = state.filter(F.size(F.split("node", "\\.")) == depth + 1)
        nodes = nodes.unionByName(describe_nodes(here, dims, depth))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("node", "\\.[0-9]+$", ""))
    return nodes.withColumn("parent", parent), state
