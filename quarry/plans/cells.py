"""A vector index stored by cells, with exact search that skips the cells which cannot hold a hit.

Entries lie in a folder per cell; a table of the cells has centroid, radius (largest distance of an entry to the centroid)
and size. For a query q and an entry x of a cell with centroid c and radius r the dot product is at most q.c + |q| r. This
bound is itself a dot product, of (q, |q|) and (c, r), so the cells that can matter are found by the same tiled join that
scores entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import norm
from quarry.operators import search as SE
from quarry.operators.ordering import top_k
from quarry.session import materialize

#: Scores are rounded; bounds leave that much room.
SLACK = 1e-7


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


class CellIndex:
    """Entries by cell under ``folder``; see :meth:`write`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.cells = spark.read.parquet(f"{self.folder}/cells")

    @classmethod
    def write(cls, entries: DataFrame, centroids: DataFrame, folder: str) -> CellIndex:
        """Store ``entries`` (row_id, embedding, further columns) by their nearest centroid (cell, vector).

        Rows without a vector are left out. A cell with very many entries is written by several tasks.
        """
        folder = folder.rstrip("/")
        placed = materialize(SE.assign_cells(entries, centroids).where("cell is not null"), "placed")
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/entries")
        reach = placed.join(centroids, "cell").groupBy("cell").agg(F.max(_distance("embedding", "vector")).alias("radius"), F.count("*").alias("n"))
        centroids.join(reach, "cell").select(F.col("cell").cast("bigint").alias("cell"), "vector", "radius", "n").write.parquet(f"{folder}/cells")
        return cls(entries.sparkSession, folder)

    def entries(self, probes: DataFrame) -> DataFrame:
        """The stored entries of the cells in ``probes``; the scan opens only their folders."""
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]
        rows = self.spark.read.parquet(f"{self.folder}/entries")
        return rows.where(F.col("cell").isin(wanted)).withColumn("cell", F.col("cell").cast("bigint"))

    def _bounds(self) -> DataFrame:
        wide = F.concat(F.transform("vector", lambda x: x.cast("double")), F.array(F.col("radius")))
        return self.cells.select(F.col("cell").alias("row_id"), wide.alias("embedding"))

    def _asking(self, queries: DataFrame, probes: DataFrame) -> DataFrame:
        cells = probes.groupBy("qid").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        return materialize(queries.join(cells, "qid"), "asking")

    def reached(self, queries: DataFrame) -> DataFrame:
        """(qid, cell): the cells whose bound reaches a query's ``minimum``."""
        wide = F.concat(F.transform("vector", lambda x: x.cast("double")), F.array(norm(F.col("vector"))))
        asked = queries.select("qid", wide.alias("vector"), (F.col("minimum") - SLACK).alias("minimum"))
        return SE.within(asked, self._bounds()).select("qid", F.col("row_id").alias("cell"))

    def within(self, queries: DataFrame) -> DataFrame:
        """All entries whose score reaches the query's ``minimum``: (qid, row_id, score)."""
        probes = materialize(self.reached(queries), "probes")
        return SE.within(self._asking(queries, probes), self.entries(probes))

    def top_k(self, queries: DataFrame, k: int = 10, probes: int = 2) -> tuple[DataFrame, DataFrame]:
        """The exact top-k of every query, and the (qid, cell) pairs that were scored for it.

        A first look into the ``probes`` nearest cells gives each query a k-th score; then only the cells whose bound
        reaches that score are opened. A query that finds fewer than k entries at first looks everywhere.
        """
        nearest = SE.knn(queries.select("qid", "vector"), self.cells.select(F.col("cell").alias("row_id"), F.col("vector").alias("embedding")), probes)
        first = materialize(nearest.select("qid", F.col("row_id").alias("cell")), "probes")
        found = materialize(SE.knn(self._asking(queries, first), self.entries(first), k), "found")
        worst = found.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("minimum"))
        asked = queries.select("qid", "vector").join(worst, "qid", "left").withColumn("minimum", F.coalesce("minimum", F.lit(float("-inf"))))
        more = materialize(self.reached(materialize(asked, "asked")).join(first, ["qid", "cell"], "left_anti"), "probes")
        rest = SE.knn(self._asking(queries, more), self.entries(more), k)
        both = reduce(DataFrame.unionByName, [h.select("qid", "row_id", "score") for h in (found, rest)])
        return top_k(both, ["qid"], [F.desc("score"), F.asc("row_id")], k), first.unionByName(more)
