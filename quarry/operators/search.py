"""Filtered top-k vector search.

Queries meet entries in a join: on the cell in a cell search, on a tile of the
entries in an exact search. Entries and queries are dealt to tiles of bounded
size, so a task holds one tile of each, whatever their numbers, and nothing
passes through the driver. A task multiplies its two tiles and keeps the top k
of each query; those rows are merged by query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordering import top_k
from quarry.session import materialize

#: Entries and queries of one tile.
ENTRY_TILE, QUERY_TILE = 1 << 14, 1 << 12
SCORE_DIGITS = 9
_HITS = "qid {qid}, row_id {row}, score double"


def metadata_filter(intent: str = "read", source: str | None = None, folder: str | None = None):
    """Search intent and scope as a predicate that reaches the scan and its partitions."""
    test = F.col("type") == ("chunk" if intent == "read" else "file")
    if source:
        test = test & (F.col("source") == source)
    if folder:
        test = test & F.col("folder").startswith(folder)
    return test


PRESETS = {
    "files": {"intent": "find"},
    "content": {"intent": "read"},
    "memory": {"intent": "read", "source": "memory"},
    "photos": {"intent": "find", "source": "photos"},
}


def with_preset(queries: DataFrame, preset: str, folder: str | None = None) -> DataFrame:
    """Add the filter columns ``type``, ``source`` and ``folder`` of a named search."""
    settings = PRESETS["files" if preset == "in_folder" else preset]
    return queries.withColumns(
        {
            "type": F.lit("chunk" if settings["intent"] == "read" else "file"),
            "source": F.lit(settings.get("source")).cast("string"),
            "folder": F.lit(folder).cast("string"),
        }
    )


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        inside = np.flatnonzero(scores >= kth)
    else:
        inside = np.arange(len(scores))
    return inside[np.lexsort((ids[inside], -scores[inside]))][:k]


def _scorer(k: int | None, filters: list[str], schema_names: list[str]):
    """The function of a group: a tile of queries and a tile of entries in, the top k of each query out, or without k all
    entries whose score reaches the query's minimum."""

    def score(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or entries.empty:
            return pd.DataFrame({n: [] for n in schema_names})
        ids = entries["row_id"].to_numpy()
        ids = ids.astype(str) if ids.dtype == object else ids
        table = np.round(_matrix(entries["embedding"]) @ _matrix(asked["vector"]).T, SCORE_DIGITS)
        masks: dict[tuple, np.ndarray] = {}

        def passing(name: str, wanted) -> np.ndarray:
            if (name, wanted) not in masks:
                own = entries[name].fillna("")
                masks[name, wanted] = (own.str.startswith(wanted) if name == "folder" else own == wanted).to_numpy(bool)
            return masks[name, wanted]

        found = []
        for column, row in enumerate(asked.itertuples(index=False)):
            mask = np.ones(len(ids), dtype=bool) if k is not None else table[:, column] >= row.minimum
            for name in filters:
                wanted = getattr(row, name)
                if wanted is not None and wanted == wanted:
                    mask = mask & passing(name, wanted)
            best = np.flatnonzero(mask)
            found.append(best if k is None else best[_best(ids[best], table[best, column], k)])
        column, place = np.repeat(np.arange(len(asked)), [len(f) for f in found]), np.concatenate(found)
        return pd.DataFrame({"qid": asked["qid"].to_numpy()[column], "row_id": ids[place], "score": table[place, column]})

    return score


def _meet(queries: DataFrame, entries: DataFrame, k: int | None) -> DataFrame:
    """Hits (qid, row_id, score) of every pair of tiles; queries and entries of a cell are dealt by that cell's own sizes,
    so an entry is sent once to each block of queries that ask in its cell, and not at all where none asks."""
    filters = [c for c in ("type", "source", "folder") if c in queries.columns]
    in_cells = "cells" in queries.columns
    own = [*filters, *(["cells"] if in_cells else []), *([] if k is not None else ["minimum"])]
    asked = queries.select("qid", "vector", *own).filter("vector is not null")
    rows = entries.select("row_id", "embedding", *filters, *(["cell"] if in_cells else [])).filter("embedding is not null")
    for name in [c for c in ("type", "source") if c in filters]:  # an index is stored by these; a few values prune its folders
        values = [r[0] for r in asked.select(name).distinct().limit(101).collect()]
        if len(values) <= 100 and None not in values:
            rows = rows.filter(F.col(name).isin(values))
    if in_cells:  # cells of another integer type than the entries' would be dealt to other tasks
        asked = asked.withColumn("cell", F.explode("cells")).drop("cells").withColumn("cell", F.col("cell").cast(rows.schema["cell"].dataType))
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / ENTRY_TILE).cast("int").alias("_tiles")).join(
            asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_TILE).cast("int").alias("_blocks")), "cell")
        rows, asked = rows.join(sizes, "cell"), asked.join(sizes, "cell")
    else:
        tiles, blocks = (max(1, -(-x.count() // size)) for x, size in ((rows, ENTRY_TILE), (asked, QUERY_TILE)))
        rows, asked = (x.withColumns({"cell": F.lit(0), "_tiles": F.lit(tiles), "_blocks": F.lit(blocks)}) for x in (rows, asked))
    rows = rows.withColumns({
        "_tile": F.pmod(F.xxhash64("row_id"), "_tiles").cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))})
    asked = asked.withColumns({
        "_block": F.pmod(F.xxhash64("qid"), "_blocks").cast("int"), "_tile": F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))})
    keys = ["cell", "_tile", "_block"]
    schema = _HITS.format(
        qid=queries.schema["qid"].dataType.simpleString(), row=entries.schema["row_id"].dataType.simpleString()
    )
    return asked.drop("_tiles", "_blocks").groupBy(*keys).cogroup(rows.drop("_tiles", "_blocks").groupBy(*keys)).applyInPandas(
        _scorer(k, filters, ["qid", "row_id", "score"]), schema)


def knn(queries: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """Exact top-k by dot product: (qid, row_id, score, rank).

    ``queries``: qid, vector and optionally type, source, folder (null = any)
    and cells; ``entries``: row_id, embedding and the columns the filters name.
    With cells a query only meets the entries of its cells. Rows without a
    vector take no part.
    """
    return top_k(_meet(queries, entries, k), ["qid"], [F.desc("score"), F.asc("row_id")], k)


def within(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """All entries whose dot product reaches ``minimum``, a column of the queries: (qid, row_id, score)."""
    return _meet(queries, entries, None)


def assign_cells(entries: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cell``, the centroid with the largest dot product (ties: smallest id); null for a row without a vector.

    Made once, when an index is written; ``row_id`` is unique.
    """
    best = knn(
        entries.select(F.col("row_id").alias("qid"), F.col("embedding").alias("vector")),
        centroids.select(F.col("cell").cast("bigint").alias("row_id"), F.col("vector").alias("embedding")), 1,
    )
    return entries.join(best.select(F.col("qid").alias("row_id"), F.col("row_id").alias("cell")), "row_id", "left").select(*entries.columns, "cell")


def train_cells(entries: DataFrame, cells: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """Cell centroids (cell, vector) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = entries.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, initMode="random").fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = entries.sparkSession.createDataFrame(rows, "cell bigint, vector array<double>")
    return table.coalesce(1 + cells // 4096)


def knn_in_cells(queries: DataFrame, entries: DataFrame, centroids: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """Approximate top-k: only entries in the ``probes`` best cells of a query are scored."""
    nearest = knn(
        queries.select("qid", "vector"), centroids.select(F.col("cell").alias("row_id"), F.col("vector").alias("embedding")),
        probes,
    )
    cells = nearest.groupBy("qid").agg(F.array_sort(F.collect_list("row_id")).alias("cells"))
    return knn(materialize(queries.join(cells, "qid"), "probes"), entries, k)


def hit_projection(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Search hits with their metadata, score at four digits."""
    meta = index.select("row_id", "text", "source", "type", "file_path", "file_name", "folder", "chunk_index")
    return hits.join(meta, "row_id").select(
        "qid", "rank", "text", "source", "type", "file_path", "file_name", "folder", "chunk_index",
        F.round("score", 4).alias("score"),
    )


def hybrid_merge(keyword_hits: DataFrame, vector_hits: DataFrame, limit: int, minimum: int) -> DataFrame:
    """Keyword hits first; queries with fewer than ``minimum`` of them are filled up with new vector hits.

    Both inputs: qid, path, rank.  Output: qid, path, method, rank.
    """
    keyword = keyword_hits.filter(F.col("rank") <= limit).select("qid", "path", "rank", F.lit(0).alias("_part"))
    enough = keyword.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)
    extra = (
        vector_hits.select("qid", "path", "rank", F.lit(1).alias("_part"))
        .join(enough, "qid", "left_anti")
        .join(keyword.select("qid", "path"), ["qid", "path"], "left_anti")
    )
    merged = keyword.unionByName(extra)
    ranked = top_k(merged, ["qid"], [F.asc("_part"), F.asc("rank"), F.asc("path")], limit, "_rank")
    method = F.when(F.col("_part") == 0, "keyword").otherwise("vector")
    return ranked.select("qid", "path", method.alias("method"), F.col("_rank").alias("rank"))


def hybrid_score(scored: DataFrame, weights: dict[str, float], minimum: float) -> DataFrame:
    """Weighted sum of ``<name>_score`` columns, weak rows dropped."""
    total = reduce(lambda a, b: a + b, [F.col(f"{name}_score") * F.lit(w) for name, w in weights.items()])
    return scored.withColumn("score", F.round(total, 6)).filter(F.col("score") >= minimum)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits; none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def hybrid_search(queries: DataFrame, index: DataFrame, nearby, weights: dict[str, float], minimum: float, hot_rows: int = 100_000) -> DataFrame:
    """Every row whose weighted score of file name, content and keywords reaches ``minimum``: (qid, row_id, three scores, score).

    ``queries``: qid, vector, terms; ``index``: row_id, file_name, text, embedding; ``nearby``: function of queries with a
    ``minimum`` that gives all rows of that content score (:func:`within`, or ``CellIndex.within``). Name and keyword score
    are the share of a query's terms among the words of file name and text.

    Candidates come from three lists, of which a row that reaches the sum must be in one: the rows whose name or whose text
    holds one of the query's terms, and the rows so near that they reach the sum without one. Words of more than
    ``hot_rows`` rows list no candidates; what they could add is taken off the content score that the near rows must have,
    so nothing is lost. All three scores are then computed for the candidates alone.
    """
    terms = queries.select("qid", F.array_distinct(F.filter(F.transform("terms", F.lower), lambda w: w != "")).alias("terms"))
    words = materialize(terms.select("qid", F.explode("terms").alias("term"), F.size("terms").alias("n")), "terms")
    share = {"filename": "file_name", "keyword": "text"}
    pairs, needed = [], queries.select("qid", "vector").withColumn("minimum", F.lit(minimum))
    for name, column in share.items():
        postings = index.select("row_id", F.explode(tokens(F.col(column))).alias("term"))
        sizes = postings.join(words.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("rows"))
        hot = materialize(sizes.where(F.col("rows") > hot_rows).select("term"), "hot")
        pairs.append(postings.join(words.join(hot, "term", "left_anti"), "term").select("qid", "row_id"))
        listed = words.join(hot, "term").groupBy("qid").agg((F.count("*") / F.first("n")).alias("hot"))
        needed = needed.join(listed, "qid", "left").withColumn("minimum", F.col("minimum") - F.coalesce("hot", F.lit(0.0)) * weights[name]).drop("hot")
    near = nearby(materialize(needed.withColumn("minimum", F.col("minimum") / weights["content"] - 1e-6), "needed"))
    found = reduce(DataFrame.unionByName, [*pairs, near.select("qid", "row_id")]).distinct()
    product = F.aggregate(F.zip_with("embedding", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(index.select("row_id", "embedding", *share.values()).where("embedding is not null"), "row_id").join(
        queries.select("qid", "vector").where("vector is not null").join(terms, "qid"), "qid")
    hits = {f"{name}_score": F.coalesce(F.size(F.array_intersect(tokens(F.col(c)), "terms")) / F.nullif(F.size("terms"), F.lit(0)), F.lit(0.0)) for name, c in share.items()}
    columns = ["qid", "row_id", "content_score", *hits]
    return hybrid_score(scored.withColumns({**hits, "content_score": F.round(product, SCORE_DIGITS)}).select(*columns), weights, minimum)


def beam_search(queries: DataFrame, nodes: DataFrame, entries: DataFrame, k: int = 10, beam: int = 8) -> DataFrame:
    """Top-k among the entries of the tree nodes that a descent keeps: (qid, row_id, score, rank).

    ``nodes``: node, parent (null for the top), vector; ``entries``: row_id, embedding and ``node``, the folder or cluster
    that holds the entry (null: the top itself), and the columns the filters name. Level by level, the children of the kept
    nodes meet their queries in tiles and the ``beam`` best of each query are kept; entries of every kept node are scored,
    those above the last level too. With a beam as wide as the widest level the result is exact.
    """
    cell = F.coalesce("parent", F.lit(""))
    below = materialize(nodes.select(F.col("node").alias("row_id"), F.col("vector").alias("embedding"), cell.alias("cell")), "nodes")
    kept = materialize(queries.select("qid", F.lit("").alias("cell")), "kept")
    every = [kept]
    while True:
        cells = kept.groupBy("qid").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        best = knn(queries.select("qid", "vector").join(cells, "qid"), below, beam)
        kept = materialize(best.select("qid", F.col("row_id").alias("cell")), "kept")
        if kept.isEmpty():
            break
        every.append(kept)
    cells = reduce(DataFrame.unionByName, every).groupBy("qid").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    asked = materialize(queries.join(cells, "qid"), "asked")
    return knn(asked, entries.withColumn("cell", F.coalesce("node", F.lit(""))), k)
