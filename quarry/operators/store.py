"""Content-addressed tables: content, paths, chunks.

``content_hash`` is the natural key of a content, ``path`` the key of a path
and (``content_hash``, ``chunk_index``) the key of a chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_known(files: DataFrame, stored: DataFrame, key: str = "content_hash", small_batch: bool = False) -> DataFrame:
    """Add ``is_known``: the content is already stored.

    ``small_batch`` first reduces the stored keys to those of the batch; Spark
    then broadcasts the batch (when it is small enough) and only scans the
    stored table instead of shuffling it.
    """
    known = stored.select(key)
    if small_batch:
        known = known.join(files.select(key).distinct(), key, "left_semi")
    known = known.distinct().withColumn("_known", F.lit(True))
    return files.join(known, key, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    return rows.join(stored.select(key), key, "left_anti")


def first_per_content(entries: DataFrame) -> DataFrame:
    """One row per content: the FILE entry with the smallest path, with the number of paths that share it."""
    files = entries.filter(F.col("entry_type") == "file")
    item = F.struct(*[c for c in files.columns])
    grouped = files.groupBy(F.coalesce("content_hash", "file_path").alias("content_key")).agg(
        F.min_by(item, F.col("file_path")).alias("_first"), F.count("*").alias("n_paths")
    )
    return grouped.select("content_key", "n_paths", "_first.*")


def insert_content(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert if absent; equal contents within one batch collapse to the smallest path's row."""
    fresh = new_rows(incoming, stored)
    item = F.struct(*[c for c in stored.columns])
    order = F.col("path") if "path" in incoming.columns else F.col("first_line")
    single = fresh.groupBy("content_hash").agg(F.min_by(item, order).alias("_row")).select("_row.*")
    return stored.unionByName(single)


def upsert_paths(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update by path; the newest verification wins."""
    columns = stored.columns
    both = stored.withColumn("_p", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_p", F.lit(1)))
    item = F.struct(*columns)
    return (
        both.groupBy(F.col("path").alias("_key"))
        .agg(F.max_by(item, F.struct("_p", "last_verified", "content_hash")).alias("_row"))
        .select("_row.*")
    )


def replace_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Drop the chunks of every content that arrives again, then add the new ones."""
    touched = incoming.select("content_hash").distinct()
    return stored.join(touched, "content_hash", "left_anti").unionByName(incoming.select(*stored.columns))


def below_roots(path: Column, roots: list[str]) -> Column:
    tests = [path.startswith(r.rstrip("/") + "/") for r in roots]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def stale_paths(stored: DataFrame, current: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Stored paths below the scanned roots that the scan did not meet."""
    scanned = stored.filter(below_roots(F.col("path"), roots or []))
    return scanned.join(current.select("path"), "path", "left_anti")


def outside(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose ``path`` lies in or below none of the folders (``path``); a path meets its own ancestors by equality."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = rows.select("path", F.explode(ancestors).alias("_folder")).join(folders.select(F.col("path").alias("_folder")), "_folder", "left_semi")
    return rows.join(below.select("path").distinct(), "path", "left_anti")


def changed_paths(described: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new, or whose content or modification time differs from the stored path row."""
    old = stored.select("path", F.col("content_hash").alias("_hash"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_stored"))
    same = F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    joined = described.join(old, "path", "left")
    return joined.filter(F.col("_stored").isNull() | ~same).drop("_hash", "_mtime", "_stored")


def without_orphans(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Content or chunk rows that some path still refers to."""
    return rows.join(paths.select("content_hash"), "content_hash", "left_semi")


def orphans(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("content_hash"), "content_hash", "left_anti")


def content_paths(content: DataFrame, paths: DataFrame) -> DataFrame:
    """Every path with its content."""
    return content.join(paths, "content_hash")


def chunk_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per chunk and path.

    A single join of two shuffled sides, which adaptive execution splits where a content has very many paths. Contents need
    not be joined: a chunk without a path falls away here, and no chunk is stored without its content.
    """
    return chunks.join(paths, "content_hash")


def index_rows(content: DataFrame, paths: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """What the vector index stores: FILE rows and CHUNK rows with vector and metadata."""
    located = ["source", "path", "file_name", "folder", "content_hash"]
    files = (
        content.filter(F.col("embedding").isNotNull())
        .select("content_hash", "embedding", F.col("first_line").alias("text"))
        .join(paths.select(*located), "content_hash")
        .withColumns({"type": F.lit("file"), "chunk_index": F.lit(None).cast("int")})
    )
    rows = files
    if chunks is not None:
        parts = chunk_paths(
            chunks.filter(F.col("embedding").isNotNull()), paths.select(*located)
        ).withColumn("type", F.lit("chunk"))
        rows = files.unionByName(parts.select(*files.columns))
    row_id = F.concat_ws("#", "type", "path", F.col("chunk_index").cast("string"))
    return rows.select(
        row_id.alias("row_id"), "type", "source", F.col("path").alias("file_path"), "file_name", "folder",
        "chunk_index", "content_hash", "text", "embedding",
    )


def duplicate_groups(paths: DataFrame) -> DataFrame:
    """Contents stored under more than one path: size of the group and its first path.

    Only constant-size aggregates, so a content with a third of all paths is
    reduced before the shuffle.
    """
    return (
        paths.groupBy("content_hash")
        .agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
        .filter(F.col("n_paths") > 1)
    )


def duplicate_paths(paths: DataFrame) -> DataFrame:
    """Every path that shares its content, one row per path instead of one list per content."""
    groups = duplicate_groups(paths).select("content_hash", "n_paths", "first_path")
    return paths.select("content_hash", "path").join(groups, "content_hash")


def index_stats(flagged: DataFrame, n_chunks: Column | None = None) -> DataFrame:
    """One row of run counters over files with ``is_known``, ``content_hash`` and ``error_type``."""
    return flagged.agg(
        F.count("*").alias("files_scanned"),
        F.count_distinct(F.when(~F.col("is_known"), F.col("content_hash"))).alias("files_indexed"),
        F.count_if("is_known").alias("files_skipped"),
        F.count_if("is_known").alias("files_deduplicated"),
        (n_chunks if n_chunks is not None else F.lit(0).cast("bigint")).alias("chunks_created"),
        F.count_if(F.col("error_type").isNotNull()).alias("errors"),
    )


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Quick test by modification time first, content hash second."""
    old = stored.select(
        "path", F.col("mtime").alias("_mtime"), F.col("content_hash").alias("_hash")
    )
    status = (
        F.when(F.col("_hash").isNull(), "new")
        .when(F.col("_mtime") == F.col("mtime"), "unchanged")
        .when(F.col("_hash") == F.col("content_hash"), "touched")
        .otherwise("modified")
    )
    return current.join(old, "path", "left").withColumn("status", status).drop("_mtime", "_hash")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a table for a table of keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")
