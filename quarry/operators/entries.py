"""Index entries: one FILE row per file, CHUNK rows per content, image and memory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import paths as P
from quarry.functions import text as T

_COMMON = ["source", "file_path", "file_name", "folder"]


def describe_files(files: DataFrame, home: str, path: str = "path") -> DataFrame:
    """Add the columns every entry needs: source, file_path, file_name, folder, extension."""
    p = F.col(path)
    return files.withColumns(
        {
            "file_path": p,
            "file_name": P.base_name(p),
            "folder": P.relative_folder(p, home),
            "source": P.classify_source(p, home),
            "extension": P.extension(P.base_name(p)),
        }
    )


def _entry(df: DataFrame, text: Column, kind: str, chunk_index: Column, content_hash: Column, meta: Column) -> DataFrame:
    return df.select(
        text.alias("text"),
        F.lit(kind).alias("entry_type"),
        *[F.col(c).cast("string").alias(c) for c in _COMMON],
        chunk_index.cast("int").alias("chunk_index"),
        content_hash.cast("string").alias("content_hash"),
        meta.cast("map<string,string>").alias("extra_metadata"),
    )


def _hash(df: DataFrame) -> Column:
    return F.col("content_hash") if "content_hash" in df.columns else F.lit(None)


def file_entries(described: DataFrame) -> DataFrame:
    text = F.concat("file_name", F.lit(" - "), P.type_description(F.col("extension")), F.lit(" file"))
    meta = F.create_map(F.lit("extension"), F.col("extension"))
    return _entry(described, text, "file", F.lit(None), _hash(described), meta)


def chunk_entries(
    described: DataFrame, text: str = "text", size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    pieces = described.withColumn("_chunks", T.chunk_array(F.col(text), size, overlap))
    total = F.size("_chunks").cast("string")
    rows = pieces.withColumn("_total", total).select("*", F.posexplode("_chunks").alias("_i", "_c"))
    meta = F.create_map(F.lit("total_chunks"), F.col("_total"))
    return _entry(rows, F.col("_c"), "chunk", F.col("_i"), _hash(described), meta)


def text_entries(described: DataFrame, text: str = "text") -> DataFrame:
    """Legacy variant: smaller chunks, source always desktop, only text file types."""
    mine = described.filter(F.col("extension").isin(fv.TEXT_EXTENSIONS)).withColumn("source", F.lit("desktop"))
    return file_entries(mine).unionByName(
        chunk_entries(mine, text, fv.LEGACY_CHUNK_SIZE, fv.LEGACY_CHUNK_OVERLAP)
    )


def image_entries(described: DataFrame) -> DataFrame:
    mine = described.filter(F.col("extension").isin(fv.IMAGE_EXTENSIONS)).withColumn("source", F.lit("photos"))
    title = F.translate(P.stem(F.col("file_name")), "_-", "  ")
    text = F.concat("file_name", F.lit(" - Photo. Image named "), title)
    meta = F.create_map(F.lit("extension"), F.col("extension"))
    return _entry(mine, text, "file", F.lit(None), _hash(mine), meta)


def memory_entries(facts: DataFrame, content: str = "content", origin: str = "source") -> DataFrame:
    """Facts of a memory table become searchable chunks without a file."""
    meta = F.create_map(F.lit("memory_source"), F.coalesce(F.nullif(F.col(origin), F.lit("")), F.lit("unknown")))
    kept = facts.filter(T.strip(F.col(content)) != "").select(
        F.col(content).alias("_text"),
        meta.alias("_meta"),
        F.lit("memory").alias("source"),
        *[F.lit(None).cast("string").alias(c) for c in _COMMON[1:]],
    )
    return _entry(kept, F.col("_text"), "chunk", F.lit(None), F.lit(None), F.col("_meta"))


def photo_entries(photos: DataFrame, home: str) -> DataFrame:
    """Photo rows as searchable file entries, described in words."""
    from quarry.operators.photos import photo_text

    rows = photos.withColumns(
        {"folder": P.relative_folder(F.col("file_path"), home), "source": F.lit("photos"), "_text": photo_text()}
    )
    meta = F.create_map(F.lit("uuid"), F.col("uuid"))
    return _entry(rows, F.col("_text"), "file", F.lit(None), F.lit(None), meta)
