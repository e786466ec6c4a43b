"""Index refresh: full runs, change batches, index rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.functions.embedding import Embed, hashing_embedding
from quarry.operators import entries as E
from quarry.operators import store as S
from quarry.plans.snapshot import Store
from quarry.session import discard, materialize
from quarry.sources.files import Extractor, extract_text, hash_files, read_files

DIMS = 64


DEFAULT_EMBED = hashing_embedding(DIMS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def described_files(files: DataFrame, home: str) -> DataFrame:
    """Files with identity and place, without their text; ``files``: path, mtime, content_hash or text."""
    if "content_hash" not in files.columns:
        files = files.withColumn("content_hash", T.fingerprint(F.col("text")))
    return E.describe_files(files.select("path", "mtime", "content_hash"), home)


def path_rows(described: DataFrame, now: Column) -> DataFrame:
    return described.select(
        "path", "content_hash", "file_name", "extension", "source", "folder",
        P.sync_status(F.col("file_name")).alias("sync_status"), "mtime", now.alias("last_verified"),
    )


def new_texts(flagged: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of every new content once, from its smallest path: content_hash, path, text.

    ``texts``: path, text.  Copies of a content meet here as (hash, path) pairs
    only; their texts are never shuffled to be compared.  The kept texts are
    rebalanced, because chunking and embedding are the dearest steps and input
    files may be uneven.
    """
    single = flagged.filter(~F.col("is_known")).groupBy("content_hash").agg(F.min("path").alias("path"))
    kept = texts.select("path", "text").join(single, "path").select("content_hash", "path", "text")
    return materialize(kept.hint("rebalance"), "texts")


def content_rows(texts: DataFrame, now: Column, embed: Embed = DEFAULT_EMBED) -> DataFrame:
    """One content per row of ``texts``; the text of its FILE entry is what gets embedded."""
    name = P.base_name(F.col("path"))
    label = F.concat(name, F.lit(" - "), P.type_description(P.extension(name)), F.lit(" file"))
    rows = texts.select(
        "content_hash", label.alias("_label"), T.first_line(F.col("text")).alias("first_line"),
        F.octet_length("text").cast("bigint").alias("size_bytes"), now.alias("indexed_at"),
    )
    return embed(rows, "_label").select(*_names(schemas.CONTENT))


def chunk_rows(texts: DataFrame, embed: Embed = DEFAULT_EMBED) -> DataFrame:
    pieces = texts.select("content_hash", F.posexplode(T.chunk_array(F.col("text"))).alias("chunk_index", "text"))
    return embed(pieces, "text").select(*_names(schemas.CHUNKS))


def full_refresh(
    store: Store, files: DataFrame, home: str, roots: list[str], batch_id: str, now: Column | None = None,
    embed: Embed = DEFAULT_EMBED, texts: DataFrame | None = None,
) -> DataFrame:
    """Scan result in, one committed version and a row of counters out.

    Cheap steps come first: the fingerprint decides what is new; only the texts
    of new contents are kept, chunked and embedded.  ``files``: path, mtime,
    error_type and content_hash or text; files with an error count as present
    but are not read.  ``texts`` (path, text) may name another place to take
    the texts from, for example a reader that runs for the new files only.
    """
    now = F.current_timestamp() if now is None else now
    described = described_files(files.filter(F.col("error_type").isNull()), home)
    flagged = materialize(S.flag_known(described, store.content()), "flagged")
    fresh = new_texts(flagged, files if texts is None else texts)
    gone = removed_paths(store, files, roots)
    changed = S.changed_paths(flagged, store.paths())
    version = store.commit(
        batch_id, content_rows(fresh, now, embed), path_rows(changed, now), chunk_rows(fresh, embed), removed=gone
    )
    counted = S.index_stats(flagged.withColumn("error_type", F.lit(None).cast("string"))).drop("chunks_created", "errors")
    n_chunks = store.version("chunks", version).agg(F.count("*").alias("chunks_created"))
    n_errors = files.filter(F.col("error_type").isNotNull()).agg(F.count("*").alias("errors"))
    parts = counted.unionByName(n_chunks, allowMissingColumns=True).unionByName(n_errors, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn(
        "files_scanned", F.col("files_scanned") + F.col("errors")
    )


def removed_paths(store: Store, files: DataFrame, roots: list[str]) -> DataFrame:
    """Stored paths below the roots that a scan did not meet."""
    return S.stale_paths(store.paths(), files.select("path"), roots).select("path")


def compared(stored: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """What differs between a listing and the stored paths: listed files that are new or whose modification time differs
    (``gone`` false), and stored paths below the roots that the listing does not have (``gone`` true). One join finds both.
    """
    known = stored.select(F.col("path").alias("_stored"), F.col("mtime").alias("_mtime"))
    both = listing.join(known, F.col("path") == F.col("_stored"), "full")
    touched = F.col("path").isNotNull() & F.col("error_type").isNull() & ~F.coalesce(F.col("_mtime") == F.col("mtime"), F.lit(False))
    gone = F.col("path").isNull() & S.below_roots(F.col("_stored"), roots)
    columns = [F.coalesce("path", "_stored").alias("path") if c == "path" else F.col(c) for c in listing.columns]
    return both.filter(touched | gone).select(*columns, gone.alias("gone"))


def refresh_from_disk(
    store: Store, listing: DataFrame, home: str, roots: list[str], batch_id: str, extractors: Sequence[Extractor] = (),
    now: Column | None = None, embed: Embed = DEFAULT_EMBED,
) -> dict:
    """From a listing (``scan_files``) to a committed version; returns the counters of the run.

    A cascade: files with the stored modification time are taken as unchanged and not opened; the others are hashed in
    the task that reads them; only one file of each new content is read for its text and goes through an extractor, once.
    Files and folders that cannot be read are counted and keep what is stored for them. Where nothing differs the run ends
    after the comparison; counts are observed while tables are written.
    """
    now = F.current_timestamp() if now is None else now
    failed = F.col("error_type").isNotNull()
    seen, stored = Observation(), store.paths()
    counted = listing.observe(seen, F.count_if(~F.col("is_dir")).alias("files"), F.count_if(failed).alias("failed"))
    different = materialize(compared(stored, counted, roots), "different")
    out = {"files_scanned": seen.get["files"], "files_read": 0, "files_indexed": 0, "errors": seen.get["failed"], "chunks_created": 0}
    if different.isEmpty():
        store.commit(batch_id)
        discard(different)
        return out
    gone = different.filter("gone").select("path")
    if seen.get["failed"]:  # what lies below a folder that could not be listed is not gone
        gone = S.outside(gone, listing.filter(F.col("is_dir") & failed).select("path"))
    touched = different.filter(~F.col("gone")).drop("gone")
    hashed = materialize(hash_files(touched), "hashed")
    described = described_files(hashed.filter(F.col("error_type").isNull()), home)
    flagged = materialize(S.flag_known(described, store.content()), "flagged")
    single = flagged.filter(~F.col("is_known")).groupBy("content_hash").agg(F.min("path").alias("path"))
    read = read_files(hashed.join(single.select("path"), "path", "left_semi"))
    texts = extract_text(read, extractors).select("content_hash", "path", "text", "error_type")
    texts = materialize(texts.filter(F.col("content_hash").isNotNull()).dropDuplicates(["content_hash"]), "texts")
    at_hand = texts.select("content_hash").unionByName(flagged.filter("is_known").select("content_hash")).distinct()
    rows = S.changed_paths(flagged, stored).join(at_hand, "content_hash", "left_semi")
    version = store.commit(
        batch_id, content_rows(texts, now, embed), path_rows(rows, now), chunk_rows(texts, embed),
        removed=gone,
    )
    n_read, n_unread = hashed.agg(F.count("*"), F.count_if(failed)).first()
    n_new, n_unparsed = texts.agg(F.count("*"), F.count_if(failed)).first()
    out |= {
        "files_read": n_read, "files_indexed": n_new, "errors": out["errors"] + n_unread + n_unparsed,
        "chunks_created": store.version("chunks", version).count(),
    }
    discard(different, hashed, flagged, texts)
    return out


def apply_changes(
    store: Store, changes: DataFrame, files: DataFrame, home: str, batch_id: str, now: Column | None = None,
    embed: Embed = DEFAULT_EMBED,
) -> int:
    """One change batch: deletions and move origins are removed, the rest is upserted if the file still exists.

    ``changes``: latest row per path (path, old_path, change_type);
    ``files``: path, text, mtime of files as they are now.  The work grows with
    the batch: the stored tables are neither rewritten nor shuffled.
    """
    now = F.current_timestamp() if now is None else now
    gone = changes.filter(F.col("change_type") == "deleted").select("path").unionByName(
        changes.filter(F.col("old_path").isNotNull()).select(F.col("old_path").alias("path"))
    )
    touched = changes.filter(F.col("change_type") != "deleted").select("path")
    present = files.join(touched, "path", "left_semi")
    flagged = materialize(S.flag_known(described_files(present, home), store.content(), small_batch=True), "flagged")
    fresh = new_texts(flagged, present)
    return store.commit(
        batch_id, content_rows(fresh, now, embed), path_rows(flagged, now), chunk_rows(fresh, embed),
        removed=gone.distinct(),
    )


def current_index(store: Store, include_chunks: bool = True) -> DataFrame:
    """Rows of the vector index from the current version; contents without a path fall away in the join."""
    return S.index_rows(store.content(), store.paths(), store.chunks() if include_chunks else None)


def entry_rows(entries: DataFrame, embed: Embed = DEFAULT_EMBED) -> DataFrame:
    """Entries that no stored file stands behind (photos, images, memory facts) as index rows."""
    key = F.coalesce(F.col("file_path"), F.sha2(F.col("text"), 256))
    rows = entries.select(
        F.concat_ws("#", F.col("entry_type"), "source", key).alias("row_id"), F.col("entry_type").alias("type"), "source", "file_path",
        "file_name", "folder", "chunk_index", "content_hash", "text",
    )
    return embed(rows, "text").select(*_names(schemas.INDEX_ROWS))


def whole_index(store: Store, home: str, photos: DataFrame | None = None, facts: DataFrame | None = None,
                images: DataFrame | None = None, embed: Embed = DEFAULT_EMBED) -> DataFrame:
    """One index of all sources: stored files and chunks, photo records, described image files and memory facts.

    ``photos``: photo records; ``facts``: content, source; ``images``: described files. A fact told twice is one row.
    """
    rows = current_index(store)
    parts = []
    if photos is not None:
        parts.append(E.photo_entries(photos, home))
    if images is not None:
        parts.append(E.image_entries(images))
    if facts is not None:
        parts.append(E.memory_entries(facts).dropDuplicates(["text"]))
    for part in parts:
        rows = rows.unionByName(entry_rows(part, embed))
    return rows


def write_index(rows: DataFrame, path: str) -> None:
    """Stored by type and source, so that a search filter prunes folders."""
    rows.write.mode("overwrite").partitionBy("type", "source").parquet(path)


def force_rebuild(store: Store, files: DataFrame, home: str, batch_id: str, now: Column | None = None,
                  embed: Embed = DEFAULT_EMBED) -> int:
    """Everything anew as a base version; older versions are hidden, not deleted."""
    now = F.current_timestamp() if now is None else now
    flagged = materialize(described_files(files, home).withColumn("is_known", F.lit(False)), "flagged")
    fresh = new_texts(flagged, files)
    return store.commit(
        batch_id, content_rows(fresh, now, embed), path_rows(flagged, now), chunk_rows(fresh, embed), base=True
    )
