"""Files on disk as DataFrames.

Listing and reading run in tasks over paths the executors can reach (a mounted
or shared file system).  Dot-files have to be seen, because cloud placeholders
are dot-files, which the built-in binary reader hides.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import paths as P
from quarry.functions import templates as M
from quarry.functions import text as T
from quarry.session import bounded_batches, materialize

_LISTING = "path string, name string, size bigint, mtime timestamp, is_dir boolean, pending boolean, error_type string"
#: Entries that a task lists before it hands the folders that are left to the next round, and rows or bytes of one frame.
WALK, FRAME_ROWS, FRAME_BYTES = 20_000, 4_096, 8 << 20


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries below the folders; symbolic links are not followed, what cannot be listed becomes an error row.

    A task goes down until it has listed ``WALK`` entries; folders that are left come out as pending rows.
    """
    rows: list[tuple] = []
    listed = 0
    for batch in batches:
        stack = list(batch["path"])
        while stack:
            folder = stack.pop()
            if listed >= WALK:
                rows.append((folder, os.path.basename(folder), 0, None, True, True, None))
            else:
                entries = _entries(folder)
                while (row := next(entries, None)) is not None:
                    listed += 1
                    if row[4] and row[6] is None:
                        if not _skipped_folder(row[1]):
                            stack.append(row[0])
                    else:
                        rows.append(row)
                    if len(rows) >= FRAME_ROWS:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTING.split(", ")])
                        rows = []
            if len(rows) >= FRAME_ROWS:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTING.split(", ")])
                rows = []
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LISTING.split(", ")])


def _entries(folder: str) -> Iterator[tuple]:
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    if not is_dir and not entry.is_file(follow_symlinks=False):
                        continue
                    stat = entry.stat(follow_symlinks=False)
                    when = datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc).replace(tzinfo=None)
                    yield entry.path, entry.name, stat.st_size, when, is_dir, False, None
                except OSError as error:
                    yield entry.path, entry.name, 0, None, False, False, type(error).__name__
    except OSError as error:
        yield folder, os.path.basename(folder), 0, None, True, False, type(error).__name__


def _skipped_folder(name: str) -> bool:
    return (name.startswith(".") and not name.endswith(".icloud")) or name in fv.SKIP_DIRS


def scan_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Recursive listing below the roots: path, root, name, extension, size, mtime, is_placeholder, is_dir, error_type.

    Folders are walked in parallel, in as many rounds as it takes until none is left; skipped folders are pruned before
    they are opened. A folder that cannot be listed is one row with ``is_dir`` and ``error_type``.
    """
    folders = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "path string")
    rounds = []
    while not rounds or not folders.isEmpty():
        level = materialize(folders.repartition(F.xxhash64("path")).mapInPandas(_walk, _LISTING), "listing")
        rounds.append(level)
        folders = level.filter("pending").select("path")
    found = reduce(lambda a, b: a.unionByName(b), [r.filter("not pending") for r in rounds])
    found = found.filter(F.col("is_dir") | P.keep(F.col("name")))
    root = F.coalesce(*[F.when(F.col("path").startswith(r.rstrip("/") + "/"), r.rstrip("/")) for r in roots], F.col("path"))
    return found.select(
        "path", root.alias("root"), "name", P.extension(F.col("name")).alias("extension"), "size", "mtime",
        P.is_placeholder(F.col("name")).alias("is_placeholder"), "is_dir", "error_type",
    )


def _reader(with_content: bool):
    """Read each file in the task that holds its row: bytes and fingerprint, or the fingerprint alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for row in batch.itertuples(index=False):
                content, digest, error = None, None, row.error_type
                if error is None:
                    try:
                        with open(row.path, "rb") as handle:
                            if with_content:
                                content = handle.read()
                                digest = hashlib.sha256(content).hexdigest()
                                size += len(content)
                            else:
                                digest = hashlib.file_digest(handle, "sha256").hexdigest()
                    except OSError as problem:
                        content, digest, error = None, None, type(problem).__name__
                rows.append((content, digest, error))
                if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                    yield _read_frame(batch, rows, with_content)
                    batch, rows, size = batch.iloc[len(rows):], [], 0
            yield _read_frame(batch, rows, with_content)

    return read


def _read_frame(batch: pd.DataFrame, rows: list[tuple], with_content: bool) -> pd.DataFrame:
    out = batch.iloc[:len(rows)].copy()
    out["error_type"] = [r[2] for r in rows]
    if with_content:
        out["content"] = [r[0] for r in rows]
    out["content_hash"] = [r[1] for r in rows]
    return out


def _read(files: DataFrame, with_content: bool) -> DataFrame:
    kept = [f for f in files.schema.fields if f.name not in ("content", "content_hash")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += (", content binary" if with_content else "") + ", content_hash string"
    spread = files.select(*[f.name for f in kept]).repartition(F.xxhash64("path"))  # listing rows, before anything is read
    return spread.mapInPandas(_reader(with_content), schema)


def read_files(files: DataFrame) -> DataFrame:
    """Add ``content`` and ``content_hash``; files that cannot be read or listed keep their row with ``error_type``."""
    return _read(files, True)


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``content_hash`` only: the bytes are hashed where they are read and never leave the task."""
    return _read(files, False)


# --------------------------------------------------------------------- plug-ins

class Extractor(NamedTuple):
    """Text extraction for file types: ``extract(extension, content)`` returns text or raises."""

    extensions: frozenset[str]
    extract: Callable[[str, bytes], str]


def _run_extractors(registry: list[Extractor]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors, size = [], [], 0
            contents, batch = batch["content"], batch.drop(columns=["content"])
            for ext, content in zip(batch["extension"], contents):
                text, error = None, None
                try:
                    plug_in = next(x for x in registry if ext in x.extensions)
                    text = plug_in.extract(ext, bytes(content))
                except Exception as problem:
                    error = type(problem).__name__
                texts.append(text)
                errors.append(error)
                size += len(text or "")
                if len(texts) >= FRAME_ROWS or size >= FRAME_BYTES:
                    yield batch.iloc[:len(texts)].assign(text=texts, error_type=errors)
                    batch, texts, errors, size = batch.iloc[len(texts):], [], [], 0
            yield batch.assign(text=texts, error_type=errors)

    return run


def extract_text(files: DataFrame, extractors: Sequence[Extractor] = ()) -> DataFrame:
    """Text and first line per file; the first extractor for an extension wins.

    Plain text stays in the JVM; only file types with a plug-in pass through
    Python.  ``files``: extension, content and others.  A file without content
    keeps its row, its error and an empty text.
    """
    special = sorted({e for x in extractors for e in x.extensions})
    is_special = F.col("extension").isin(special) if special else F.lit(False)
    is_special = is_special & F.col("content").isNotNull()
    readable = files
    plain = readable.filter(~is_special).withColumn("text", T.decode_utf8(F.col("content"))).drop("content")
    if special:
        bounded_batches(files.sparkSession)
        kept = [f for f in readable.schema.fields if f.name not in ("content", "error_type", "text")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        columns = [f.name for f in kept]
        parsed = readable.filter(is_special).select(*columns, "content").mapInPandas(
            _run_extractors(list(extractors)), schema + ", text string, error_type string"
        )
        known = F.col("error_type") if "error_type" in readable.columns else F.lit(None).cast("string")
        plain = plain.select(*columns, "text", known.alias("error_type")).unionByName(parsed)
    return plain.withColumns({"text": F.coalesce("text", F.lit("")),
                              "first_line": F.coalesce(T.first_line(F.col("text")), F.lit(""))})


def classify_errors(rows: DataFrame, file: str = "path", detail: str = "error_detail") -> DataFrame:
    """Action, level and message for rows with an ``error_type``."""
    kind, none = F.col("error_type"), F.lit(None).cast("string")
    policies = [*fv.ERROR_POLICIES, (None, *fv.DEFAULT_ERROR_POLICY)]
    columns = {}
    for position, name in ((1, "action"), (2, "log_level"), (3, "template")):
        value = None
        for policy in policies[:-1]:
            value = (F.when if value is None else value.when)(kind == policy[0], policy[position])
        columns[name] = F.when(kind.isNotNull(), value.otherwise(policies[-1][position])).otherwise(none)
    out = rows.withColumns(columns)
    message = M.error_message(F.col("template"), F.col(file), F.coalesce(F.col(detail), F.lit("")))
    return out.withColumn("message", message).drop("template")
