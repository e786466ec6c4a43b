"""Helpers shared by the operators of this subpackage: Arrow batches, row keys, components, broadcasts."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import bounded_batches, discard, materialize

#: Rows of one Arrow batch are worked on in runs of about this many text bytes, which bounds a task's memory.
RUN_BYTES = 1 << 20

_HELD: dict = {}
_TRIMMED = [0.0]


def held(key, make: Callable):
    """What ``make()`` gives, kept by a worker for its next tasks; one thing at a time, as it may be large."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """A worker gives up what an operator before kept, so that the memory is there for the one at work."""
    _HELD.clear()
    trim()


def trim(pause: float = 0.0) -> None:
    """Freed memory goes back to the system, where the C library and Arrow would keep it in each worker, idle ones too.

    Nothing is done within ``pause`` seconds of the last time.
    """
    now = time.monotonic()
    if now - _TRIMMED[0] < pause:
        return
    _TRIMMED[0] = now
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):  # glibc
        library.malloc_trim(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1)).cast("int")


def without(df: DataFrame, names) -> DataFrame:
    """Without the columns that outputs of the same name (in any case) replace."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_runs(batch: pa.RecordBatch, column: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with about ``limit`` text bytes each."""
    offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def append(df: DataFrame, column: str, fields: list[T.StructField], work: Callable, using: list[str] = (), holds: bool = False) -> DataFrame:
    """``df`` with new columns that ``work(batch)`` derives from runs of rows, as a list of Arrow arrays.

    Input columns with the same names are replaced, unless ``using`` names them as inputs, which ``work`` reads and the
    output leaves out. What workers kept before is released, except for a ``work`` that ``holds`` something itself.
    """
    names = [f.name for f in fields]
    left_out = {n.lower() for n in (*names, *using)}
    kept = [f for f in df.schema.fields if f.name.lower() not in left_out]
    schema = T.StructType(kept + fields)
    own = [f.name for f in kept]
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c in own or c in using or c == column])

    def run(batches):
        if not holds:
            release()
        for batch in batches:
            for part in text_runs(batch, column):
                if part.num_rows:
                    columns = [part.column(part.schema.get_field_index(c)) for c in own]
                    yield pa.RecordBatch.from_arrays(columns + list(work(part)), own + names)
        trim()

    return source.mapInArrow(run, schema)


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Connected components of links as (node, component_id): the smallest id reachable; nodes without links are absent.

    Alternates two star contractions until no link moves. Each round is a written table in the shared folder; a node with
    very many links only takes part in a minimum, which is combined before the shuffle, and in a join that adaptive
    execution splits.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).where("a < b").distinct(), "links")
    state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = materialize(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        before, now = now, materialize(small.where("a < b").distinct(), "small")
        discard(before, large)
        after = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(after) == tuple(state):
            break
        state = after
    if not state[0]:
        return spark.createDataFrame([], "node long, component_id long")
    found = now.select(F.col("b").alias("node"), F.col("a").alias("component_id"))
    roots = found.select(F.col("component_id").alias("node"), "component_id").distinct()
    return found.unionByName(roots)


def local_forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest of links between positions 0..n-1: (k, 2) of those that joined two trees."""
    parent = list(range(n))
    kept = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)
