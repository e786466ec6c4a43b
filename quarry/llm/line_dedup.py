"""Line dedup with two Bloom filters: lines seen once and lines seen twice.

1. Every task fills a once-seen and a twice-seen filter with the keys of its lines. The filters of all tasks are merged
   per segment of bits on the executors: a bit that is new twice moves on to the twice-seen filter.
2. A line whose key is not in the merged twice-seen filter occurs in one document only and never leaves its task. Only
   suspected repeats are counted, exactly, by a 128-bit key, combined within each batch before the shuffle.
3. Keys found in ``min_docs`` documents or more lose their lines, in all documents or in all but the first.

The filters have a fixed size (``filter_bits``, taken from the size of the input up to 2**30 bits), so what is broadcast is
bounded. When far more lines than bits arrive, more lines are suspected and shuffled; the result stays exact. The table of
repeated keys reaches the tasks by broadcast while it has at most ``max_broadcast_keys`` rows and by joins beyond that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, spans
from quarry.session import materialize

SEGMENT = 1 << 13
PROBES = 3


def _line_keys(data, offsets):
    """Starts, ends, rows, first and second hash of all lines, and whether their key has a code point."""
    starts, ends, rows = spans.lines(data, offsets)
    s, e = spans.strip(data, starts, ends)
    first = spans.hashes(data, s, e)
    second = spans.mix(first + spans.hashes(data[::-1], (len(data) - e)[::-1], (len(data) - s)[::-1])[::-1])
    return starts, ends, rows, first, second, e > s


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    step = spans.mix(keys + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([((keys + np.uint64(i) * step) & mask).astype(np.int64) for i in range(PROBES)])


def _holds(filter_bytes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return ((filter_bytes[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1).all(axis=0)


def _put(filter_bytes: np.ndarray, positions: np.ndarray) -> None:
    flat = positions.ravel()
    np.bitwise_or.at(filter_bytes, flat >> 3, np.left_shift(np.uint8(1), (flat & 7).astype(np.uint8)))


def _filter_bits(df: DataFrame) -> int:
    """A power of two near two bits for a byte of stored input: many for each line, 2**20 at least, 2**30 at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(30, max(20, math.ceil(math.log2(max(1, size) / 4))))


def twice_seen(df: DataFrame, column: str = "text", filter_bits: int | None = None) -> np.ndarray:
    """The merged filter of line keys found in more than one document, as packed bytes."""
    bits = filter_bits or _filter_bits(df)

    def fill(batches):
        common.release()
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for part in common.text_runs(batch, column):
                data, offsets = common.text_bytes(part.column(0))
                _, _, rows, first, _, filled = _line_keys(data, offsets)
                pairs = np.unique(np.stack([first[filled], rows[filled].astype(np.uint64)]), axis=1)[0]
                keys, counts = np.unique(pairs, return_counts=True)
                at = _positions(keys, bits)
                again = _holds(once, at) | (counts > 1)
                _put(twice, at[:, again])
                _put(once, at)
        filled = [i for i in range(0, bits >> 3, SEGMENT) if once[i:i + SEGMENT].any()]
        for k in range(0, len(filled), 512):
            some = filled[k:k + 512]
            yield pa.RecordBatch.from_arrays([
                pa.array([i // SEGMENT for i in some], pa.int32()),
                pa.array([once[i:i + SEGMENT].tobytes() for i in some], pa.binary()),
                pa.array([twice[i:i + SEGMENT].tobytes() for i in some], pa.binary())], ["segment", "once", "twice"])

    def merge(key, batches):
        once = twice = None
        for batch in batches:
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                         ["segment", "twice"])

    parts = df.select(F.col(f"`{column}`").cast("string").alias(column)).mapInArrow(fill, "segment int, once binary, twice binary")
    # rows of a group come in batches, so a segment's parts from any number of tasks never lie in memory together
    merged = parts.groupBy("segment").applyInArrow(_as_iterator(merge), "segment int, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    found = merged.toArrow()  # as many bytes as the filter has
    for segment, part in zip(found["segment"].to_pylist(), found["twice"]):
        out[segment * SEGMENT:(segment + 1) * SEGMENT] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def _as_iterator(merge):
    from collections.abc import Iterator

    def grouped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge(key, batches)

    grouped.__annotations__ = {
        "key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return grouped


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, column: str = "text", id_column: str = "doc_id",
                   filter_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, suspects): exact keys (h1, h2, n_docs, first_id) in ``min_docs`` documents or more, and all suspected rows.

    Every row is a document, rows with equal ids too; a null text has one empty line. ``first_id`` is the smallest id.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(twice_seen(docs, column, filter_bits))

    def suspects(batches):
        common.release()
        seen = bits.value
        for batch in batches:
            for part in common.text_runs(batch, column):
                data, offsets = common.text_bytes(part.column(1))
                starts, ends, rows, first, second, filled = _line_keys(data, offsets)
                if min_chars > 1:
                    s, e = spans.strip(data, starts, ends)
                    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    filled &= heads[e] - heads[s] >= min_chars
                hit = filled.copy()
                hit[filled] = _holds(seen, _positions(first[filled], len(seen) * 8))
                found = pd.DataFrame({"h1": first[hit].view(np.int64), "h2": second[hit].view(np.int64), "row": rows[hit]}).drop_duplicates()
                ids = part.column(0).take(pa.array(found["row"].to_numpy(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(found["h1"].to_numpy()), pa.array(found["h2"].to_numpy()), ids], ["h1", "h2", "id"])

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").cast("string").alias(column))
    rows = source.mapInArrow(suspects, f"h1 long, h2 long, id {kind}")
    counted = rows.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"))
    return counted.where(F.col("n_docs") >= min_docs), rows


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, column: str = "text",
                        id_column: str = "doc_id", filter_bits: int | None = None, max_broadcast_keys: int = 1 << 21) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; the other lines stay, joined by line feeds.

    With ``keep_first`` the document with the smallest id keeps its first line of each repeated key. A null or empty text
    has one empty line, which has no key and stays. Input columns named like the outputs are replaced. No rows give no
    rows. Ids may be null or repeated: keys decide, not ids, except for ``keep_first``.
    """
    keys, suspects = repeated_lines(docs, min_docs, min_chars, column, id_column, filter_bits)
    keys = materialize(keys, "line-keys")
    fields = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    docs = common.without(docs, [f.name for f in fields]).withColumn(column, F.col(f"`{column}`").cast("string"))

    def work(part, gone, keepers):
        data, offsets = common.text_bytes(part.column(part.schema.get_field_index(column)))
        starts, ends, rows, first, second, filled = _line_keys(data, offsets)
        drop = gone(part, rows, first, second) & filled
        if keep_first and drop.any():
            at = np.flatnonzero(drop)
            mine = at[keepers(part, rows[at], first[at], second[at])]
            _, heads = np.unique(np.stack([rows[mine].astype(np.uint64), first[mine], second[mine]]), axis=1, return_index=True)
            drop[mine[heads]] = False
        n = len(offsets) - 1
        lost = np.bincount(rows, drop, n).astype(np.int64)
        total = np.bincount(rows, minlength=n)
        raw = data.tobytes()
        bounds = np.concatenate([[0], np.cumsum(total)])
        texts = []
        for i in range(n):
            if lost[i]:
                mine = np.arange(bounds[i], bounds[i + 1])
                mine = mine[~drop[mine]]
                texts.append(b"\n".join(raw[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist())))
            else:
                texts.append(raw[offsets[i]:offsets[i + 1]])
        return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]

    if keys.count() <= max_broadcast_keys:
        found = keys.select("h1", "h2", "first_id").toArrow()
        pairs = np.stack([found["h1"].to_numpy(), found["h2"].to_numpy()], 1).astype(np.int64).view(np.uint64) if found.num_rows else np.zeros((0, 2), np.uint64)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, firsts = pairs[order], found["first_id"].take(pa.array(order))
        shared = docs.sparkSession.sparkContext.broadcast((pairs, firsts.to_pylist() if keep_first else None))

        def lookup(first, second):
            table = shared.value[0]
            if not len(table):
                return np.zeros(len(first), np.int64), np.zeros(len(first), bool)
            low = np.searchsorted(table[:, 0], first)
            found = np.zeros(len(first), bool)
            at = np.minimum(low, len(table) - 1)
            for _ in range(int(np.unique(table[:, 0], return_counts=True)[1].max())):  # nearly always one
                same = (table[at, 0] == first) & (table[at, 1] == second)
                low = np.where(same, at, low)
                found |= same
                at = np.minimum(at + 1, len(table) - 1)
            return low, found

        def gone(part, rows, first, second):
            return lookup(first, second)[1]

        def keepers(part, rows, first, second):
            ids = part.column(part.schema.get_field_index(id_column)).to_pylist()
            at, _ = lookup(first, second)
            return np.array([shared.value[1][k] == ids[r] for k, r in zip(at.tolist(), rows.tolist())], bool)

        return common.append(docs, column, fields, lambda part: work(part, gone, keepers))

    # each document meets its own repeated keys; a key in very many documents is split by the adaptive skew join
    mine = suspects.join(keys.select("h1", "h2", "first_id"), ["h1", "h2"]).groupBy("id").agg(
        F.collect_set(F.struct("h1", "h2", F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)).alias("own"))).alias("_drop"))
    joined = docs.join(mine.withColumnRenamed("id", "_id"), F.col(f"`{id_column}`").eqNullSafe(F.col("_id")), "left").drop("_id")

    def listed(part, rows, first, second, own):
        lists = part.column(part.schema.get_field_index("_drop")).to_pylist()
        sets = [{(x["h1"], x["h2"]) for x in (entry or ()) if x["own"] or not own} for entry in lists]
        a, b = first.view(np.int64).tolist(), second.view(np.int64).tolist()
        return np.array([bool(sets[r]) and (x, y) in sets[r] for r, x, y in zip(rows.tolist(), a, b)], bool)

    return common.append(joined, column, fields, lambda part: work(
        part, lambda p, r, f, s: listed(p, r, f, s, False), lambda p, r, f, s: listed(p, r, f, s, True)), using=["_drop"])
