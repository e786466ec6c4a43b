"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all windows of the training texts.

Words are runs of ASCII letters, digits and all code points beyond ASCII, A-Z lower-cased. A window is ``n`` consecutive
words of a test item; an item with fewer words, but not none, is one shorter window. Every text is scanned whole: the hash
of each run of words, for each window length in use, is looked up in the set, and each hit is verified word by word.

The set is broadcast in blocks of at most ``max_windows`` windows, one scan for each block, so its size is bounded whatever
the benchmark's. One block is enough for any benchmark of usual size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, spans

_PIECE = 1 << 17


def _gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    total = len(word_hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(total, np.uint64)
    for a in range(0, total, _PIECE):
        b = min(a + _PIECE, total)
        part = word_hashes[a:b + n - 1]
        up, down = spans._powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        out[a:b] = spans.mix((sums[n:] - sums[:-n]) * down[:b - a])
    return out


class _Windows:
    """The windows of one block of items: hashes per length, words and items of each."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        found: dict[tuple, set] = {}
        for item, text in items:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            s, e, _ = spans.words(data, np.array([0, len(raw)]), spans.ALNUM)
            tokens = [raw[a:b].lower() for a, b in zip(s.tolist(), e.tolist())]
            size = min(n, len(tokens))
            for i in range(len(tokens) - size + 1 if tokens else 0):
                found.setdefault(tuple(tokens[i:i + size]), set()).add(item)
        self.lengths: dict[int, tuple] = {}
        for size in sorted({len(w) for w in found}):
            mine = [w for w in found if len(w) == size]
            raw = b" ".join(b" ".join(w) for w in mine)
            s, e, _ = spans.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), spans.ALNUM)
            keys = _gram_hashes(spans.hashes(np.frombuffer(raw, np.uint8), s, e), size)[::size]
            marks = np.zeros(1 << 20, bool)
            marks[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            table: dict[int, list] = {}
            for key, w in zip(keys.tolist(), mine):
                table.setdefault(key, []).append((b" ".join(w), tuple(found[w])))
            self.lengths[size] = (marks, table)

    def hits(self, raw: bytes, hashes: np.ndarray, rows: np.ndarray, s: np.ndarray, e: np.ndarray):
        """First word, last word + 1 and items of each verified occurrence."""
        for size, (marks, table) in self.lengths.items():
            grams = _gram_hashes(hashes, size)
            for i in np.flatnonzero(marks[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]).tolist():
                if rows[i] == rows[i + size - 1] and (entries := table.get(int(grams[i]))):
                    text = b" ".join(raw[a:b] for a, b in zip(s[i:i + size].tolist(), e[i:i + size].tolist())).lower()
                    for words, items in entries:
                        if words == text:
                            yield i, i + size, items


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, column: str = "text", item_column: str = "item_id",
               item_text: str = "text", max_windows: int = 1 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``leaked_items`` (distinct ids as sorted strings) and ``leak_spans``.

    ``leak_spans`` holds [from, to) byte positions in the UTF-8 text of the runs of hit words. Null texts have no words;
    items with null text or no words have no windows; windows of an item with null id hit but name no item. Repeated
    items count once. An empty benchmark hits nothing. Columns named like the outputs are replaced.
    """
    spark = docs.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("leaked_items", T.ArrayType(T.StringType())), T.StructField("leak_spans", T.ArrayType(T.LongType()))]
    out = common.without(docs, [f.name for f in fields]).withColumn(column, F.col(f"`{column}`").cast("string"))
    items = benchmark.select(F.col(f"`{item_column}`").cast("string"), F.col(f"`{item_text}`").cast("string")).where(f"`{item_text}` is not null")

    def scan(block, first):
        def work(part):
            index = part.schema.get_field_index
            data, offsets = common.text_bytes(part.column(index(column)))
            raw = data.tobytes()
            s, e, rows = spans.words(data, offsets, spans.ALNUM)
            n_rows = part.num_rows
            found: list[set] = [set() for _ in range(n_rows)]
            ends = np.zeros(len(s) + 1, np.int64)
            for a, b, ids in block.value.hits(raw, spans.hashes(data, s, e), rows, s, e):
                ends[a] += 1
                ends[b] -= 1
                found[rows[a]].update(i for i in ids if i is not None)
            hit = np.cumsum(ends[:-1]) > 0
            if not first:  # words found with earlier blocks of the benchmark
                for r, (old_items, old_spans) in enumerate(zip(part.column(index("leaked_items")).to_pylist(), part.column(index("leak_spans")).to_pylist())):
                    found[r].update(old_items)
                    for a, b in zip(old_spans[::2], old_spans[1::2]):
                        hit[np.searchsorted(s, a + offsets[r]):np.searchsorted(s, b + offsets[r])] = True
            runs: list[list[int]] = [[] for _ in range(n_rows)]
            at = np.flatnonzero(hit)
            for k in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(rows[at]) > 0)) + 1):
                if len(k):
                    r = rows[k[0]]
                    runs[r] += [int(s[k[0]] - offsets[r]), int(e[k[-1]] - offsets[r])]
            return [pa.array(np.bincount(rows, minlength=n_rows), pa.int64()), pa.array(np.bincount(rows[at], minlength=n_rows), pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))]
        return work

    blocks, block, size = [], [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += text.count(" ") + 1
        if size >= max_windows:
            blocks.append(_Windows(block, n))
            block, size = [], 0
    for k, windows in enumerate([*blocks, _Windows(block, n)]):
        using = [f.name for f in fields] if k else []
        out = common.append(out, column, fields, scan(spark.sparkContext.broadcast(windows), not k), using)
    return out


def remove_leaks(found: DataFrame, whole_documents: bool = True, column: str = "text") -> DataFrame:
    """Decisions on the rows of ``find_leaks``: without hit documents, or with the hit spans cut out of their texts."""
    if whole_documents:
        return found.where("n_hit = 0")
    fields = [f for f in found.schema.fields if f.name == column]

    def work(part):
        texts = part.column(part.schema.get_field_index(column)).to_pylist()
        cuts = part.column(part.schema.get_field_index("leak_spans")).to_pylist()
        out = []
        for text, cut in zip(texts, cuts):
            if cut:
                raw, at, kept = text.encode(), 0, []
                for a, b in zip(cut[::2], cut[1::2]):
                    kept.append(raw[at:a])
                    at = b
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return [pa.array(out, pa.string())]

    order = found.columns
    return common.append(found, column, fields, work, using=[column]).select(*[F.col(f"`{c}`") for c in order])
