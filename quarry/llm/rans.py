"""Token ids in files coded by a static range asymmetric numeral system.

A file is a run of sections. A section has one frequency table, shared by its blocks, and blocks of up to ``BLOCK`` ids that
decode independently: ids are dealt over ``LANES`` interleaved 64-bit states that give out 32-bit words. Each block carries
its final states, the checksum of its ids and checkpoints: which documents lie in it, with how many ids.

    record  = kind (1 byte, T or B), length of the body (8 bytes), body, line feed
    T body  = n (4), n symbols (4 each), n frequencies (4 each), which sum to 2**SCALE
    B body  = ids (4), words (4), documents (4), crc32 of the ids as 32-bit integers (4), lanes' states (8 each), words (4
              each), then per document: id (8), ids in this block (8), flags (1: 1 ends here, 2 id is null)

Numbers are little-endian. Files are written by Spark's own committer, in ascending order of document ids over the names
of the files; a lost task writes its file again.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.byte_bpe import WordMemo, text_ids
from quarry.session import materialize

SCALE = 20
LANES = 1024
BLOCK = 1 << 18
#: Ids of a section, which bounds a writer's memory.
SECTION = 1 << 21
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for each symbol that occurs."""
    total = 1 << SCALE
    used = np.flatnonzero(counts)
    if not len(used):
        return counts.astype(np.int64)
    if len(used) > total:
        raise ValueError("more symbols than the table can tell apart")
    out = np.zeros(len(counts), np.int64)
    out[used] = np.maximum(1, counts[used] * (total / counts.sum())).astype(np.int64)
    extra = total - int(out.sum())
    order = used[np.argsort(-out[used], kind="stable")]
    if extra >= 0:
        out[order[0]] += extra
    else:  # taken from the most frequent, which stay above zero
        for i in order:
            cut = min(-extra, int(out[i]) - 1)
            out[i] -= cut
            extra += cut
            if not extra:
                break
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of a block; ids are dealt over the lanes in turn and coded from the last to the first."""
    states = np.full(LANES, _LOW, np.uint64)
    f, s = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    limit = f << np.uint64(31 - SCALE + 32)
    words = []
    for at in range((len(ids) - 1) // LANES * LANES if len(ids) else -1, -1, -LANES):
        stop = min(at + LANES, len(ids))
        x = states[:stop - at]
        full = x >= limit[at:stop]
        if full.any():
            words.append((x[full] & _MASK).astype(np.uint32))
            x[full] >>= _WORD
        fs = f[at:stop]
        q = x // fs
        x[:] = (q << np.uint64(SCALE)) + (x - q * fs) + s[at:stop]
    return states, np.concatenate([np.zeros(0, np.uint32), *words[::-1]])


def decode_block(n: int, states: np.ndarray, words: np.ndarray, symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The ids of a block; ``slots`` maps a slot of the table to the place of its symbol."""
    states, out, at = states.copy(), np.empty(n, np.int64), 0
    low = np.uint64((1 << SCALE) - 1)
    for i in range(0, n, LANES):
        stop = min(i + LANES, n)
        x = states[:stop - i]
        slot = x & low
        k = slots[slot.astype(np.int64)]
        out[i:stop] = k
        x[:] = freq[k] * (x >> np.uint64(SCALE)) + slot - start[k]
        empty = x < _LOW
        m = int(np.count_nonzero(empty))
        if m:
            x[empty] = (x[empty] << _WORD) | words[at:at + m]
            at += m
    return symbols[out]


def _record(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<Q", len(body)) + body


def write_section(documents: list[tuple[int | None, np.ndarray, bool]]):
    """Records of one section; documents are (id, ids, whether they end here), and may go on in the next section."""
    ids = np.concatenate([x[1] for x in documents]).astype(np.int64)
    counts = np.bincount(ids)
    freq = frequencies(counts)
    start = np.cumsum(freq) - freq
    used = np.flatnonzero(freq)
    yield _record(b"T", struct.pack("<I", len(used)) + used.astype("<u4").tobytes() + freq[used].astype("<u4").tobytes())
    doc, done = 0, 0
    for a in range(0, len(ids), BLOCK):
        block = ids[a:a + BLOCK]
        states, words = encode_block(block, freq, start)
        left, points = len(block), []
        while left:
            name, own, ends = documents[doc]
            n = min(left, len(own) - done)
            done, left = done + n, left - n
            last = done == len(own)
            points.append(struct.pack("<qQB", name or 0, n, (1 if last and ends else 0) | (2 if name is None else 0)))
            if last:
                doc, done = doc + 1, 0
        yield _record(b"B", struct.pack("<4I", len(block), len(words), len(points), zlib.crc32(block.astype("<u4").tobytes()))
                      + states.astype("<u8").tobytes() + words.astype("<u4").tobytes() + b"".join(points))


def read_file(raw) -> "Iterator[tuple[int | None, np.ndarray, bool]]":  # noqa: F821
    """Parts of documents in the order of the file: (id, ids, whether the document ends). Wrong checksums are errors."""
    at, table = 0, None
    while at < len(raw):
        kind, size = bytes(raw[at:at + 1]), struct.unpack_from("<Q", raw, at + 1)[0]
        body = memoryview(raw)[at + 9:at + 9 + size]
        if len(body) < size:
            raise ValueError("a record is cut short")
        at += 10 + size
        if kind == b"T":
            n = struct.unpack_from("<I", body)[0]
            symbols, freq = (np.frombuffer(body, "<u4", n, 4 + 4 * n * k).astype(np.int64) for k in (0, 1))
            start = np.cumsum(freq) - freq
            table = symbols, freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(n), freq)
            continue
        if kind != b"B" or table is None:
            raise ValueError("not a token file")
        n, n_words, n_docs, crc = struct.unpack_from("<4I", body)
        states = np.frombuffer(body, "<u8", LANES, 16)
        words = np.frombuffer(body, "<u4", n_words, 16 + 8 * LANES).astype(np.uint64)
        ids = decode_block(n, states, words, *table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        place = 0
        for name, count, flags in struct.iter_unpack("<qQB", body[16 + 8 * LANES + 4 * n_words:]):
            yield (None if flags & 2 else name), ids[place:place + count], bool(flags & 1)
            place += count


class WordEncoder:
    """A tokenizer of the tokenizers library that encodes each distinct word once, while it is remembered.

    Words are cut before a single space between solid characters, where byte-level tokenizers always cut too; a tokenizer
    for which that doesn't hold takes whole texts (``by_word`` false).
    """

    def __init__(self, definition: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(definition), by_word
        self.memo = WordMemo()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[k:k + 4096], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and the offsets of each text's."""
        if self.by_word:
            return text_ids(*common.text_bytes(texts), self.memo, self._encode)
        ids = [np.array(x, np.uint32) for x in self._encode([t or "" for t in texts.to_pylist()])]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])


def _encoder(definition: str, by_word: bool) -> WordEncoder:
    """A worker keeps its encoder, so that the words it remembers serve its next tasks."""
    return common.held(("token files", hash(definition), by_word), lambda: WordEncoder(definition, by_word))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int, by_word: bool = True, column: str = "text", id_column: str = "doc_id") -> None:
    """Encode each whole text, append ``end`` and write all ids in ascending order of document ids (null first).

    ``tokenizer`` is the path of a definition file on the driver. Null texts count as empty and have the end id only.
    Repeated ids are documents of their own. An empty table gives a folder without ids.
    """
    with open(tokenizer) as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def code(batches):
        coder = _encoder(definition.value, by_word)
        section: list[tuple[int | None, np.ndarray, bool]] = []
        size = 0
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                flat, ends = coder.encode(part.column(1))
                flat = np.insert(flat, ends[1:], np.uint32(end))
                ends = (ends + np.arange(len(ends))).tolist()
                for name, a, b in zip(part.column(0).to_pylist(), ends, ends[1:]):
                    ids = flat[a:b]
                    while size + len(ids) >= SECTION:
                        cut = SECTION - size
                        section.append((name, ids[:cut], cut == len(ids)))
                        yield from batches_of(write_section(section))
                        section, size, ids = [], 0, ids[cut:]
                    if len(ids):
                        section.append((name, ids, True))
                        size += len(ids)
        if section:
            yield from batches_of(write_section(section))

    def batches_of(records):
        for record in records:
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    ordered = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    records = ordered.mapInArrow(code, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``ids``."""

    def documents(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                at, n, crc, parts = 0, 0, 0, []
                for doc, ids, ends in read_file(content.as_buffer()):
                    n += len(ids)
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    if with_ids:
                        parts.append(ids)
                    if ends:
                        rows.append((name, at, doc, n, crc, np.concatenate(parts) if parts else None))
                        at, n, crc, parts = at + n, 0, 0, []
                    if len(rows) >= 2000:
                        yield out(rows)
                        rows = []
                yield out(rows)

    def out(rows):
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                                          ["file", "at", "doc_id", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    parts = files.mapInArrow(documents, "file string, at long, doc_id long, n_tokens long, ids_crc32 long, ids array<int>")
    parts = materialize(parts if with_ids else parts.drop("ids"), "token-files")
    totals = parts.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    out_columns = ["doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return parts.join(before, "file").select(*out_columns)
