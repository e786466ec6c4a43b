"""Fill-in-the-middle examples: a text is cut at two places between units and its parts are put in another order.

A unit is a run of ASCII letters or any other single code point. The bytes of a text are cut into blocks of fixed size; a
Fenwick tree over a text's blocks holds how many units begin and how many code points lie in them. A cut after so many
units is found by binary lifting: the descent skips whole blocks while their units fit, adding up code points on its way,
and ends at the block where the wanted unit begins; only that block is searched. Trees of all texts of a run are built and
descended together as arrays.

A null text is an empty one and stays plain. A null id is hashed as empty digits. Repeated rows give equal rows, an empty
table gives an empty one, and columns named like an output are replaced. Texts of any length are taken whole; besides the
text itself a task holds a few bytes a byte of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm import common, spans

#: Bytes of a block.
BLOCK = 256
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_LETTER = spans.byte_class((0x41, 0x5A), (0x61, 0x7A))
_BEGINS = ~spans.byte_class((0x80, 0xBF))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin and where code points begin in the bytes of all rows."""
    letter, point = _LETTER[data], _BEGINS[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    begin = offsets[:-1][offsets[1:] > offsets[:-1]]
    unit[begin] = point[begin]
    return unit, point


class BlockTrees:
    """Fenwick trees over the blocks of every row: ``units`` and ``points``, one after the other in flat arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = BLOCK):
        self.size, self.offsets = size, offsets
        self.unit, self.point = unit_starts(data, offsets)
        self.blocks = -(-(offsets[1:] - offsets[:-1]) // size)
        self.base = np.cumsum(self.blocks) - self.blocks
        row = np.repeat(np.arange(len(self.blocks)), self.blocks)
        within = np.arange(len(row)) - self.base[row]
        begins = offsets[row] + within * size
        self.units = self._tree(self.unit, begins, row, within)
        self.points = self._tree(self.point, begins, row, within)

    def _tree(self, marks: np.ndarray, begins: np.ndarray, row: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Node i (from 1) of a row holds the sum over the blocks i - lowest bit of i + 1 to i."""
        if not len(begins):
            return np.zeros(0, np.int64)
        counts = np.add.reduceat(marks.view(np.uint8), begins, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(counts)])
        node = within + 1
        return sums[self.base[row] + node] - sums[self.base[row] + node - (node & -node)]

    def total_units(self) -> np.ndarray:
        """Units of each row, by walking down from its last block."""
        total, at = np.zeros(len(self.blocks), np.int64), self.blocks.copy()
        while (on := at > 0).any():
            total[on] += self.units[self.base[on] + at[on] - 1]
            at[on] -= at[on] & -at[on]
        return total

    def cut(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset within the row and code points before it of the place after ``after`` units of each row."""
        left, points, at = after.astype(np.int64), np.zeros(len(after), np.int64), np.zeros(len(after), np.int64)
        step = 1 << int(self.blocks.max(initial=0)).bit_length() >> 1
        while step:
            inside = np.flatnonzero(at + step <= self.blocks)
            node = self.base[inside] + at[inside] + step - 1
            fits = self.units[node] <= left[inside]
            go, node = inside[fits], node[fits]
            left[go] -= self.units[node]
            points[go] += self.points[node]
            at[go] += step
            step >>= 1
        begin = np.minimum(self.offsets[:-1] + at * self.size, self.offsets[1:])
        for i in np.flatnonzero(at < self.blocks):
            block = slice(begin[i], min(begin[i] + self.size, self.offsets[i + 1]))
            ahead = int(np.flatnonzero(self.unit[block])[left[i]])
            points[i] += np.count_nonzero(self.point[block][:ahead])
            begin[i] += ahead
        return begin - self.offsets[:-1], points


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row, from its id and the seed."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20, using: list[str] = ()) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``rate`` per cent of the texts are cut, ``spm_rate`` per cent of those with the suffix first (``spm``), the others with
    the prefix first (``psm``). Empty texts and texts that hold one of the marks stay ``plain``. ``using`` names inputs that
    the result leaves out.
    """
    def work(batch: pa.RecordBatch):
        names = batch.schema.names
        data, offsets = common.text_bytes(batch.column(names.index(text)))
        trees = BlockTrees(data, offsets)
        n = trees.total_units()
        drawn = np.array([draws(k, seed) for k in batch.column(names.index(key)).to_pylist()], np.int64).reshape(-1, 4)
        low, high = np.sort(drawn[:, :2] % (n[:, None] + 1), axis=1).T
        a, a_points = trees.cut(low)
        b, b_points = trees.cut(high)
        forms, outputs = [], []
        raw = data.tobytes()
        for i in range(len(n)):
            whole = raw[offsets[i]:offsets[i + 1]]
            if not whole or drawn[i, 2] % 100 >= rate or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                outputs.append(whole)
                continue
            prefix, middle, suffix = whole[:a[i]], whole[a[i]:b[i]], whole[b[i]:]
            first = drawn[i, 3] % 100 < spm_rate
            forms.append("spm" if first else "psm")
            outputs.append(b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if first else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]))
        plain = np.array([f == "plain" for f in forms], bool)
        return [
            pa.array(n), pa.array(forms, pa.string()), pa.array(a_points, mask=plain), pa.array(b_points - a_points, mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string())]

    return common.append(docs, text, _FIELDS, work, using)


def original(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "psm":
        prefix, rest = output[len(PREFIX):].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    elif form == "spm":
        suffix, rest = output[len(SUFFIX):].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    else:
        return output
    return prefix + middle + suffix


def restore(examples: DataFrame) -> DataFrame:
    """``examples`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone; a null form counts as plain."""
    def work(batch: pa.RecordBatch):
        names = batch.schema.names
        data, offsets = common.text_bytes(batch.column(names.index("output")))
        forms, raw = batch.column(names.index("form")).to_pylist(), data.tobytes()
        texts = [original(raw[offsets[i]:offsets[i + 1]], form) for i, form in enumerate(forms)]
        return [pa.array(texts, pa.binary()).cast(pa.string())]

    return common.append(examples, "output", [T.StructField("restored", T.StringType())], work)
