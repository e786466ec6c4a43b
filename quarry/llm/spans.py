"""Words and lines of UTF-8 bytes as arrays: where they lie and 64-bit hashes of them, without a Python loop per word.

A span's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then mixed. Upper-case A-Z hash like
a-z. Two different spans share a hash with a probability of about 2**-64; operators that need more compare the bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def _random_table() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


_VALUES = _random_table()
#: Values that tell upper-case letters from lower-case ones.
CASED = _VALUES.copy()
CASED[65:91] = np.random.default_rng(20240301).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, _PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words between blanks.
NOT_BLANK = ~BLANK
#: Words of digits, letters and all code points beyond ASCII, for lower-cased text (A-Z count as letters).
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` bytes; a run never crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    begin, end = offsets[:-1], offsets[1:]
    filled = end > begin
    first[begin[filled]] = mask[begin[filled]]
    last[end[filled] - 1] = mask[end[filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines of each row, cut at line feeds; an empty row has one empty line."""
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    if len(rows):
        is_last = np.append(rows[1:] != rows[:-1], True)
        ends[is_last] = offsets[rows[is_last] + 1]
    return starts, ends, rows


def strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without blanks at both ends."""
    solid = np.flatnonzero(NOT_BLANK[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    empty = low == high
    if not len(solid):
        return starts, starts
    s = np.where(empty, starts, solid[np.minimum(low, len(solid) - 1)])
    e = np.where(empty, starts, solid[np.maximum(high, 1) - 1] + 1)
    return s, e


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """64-bit hashes of ascending spans that do not overlap; with ``CASED``, A-Z differ from a-z."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + _PIECE, "right")), i + 1)
        stop = int(ends[j - 1])
        up, down = _powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(values[data[base:stop]] * up[:stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``n`` words of a row; a row with fewer words has one run of all its words."""
    if not len(word_hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(word_hashes), np.uint64)
    counts = np.bincount(rows)
    position = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    left = counts[rows] - position
    for k in range(n):
        has = left > k
        value = np.zeros(len(out), np.uint64)
        value[has] = word_hashes[np.flatnonzero(has) + k]
        out = out * np.uint64(_BASE) + value
    keep = (left >= n) | (position == 0)
    return mix(out[keep]), rows[keep]
