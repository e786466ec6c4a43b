"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton and backtracking.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds every vocabulary entry in a piece in one pass. The
encoder walks from longest matches: a token may follow another one only if the merges of the two tokens' bytes give just
these two (memoised); where no match fits, it steps back and never tries that position again. A sequence whose neighbours
are all compatible is the sequence that the merges make, so results are exact, in time linear in the piece.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, spans

#: Bytes that are white space by some definition, and the code points beyond ASCII that are, as two or three bytes.
_BLANK = spans.byte_class((0x09, 0x0D), (0x1C, 0x20))
_WIDE_BLANKS = np.array([int.from_bytes(chr(c).encode(), "big") for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: Words that a worker remembers (of at most so many bytes; with fewer, the long tail is encoded again) and pairs of tokens.
MEMO = 750_000
WORD_BYTES = 64
#: Words looked up at once.
RUN_WORDS = 1 << 17
PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts start, and the place of each text's first word among them.

    Words are cut before each single space between two characters that no definition calls white space, where the pattern
    always cuts too; the space belongs to the word behind it.
    """
    at = np.flatnonzero(data == 0x20)
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[(at > offsets[row]) & (at < offsets[row + 1] - 1)]
    before, after = data[at - 1], data[at + 1]
    solid = ~(_BLANK[before] | _BLANK[after])
    for wide, way in ((before >= 0x80, -1), (after >= 0x80, 1)):
        i = np.flatnonzero(wide & solid)
        a, b, c = (data[np.clip(at[i] + way * k, 0, len(data) - 1)].astype(np.int64) for k in (1, 2, 3))
        two, three = (b << 8 | a, c << 16 | b << 8 | a) if way < 0 else (a << 8 | b, a << 16 | b << 8 | c)
        solid[i] = ~(np.isin(two, _WIDE_BLANKS) | np.isin(three, _WIDE_BLANKS))
    starts = np.sort(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], at[solid]]), kind="stable")
    return starts, np.searchsorted(starts, offsets)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from each start on, so many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _flat(values: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter(chain.from_iterable(values), np.uint32, int(sizes.sum())), sizes


class WordMemo:
    """Remembers what was made of words, as arrays: a hash table, the words' bytes and the numbers made of them.

    A word that is found is compared byte by byte. When the memo is full, the half that was asked for in the fewest runs is
    forgotten. Longer words than ``WORD_BYTES`` are not remembered.
    """

    def __init__(self, limit: int = MEMO):
        self.limit, self.count, self.mask = limit, 0, (1 << (2 * limit).bit_length()) - 1
        self.slots = np.zeros(self.mask + 1, np.int32)  # entry + 1
        self.keys = np.empty(limit, np.uint64)
        self.hits = np.zeros(limit, np.int32)
        self.words, self.word_ends = np.empty(16 * limit, np.uint8), np.zeros(limit + 1, np.int32)
        self.values, self.value_ends = np.empty(8 * limit, np.uint32), np.zeros(limit + 1, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of the keys, -1 without one."""
        found = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            entry = self.slots[slot].astype(np.int64) - 1
            here = (entry >= 0) & (self.keys[entry] == keys[left])
            found[left[here]] = entry[here]
            on = (entry >= 0) & ~here
            left, slot = left[on], (slot[on] + 1) & self.mask
        return found

    def _file(self, entries: np.ndarray) -> None:
        """Give slots to entries whose keys have none."""
        slot = (self.keys[entries] & np.uint64(self.mask)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entries[free] + 1
            on = self.slots[slot] != entries + 1
            entries, slot = entries[on], (slot[on] + 1) & self.mask

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.hits[:self.count], kind="stable")[self.count - self.count // 2:])
        self.count = len(keep)
        for ends, store in ((self.word_ends, self.words), (self.value_ends, self.values)):
            sizes = np.diff(ends)[keep]
            kept = store[_ranges(ends[keep].astype(np.int64), sizes)]
            store[:len(kept)] = kept
            ends[1:self.count + 1] = np.cumsum(sizes)
        self.keys[:self.count], self.hits[:self.count] = self.keys[keep], self.hits[keep] >> 1
        self.slots[:] = 0
        self._file(np.arange(self.count))

    def _remember(self, keys: np.ndarray, words: list[bytes], values: np.ndarray, sizes: np.ndarray) -> None:
        """File new words under their keys, of which none is known; what the memo has no room for is left out."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))

        def room():
            n, a, b = self.count, self.word_ends[self.count], self.value_ends[self.count]
            ok = (n + 1 + np.arange(len(words)) <= self.limit) & (a + np.cumsum(lengths) <= len(self.words)) & (b + np.cumsum(sizes) <= len(self.values))
            return int(np.count_nonzero(ok))

        fit = room()
        if fit < len(words) and self.count:
            self._forget()
            fit = room()
        a, b = self.count, self.count + fit
        self.keys[a:b], self.hits[a:b] = keys[:fit], 0
        for ends, store, flat, n in ((self.word_ends, self.words, np.frombuffer(b"".join(words[:fit]), np.uint8), lengths), (self.value_ends, self.values, values, sizes)):
            ends[a + 1:b + 1] = ends[a] + np.cumsum(n[:fit])
            store[ends[a]:ends[b]] = flat[:ends[b] - ends[a]]
        self.count = b
        self._file(np.arange(a, b))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """What ``make(list of words)`` gives for ascending spans, one after the other, and how many numbers each has.

        ``make`` gives a sequence of numbers below 2**32 for each word, and is asked for new words only.
        """
        parts = [self._run(data, starts[k:k + RUN_WORDS], ends[k:k + RUN_WORDS], make) for k in range(0, len(starts), RUN_WORDS)]
        return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint32), np.zeros(0, np.int64)), *parts))

    def _run(self, data, starts, ends, make):
        lengths = ends - starts
        short = np.flatnonzero(lengths <= WORD_BYTES)
        keys = np.zeros(len(starts), np.uint64)
        keys[short] = spans.hashes(data, starts[short], ends[short], spans.CASED)
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = self._find(keys[short])
        new = entry < 0
        known = np.flatnonzero(~new)
        at, n = self.word_ends[entry[known]].astype(np.int64), lengths[known]
        same = self.word_ends[entry[known] + 1] - at == n
        other = [known[~same]]  # words whose key another word has
        known, at, n = known[same], at[same], n[same]
        differs = np.flatnonzero(data[_ranges(starts[known], n)] != self.words[_ranges(at, n)])
        other = np.concatenate([*other, known[np.searchsorted(np.cumsum(n), differs, "right")]])
        entry[other] = -1
        known = np.flatnonzero(entry >= 0)
        sizes = np.zeros(len(starts), np.int64)
        at = self.value_ends[entry[known]].astype(np.int64)
        sizes[known] = self.value_ends[entry[known] + 1] - at
        self.hits[entry[known]] += 1
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return self.values[_ranges(at, sizes)], sizes
        low = starts[missing[0]]
        raw, place = data[low:ends[missing[-1]]].tobytes(), {}
        words = [raw[a:b] for a, b in zip((starts[missing] - low).tolist(), (ends[missing] - low).tolist())]
        which = np.array([place.setdefault(w, len(place)) for w in words])
        made, made_sizes = _flat(make([w.decode() for w in place]))
        made_at = np.cumsum(made_sizes) - made_sizes
        sizes[missing] = made_sizes[which]
        out_at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[_ranges(out_at[known], sizes[known])] = self.values[_ranges(at, sizes[known])]
        out[_ranges(out_at[missing], sizes[missing])] = made[_ranges(made_at[which], sizes[missing])]
        fresh = missing[new[missing] & (lengths[missing] <= WORD_BYTES)]
        if len(fresh):
            fresh = np.sort(fresh[np.unique(keys[fresh], return_index=True)[1]])  # of several words with a key, the first
            pick = which[np.searchsorted(missing, fresh)]
            in_order = list(place)
            self._remember(keys[fresh], [in_order[i] for i in pick], made[_ranges(made_at[pick], made_sizes[pick])], made_sizes[pick])
        return out, sizes

    def results(self, words: list[str], make) -> list[bytes]:
        """The same for a list of words, where ``make`` gives bytes."""
        data, offsets = common.text_bytes(pa.array(words, pa.string()))
        values, sizes = self.numbers(data, offsets[:-1], offsets[1:], make)
        raw, ends = values.astype(np.uint8).tobytes(), np.cumsum(sizes)
        return [raw[b - n:b] for b, n in zip(ends.tolist(), sizes.tolist())]


def text_ids(data: np.ndarray, offsets: np.ndarray, memo: WordMemo, make) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts and the offsets of each text's; ``make`` encodes a list of strings on their own."""
    starts, first = split_words(data, offsets)
    ids, sizes = memo.numbers(data, starts, np.append(starts[1:], len(data)), make)
    return ids, np.append(0, np.cumsum(sizes))[first]


class Coder:
    """Encoder and decoder of one vocabulary in a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.automaton = None  # built by the first encoding; a worker that only decodes does without
        self.pairs: dict[int, bool] = {}
        self.words = WordMemo()
        ends = np.cumsum([0] + [len(self.bytes_of.get(i, b"")) for i in range(max(ranks.values(), default=-1) + 1)])
        self.lengths, self.starts = np.diff(ends), ends[:-1]
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.starts))), np.uint8)

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()

    def _merged(self, raw: bytes) -> list[int]:
        """The merges themselves, lowest rank first, for the few bytes of two tokens."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        rank_of = self.ranks.get
        ranks = [rank_of(raw[i:i + 2], 1 << 60) for i in range(len(raw) - 1)]
        while ranks and (least := min(ranks)) < 1 << 60:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], 1 << 60)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if self.automaton is None:
            self._build()
        n = len(raw)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(raw.decode("latin-1")):
            starting[last + 1 - match[1]].append(match)  # by growing length
        known = self.pairs.get
        closed = bytearray(n + 1)
        tokens: list[tuple[int, int]] = []
        tried: list[int] = []  # matches left to try at each step of the way, longest last
        at = 0
        left = len(starting[0])
        while at < n:
            matches = starting[at]
            before = tokens[-1][0] if tokens else -1
            while left:
                left -= 1
                match = matches[left]
                if closed[at + match[1]]:
                    continue
                if before < 0:
                    break
                fits = known(before << 32 | match[0])
                if fits or fits is None and self.compatible(before, match[0]):
                    break
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks single bytes")
                closed[at] = 1
                at -= tokens.pop()[1]
                left = tried.pop()
                continue
            tried.append(left)
            tokens.append(match)
            at += match[1]
            left = len(starting[at]) if at < n else 0
        return [match[0] for match in tokens]

    def word(self, word: str) -> list[int]:
        return [i for match in self.pattern.findall(word) for i in self.piece(match.encode())]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and the offsets of each text's."""
        return text_ids(data, offsets, self.words, lambda words: [self.word(w) for w in words])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of some texts' ids and the offsets of each text's."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.starts) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.all_bytes[at], np.append(0, ends)[offsets]


def _coder(shared) -> Coder:
    return common.held(("byte bpe", shared.id), lambda: Coder(*shared.value))


class _Shared:
    """The vocabulary on its way to the workers; ``id`` tells coders of one worker apart."""

    def __init__(self, spark, vocabulary: str, pattern: str):
        self.sent = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))
        self.id = hash((vocabulary, pattern))

    @property
    def value(self):
        return self.sent.value


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, column: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of each whole text, as an array of ints.

    ``vocabulary`` is the path of a rank file on the driver; each match of ``pattern`` is encoded by itself, without special
    tokens. A null or empty text has no ids. A column named like ``out`` is replaced; ids and rows may repeat or be null.
    With ``decoded``, a column of that name takes the place of the text: the bytes decoded from the ids by the same worker,
    while ``decode`` behind this function would have a second worker with each task.
    """
    shared = _Shared(docs.sparkSession, vocabulary, pattern)

    def work(part):
        coder = _coder(shared)
        ids, ends = coder.encode(*common.text_bytes(part.column(part.schema.get_field_index(column))))
        columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))]
        return columns + [_binary(*coder.decode(ids.astype(np.int64), ends))] * (decoded is not None)

    source = docs.withColumn(column, F.col(f"`{column}`").cast("string"))
    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded is None:
        return common.append(source, column, fields, work, holds=True)
    return common.append(source, column, [*fields, T.StructField(decoded, T.BinaryType())], work, using=[column], holds=True)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes of the ids. Null ids give no bytes; an id outside the vocabulary is an error."""
    shared = _Shared(encoded.sparkSession, vocabulary, pattern)
    kept = [f for f in encoded.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in kept]

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(part.schema.get_field_index(column))
                sizes = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                data, ends = coder.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [_binary(data, ends)], names + [out])

    return encoded.select(*[f"`{n}`" for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))
