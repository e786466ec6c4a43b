"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, partitioned tables.

``fit_all`` and ``score_all``, which ``score_documents`` uses, are a bigram model over all words of the training texts, an
end token and a start context; words never seen share the mass of one unseen word:

    p(word | h)      = d(c) * c / c(h)             for pairs seen c times, d by Good-Turing for c up to 5
                     = bow(h) * p(word)            for the others, bow such that all words sum to one

The ``vocabulary`` most frequent words are hot: their counts, contexts and most frequent pairs go to all tasks, pairs of two
of them are packed in 32 bits. Pairs with another word lie in the bucket of that word's hash: those with such a word in the
word's bucket, next to its count, those after such a context in the context's bucket, next to its weights. An occurrence with
two such words asks both buckets, and the answers add up. No word is left out, and no key of an exchange is large.

``fit`` and ``score`` are the smaller model over the ``vocabulary`` most frequent words, an end token, a start context and one
class for all other words, which spells a word by its share of the class:

    p(word | before) = p(class | class before) * p(word | class)
    p(class | h)     = d(c) * c / c(h)             for pairs seen c times, d by Good-Turing for c up to 5
                     = bow(h) * p(class)           for the others, bow such that all classes sum to one
    p(word)          = d(c) * c / N                for seen words, the rest of the mass for one unseen word

Counting combines in the tasks and meets in buckets by hash; the tables of words and of pairs are written per bucket as
sorted arrays. Scoring sends, in the same buckets, the occurrences of rare words and of pairs, and brings back one sum per
document and bucket. What goes to all tasks is bounded by the vocabulary: its counts, one row per context, and the hot
pairs, of which each makes up at least 2**-17 of all tokens, so that there are at most 2**17 of them. So no key of an
exchange is large. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, spans
from quarry.llm.line_dedup import _as_iterator
from quarry.session import materialize

#: Counts up to this one are discounted.
LAST_DISCOUNT = 5
HOT_SHARE = 1 << 17
#: Entries of one bucket and bytes of text between two hand-outs of a task: both bound its memory.
BUCKET_ENTRIES = 1 << 23
HAND_OUT = 1 << 23
#: As BUCKET_ENTRIES, where pairs are held as two hashes.
BUCKET_PAIRS = 1 << 20
#: Stand for the end token and the start context among hashes of words.
END, START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_BLOB = "bucket int, kind int, keys binary, counts binary, docs binary"
_NAMES = ["bucket", "kind", "keys", "counts", "docs"]


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0..LAST_DISCOUNT from counts of counts ``n`` (index 1..LAST_DISCOUNT + 1).

    Where counts of counts are too few for a factor between 0 and 1, the count is not discounted.
    """
    out = np.ones(LAST_DISCOUNT + 1)
    if n[1] <= 0:
        return out
    cut = (LAST_DISCOUNT + 1) * n[LAST_DISCOUNT + 1] / n[1]
    for r in range(1, LAST_DISCOUNT + 1):
        if n[r] > 0 and n[r + 1] > 0 and cut < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
            if 0 < d <= 1:
                out[r] = d
    return out


def _discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LAST_DISCOUNT, factors[np.minimum(counts, LAST_DISCOUNT)], 1.0)


@dataclass
class Model:
    """All of the model that goes to every task. Classes: words of the vocabulary, then other, end and start."""

    words: np.ndarray  # sorted hashes of the vocabulary
    counts: np.ndarray  # their counts
    tokens: int  # N, with ends
    types: int  # V, with the end
    documents: int  # count of the end token
    word_factors: np.ndarray
    pair_factors: np.ndarray
    unseen: float  # mass of the unseen word
    scale: float  # of all seen words' mass
    p1: np.ndarray  # of each class
    totals: np.ndarray | None = None  # c(h)
    seen: np.ndarray | None = None  # scale of seen pairs after h
    bow: np.ndarray | None = None
    hot: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def other(self) -> int:
        return len(self.words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Classes of hashes of words, ``END`` and ``START``."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        found = np.where(known, at, self.other).astype(np.int64)
        found[hashes == END] = self.other + 1
        found[hashes == START] = self.other + 2
        return found

    def word_mass(self, counts: np.ndarray) -> np.ndarray:
        """p(word) for counts; the unseen word for count 0."""
        return np.where(counts > 0, self.scale * _discounted(counts, self.word_factors) / max(self.tokens, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def pair(self, context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """p(class | context) by the pair's count, backing off where it is 0 (and to the class alone after a new context)."""
        seen = self.seen[context] * _discounted(counts, self.pair_factors) / np.maximum(self.totals[context], 1)
        return np.where(counts > 0, seen, self.bow[context] * self.p1[word])


class _Texts:
    """Classes, contexts and documents of the tokens of some rows: the words, then one end for each row."""

    def __init__(self, model: Model | None, column):
        data, offsets = common.text_bytes(column)
        s, e, rows = spans.words(data, offsets, spans.NOT_BLANK)
        self.hashes, self.rows, self.n = spans.hashes(data, s, e), rows, len(offsets) - 1
        if model is not None:
            at = np.searchsorted(model.words, self.hashes)
            hit = np.minimum(at, max(len(model.words) - 1, 0))
            known = model.words[hit] == self.hashes if len(model.words) else np.zeros(len(at), bool)
            classes = np.where(known, hit, model.other).astype(np.int64)
            ends = np.searchsorted(rows, np.arange(self.n), "right") + np.arange(self.n)
            self.of = np.insert(rows, np.searchsorted(rows, np.arange(self.n), "right"), np.arange(self.n)) if self.n else rows
            self.classes = np.full(len(rows) + self.n, model.other + 1, np.int64)
            is_word = np.ones(len(self.classes), bool)
            is_word[ends] = False
            self.classes[is_word] = classes
            self.context = np.concatenate([[model.other + 2], self.classes[:-1]])[:len(self.classes)]
            self.context[np.append(0, ends[:-1] + 1)[:self.n]] = model.other + 2
            self.pairs = (self.context << 16 | self.classes).astype(np.uint32)
            self.rare = classes == model.other


class _Counter:
    """Counts of keys in a task, put together now and then."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = added(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return keys, counts


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _deal(kind: int, keys: np.ndarray, buckets: int, counts=None, rows=None, names=None):
    """Blobs per bucket of keys with counts, or with rows into the documents' names."""
    to = (spans.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    keys = keys[order]
    second = (counts if counts is not None else rows)[order].astype(np.uint32)
    used = [i for i in range(buckets) if cuts[i + 1] > cuts[i]]
    if used:
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), pa.array([keys[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary()),
            pa.array([second[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary()),
            pa.array([b"" if names is None else names.tobytes() for _ in used], pa.binary())], _NAMES)


_KINDS = {0: np.uint64, 1: np.uint32}  # words and pairs


def _counted(rows: DataFrame, kind: int, keys_of, buckets: int) -> DataFrame:
    """A table of one row per bucket: sorted keys and their counts over all ``rows`` (column text)."""

    def count(batches):
        counter = _Counter()
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                counter.add(keys_of(part.column(0)))
                if counter.size > 1 << 22:
                    keys, counts = counter.take()
                    yield from _deal(kind, keys, buckets, counts)
        keys, counts = counter.take()
        yield from _deal(kind, keys, buckets, counts)

    def merge(key, batches):
        keys, counts = [], []
        for batch in batches:
            keys += [np.frombuffer(v.as_buffer(), _KINDS[kind]) for v in batch.column(2)]
            counts += [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(3)]
        total, sums = added(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([kind], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary()), pa.array([np.minimum(sums, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()),
                                          pa.array([b""], pa.binary())], _NAMES)

    dealt = rows.select("text").mapInArrow(count, _BLOB)
    return materialize(dealt.groupBy("bucket").applyInArrow(_as_iterator(merge), _BLOB), ("words", "pairs")[kind])


def _statistics(counted: DataFrame, kind: int):
    """Counts of counts 1..LAST_DISCOUNT + 1, number of keys and sum of counts."""

    def tell(batches):
        for batch in batches:
            for v in batch.column(0):
                c = np.frombuffer(v.as_buffer(), np.uint32)
                n = np.bincount(c[c <= LAST_DISCOUNT + 1], minlength=LAST_DISCOUNT + 2)
                yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([len(c)], pa.int64()), pa.array([int(c.sum(dtype=np.int64))], pa.int64())], ["n", "keys", "sum"])

    rows = counted.select("counts").mapInArrow(tell, "n array<long>, keys long, sum long")
    found = rows.select(*[F.sum(F.col("n")[i]) for i in range(LAST_DISCOUNT + 2)], F.sum("keys"), F.sum("sum")).first()
    values = [int(v or 0) for v in found]
    return np.array(values[:-2], np.float64), values[-2], values[-1]


def _single_words(texts: DataFrame, vocabulary: int, entries: int = BUCKET_ENTRIES, joined: int = 1) -> tuple[Model, DataFrame, int]:
    """The model's single words, the table of all words, and the number of buckets, a multiple of ``joined``."""
    if not 0 < vocabulary <= (1 << 16) - 3:
        raise ValueError("a vocabulary has 1 to 65,533 words")
    spark = texts.sparkSession
    stated = texts.agg(F.count("*"), F.sum(F.length(F.col("text").cast("binary")))).first()
    documents = int(stated[0])
    buckets = int(max(spark.sparkContext.defaultParallelism, -(-int(stated[1] or 0) // 4 // entries)))
    buckets = -(-buckets // joined) * joined  # before the words are dealt: all tables lie in the same buckets
    words = _counted(texts, 0, lambda column: _Texts(None, column).hashes, buckets)
    n, types, tokens = _statistics(words, 0)
    if documents:
        if documents <= LAST_DISCOUNT + 1:
            n[documents] += 1
        types, tokens = types + 1, tokens + documents

    def top(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                keys, counts = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint32)
                order = np.lexsort((keys.view(np.int64), -counts.astype(np.int64)))[:vocabulary]
                yield pa.RecordBatch.from_arrays([pa.array(keys[order].view(np.int64)), pa.array(counts[order].astype(np.int64))], ["word", "n"])

    chosen = words.select("keys", "counts").mapInArrow(top, "word long, n long").orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    keys, counts = chosen["word"].to_numpy().view(np.uint64), chosen["n"].to_numpy()
    order = np.argsort(keys)
    factors = discounts(n)
    lost = float(sum(n[r] * r * (1 - factors[r]) for r in range(1, LAST_DISCOUNT + 1))) / max(tokens, 1)
    unseen = lost if lost > 0 else 1 / (tokens + 1)
    model = Model(keys[order], counts[order], tokens, types, documents, factors, np.ones(LAST_DISCOUNT + 1), unseen, (1 - unseen) / (1 - lost), np.zeros(0))
    own = model.word_mass(model.counts)
    end = float(model.word_mass(np.array([documents]))[0]) if documents else 0.5  # without texts, an end is as likely as a word
    model.p1 = np.concatenate([own, [max(1 - own.sum() - end, 0.0), end, 0.0]])
    return model, words, buckets


def fit(texts: DataFrame, vocabulary: int = 65_000) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model of the rows' ``text`` (null: empty), the tables of words and pairs, and the number of buckets."""
    spark = texts.sparkSession
    model, words, buckets = _single_words(texts, vocabulary)
    shared = spark.sparkContext.broadcast(model)
    pairs = _counted(texts, 1, lambda column: _Texts(shared.value, column).pairs, buckets)
    model.pair_factors = discounts(_statistics(pairs, 1)[0])
    shared = spark.sparkContext.broadcast(model)
    size = len(model.p1)

    def contexts(batches):
        m = shared.value
        sums = np.zeros((3, size))
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                keys, counts = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32).astype(np.int64)
                h, w = (keys >> 16).astype(np.int64), (keys & 0xFFFF).astype(np.int64)
                for i, value in enumerate((counts, _discounted(counts, m.pair_factors), m.p1[w])):
                    sums[i] += np.bincount(h, value, size)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(s[used]) for s in sums]], ["h", "total", "kept", "p1"])

    found = pairs.select("keys", "counts").mapInArrow(contexts, "h long, total double, kept double, p1 double").groupBy("h").agg(
        F.sum("total"), F.sum("kept"), F.sum("p1")).toArrow()  # a row for each context of the vocabulary at most
    h, total, kept, mass = (found[i].to_numpy() for i in range(4))
    model.totals, model.seen, model.bow = np.zeros(size), np.ones(size), np.ones(size)
    model.totals[h] = total
    model.seen[h], model.bow[h] = _weights(total, kept, mass)
    model.hot = _hot_pairs(model, pairs)
    return model, words, pairs, buckets


def _weights(total: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of seen pairs and backoff weight of contexts from counts, discounted counts and the mass of what was seen after."""
    left = np.where(kept >= total - 1e-9, 1 / (total + 1), 1 - kept / np.maximum(total, 1))
    rest = 1 - mass
    left = np.where(rest > 1e-12, left, 0.0)  # everything was seen after h
    return (1 - left) * total / kept, left / np.maximum(rest, 1e-12)


def _hot_pairs(model: Model, pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    least = max(1, -(-model.tokens // HOT_SHARE))

    def hot(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                keys, counts = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
                some = counts >= max(least, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array(counts[some].astype(np.int64))], ["pair", "n"])

    most = pairs.select("keys", "counts").mapInArrow(hot, "pair long, n long").toArrow()
    keys, counts = most["pair"].to_numpy().astype(np.uint32), most["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def score(texts: DataFrame, fitted: tuple[Model, DataFrame, DataFrame, int]) -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row of ``id`` and ``text`` (null: empty).

    ``score`` is the log10 probability of the text with its end; ``base_score`` that of single words with half a count added.
    """
    spark = texts.sparkSession
    model, words, pairs, buckets = fitted
    shared = spark.sparkContext.broadcast(model)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cold(m: Model, t: _Texts):
        at = np.minimum(np.searchsorted(m.hot[0], t.pairs), max(len(m.hot[0]) - 1, 0))
        return (m.hot[0][at] != t.pairs if len(m.hot[0]) else np.ones(len(t.pairs), bool)), at

    def near(batches):
        """What a task can tell by itself: words of the vocabulary and hot pairs."""
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                m = shared.value
                t = _Texts(m, part.column(1))
                far, at = cold(m, t)
                value = np.zeros(len(t.pairs))
                value[~far] = np.log10(m.pair(t.context[~far], t.classes[~far], m.hot[1][at[~far]]))
                known = t.classes != m.other
                c = np.append(m.counts, [0, m.documents])[t.classes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [pa.array(x) for x in (
                    np.bincount(t.of, minlength=t.n), np.bincount(t.of, known & (c > 0), t.n), np.bincount(t.of, np.where(known, m.base(c), 0.0), t.n), np.bincount(t.of, value, t.n))],
                    ["id", "key", "n_tokens", "known", "base", "value"])

    def send(batches):
        for batch in batches:
            for part in common.text_runs(batch, "text", HAND_OUT):
                names, first = part.column(2).to_numpy(), 0
                pair_keys, pair_rows, word_keys, word_rows = [], [], [], []
                for run in common.text_runs(part, "text"):
                    m = shared.value
                    t = _Texts(m, run.column(1))
                    far, _ = cold(m, t)
                    pair_keys.append(t.pairs[far])
                    pair_rows.append(t.of[far] + first)
                    word_keys.append(t.hashes[t.rare])
                    word_rows.append(t.rows[t.rare] + first)
                    first += t.n
                yield from _deal(1, np.concatenate(pair_keys), buckets, rows=np.concatenate(pair_rows), names=names)
                yield from _deal(0, np.concatenate(word_keys), buckets, rows=np.concatenate(word_rows), names=names)

    def far(key, batches):
        m = shared.value
        tables, wanted = {}, []
        for batch in batches:
            for kind_, keys, counts, docs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                keys, counts = np.frombuffer(keys.as_buffer(), _KINDS[kind_]), np.frombuffer(counts.as_buffer(), np.uint32)
                if docs.as_buffer().size:
                    wanted.append((kind_, keys, counts, np.frombuffer(docs.as_buffer(), np.int64)))
                else:
                    tables[kind_] = keys, counts
        for kind_, keys, of, names in wanted:
            table, n = tables.get(kind_, (np.zeros(0, _KINDS[kind_]), np.zeros(0, np.uint32)))
            at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
            c = np.where(table[at] == keys, n[at], 0).astype(np.int64) if len(table) else np.zeros(len(keys), np.int64)
            if kind_:
                value = np.log10(m.pair((keys >> 16).astype(np.int64), (keys & 0xFFFF).astype(np.int64), c))
                known, base = np.zeros(len(c)), np.zeros(len(c))
            else:
                value, known, base = np.log10(m.word_mass(c) / m.p1[m.other]), c > 0, m.base(c)
            used, place = np.unique(of, return_inverse=True)
            sums = [np.bincount(place, x, len(used)) for x in (known, base, value)]
            yield pa.RecordBatch.from_arrays([pa.array(names[used]), *[pa.array(s) for s in sums]], ["key", "known", "base", "value"])

    own = rows.mapInArrow(near, f"id {kind}, key long, n_tokens long, known double, base double, value double")
    sent = rows.mapInArrow(send, _BLOB).unionByName(words).unionByName(pairs)
    back = sent.groupBy("bucket").applyInArrow(_as_iterator(far), "key long, known double, base double, value double")
    return _together(own, back)


def _together(own: DataFrame, back: DataFrame) -> DataFrame:
    """Each row's own sums and those that came back for it."""
    back = back.groupBy("key").agg(*[F.sum(c).alias(f"far_{c}") for c in ("known", "base", "value")])
    # rows that are equal in id and text share a key, and what came back for it counts once for each of them
    own = materialize(own, "near")
    copies = own.groupBy("key").agg(F.count("*").alias("copies"))
    out = own.join(copies, "key").join(back, "key", "left")
    total = lambda c: F.col(c) + F.coalesce(F.col(f"far_{c}") / F.col("copies"), F.lit(0.0))
    return out.select("id", "n_tokens", F.round(total("known")).cast("long").alias("n_known"), total("base").alias("base_score"), total("value").alias("score"))


_WIDE = "bucket int, kind int, keys binary, others binary, counts binary, docs binary"
_WIDE_NAMES = ["bucket", "kind", "keys", "others", "counts", "docs"]
#: Kinds of rows: counts of words, pairs of hot words, pairs by their rare word, pairs by their rare context, weights of contexts.
#: And documents' keys of a hand-out under a hash of them: questions and answers name the hand-out and places in it, and the
#: keys meet the added-up answers once.
WORDS, HOT_PAIRS, BY_WORD, BY_CONTEXT, WEIGHTS, NAMES = range(6)
#: Buckets that meet in one group for scoring: the fewer groups, the fewer answers for a hand-out.
JOINED = 4


class _Pairs(_Texts):
    """Also the hashes of words (or ``END``) and of what is before them (or ``START``), and which of them are not hot."""

    def __init__(self, model: Model, column):
        super().__init__(model, column)
        self.word = np.full(len(self.classes), END, np.uint64)
        self.word[self.classes != model.other + 1] = self.hashes
        self.before = np.append(START, self.word)[:-1]
        self.before[self.context == model.other + 2] = START
        self.rare_word, self.rare_before = self.classes == model.other, self.context == model.other


def _packed(m: Model, hashes: np.ndarray) -> np.ndarray:
    """Bytes of hashes: two for the class of each, then the whole hash of those that are not hot."""
    classes = m.find(hashes)
    return np.concatenate([classes.astype(np.uint16).view(np.uint8), hashes[classes == m.other].view(np.uint8)])


def _unpacked(m: Model, packed, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes from ``_packed``."""
    classes = np.frombuffer(packed, np.uint16, n).astype(np.int64)
    hashes = np.concatenate([m.words, np.array([0, END, START], np.uint64)])[classes]
    hashes[classes == m.other] = np.frombuffer(packed, np.uint8)[2 * n:].copy().view(np.uint64)
    return hashes, classes


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return spans.mix(spans.mix(before) * np.uint64(0xD6E8FEB86659FD93) + word)


def _added_pairs(keys: np.ndarray, others: np.ndarray, counts: np.ndarray):
    """Distinct pairs in order and the sums of their counts."""
    order = np.lexsort((others, keys))
    keys, others, counts = keys[order], others[order], counts[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (others[1:] != others[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], others[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _wide(bucket, kind: int, keys: np.ndarray, others=None, counts=None, docs=None) -> pa.RecordBatch:
    """A row of one bucket."""
    blob = lambda x: pa.array([b"" if x is None else np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), blob(keys), blob(others), blob(counts), blob(docs)], _WIDE_NAMES)


def _deal_wide(m: Model, kind: int, keys: np.ndarray, others, counts: np.ndarray, buckets: int, docs=None, names=None):
    """Blobs per bucket of keys, their other halves and counts (or rows into the documents' ``names``), and ``docs`` for each key."""
    to = (spans.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    keys, counts = keys[order], counts[order].astype(np.uint32 if names is None else _places(names))
    others, docs = (x if x is None else x[order] for x in (others, docs))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[i], cuts[i + 1])
        yield _wide(i, kind, keys[part], None if others is None else _packed(m, others[part]), counts[part], docs[part] if docs is not None else None if names is None else _hand_out(names))


def _names_hash(names: np.ndarray) -> np.ndarray:
    return spans.mix(spans.mix(names.view(np.uint64)) + np.arange(len(names), dtype=np.uint64)).sum(keepdims=True)


def _hand_out(names: np.ndarray) -> np.ndarray:
    """What names a hand-out of documents where their keys are not: a hash of the keys, and how many there are."""
    return np.append(_names_hash(names), np.uint64(len(names)))


def _one_table(tables: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts from several such tables without common keys."""
    keys, counts = (np.concatenate(x) for x in zip(*tables))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _places(names: np.ndarray):
    """The type of places in ``names``."""
    return _place_type(len(names))


def _place_type(n: int):
    return np.uint16 if n <= 1 << 16 else np.uint32


def _looked_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _count_at(table, keys: np.ndarray) -> np.ndarray:
    at, there = _looked_up(table[0], keys)
    return np.where(there, table[1][at], 0).astype(np.int64) if len(table[0]) else np.zeros(len(keys), np.int64)


def _summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of the three values at each."""
    used, at = np.unique(places, return_inverse=True)
    return used, np.stack([np.bincount(at, x, len(used)) for x in values])


def _answer(at: np.ndarray, places=None, sums=None, names=None) -> pa.RecordBatch:
    """A row for one hand-out: sums at places of it, or the keys of its documents."""
    blobs = [b"" if names is None else bytes(names), b"" if places is None else places.astype(np.uint32).tobytes(), b"" if sums is None else sums.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), *[pa.array([b], pa.binary()) for b in blobs]], ["at", "names", "places", "sums"])


def _read(batch: pa.RecordBatch):
    """Kind, keys, others, counts and docs of each row of ``_WIDE``, the last three as buffers."""
    for kind, keys, others, counts, docs in zip(batch.column(1).to_pylist(), *(batch.column(i) for i in range(2, 6))):
        yield kind, np.frombuffer(keys.as_buffer(), np.uint32 if kind == HOT_PAIRS else np.uint64), others.as_buffer(), counts.as_buffer(), docs.as_buffer()


def fit_all(texts: DataFrame, vocabulary: int = 65_000) -> tuple[Model, DataFrame, DataFrame, DataFrame, int]:
    """The model of all words of the rows' ``text`` (null: empty): what goes to every task, the tables of words, of pairs and
    of contexts, and the number of buckets."""
    spark = texts.sparkSession
    model, words, buckets = _single_words(texts, vocabulary, BUCKET_PAIRS, JOINED)
    if not model.documents:
        model.unseen = float(model.p1[model.other])
    words = words.select("bucket", "kind", "keys", F.lit(b"").alias("others"), "counts", "docs")
    shared = spark.sparkContext.broadcast(model)

    def count(batches):
        near, held = _Counter(), {BY_WORD: [], BY_CONTEXT: []}

        def hand_out():
            keys, counts = near.take()
            if len(keys):
                yield from _deal_wide(shared.value, HOT_PAIRS, keys, None, counts, buckets)
            for kind, parts in held.items():
                if parts:
                    keys, others, counts = _added_pairs(*(np.concatenate(x) for x in zip(*parts)))
                    yield from _deal_wide(shared.value, kind, keys, others, counts, buckets)
                    parts.clear()

        size = 0
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                t = _Pairs(shared.value, part.column(0))
                near.add(t.pairs[~t.rare_word & ~t.rare_before])
                after = t.rare_before & ~t.rare_word
                for kind, keys, others in ((BY_WORD, t.word[t.rare_word], t.before[t.rare_word]), (BY_CONTEXT, t.before[after], t.word[after])):
                    held[kind].append(_added_pairs(keys, others, np.ones(len(keys), np.int64)))
                    size += len(held[kind][-1][0])
                if near.size + 2 * size > 1 << 20:
                    yield from hand_out()
                    size = 0
        yield from hand_out()

    def merge(key, batches):
        bucket, known, parts = key[0].as_py(), (np.zeros(0, np.uint64), np.zeros(0, np.uint32)), {HOT_PAIRS: [], BY_WORD: [], BY_CONTEXT: []}
        for batch in batches:
            for kind, keys, others, counts, _ in _read(batch):
                counts = np.frombuffer(counts, np.uint32)
                if kind == WORDS:
                    known = keys, counts
                else:
                    parts[kind].append((keys, _unpacked(shared.value, others, len(keys))[0] if kind != HOT_PAIRS else keys, counts.astype(np.int64)))
        for kind, own in parts.items():
            if own:
                keys, others, counts = _added_pairs(*(np.concatenate(x) for x in zip(*own)))
                own.clear()
                yield _wide(bucket, kind, keys, None if kind == HOT_PAIRS else _packed(shared.value, others), np.minimum(counts, 2**32 - 1).astype(np.uint32),
                            _count_at(known, keys).astype(np.uint32) if kind == BY_WORD else None)

    dealt = texts.select("text").mapInArrow(count, _WIDE).unionByName(words)
    pairs = materialize(dealt.groupBy("bucket").applyInArrow(_as_iterator(merge), _WIDE), "pairs")
    model.pair_factors = discounts(_statistics(pairs, 1)[0])
    shared = spark.sparkContext.broadcast(model)
    size = len(model.p1)

    def hot_contexts(batches):
        m, sums = shared.value, np.zeros((3, size))
        for batch in batches:
            for kind, keys, others, counts, docs in _read(batch):
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                if kind == HOT_PAIRS:
                    h, mass = (keys >> 16).astype(np.int64), m.p1[keys & 0xFFFF]
                else:
                    h, mass = _unpacked(m, others, len(keys))[1], m.word_mass(np.frombuffer(docs, np.uint32).astype(np.int64))
                for i, value in enumerate((counts, _discounted(counts, m.pair_factors), mass)):
                    sums[i] += np.bincount(h, value, size)
        sums[:, m.other] = 0
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(s[used]) for s in sums]], ["h", "total", "kept", "p1"])

    found = pairs.where(F.col("kind").isin(HOT_PAIRS, BY_WORD)).mapInArrow(hot_contexts, "h long, total double, kept double, p1 double").groupBy("h").agg(
        F.sum("total"), F.sum("kept"), F.sum("p1")).toArrow()  # a row for each hot context at most
    h, total, kept, mass = (found[i].to_numpy() for i in range(4))
    model.totals, model.seen, model.bow = np.zeros(size), np.ones(size), np.ones(size)
    model.totals[h] = total
    model.seen[h], model.bow[h] = _weights(total, kept, mass)

    def onward(batches):
        """Pairs of two rare words to the bucket of the context; those with a hot word are there."""
        m = shared.value
        for batch in batches:
            for kind, keys, others, counts, docs in _read(batch):
                (others, classes), counts = _unpacked(m, others, len(keys)), np.frombuffer(counts, np.uint32)
                if kind == BY_CONTEXT:
                    yield from _deal_wide(m, kind, keys, others, counts, buckets)
                else:
                    rare = classes == m.other
                    if rare.any():
                        yield from _deal_wide(m, kind, others[rare], keys[rare], counts[rare], buckets, np.frombuffer(docs, np.uint32)[rare])

    def contexts(key, batches):
        m, parts = shared.value, []
        for batch in batches:
            for kind, keys, others, counts, docs in _read(batch):
                others, classes = _unpacked(m, others, len(keys))
                mass = m.p1[classes] if kind == BY_CONTEXT else m.word_mass(np.frombuffer(docs, np.uint32).astype(np.int64))
                parts.append((keys, others, np.frombuffer(counts, np.uint32), mass))
        before, word, counts, mass = (np.concatenate(x) for x in zip(*parts))
        hashes = pair_hashes(before, word)
        order = np.argsort(hashes, kind="stable")
        yield _wide(key[0].as_py(), BY_CONTEXT, hashes[order], None, counts[order])
        order = np.argsort(before, kind="stable")
        before, mass, counts = before[order], mass[order], counts[order].astype(np.int64)
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        total, kept, mass = (np.add.reduceat(x, heads) for x in (counts, _discounted(counts, m.pair_factors), mass))
        seen, bow = _weights(total, kept, mass)
        yield _wide(key[0].as_py(), WEIGHTS, before[heads], seen / total, bow)

    moved = pairs.where(F.col("kind").isin(BY_WORD, BY_CONTEXT)).mapInArrow(onward, _WIDE)
    weights = materialize(moved.groupBy("bucket").applyInArrow(_as_iterator(contexts), _WIDE), "contexts")
    model.hot = _hot_pairs(model, pairs.where(F.col("kind") == HOT_PAIRS))
    return model, words, pairs, weights, buckets


def score_all(texts: DataFrame, fitted: tuple[Model, DataFrame, DataFrame, DataFrame, int]) -> DataFrame:
    """As ``score``, by the model of ``fit_all``."""
    spark = texts.sparkSession
    model, words, pairs, weights, buckets = fitted
    groups = buckets // JOINED
    shared = spark.sparkContext.broadcast(model)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()

    def at_hand(m: Model, t: _Pairs):
        at, there = _looked_up(m.hot[0], t.pairs)
        return at, there & ~t.rare_word & ~t.rare_before

    def near(batches):
        """What a task can tell by itself: counts of hot words, and hot pairs."""
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                m = shared.value
                t = _Pairs(m, part.column(1))
                at, here = at_hand(m, t)
                value = np.zeros(len(t.pairs))
                value[here] = np.log10(m.pair(t.context[here], t.classes[here], m.hot[1][at[here]]))
                c = np.append(m.counts, [0, m.documents])[t.classes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [pa.array(x) for x in (
                    np.bincount(t.of, minlength=t.n), np.bincount(t.of, ~t.rare_word & (c > 0), t.n), np.bincount(t.of, np.where(t.rare_word, 0.0, m.base(c)), t.n), np.bincount(t.of, value, t.n))],
                    ["id", "key", "n_tokens", "known", "base", "value"])

    def send(batches):
        for batch in batches:
            for part in common.text_runs(batch, "text", HAND_OUT):
                names, first, asked = part.column(2).to_numpy(), 0, {HOT_PAIRS: [], BY_WORD: [], BY_CONTEXT: []}
                for run in common.text_runs(part, "text"):
                    m = shared.value
                    t = _Pairs(m, run.column(1))
                    cold = ~at_hand(m, t)[1] & ~t.rare_word & ~t.rare_before
                    for k, keys, others, some in ((HOT_PAIRS, t.pairs, t.pairs, cold), (BY_WORD, t.word, t.before, t.rare_word), (BY_CONTEXT, t.before, t.word, t.rare_before)):
                        asked[k].append((keys[some], others[some], t.of[some] + first))
                    first += t.n
                for k, parts in asked.items():
                    keys, others, of = (np.concatenate(x) for x in zip(*parts))
                    yield from _deal_wide(shared.value, k, keys, None if k == HOT_PAIRS else others, of, groups, names=names)
                yield _wide(int(_names_hash(names)[0] % np.uint64(groups)), NAMES, _names_hash(names), names)

    def slim(batches):
        for batch in batches:
            for bucket, (k, keys, others, counts, _) in zip(batch.column(0).to_pylist(), _read(batch)):
                counts = np.frombuffer(counts, np.uint32)
                if k == BY_WORD:
                    keys = pair_hashes(_unpacked(shared.value, others, len(keys))[0], keys)
                    order = np.argsort(keys, kind="stable")
                    keys, counts = keys[order], counts[order]
                yield _wide(bucket, k, keys, None, counts)

    def far(key, batches):
        m = shared.value
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        found, wanted, own, told = {}, [], [], {}
        for batch in batches:
            for k, keys, others, counts, docs in _read(batch):
                if k == NAMES:
                    yield _answer(keys, names=others)
                elif k == WEIGHTS:
                    own.append((keys, np.stack([np.frombuffer(others, np.float64), np.frombuffer(counts, np.float64)], 1)))
                elif docs.size:
                    wanted.append((k, keys, others, counts, docs))
                else:
                    found.setdefault(k, []).append((keys, np.frombuffer(counts, np.uint32)))
        tables = {HOT_PAIRS: (np.zeros(0, np.uint32), none[1])} | {k: _one_table(v) for k, v in found.items()}
        own = _one_table(own) if own else (none[0], np.zeros((0, 2)))
        found.clear()
        for k, keys, others, of, at in wanted:
            hand_out = np.frombuffer(at, np.uint64)
            of = np.frombuffer(of, _place_type(int(hand_out[1])))
            known, base = np.zeros(len(keys)), np.zeros(len(keys))
            if k == HOT_PAIRS:
                value = np.log10(m.pair((keys >> 16).astype(np.int64), (keys & 0xFFFF).astype(np.int64), _count_at(tables[k], keys)))
            elif k == BY_WORD:
                before, h = _unpacked(m, others, len(keys))
                c = _count_at(tables.get(k, none), pair_hashes(before, keys))
                n = _count_at(tables.get(WORDS, none), keys)
                alone = m.word_mass(n)
                after_hot = np.where(c > 0, m.seen[h] * _discounted(c, m.pair_factors) / np.maximum(m.totals[h], 1), m.bow[h] * alone)
                value = np.log10(np.where(h != m.other, after_hot, np.where(c > 0, 1.0, alone)))
                known, base = n > 0, m.base(n)
            else:
                word, w = _unpacked(m, others, len(keys))
                c = _count_at(tables.get(k, none), pair_hashes(keys, word))
                at, there = _looked_up(own[0], keys)
                share, bow = np.where(there[:, None], own[1][at], 1.0).T if len(own[0]) else np.ones((2, len(keys)))
                value = np.log10(np.where(c > 0, share * _discounted(c, m.pair_factors), bow * np.where(w != m.other, m.p1[w], 1.0)))
            told.setdefault(hand_out[0], []).append(_summed(of, np.stack([known, base, value])))
        for at, parts in told.items():
            yield _answer(np.array([at]), *_summed(*(np.concatenate(x, axis=-1) for x in zip(*parts))))

    def tell(key, batches):
        """What all buckets answered for one hand-out, added up and given to its documents."""
        names, answers = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                named, places, sums = (batch.column(c)[i].as_buffer() for c in (1, 2, 3))
                if named.size:
                    names = np.frombuffer(named, np.int64)
                else:
                    places = np.frombuffer(places, np.uint32)
                    answers.append((places, np.frombuffer(sums, np.float64).reshape(3, len(places))))
        total = np.zeros((3, len(names)))
        for places, sums in answers:
            total[:, places] += sums
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(x) for x in total]], ["key", "known", "base", "value"])

    own = rows.mapInArrow(near, f"id {kind}, key long, n_tokens long, known double, base double, value double")
    tables = words.unionByName(pairs.where(F.col("kind").isin(HOT_PAIRS, BY_WORD)).mapInArrow(slim, _WIDE)).unionByName(weights)
    tables = tables.withColumn("bucket", (F.col("bucket") % groups).cast("int"))
    sent = rows.mapInArrow(send, _WIDE).unionByName(tables)
    answers = sent.groupBy("bucket").applyInArrow(_as_iterator(far), "at long, names binary, places binary, sums binary")
    back = answers.groupBy("at").applyInArrow(_as_iterator(tell), "key long, known double, base double, value double")
    return _together(own, back)


def score_documents(docs: DataFrame, training: str, vocabulary: int = 65_000, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Fit on the rows that fulfil ``training`` (a condition on ``id``) and score all rows; see ``score`` for the columns.

    Every word has its own pairs; ``vocabulary`` is only how many words all tasks keep at hand.
    """
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text"))
    fitted = fit_all(texts.where(training), vocabulary)
    return score_all(texts, fitted).withColumn("train_tokens", F.lit(fitted[0].tokens).cast("long"))
