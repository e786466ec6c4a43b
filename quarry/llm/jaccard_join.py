"""N-gram Jaccard join with prefix trees: all documents whose shingle sets are similar enough, exactly, as components.

1. Order. A sketch of 2**20 counters over all shingles of all documents gives one global order: rare buckets first, then
   the hash. Any fixed order is correct; this one keeps frequent shingles out of the prefixes.
2. Candidates. Two similar sets share a shingle of their first ``n - ceil(t * n) + 1`` ones. Classes of equal sets count
   once. Only shingles that lie in several prefixes leave the exchange.
3. First links. In each group of a shared shingle the set that has it first, with the fewest shingles of its own before it,
   is the leader. Each set, then each component of those found, is verified with the leader that it shares most with; a few
   rounds of this join nearly all groups of copies with a pair for each member. They only spare work.
4. All other links. Every pair of different components that shares a prefix shingle early enough in both sets (all other
   shared ones must still follow it) is verified. Pairs inside a component are not needed again, so a large group of near
   copies costs one pass, not its square.

Verification joins one set with a prefix tree: the candidate sets, in global order, are walked in the order of the tree, a
common head is intersected once, and a subtree is left as soon as its misses exceed what the longest admissible set
allows. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, spans
from quarry.llm.common import components
from quarry.llm.line_dedup import _as_iterator
from quarry.session import discard, materialize

SKETCH_BITS = 20
SEGMENT = 1 << 14
#: Prefix entries of a bucket and members of a probe's block, which bound the memory of a task.
BUCKET_ENTRIES = 1 << 19
BLOCK = 512
#: Rounds of leaders before all pairs of components that are left, and bits of a map of ids (a prime).
LEADER_ROUNDS = 3
MAP_BITS = 8_388_593


def _shingles(data, offsets, size):
    s, e, rows = spans.words(data, offsets, spans.NOT_BLANK)
    return spans.shingles(spans.hashes(data, s, e), rows, size)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sketch(texts: DataFrame, column: str, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each bucket of their hash."""

    def count(batches):
        common.release()
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in common.text_runs(batch, column):
                grams, _ = _shingles(*common.text_bytes(part.column(part.schema.get_field_index(column))), size)
                total += np.bincount(_bucket(grams), minlength=len(total))
        total = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, SEGMENT)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i].tobytes() for i in used], pa.binary())], ["segment", "counts"])

    def add(key, batches):
        total = np.zeros(SEGMENT, np.int64)
        for batch in batches:
            for part in batch.column(1):
                total += np.frombuffer(part.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["segment", "counts"])

    parts = texts.select(column).mapInArrow(count, "segment int, counts binary")
    merged = parts.groupBy("segment").applyInArrow(_grouped(add), "segment int, counts binary").toArrow()  # 8 MB
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for segment, counts in zip(merged["segment"].to_pylist(), merged["counts"]):
        out[segment * SEGMENT:(segment + 1) * SEGMENT] = np.frombuffer(counts.as_buffer(), np.int64)
    return out.astype(np.float32)


def ordered_sets(data, offsets, size: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in the global order, and their rows."""
    grams, rows = _shingles(data, offsets, size)
    order = np.lexsort((grams, sketch[_bucket(grams)], rows))
    grams, rows = grams[order], rows[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[new], rows[new]
    return grams, rows


def _needed(n, percent):
    """Least overlap of a set of ``n`` with any similar set."""
    return -(-percent * n // 100)


def _pair_needed(a, b, percent):
    return -(-percent * (a + b) // (100 + percent))


def _may_link(n, place, m, other, percent):
    """Whether sets of ``n`` and ``m`` shingles that share one at these places may be similar with it as their first.

    The first shingle that two similar sets share lies in front of all others they share, of which there are enough.
    """
    needed = _pair_needed(n, m, percent)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (place <= n - needed) & (other <= m - needed)


def tree_join(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets, all in the global order, are similar to the probe: one walk over their prefix tree."""
    found: list[int] = []
    n = len(probe)
    if not n:
        return found
    sorted_probe = np.sort(probe)
    longest = n * 100 // percent
    most_missing = longest - _pair_needed(n, longest, percent)
    walk = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    path, misses, dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), None
    for i in walk:
        own = sets[i]
        m = len(own)
        k = min(len(path), m)
        differs = np.flatnonzero(path[:k] != own[:k])
        shared = int(differs[0]) if len(differs) else k
        if dead is not None and shared >= dead:
            continue  # below a node whose misses already exceed every bound
        dead = None
        shared = min(shared, len(misses) - 1)
        at = np.minimum(np.searchsorted(sorted_probe, own[shared:]), n - 1)
        misses = np.concatenate([misses[:shared + 1], misses[shared] + np.cumsum(sorted_probe[at] != own[shared:])])
        path = own
        over = np.flatnonzero(misses > most_missing)
        if len(over):
            dead = int(over[0])
            misses = misses[:dead + 1]
        elif m * 100 >= percent * n and m <= longest and (m - int(misses[m])) >= _pair_needed(n, m, percent):
            found.append(i)
    return found


def _grouped(work):
    """``work`` on the batches of each group; memory freed meanwhile goes back to the system about once a second."""

    def run(key, batches):
        yield from work(key, batches)
        common.trim(1.0)

    return _as_iterator(run)


def _group_columns(batches):
    table = pa.Table.from_batches(list(batches))
    return [table[c].to_numpy() for c in ("gram", "node", "n", "place", "of")]


def _labelled(groups: DataFrame, known: DataFrame | None, buckets: int) -> DataFrame:
    """The groups of shared shingles by bucket, each member with its component so far."""
    of = F.col("node")
    if known is not None:
        groups, of = groups.join(known, "node", "left"), F.coalesce("component_id", "node")
    return groups.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket"), "gram", "node", "n", "place", of.alias("of"))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]


def _of_nodes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts without most of those that a join with ``wanted`` would drop, so that they are not shuffled for it.

    A bit map of the ids modulo a prime, always of the same size, goes to the tasks.
    """
    bit = F.pmod(F.col("node"), F.lit(MAP_BITS))
    parts = wanted.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("k")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    marks = np.zeros(-(-MAP_BITS // 32768) * 4096, np.uint8)
    for k, bits in parts:
        marks[k * 4096:(k + 1) * 4096] = np.frombuffer(bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        common.release()
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy() % MAP_BITS
            yield batch.filter(pa.array((shared.value[ids >> 3] >> (ids & 7)) & 1).cast(pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, sketch) -> DataFrame:
    """The pairs (x, y) that are similar. A probe's candidates are split into blocks, each with the probe's own text."""
    blocks = pairs.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = pairs.join(blocks, "x").select("x", F.pmod(F.xxhash64("y"), "blocks").alias("block"), F.col("y").alias("node"))
    probes = blocks.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("x").alias("node"))
    wanted = materialize(members.unionByName(probes), "wanted")
    rows = wanted.join(_of_nodes(texts, wanted).withColumnRenamed("id", "node"), "node")

    def join(key, batches):
        x = key[0].as_py()
        probes, nodes, sets = [], [], []
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                data, offsets = common.text_bytes(part.column(part.schema.get_field_index("text")))
                grams, at = ordered_sets(data, offsets, size, sketch.value)
                bounds = np.searchsorted(at, np.arange(part.num_rows + 1))
                for i, node in enumerate(part.column(part.schema.get_field_index("node")).to_pylist()):
                    own = grams[bounds[i]:bounds[i + 1]].copy()
                    if node == x:
                        probes.append(own)
                    else:
                        nodes.append(node)
                        sets.append(own)
        hits = sorted({nodes[i] for probe in probes for i in tree_join(probe, sets, percent)})
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(hits), pa.int64()), pa.array(hits, pa.int64())], ["a", "b"])

    return rows.groupBy("x", "block").applyInArrow(_grouped(join), "a long, b long")


def similar_components(docs: DataFrame, size: int = 4, percent: int = 85, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words lie between blanks, A-Z lower-cased. A text with fewer than ``size`` words is one shingle; without words it has
    none and links with nothing. Two documents link when 100 * intersection >= percent * union. Equal ids are one document
    for the components and keep one row each; a null id links with nothing and has a null component. An empty table gives
    no rows. Ids are integers.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text"))
    sketch = spark.sparkContext.broadcast(shingle_sketch(texts, "text", size))

    def describe(batches):
        common.release()
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                grams, rows = ordered_sets(*common.text_bytes(part.column(1)), size, sketch.value)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                n = np.diff(bounds)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(spans.mix(grams ^ np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
                keys = [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]
                length = n - _needed(n, percent) + (n > 0)
                heads = [grams[a:a + k].tobytes() for a, k in zip(bounds[:-1].tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *keys, pa.array(heads, pa.binary())], ["id", "n", "k1", "k2", "head"])

    sets = materialize(texts.mapInArrow(describe, "id long, n long, k1 long, k2 long, head binary"), "sets")
    filled = sets.where("n > 0 and id is not null")
    classes = materialize(filled.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.any_value("head").alias("head")), "classes")
    entries = classes.agg(F.sum(F.length("head") / 8)).first()[0] or 0
    buckets = int(max(spark.sparkContext.defaultParallelism, -(-entries // BUCKET_ENTRIES)))

    def deal(batches):
        common.release()
        for batch in batches:
            heads = batch.column(2)
            if not len(heads):
                continue
            lengths = np.array([len(h.as_buffer()) >> 3 for h in heads])
            grams = np.frombuffer(b"".join(h.as_buffer() for h in heads), np.uint64)
            nodes, n = (np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 1))
            places = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            to = (spans.mix(grams) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            grams, nodes, n, places = grams[order], nodes[order], n[order].astype(np.int32), places[order].astype(np.int32)
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [
                pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in used], pa.binary()) for x in (grams, nodes, n, places)],
                ["bucket", "grams", "nodes", "sizes", "places"])

    def shared(key, batches):
        parts = [[], [], [], []]
        for batch in batches:
            for i, kind in enumerate((np.uint64, np.int64, np.int32, np.int32)):
                parts[i] += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(i + 1)]
        grams, nodes, n, places = (np.concatenate(p) for p in parts)
        order = np.lexsort((nodes, places, grams))
        grams, nodes, n, places = grams[order], nodes[order], n[order].astype(np.int64), places[order].astype(np.int64)
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(grams)))
        keep = np.repeat(counts, counts) > 1
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (grams.view(np.int64), nodes, n, places)], ["gram", "node", "n", "place"])

    dealt = classes.select("node", "n", "head").mapInArrow(deal, "bucket int, grams binary, nodes binary, sizes binary, places binary")
    groups = materialize(dealt.groupBy("bucket").applyInArrow(_grouped(shared), "gram long, node long, n long, place long"), "groups")

    def leaders(key, batches):
        grams, nodes, n, places, of = _group_columns(batches)
        order = np.lexsort((nodes, places, grams))
        grams, nodes, n, places, of = grams[order], nodes[order], n[order], places[order], of[order]
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        lead = np.repeat(heads, np.diff(np.append(heads, len(grams))))
        fits = (of != of[lead]) & _may_link(n, places, n[lead], places[lead], percent)
        pairs, counts = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if fits.any():
            pairs, counts = np.unique(np.stack([nodes[lead[fits]], nodes[fits], of[fits]], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in pairs.T], pa.array(counts)], ["x", "y", "of", "c"])

    links, tried = [], []
    known = None
    for _ in range(LEADER_ROUNDS):
        found = _labelled(groups, known, buckets).groupBy("bucket").applyInArrow(_grouped(leaders), "x long, y long, of long, c long")
        found = found.groupBy("x", "y").agg(F.max("of").alias("of"), F.sum("c").alias("c"))
        for before in tried:
            found = found.join(before, ["x", "y"], "left_anti")
        best = found.groupBy("of").agg(F.max_by(F.struct("x", "y"), F.struct("c", "x", "y")).alias("p"))
        tried.append(materialize(best.select("p.x", "p.y"), "pairs"))
        links.append(materialize(_verified(tried[-1], texts, size, percent, sketch), "links"))
        known = components(reduce(DataFrame.unionByName, links))

    def across(key, batches):
        grams, nodes, n, places, of = _group_columns(batches)
        order = np.lexsort((n, grams))
        grams, nodes, n, places, of = grams[order], nodes[order], n[order], places[order], of[order]
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        mixed = np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads) if len(heads) else heads.astype(bool)
        stops = np.append(heads[1:], len(grams))
        pairs, size = [np.zeros((0, 2), np.int64)], 0
        for a, b in zip(heads[mixed].tolist(), stops[mixed].tolist()):
            names, counts = np.unique(of[a:b], return_counts=True)
            is_minor = of[a:b] != names[np.argmax(counts)]
            minor = np.flatnonzero(is_minor)
            for k in range(0, len(minor), 32):  # each pair once: minors with the largest component and with later minors
                i = minor[k:k + 32]
                low = a + int(np.searchsorted(n[a:b], -(-percent * n[a + i[0]] // 100)))
                high = a + int(np.searchsorted(n[a:b], n[a + i[-1]] * 100 // percent, "right"))
                j = np.arange(low - a, high - a)  # sizes that may fit
                x, y = i[:, None], j[None, :]
                fits = (of[a + x] != of[a + y]) & (~is_minor[y] | (y > x)) & _may_link(n[a + x], places[a + x], n[a + y], places[a + y], percent)
                at, to = np.nonzero(fits)
                x, y = nodes[a + i[at]], nodes[a + j[to]]
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                size += len(x)
                if size > 1 << 18:
                    pairs, size = [_distinct(np.concatenate(pairs))], 0
        x, y = _distinct(np.concatenate(pairs)).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y))], ["x", "y"])

    second = _labelled(groups, known, buckets).groupBy("bucket").applyInArrow(_grouped(across), "x long, y long").distinct()
    for before in tried:
        second = second.join(before.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    tried.append(materialize(second, "pairs"))
    links.append(materialize(_verified(tried[-1], texts, size, percent, sketch), "links"))
    discard(groups, *tried)
    copies = filled.join(classes.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = components(reduce(DataFrame.unionByName, links).unionByName(copies))
    discard(classes, *links)
    out = sets.select("id", "n").join(found, sets["id"] == found["node"], "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

