"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and names the closest signed axis.
``K`` hashes make the key of a table; a vector lies in the bucket of its key and looks into those of its next likely keys.
The number of hashes follows the logarithm of the number of vectors; the number of tables is the least that finds a pair at
the threshold with probability ``recall``, by a simulation of the hash. Every pair that meets is verified in double
precision, in the first bucket where it meets only, so that links can be counted without a list of all pairs: a bucket
gives out one count per vector and a spanning forest. Equal vectors are one class with a number of copies. A bucket with
more than ``BLOCK`` vectors is cut into blocks, and each pair of blocks is a unit of work of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.line_dedup import _as_iterator
from quarry.session import discard, materialize

BLOCK = 4096
PROBES = 4
_NEXT = 4  # closest axes of one hash that take part in probes
_UNIT_ENTRIES = 1 << 15


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Hashes:
    """The random signs of all tables (tables, K, 3, D)."""

    signs: np.ndarray

    @classmethod
    def make(cls, tables: int, k: int, dims: int, seed: int = 11) -> "Hashes":
        d = 1 << max(1, (dims - 1).bit_length())
        return cls(np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, k, 3, d)))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Keys (n, tables, PROBES), the likeliest first, of unit vectors."""
        tables, k, _, d = self.signs.shape
        n = len(vectors)
        padded = np.zeros((n, d))
        padded[:, :vectors.shape[1]] = vectors
        out = np.zeros((n, tables, PROBES), np.int64)
        for t in range(tables):
            cost, key = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
            for f in range(k):
                y = padded
                for signs in self.signs[t, f]:
                    y = hadamard(y * signs)
                axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :_NEXT]
                value = np.take_along_axis(y, axes, 1)
                names = axes * 2 + (value < 0)
                away = (np.abs(value[:, :1]) - np.abs(value)) ** 2
                cost = (cost[:, :, None] + away[:, None, :]).reshape(n, -1)
                key = (key[:, :, None] * (2 * d) + names[:, None, :]).reshape(n, -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
                cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
            out[:, t, :key.shape[1]] = key
            out[:, t, key.shape[1]:] = key[:, -1:]
        return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per table, whether pairs of keys (n, tables, PROBES) meet: one's own bucket is among the other's."""
    return (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)


def plan(n: int, dims: int, cosine: float, recall: float) -> tuple[int, int]:
    """(tables, K) for ``n`` vectors: K near log n in base 2D, tables for ``recall`` at the threshold."""
    d = 1 << max(1, (dims - 1).bit_length())
    k = min(6, max(1, round(np.log(max(n, 2)) / np.log(2 * d))))
    rng = np.random.default_rng(5)
    a = rng.standard_normal((1500, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dims < 2:
        return 1, k
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    found = meet(Hashes.make(2, k, dims, 3).keys(a), Hashes.make(2, k, dims, 3).keys(b)).mean()
    return (1 if found > 1 - 1e-9 else int(np.ceil(np.log(1 - recall) / np.log(1 - found)))), k


def _linked(vectors, keys, table, key, cosine, first, second, weight):
    """Links counted per vector and component labels of one unit: pairs of a ``first`` and a ``second`` member."""
    n = len(vectors)
    links, label = np.zeros(n, np.int64), np.arange(n)
    own = keys[:, table, 0] == key
    for a in range(0, n, 512):
        close = vectors[a:a + 512] @ vectors.T >= cosine
        i, j = np.nonzero(close)
        i = i + a
        fits = (i < j) & (own[i] | own[j]) & ((first[i] & second[j]) | (second[i] & first[j]))
        i, j = i[fits], j[fits]
        for s in range(0, len(i), 1 << 16):
            x, y = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            new = np.ones(len(x), bool)
            if table:
                new &= ~meet(keys[x, :table], keys[y, :table]).any(axis=1)
            kx, ky = keys[x, table], keys[y, table]
            at_x, at_y = (ky == kx[:, :1]).any(axis=1), (kx == ky[:, :1]).any(axis=1)  # they meet in x's bucket, in y's
            least = np.minimum(np.where(at_x, kx[:, 0], np.iinfo(np.int64).max), np.where(at_y, ky[:, 0], np.iinfo(np.int64).max))
            new &= least == key
            x, y = x[new], y[new]
            links += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
            while True:
                lx, ly = label[x], label[y]
                apart = lx != ly
                if not apart.any():
                    break
                x, y, low = x[apart], y[apart], np.minimum(lx, ly)[apart]
                np.minimum.at(label, lx[apart], low)
                np.minimum.at(label, ly[apart], low)
                while (label[label] != label).any():
                    label = label[label]
    return links, label


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``, ``kept``.

    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. A null id links with nothing, has a null component and is kept. Rows with equal ids are rows of
    their own that share a component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialize(rows.withColumn("v", F.when(F.col("id").isNotNull() & finite, F.transform("v", lambda x: x + F.lit(0.0)))), "vectors")
    valid = rows.where("v is not null")
    classes = materialize(valid.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("m")), "classes")
    stated = classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()
    counts, links = [], []
    for dims, n in stated:  # one length of vectors as a rule
        found = materialize(_counts(classes.where(F.size("v") == dims), dims, cosine, *plan(n, dims, cosine, recall)), "counts")
        counts.append(found.groupBy("node").agg(F.sum("links").alias("links")))
        links.append(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    if not stated:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    for more in links[1:]:
        links[0] = links[0].unionByName(more)
    members = valid.join(classes, "v").select("id", "node", "m")
    members = materialize(members.join(counts[0].groupBy("node").agg(F.sum("links").alias("links")), "node", "left"), "members")
    edges = links[0].unionByName(members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")))
    found = common.components(edges)
    discard(classes)
    out = members.select("id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")).unionByName(
        rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links")))
    out = out.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _counts(classes: DataFrame, dims: int, cosine: float, tables: int, k: int) -> DataFrame:
    """(node, links, root) of classes, from each unit of work where a class has links."""
    shared = classes.sparkSession.sparkContext.broadcast(Hashes.make(tables, k, dims))

    def place(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                v = np.array(part.column(0).flatten().to_numpy()).reshape(-1, dims)
                unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
                keys = shared.value.keys(unit)
                entries = [(i, t, key) for i in range(len(v)) for t in range(tables) for key in dict.fromkeys(keys[i, t].tolist())]
                at = pa.array([e[0] for e in entries], pa.int64())
                raw, named = (pa.array([r.tobytes() for r in x], pa.binary()).take(at) for x in (unit, keys))
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(2).take(at), pa.array([e[1] for e in entries], pa.int32()),
                                                  pa.array([e[2] for e in entries], pa.int64()), raw, named], ["node", "m", "t", "key", "unit", "keys"])

    entries = classes.select("v", "node", "m").mapInArrow(place, "node long, m long, t int, key long, unit binary, keys binary")
    slim = entries.groupBy("t", "key").agg(F.count("*").alias("n"))
    large = slim.where(F.col("n") > BLOCK).select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    total = classes.count() * tables * PROBES
    buckets = int(max(classes.sparkSession.sparkContext.defaultParallelism, -(-total // _UNIT_ENTRIES)))
    cut = entries.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("t", "key", "low", "high"), F.lit(buckets)))
    cut = cut.select("bucket", "t", "key", "low", "high", "block", "node", "m", "unit", "keys")

    def work(key, batches):
        table = pa.Table.from_batches(list(batches))
        t, k_, low, high, block, nodes, m = (table[c].to_numpy() for c in ("t", "key", "low", "high", "block", "node", "m"))
        units, keys = table["unit"].combine_chunks(), table["keys"].combine_chunks()
        order = np.lexsort((nodes, high, low, k_, t))
        ids = np.stack([t, k_, low, high], 1)[order]
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1))) if len(ids) else np.zeros(0, np.int64)
        found = [[], [], []]
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)]):
            if b - a < 2:
                continue
            at = order[a:b]
            v = np.frombuffer(b"".join(units[i].as_buffer() for i in at.tolist()), np.float64).reshape(b - a, -1)
            own = np.frombuffer(b"".join(keys[i].as_buffer() for i in at.tolist()), np.int64).reshape(b - a, -1, PROBES)
            links, label = _linked(v, own, int(ids[a, 0]), int(ids[a, 1]), cosine, block[at] == low[at], block[at] == high[at], m[at])
            some = links > 0
            for column, value in zip(found, (nodes[at][some], links[some], nodes[at][label[some]])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in found], ["node", "links", "root"])

    return cut.groupBy("bucket").applyInArrow(_as_iterator(work), "node long, links long, root long")
