"""Merkle manifest of a dataset: a hash tree with eight children a parent for every group, and one over the groups.

Rows get their place in a group by a range sort and running counts, so a group of any size lies in many tasks. Runs of
4,096 neighbouring nodes are blocks; a task turns a block into one node, several levels at once, and the nodes of all
blocks are the input of the next pass until one node of each group is left. The same passes over the groups' roots give
the root.

A parent keeps a copy of its hash state before each child slot. To put another digest in a slot, the state kept there is
resumed with the replacement and the right siblings only: what is left of the slot is never hashed again. A block gets
the way from its own node to the root once (siblings on both sides, level by level) and holds the states of those
ancestors likewise, so each row of it is folded up to the root by resuming states only.

Null groups are a group of their own, which comes first; null ids come first in a group, equal ids are ordered by their
leaf; equal rows have a leaf each. An empty table has no root and gives no rows. Texts enter as their hash only, which the
scan takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import discard, materialize

FAN = 8
#: Levels that one pass folds: a block has FAN**HEIGHT nodes.
HEIGHT = 4


def leaf_hash(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns, each as its UTF-8 length, a colon and its text; a null is ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(total: int, height: int) -> int:
    """Levels of a pass over a group of ``total`` nodes: as many as leave one node, or ``height``."""
    n = 0
    while total > 1 and n < height:
        total, n = -(-total // FAN), n + 1
    return n


class Parent:
    """A run of at most ``FAN`` nodes: the hash state before each slot, the nodes right of it, and all others."""

    __slots__ = ("digest", "before", "right", "nodes")

    def __init__(self, nodes: list[bytes]):
        state = hashlib.sha256()
        self.nodes, self.before = nodes, []
        for node in nodes:
            self.before.append(state.copy())
            state.update(node)
        self.digest = state.hexdigest().encode()
        self.right = [b"".join(nodes[i + 1:]) for i in range(len(nodes))]

    def left(self, slot: int) -> bytes:
        return b"".join(self.nodes[:slot])

    def replaced(self, slot: int, node: bytes) -> bytes:
        """The digest with another node in a slot."""
        state = self.before[slot].copy()
        state.update(node)
        state.update(self.right[slot])
        return state.hexdigest().encode()


class Block:
    """The tree over one block, with the way from its top to the root."""

    def __init__(self, nodes: list[bytes], height: int, left: list[str] = (), right: list[str] = ()):
        self.nodes, self.levels = nodes, []
        for _ in range(height):
            self.levels.append([Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
            nodes = [p.digest for p in self.levels[-1]]
        self.digest = nodes[0]
        self.left, self.right = list(left), list(right)
        self.above = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(left, right)]

    def way(self, i: int) -> tuple[list[str], list[str]]:
        """Siblings left and right of node ``i`` and its ancestors, level by level up to the root."""
        left, right = [], []
        for level in self.levels:
            parent = level[i // FAN]
            left.append(parent.left(i % FAN).decode())
            right.append(parent.right[i % FAN].decode())
            i //= FAN
        return left + self.left, right + self.right

    def proofs(self) -> Iterator[str]:
        """For each node the hash of all its siblings, from its own level to the root."""
        tail = [b"".join(a.encode() + b.encode() for a, b in zip(self.left, self.right))]
        for level in reversed(self.levels):
            tail = [p.left(s) + p.right[s] + t for p, t in zip(level, tail) for s in range(len(p.nodes))]
        return (hashlib.sha256(t).hexdigest() for t in tail)

    def folded(self, i: int, node: bytes) -> str:
        """The root with ``node`` in place ``i``."""
        for level in self.levels:
            node = level[i // FAN].replaced(i % FAN, node)
            i //= FAN
        for state, right in self.above:
            state = state.copy()
            state.update(node)
            state.update(right)
            node = state.hexdigest().encode()
        return node.decode()


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, the place in its group by ``order``, and ``total``, the group's size; and the written table
    that this reads.

    A range sort deals each group over as many tasks as its size asks for; tasks number their own rows, and one count per
    group and task is summed up to the first number of each.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    at = rows.columns.index(group)

    def count(batches):
        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for value in batch.column(at).to_pylist():
                now, n = (now, n + 1) if value == now else (value, 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [f.name for f in schema])

    stored = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(count, schema), "numbered")
    same = Window.partitionBy(group)
    before = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(group, "part").agg(F.count("*").alias("n")).select(
        group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(same).alias("total"))
    return stored.join(sizes, [group, "part"]).select(*rows.columns, (F.col("first") + F.col("nth")).alias("pos"), "total"), stored


def _to_block(carried: list[str], height: int):
    def fold(table):
        table = table.sort_by("pos")
        block = Block([n.encode() for n in table.column("node").to_pylist()], levels(table.column("total")[0].as_py(), height))
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("node", *carried)]
        once = [table.column(c)[:1] for c in ("g", "block", "total")]
        return pa.table([*once, pa.array([block.digest.decode()]), *lists], names=["g", "block", "total", "digest", "node", *carried])

    return fold


def _passes(nodes: DataFrame, carried: list[str], height: int) -> list[DataFrame]:
    """Written tables of blocks, pass by pass, from (g, pos, total, node) and columns that the first pass carries along."""
    out: list[DataFrame] = []
    cap = FAN**height
    while True:
        types = {f.name: f.dataType for f in nodes.schema.fields}
        schema = T.StructType([
            T.StructField("g", T.StringType()), T.StructField("block", T.LongType()), T.StructField("total", T.LongType()),
            T.StructField("digest", T.StringType()),
            *[T.StructField(c, T.ArrayType(types[c])) for c in ("node", *carried)]])

        inputs = nodes.select("g", F.expr(f"pos div {cap}").alias("block"), "pos", "total", "node", *carried)
        blocks = materialize(inputs.groupBy("g", "block").applyInArrow(_to_block(carried, height), schema), "blocks")
        out.append(blocks)
        more = blocks.where(F.col("total") > cap)
        if more.isEmpty():
            return out
        nodes = more.select("g", F.col("block").alias("pos"), F.expr(f"(total + {cap - 1}) div {cap}").alias("total"), F.col("digest").alias("node"))
        carried = []


def _tops(passes: list[DataFrame], height: int) -> DataFrame:
    """(g, node): the one node left of each group."""
    return reduce(DataFrame.unionByName, [p.where(F.col("total") <= FAN**height).select("g", F.col("digest").alias("node")) for p in passes])


_WAY = "left array<string>, right array<string>, subroot string, root string"


def _each_block(blocks: DataFrame, ways: DataFrame, carried: list[str], height: int, schema: str, rows: Callable) -> DataFrame:
    """Rows that ``rows(block, record)`` gives for every block, which meets its own way to the root."""
    types = {f.name: f.dataType for f in blocks.schema.fields}
    own = "".join(f", {c} {types[c].elementType.simpleString()}" for c in carried)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.slice(i, 1).to_pylist()[0]
                block = Block([n.encode() for n in record["node"]], levels(record["total"], height), record["left"], record["right"])
                columns = rows(block, record)
                along = [batch.column(batch.schema.names.index(c)).slice(i, 1).flatten() for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, *along], [*names, *carried])

    names = [part.split()[0] for part in schema.split(", ")]
    return blocks.join(ways, ["g", "block"]).mapInArrow(run, schema + own)


def _ways(passes: list[DataFrame], entries: DataFrame, height: int) -> DataFrame:
    """The ways of the blocks of the first pass, from those of the groups' tops, down pass by pass."""
    ways = None
    for p in reversed(range(len(passes))):
        here = passes[p].where(F.col("total") <= FAN**height).select("g", "block").join(entries, "g")
        ways = here if ways is None else here.unionByName(_lower(passes[p + 1], ways, [], height).withColumnRenamed("pos", "block").drop("node"))
    return ways


def _lower(blocks: DataFrame, ways: DataFrame, carried: list[str], height: int) -> DataFrame:
    """The way of every node of the blocks: (g, pos, node, left, right, subroot, root) and the carried columns."""
    def rows(block: Block, record: dict):
        n = len(block.nodes)
        found = [block.way(i) for i in range(n)]
        lists = pa.list_(pa.string())
        return [
            pa.array([record["g"]] * n, pa.string()), pa.array([record["block"] * FAN**height + i for i in range(n)], pa.int64()),
            pa.array(record["node"], pa.string()), pa.array([w[0] for w in found], lists), pa.array([w[1] for w in found], lists),
            pa.array([record["subroot"]] * n, pa.string()), pa.array([record["root"]] * n, pa.string())]

    return _each_block(blocks, ways, carried, height, "g string, pos long, node string, " + _WAY, rows)


@dataclass
class Manifest:
    """Written passes over the groups' leaves and over the groups' roots, and the names of the columns carried along."""

    passes: list[DataFrame]
    top: list[DataFrame]
    names: dict[str, str]
    height: int

    def root(self) -> DataFrame:
        """One row ``root``, or none for an empty table."""
        return _tops(self.top, self.height).select(F.col("node").alias("root"))

    def _entries(self) -> DataFrame:
        """The way from each group's root to the root: (g, left, right, subroot, root)."""
        none = F.array().cast("array<string>")
        start = _tops(self.top, self.height).select("g", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
        found = _lower(self.top[0], _ways(self.top, start, self.height), ["key"], self.height)
        return found.select(F.col("key").alias("g"), "left", "right", F.col("node").alias("subroot"), "root")

    def verify(self, replacement: str | None = None) -> DataFrame:
        """Per leaf the carried columns and ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (hash of its siblings up to
        the root), ``folded_root`` (from the digest in the carried column ``replacement``, where that is not null, else
        from the leaf) and ``verified``. Carried columns of the same name are left out."""
        given = next((c for c, name in self.names.items() if name == replacement), None)

        def rows(block: Block, record: dict):
            n = len(block.nodes)
            new = record[given] if given else [None] * n
            folded = [block.folded(i, new[i].encode() if new[i] is not None else block.nodes[i]) for i in range(n)]
            root = record["root"]
            return [
                pa.array(record["node"], pa.string()), pa.array([record["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()),
                pa.array(block.proofs(), pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]

        outputs = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        fields = ", ".join(f"{n} {'boolean' if n == 'verified' else 'string'}" for n in outputs)
        found = _each_block(self.passes[0], _ways(self.passes, self._entries(), self.height), list(self.names), self.height, fields, rows)
        return found.select(*[F.col(c).alias(n) for c, n in self.names.items() if n.lower() not in outputs], *outputs)


def build(rows: DataFrame, group: Column, leaf: Column, order: str, carried: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``rows``: trees per ``group`` over the ``leaf`` digests in the order of column ``order``.

    ``carried`` are further columns that ``Manifest.verify`` returns, besides the order column; ``height`` changes the size
    of blocks, not the result.
    """
    more = {f"c{i}": item for i, item in enumerate((carried or {}).items())}
    key = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))
    leaves = materialize(rows.select(
        key.alias("g"), leaf.alias("node"), F.col(f"`{order}`").alias("key"), *[c.alias(at) for at, (_, c) in more.items()]), "leaves")
    names = {"key": order, **{at: name for at, (name, _) in more.items()}}
    nodes, stored = numbered(leaves, "g", ["key", "node"])
    passes = _passes(nodes, list(names), height)
    discard(leaves, stored)
    tops, stored = numbered(_tops(passes, height).select(F.lit("").alias("g"), "node", F.col("g").alias("key")), "g", ["key"])
    top = _passes(tops, ["key"], height)
    discard(stored)
    return Manifest(passes, top, names, height)
