"""Versioned tables on plain Parquet.

A version is a folder per table, under a name of its own, plus one commit file
written last, which names the folder.  Readers only see committed versions, so
half a batch is never visible.  Of two writers that want the same version number
one creates the commit file; the other gets ``CommitConflict`` and has touched
nothing that a reader sees.  A *delta* adds rows (new contents, chunks and path
changes) without touching older files; a *base* rewrites the tables and hides
everything before it.

Every ``CHECKPOINT_EVERY`` versions a checkpoint is written: one file with the
visible part of the commit log, and the path rows of the versions since the last
one merged to a *run*, one row per path, in folders by hash bucket.  Runs are
merged by levels: a new run takes up the newest runs that are not much larger
than itself, so few runs exist and a row is rewritten a few times only.  A
reader opens the newest checkpoint and the commit files after it, however many
versions there have been.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.session import remove_folder

TABLES = {
    "content": schemas.CONTENT,
    "paths": schemas.PATHS + ", deleted boolean, version bigint",
    "chunks": schemas.CHUNKS,
}


def _latest(rows: DataFrame) -> DataFrame:
    """The newest row of every path; of one version a row that is there before a deletion."""
    found = rows.groupBy(F.col("path").alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct("version", ~F.col("deleted"), "last_verified")).alias("r"))
    return found.select(*[F.col(f"r.{c}") for c in rows.columns])


class CommitConflict(RuntimeError):
    """Another writer committed a version since this one was planned; plan again on what it wrote."""


def retried(plan: Callable, store: "Store", attempts: int = 5):
    """``plan()`` again after a conflict, each time on the newest version."""
    for left in range(attempts - 1, -1, -1):
        try:
            return plan()
        except CommitConflict:
            store.status(refresh=True)
            if not left:
                raise


CHECKPOINT_EVERY = 50
#: Hash buckets of a run, and how much larger an older run may be to be merged with a new one.
BUCKETS, LEVEL = 16, 4
_RUN = TABLES["paths"] + ", bucket int"


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Store:
    """Content, paths and chunks below one folder; reads see the version known when they were first asked."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: list | None = None
        self._point: dict = {"version": -1, "rows": [], "runs": []}

    def _files(self, name: str = "commits"):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return jvm, folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, folder: str, version: int) -> str | None:
        """A small file of the log, or None where there is none."""
        jvm, where, files = self._files(folder)
        path = jvm.org.apache.hadoop.fs.Path(where, f"{version:012d}.json")
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, folder: str) -> list[int]:
        _, where, files = self._files(folder)
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _tail(self) -> list[tuple[int, str]]:
        """Number and text of the commit files after the checkpoint, one after the other until there is none."""
        tail, version = [], self._point["version"] + 1
        while (text := self._text("commits", version)) is not None:
            tail.append((version, text))
            version += 1
        return tail

    def _log(self, refresh: bool = False) -> list[dict]:
        """Visible commit rows, oldest first: those of the checkpoint and of the commit files after it. A commit file that
        its writer did not finish holds no row."""
        if self._seen is None or refresh:
            newest = max(self._versions("log"), default=-1)
            if newest > self._point["version"]:
                self._point = json.loads(self._text("log", newest))
            rows = list(self._point["rows"])
            for _, text in self._tail():
                try:
                    rows.append(json.loads(text))
                except ValueError:
                    continue
            self._seen = rows
        return self._seen

    def _next_version(self) -> int:
        """One more than the last commit file, whether or not its writer finished it."""
        return max([v for v, _ in self._tail()], default=self._point["version"]) + 1

    def status(self, refresh: bool = False) -> dict:
        """Does an index exist, at which version, made of how many versions."""
        log = self._log(refresh)
        if not log:
            return {"indexed": False, "path": self.root, "version": -1, "base": 0, "versions": 0}
        version = log[-1]["version"]
        base = max((r["version"] for r in log if r["is_base"]), default=0)
        versions = sum(r["version"] >= base for r in log)
        return {"indexed": True, "path": self.root, "version": version, "base": base, "versions": versions}

    def _read(self, table: str, log: list) -> DataFrame:
        folders = [f"{self.root}/{table}/{r['folder']}" for r in log if table in r["tables"]]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def _parts(self, table: str) -> DataFrame:
        base = self.status()["base"]
        return self._read(table, [r for r in self._log() if r["version"] >= base])

    def version(self, table: str, version: int) -> DataFrame:
        """The rows one version added to a table."""
        return self._read(table, [r for r in self._log() if r["version"] == version])

    def content(self) -> DataFrame:
        return self._parts("content")

    def chunks(self) -> DataFrame:
        return self._parts("chunks")

    def _runs(self) -> list[dict]:
        """Merged runs that hold visible rows only."""
        return [r for r in self._point["runs"] if r["first"] >= self.status()["base"]]

    def _path_rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Visible path rows: runs, and the versions after them."""
        log, runs = self._log(), self._runs()
        merged = max((r["last"] for r in runs), default=-1)
        rows = self._read("paths", [r for r in log if r["version"] > merged and r["version"] >= self.status()["base"]])
        if buckets is not None:
            rows = rows.where(bucket_of(F.col("path")).isin(buckets))
        for run in runs:
            part = self.spark.read.schema(_RUN).parquet(f"{self.root}/runs/{run['folder']}")
            part = part if buckets is None else part.where(F.col("bucket").isin(buckets))
            rows = rows.unionByName(part.drop("bucket"))
        return rows

    def paths(self, of: DataFrame | None = None) -> DataFrame:
        """Current paths: the newest row per path, deletions removed.

        With ``of``, a small table with a column ``path``, only the buckets of those paths are read.
        """
        buckets = None
        if of is not None:
            buckets = [r[0] for r in of.select(bucket_of(F.col("path"))).distinct().collect()]
        latest = _latest(self._path_rows(buckets))
        return latest.filter(~F.col("deleted")).drop("deleted", "version")

    def has_batch(self, batch_id: str) -> bool:
        if any(r["batch_id"] == batch_id for r in self._log(refresh=True)):
            return True
        if self._point["version"] < 0:
            return False
        return not self.spark.read.schema("batch_id string").parquet(f"{self.root}/batches").where(F.col("batch_id") == batch_id).isEmpty()

    def checkpoint(self) -> None:
        """Write the visible log and merge the path rows that no run holds yet. Of two writers one writes it; readers go on
        meanwhile with what they have."""
        log = self._log(refresh=True)
        version, runs = max([v for v, _ in self._tail()], default=-1), self._runs()
        if version < 0:
            return
        base, merged = self.status()["base"], max((r["last"] for r in runs), default=-1)
        fresh = [r for r in log if r["version"] > merged and r["version"] >= base]
        ids = [(r["batch_id"],) for r in log if r["version"] > self._point["version"]]
        self.spark.createDataFrame(ids, "batch_id string").coalesce(1).write.mode("append").parquet(f"{self.root}/batches")
        if fresh:
            rows, size = self._read("paths", fresh), 0
            size, first = rows.count(), fresh[0]["version"]
            while runs and runs[-1]["rows"] <= LEVEL * size:
                last = runs.pop()
                rows = rows.unionByName(self.spark.read.schema(_RUN).parquet(f"{self.root}/runs/{last['folder']}").drop("bucket"))
                size, first = size + last["rows"], last["first"]
            latest = _latest(rows)
            latest = latest if runs else latest.filter(~F.col("deleted"))  # nothing older is left to be hidden
            folder = f"{first}-{version}-{uuid.uuid4().hex}"
            latest.withColumn("bucket", bucket_of(F.col("path"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/runs/{folder}")
            n = self.spark.read.schema(_RUN).parquet(f"{self.root}/runs/{folder}").count()
            runs = [*runs, {"folder": folder, "first": first, "last": version, "rows": n}]
        visible = [r for r in log if r["version"] >= base]
        self._create("log", version, json.dumps({"version": version, "rows": visible, "runs": runs}))
        jvm, where, files = self._files("log")
        for old in self._versions("log")[:-2]:
            files.delete(jvm.org.apache.hadoop.fs.Path(where, f"{old:012d}.json"), False)
        self._seen = None

    def commit(
        self,
        batch_id: str,
        content: DataFrame | None = None,
        paths: DataFrame | None = None,
        chunks: DataFrame | None = None,
        removed: DataFrame | None = None,
        base: bool = False,
    ) -> int:
        """Write one version; replaying a committed batch id changes nothing.

        ``removed``: paths to delete.  They are logged as such without a look at
        the stored table; of a path both written and removed, the row stays.
        """
        if self.has_batch(batch_id):
            return self.status()["version"]
        version, known = self._next_version(), self.status()["version"]
        path_parts = []
        if paths is not None:
            path_parts.append(paths.withColumn("deleted", F.lit(False)))
        if removed is not None:
            nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schemas.PATHS.split(", ")[1:]]
            path_parts.append(removed.select("path", *nothing).withColumn("deleted", F.lit(True)))
        parts = {"content": content, "chunks": chunks}
        if path_parts:
            log = reduce(lambda a, b: a.unionByName(b), path_parts)
            parts["paths"] = log.withColumn("version", F.lit(version).cast("bigint"))
        parts = {table: rows for table, rows in parts.items() if rows is not None}
        folder = f"v={version}-{uuid.uuid4().hex}"
        for table, rows in parts.items():
            rows.write.parquet(f"{self.root}/{table}/{folder}")
        row = {"version": version, "batch_id": batch_id, "is_base": base or known < 0, "folder": folder, "tables": sorted(parts)}
        try:
            self._create("commits", version, json.dumps(row))
        except CommitConflict:
            for table in parts:
                remove_folder(self.spark, f"{self.root}/{table}/{folder}")
            raise
        self._seen = None
        if version - self._point["version"] >= CHECKPOINT_EVERY:
            try:
                self.checkpoint()
            except CommitConflict:  # another writer has just written it
                self._seen = None
        return version

    def _create(self, name: str, version: int, text: str) -> None:
        """Create a file of the log; the file system lets one writer do so."""
        jvm, folder, files = self._files(name)
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json")
        try:
            out = files.create(target, False)
        except Py4JJavaError as error:
            if files.exists(target):
                raise CommitConflict(f"version {version} of {self.root} was committed by another writer") from error
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def compact(self, batch_id: str) -> int:
        """Rewrite everything visible as a new base, without contents and chunks no path refers to."""
        from quarry.operators.store import without_orphans

        paths = self.paths()
        return self.commit(
            batch_id, without_orphans(self.content(), paths), paths, without_orphans(self.chunks(), paths), base=True
        )
