"""File change log: latest change per path, debounced batches, incremental refresh."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import fixed_values as fv
from quarry import schemas
from quarry.functions import paths as P
from quarry.session import discard, materialize

NEVER = -(2**62)


def read_changes(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a folder of change records (JSON timestamps carry milliseconds by default)."""
    reader = spark.readStream.schema(schemas.CHANGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(folder)


def relevant(changes: DataFrame) -> DataFrame:
    """Changes of files that would be indexed."""
    return changes.filter(P.keep(F.col("path"), "any_part"))


def latest_per_path(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per path: the newest change, with the newest known old path."""
    order = F.struct("ts", "seq")
    keys = [*(by or []), "path"]
    return changes.groupBy(*keys).agg(
        F.max_by("change_type", order).alias("change_type"),
        F.max_by("old_path", F.when(F.col("old_path").isNotNull(), order)).alias("old_path"),
        F.max("ts").alias("ts"), F.max("seq").alias("seq"), F.count("*").alias("n_changes"),
    )


# -------------------------------------------------------------------- debounce
#
# The first change of a root opens a batch that closes ``debounce`` later; the
# next batch opens with the first change at or after that moment.  This chain is
# sequential per root.  To keep a hot root parallel, time is cut into bins: each
# bin computes, for every change that may be the first of a batch, where the
# chain leaves the bin.  Only the exits reachable from the previous bin (changes
# within one debounce of the bin's start, plus one) are chained per root; then
# every bin assigns its own changes.


def _complete_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by ``keys``, re-cut so that no group is split, with the bounds of their groups."""
    carry: pd.DataFrame | None = None

    def cut(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        for key in keys:
            values = pdf[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])

    for batch in batches:
        pdf = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
        if pdf.empty:
            continue
        bounds = cut(pdf)
        carry = pdf.iloc[bounds[-2]:]
        if len(bounds) > 2:
            yield pdf.iloc[: bounds[-2]], bounds[:-1]
    if carry is not None and len(carry):
        yield carry, np.array([0, len(carry)])


def _exits(times: np.ndarray, width: int) -> np.ndarray:
    """Close time of the last batch in the bin, for a chain that enters at each change."""
    following = np.searchsorted(times, times + width, side="left").tolist()
    out = (times + width).tolist()
    for i in range(len(out) - 1, -1, -1):
        if following[i] < len(out):
            out[i] = out[following[i]]
    return np.array(out, dtype=np.int64)


def _summarize(width: int, bin_width: int):
    """Per (root, bin): every change that may enter the chain, with the time at which the chain leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _complete_groups(batches, ["root", "bin"]):
            us, bins = pdf["us"].to_numpy(np.int64), pdf["bin"].to_numpy(np.int64)
            kept, exits = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                times = us[a:b]
                leave = _exits(times, width)
                reach = min(b - a, int(np.searchsorted(times, bins[a] * bin_width + width, side="left")) + 1)
                kept.append(np.arange(a, a + reach))
                exits.append(leave[:reach])
            rows = np.concatenate(kept)
            yield pd.DataFrame(
                {"root": pdf["root"].to_numpy()[rows], "bin": bins[rows], "entry": us[rows], "exit": np.concatenate(exits)}
            )

    return run


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the bins of every root: the earliest moment a batch may open in each bin."""
    for pdf, bounds in _complete_groups(batches, ["root"]):
        bins = pdf["bin"].to_numpy(np.int64)
        entry, leave = pdf["entry"].to_numpy(np.int64), pdf["exit"].to_numpy(np.int64)
        rows, free_from = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            free = NEVER
            starts = [a, *(a + 1 + np.flatnonzero(bins[a + 1 : b] != bins[a : b - 1])).tolist(), b]
            for c, d in zip(starts[:-1], starts[1:]):
                rows.append(c)
                free_from.append(free)
                at = c + int(np.searchsorted(entry[c:d], free, side="left"))
                if at < d:
                    free = int(leave[at])
        yield pd.DataFrame({"root": pdf["root"].to_numpy()[rows], "bin": bins[rows], "free_from": free_from})


def _open_batches(width: int):
    """Per (root, bin): the opening time of the batch of every change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _complete_groups(batches, ["root", "bin"]):
            us, free_from = pdf["us"].to_numpy(np.int64), pdf["free_from"].to_numpy(np.int64)
            opened = np.empty(len(pdf), dtype=np.int64)
            for a, b in zip(bounds[:-1], bounds[1:]):
                times, free = us[a:b], int(free_from[a])
                at = int(np.searchsorted(times, free, side="left"))
                opened[a : a + at] = free - width
                while at < b - a:
                    end = int(np.searchsorted(times, times[at] + width, side="left"))
                    opened[a + at : a + end] = times[at]
                    at = end
            yield pdf.drop(columns=["free_from", "bin"]).assign(opened_us=opened)

    return run


def debounce(changes: DataFrame, width_ms: int = fv.DEBOUNCE_MS, bin_width_ms: int | None = None) -> DataFrame:
    """Add ``batch_opened``, the moment the batch of every change was opened, keyed by root."""
    width = width_ms * 1000
    bin_width = (bin_width_ms or width_ms * 1000) * 1000
    columns = [c for c in changes.columns if c != "ts"]
    timed = changes.select(*columns, F.unix_micros("ts").alias("us")).withColumn("bin", F.floor(F.col("us") / bin_width))
    root = changes.schema["root"].dataType.simpleString()
    sorted_bins = timed.select("root", "bin", "us").repartition("root", "bin").sortWithinPartitions("root", "bin", "us")
    summary = sorted_bins.mapInPandas(
        _summarize(width, bin_width), f"root {root}, bin bigint, entry bigint, exit bigint"
    )
    sorted_roots = summary.repartition("root").sortWithinPartitions("root", "bin", "entry")
    entries = sorted_roots.mapInPandas(_walk, f"root {root}, bin bigint, free_from bigint")
    located = timed.join(entries, ["root", "bin"]).select(*columns, "us", "bin", "free_from")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.select(*columns, "us").schema.fields)
    opened = located.repartition("root", "bin").sortWithinPartitions("root", "bin", "us").mapInPandas(
        _open_batches(width), shape + ", opened_us bigint"
    )
    return opened.withColumns(
        {"ts": F.timestamp_micros("us"), "batch_opened": F.timestamp_micros("opened_us")}
    ).drop("us", "opened_us")


def batches(debounced: DataFrame) -> DataFrame:
    """Per batch the latest change of every path."""
    return latest_per_path(debounced, ["root", "batch_opened"])


def debounce_approximate(changes: DataFrame, width: str) -> DataFrame:
    """Tumbling windows instead of anchored ones: cheaper, batches may split differently."""
    opened = F.window("ts", width)["start"]
    return latest_per_path(changes.withColumn("batch_opened", opened), ["root", "batch_opened"])


# ------------------------------------------------------------------- streaming


class StreamState:
    """Tables that a stream hands from one micro-batch to the next, in one folder per step below ``folder``.

    A step is named ``batch.n``: n is 0 for the micro-batch itself and counts on for what is done between two batches. It
    counts once its clock is written, which comes last, so a step that is repeated after a failure starts from the step
    before it and writes the same again. Older steps are removed.
    """

    CLOCK = "watermark bigint, newest bigint, late bigint, on_time bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def steps(self) -> list[tuple[int, int]]:
        """Finished steps in order."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = [f.getPath() for f in self._files.listStatus(self._path(self.folder))]
        done = [p.getName() for p in found if self._files.exists(self._path(f"{p.toString()}/clock/_SUCCESS"))]
        return sorted(tuple(int(n) for n in name.split(".")) for name in done)

    def before(self, batch_id: int) -> tuple[int, int] | None:
        """The newest finished step of the micro-batches before this one."""
        return max((s for s in self.steps() if s[0] < batch_id), default=None)

    def table(self, step: tuple[int, int] | None, name: str, schema) -> DataFrame:
        if step is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{step[0]}.{step[1]}/{name}")

    def watermark(self, step: tuple[int, int] | None) -> int:
        row = self.table(step, "clock", self.CLOCK).first()
        return row["watermark"] if row else NEVER

    def finish(self, step: tuple[int, int], tables: dict[str, DataFrame], clock: tuple) -> None:
        """Write the tables of a step and then its clock; steps before the previous batch go."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{step[0]}.{step[1]}/{name}")
        self.spark.createDataFrame([clock], self.CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{step[0]}.{step[1]}/clock")
        for old in self.steps():
            if old[0] < step[0] - 1:
                self._files.delete(self._path(f"{self.folder}/{old[0]}.{old[1]}"), True)


def _advanced(watermark: int, newest: int | None, delay_us: int) -> int:
    return watermark if newest is None else max(watermark, newest - delay_us)


def _noted(rows: DataFrame, watermark: int, path: str) -> tuple[DataFrame, dict]:
    """The rows written with ``late``, their time before the watermark, and what was observed while they were written."""
    us, late = F.unix_micros("ts"), F.coalesce(F.unix_micros("ts") < F.lit(watermark), F.lit(False))
    seen = Observation()
    flagged = rows.withColumn("late", late).observe(
        seen, F.max(us).alias("newest"), F.min(us).alias("oldest"), F.count_if(F.col("late")).alias("late"), F.count_if(~F.col("late")).alias("on_time"))
    flagged.write.mode("overwrite").partitionBy("late").parquet(path)
    return rows.sparkSession.read.schema(flagged.schema).parquet(path), seen.get


def run_split_late(changes: DataFrame, out: str, checkpoint: str, delay_ms: int, trigger: dict | None = None):
    """Write the stream to ``out``, rows that come too late apart from those on time (``late=true`` and ``late=false``).

    The watermark of a micro-batch is the newest time of all batches before it less ``delay_ms``, and never goes back; rows
    older than that are late, rows without a time never are. Counts and watermark of each batch are observed in the pass
    that writes the rows: ``late_log`` has them. Replaying a batch writes the same again.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        state = StreamState(batch.sparkSession, checkpoint + "-state")
        watermark = state.watermark(state.before(batch_id))
        _, seen = _noted(batch, watermark, f"{out}/rows/batch={batch_id}")
        log = batch.sparkSession.createDataFrame(
            [(None if watermark == NEVER else watermark, seen["late"], seen["on_time"])], "watermark bigint, late bigint, on_time bigint")
        log.coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
        state.finish((batch_id, 0), {}, (_advanced(watermark, seen["newest"], delay_ms * 1000), seen["newest"], seen["late"], seen["on_time"]))

    return _started(changes, apply, checkpoint, trigger)


def late_log(spark: SparkSession, out: str) -> DataFrame:
    """Per micro-batch of ``run_split_late``: batch, watermark (micros, null before the first times are known), late, on_time."""
    return spark.read.schema("watermark bigint, late bigint, on_time bigint, batch bigint").parquet(f"{out}/log")


def split_late_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows that ``run_split_late`` wrote, with ``late`` and ``batch``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])).parquet(f"{out}/rows")


def _started(changes: DataFrame, apply, checkpoint: str, trigger: dict | None):
    return (
        changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


#: Type of the records that only tell the time.
HEARTBEAT = "heartbeat"


def with_heartbeat(changes: DataFrame) -> DataFrame:
    """The stream with a record every second that carries the wall clock, so that micro-batches come when nothing changes."""
    ticks = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    made = {"ts": F.col("timestamp"), "change_type": F.lit(HEARTBEAT)}
    return changes.unionByName(ticks.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in changes.schema.fields]))


class DebouncedStream:
    """Debounced batches of a change stream, the binned batch plan run on every micro-batch.

    The changes of a root's open batch are carried from one micro-batch to the next as table rows; the plan runs over them
    and the new changes together, so one root's changes are spread over many tasks. A batch is closed and comes out once the
    watermark (newest time seen less ``delay_ms``) has passed its end, or by the wall clock: in a micro-batch that only holds
    heartbeats, and by :meth:`expire` for a stream that does not run. After a log that has ended :meth:`close` lets out the
    rest, for times may lie ahead of the clock. Changes older than the watermark come out at once as batches
    of their own, marked ``late``, and so do changes without a time, in batches without one. Output: root, batch_opened, path, change_type, old_path, ts, seq, n_changes, late.
    """

    def __init__(self, out: str, checkpoint: str, width_ms: int = fv.DEBOUNCE_MS, delay_ms: int = 0):
        self.out, self.checkpoint = out.rstrip("/"), checkpoint.rstrip("/")
        self.width, self.delay = width_ms * 1000, delay_ms * 1000

    def start(self, changes: DataFrame, trigger: dict | None = None):
        return _started(changes, self._apply, self.checkpoint, trigger)

    def batches(self, spark: SparkSession) -> DataFrame:
        """What has come out so far."""
        shape = ("root string, batch_opened timestamp, path string, change_type string, old_path string, ts timestamp, "
                 "seq bigint, n_changes bigint, late boolean, step string")
        return spark.read.schema(shape).parquet(self.out).drop("step")

    def _bin_ms(self, seen: dict, tasks: int) -> int:
        """Bins so wide that a root which fills the whole span is cut for a few times as many tasks, but of four widths at
        least: only changes within a width of a bin's beginning are chained from bin to bin."""
        span = 0 if seen["newest"] is None else seen["newest"] - seen["oldest"]
        return max(4 * self.width, span // (4 * tasks)) // 1000 + 1

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = StreamState(spark, self.checkpoint + "-state")
        before = state.before(batch_id)
        watermark = state.watermark(before)
        shaped = batch.select("root", "path", "change_type", "old_path", "ts", "seq")
        noted, seen = _noted(relevant(shaped), watermark, f"{self.checkpoint}-noted")
        rows = noted.where("not late and ts is not null").drop("late").unionByName(state.table(before, "open", _OPEN))
        opened = debounce(rows, self.width // 1000, self._bin_ms(seen, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        after = until = _advanced(watermark, seen["newest"], self.delay)
        if seen["newest"] is None:
            now = shaped.where(F.col("change_type") == HEARTBEAT).agg(F.max(F.unix_micros("ts"))).first()[0]
            until = after if now is None else max(after, now - self.delay)
        late = noted.where("late or ts is null").withColumn("batch_opened", F.min("ts").over(Window.partitionBy("root", "path")))
        self._step(state, (batch_id, 0), opened, until, after, late, seen)

    def _step(self, state: StreamState, step: tuple[int, int], opened: DataFrame, until: int, watermark: int, late: DataFrame | None, seen: dict) -> None:
        """Let out the batches that end until then; the others stay open."""
        written = materialize(opened, "opened")
        closed = F.unix_micros("batch_opened") + self.width <= until
        done = batches(written.where(closed)).withColumn("late", F.lit(False))
        if late is not None:
            done = done.unionByName(batches(late).withColumn("late", F.lit(True)))
        done.write.mode("overwrite").parquet(f"{self.out}/step={step[0]}.{step[1]}")
        if until > watermark:  # by the wall clock: nothing may join what came out
            last = written.where(closed).agg(F.max(F.unix_micros("batch_opened"))).first()[0]
            watermark = watermark if last is None else max(watermark, last + self.width)
        state.finish(step, {"open": written.where(~closed).drop("batch_opened")}, (watermark, seen.get("newest"), seen.get("late", 0), seen.get("on_time", 0)))
        discard(written)

    def expire(self, spark: SparkSession, now_us: int | None = None) -> None:
        """Let out what is open although its end has passed by the clock; for a stream that does not run."""
        now = time.time_ns() // 1000 if now_us is None else now_us
        self._let_out(spark, now - self.delay)

    def close(self, spark: SparkSession) -> None:
        """Let out all that is open, whatever the clock says; for a log that has ended, to which nothing will be added."""
        self._let_out(spark, -NEVER)

    def _let_out(self, spark: SparkSession, until: int) -> None:
        state = StreamState(spark, self.checkpoint + "-state")
        last = max(state.steps(), default=None)
        if last is not None:
            opened = debounce(state.table(last, "open", _OPEN), self.width // 1000)
            self._step(state, (last[0], last[1] + 1), opened, until, state.watermark(last), None, {})


_OPEN = "root string, path string, change_type string, old_path string, ts timestamp, seq bigint"


def stream_id(spark, checkpoint: str) -> str:
    """The name of a stream, kept beside its checkpoint: the same after a restart, another one for a new checkpoint."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream-name")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(path.toString()).first()[0]


def run_incremental(changes: DataFrame, store, current_files, home: str, checkpoint: str, trigger: dict | None = None,
                    fold_after: int = 64):
    """Apply every micro-batch to the store; the batch id, which names the stream too, makes a replay harmless.

    ``current_files``: function (SparkSession) to DataFrame of the files as they are now. After ``fold_after`` versions
    the store is compacted. A version that another writer committed meanwhile makes the batch plan again.
    """
    from quarry.plans.index import apply_changes
    from quarry.plans.snapshot import retried

    name = stream_id(changes.sparkSession, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = latest_per_path(relevant(batch))
        files = current_files(batch.sparkSession)
        retried(lambda: apply_changes(store, latest, files, home, f"stream-{name}-{batch_id}"), store)
        if store.status(refresh=True)["versions"] > fold_after:
            retried(lambda: store.compact(f"fold-{name}-{batch_id}"), store)

    return _started(changes, apply, checkpoint, trigger)
