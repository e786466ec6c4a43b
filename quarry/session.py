"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "quarry", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of few bytes: texts and files may be long, and a task holds batches several times.

    A setting of the session, which a user of the operators makes; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextlib.contextmanager
def stateful_streams(spark: SparkSession, idle_batches: bool = True):
    """Streams started inside keep their state in RocksDB, which operators with several states and timers need.

    Without ``idle_batches`` no micro-batch runs when there are no new rows: a stream with timers that reads what is
    available then ends, while otherwise it would wait for its timers for ever.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower(),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """What a query started inside has shuffled is removed from the executors' disks when the query ends.

    Otherwise it stays until the driver happens to collect its garbage. For jobs whose queries follow one another and that
    execute no table twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        named = _LOCAL_DIRS[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing folder below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str = "stage"):
    """Write once to the shared folder and read back: reused by several consumers, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*written) -> None:
    """Remove tables of ``materialize`` that nothing will read again: their consumers are written themselves."""
    for df in written:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
