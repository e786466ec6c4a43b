import random
import tempfile
import time

from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import chat as CH
from quarry.operators import context as C
from quarry.session import stateful_streams
from quarry.streaming import changes as SC
from quarry.streaming import tokens as TK
from tests.conftest import rows


def change_table(spark, data):
    raw = spark.createDataFrame(data, "root string, seq bigint, us bigint, path string, old_path string, change_type string")
    return raw.withColumn("ts", F.timestamp_micros("us")).select("root", "seq", "ts", "path", "old_path", "change_type")


def anchored(times, width):
    opened, out = None, {}
    for t in sorted(set(times)):
        if opened is None or t >= opened + width:
            opened = t
        out[t] = opened
    return out


def test_debounce_equals_a_sequential_fold(spark):
    random.seed(11)
    data, seq = [], 0
    for root, n, span in (("hot", 3000, 4_000_000), ("calm", 60, 900_000_000), ("one", 1, 10), ("tie", 30, 3_000)):
        for _ in range(n):
            data.append((root, seq, 1_700_000_000_000_000 + random.randrange(span), f"/{root}/f{seq % 7}", None, "modified"))
            seq += 1
    df = change_table(spark, data).repartition(5)
    for width_ms, bin_ms in ((2, 10), (2, 2), (50, 1000), (2000, 5000)):
        got = {r.seq: r.o for r in SC.debounce(df, width_ms, bin_ms).select("seq", F.unix_micros("batch_opened").alias("o")).collect()}
        want = {}
        for root in {r for r, *_ in data}:
            fold = anchored([d[2] for d in data if d[0] == root], width_ms * 1000)
            want |= {d[1]: fold[d[2]] for d in data if d[0] == root}
        assert got == want, (width_ms, bin_ms)


def test_debounce_with_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_debounce_equals_a_sequential_fold(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_latest_change_wins_and_keeps_the_origin(spark):
    df = change_table(spark, [
        ("/r", 1, 10, "/r/a.txt", "/r/old.txt", "moved"), ("/r", 2, 20, "/r/a.txt", None, "modified"),
        ("/r", 3, 10, "/r/b.txt", None, "deleted"), ("/r", 4, 30, "/r/b.txt", None, "created"),
        ("/r", 5, 30, "/r/.git/x", None, "created"),
    ])
    got = {r.path: (r.change_type, r.old_path) for r in SC.latest_per_path(SC.relevant(df)).collect()}
    assert got == {"/r/a.txt": ("modified", "/r/old.txt"), "/r/b.txt": ("created", None)}


def wait_for(found, n, seconds=60):
    """What ``found`` gives, as soon as it has n rows."""
    deadline = time.time() + seconds
    while True:
        time.sleep(1)
        try:
            got = found()
        except Exception:  # nothing written yet
            got = []
        if len(got) >= n or time.time() > deadline:
            return got


BASE = 1_700_000_000_000_000


def stream_of(spark, *files):
    """A folder of changes with one file for each list, in this order."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for data in files:
        change_table(spark, data).coalesce(1).write.mode("append").parquet(folder)
    return folder


def debounced(spark, folder, width, delay=0, job=None):
    job = job or SC.DebouncedStream(folder + "-out", folder + "-state", width, delay)
    job.start(SC.read_changes(spark, folder, "parquet", files_per_trigger=1)).awaitTermination(120)
    return job


def told(job, spark):
    return sorted((r.opened - BASE, r.path, r.n_changes, r.late) for r in job.batches(spark).where("batch_opened is not null").withColumn("opened", F.unix_micros("batch_opened")).collect())


def test_one_hot_root_debounced_over_micro_batches(spark):
    """All changes in one root; batches that begin in one micro-batch and end in another are chained as in one piece."""
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 4_000_000) for _ in range(600))
    data = [("/r", i, BASE + t, f"/r/f{i % 7}", None, "modified") for i, t in enumerate(times)]
    folder = stream_of(spark, data[:250], data[250:251], data[251:])
    job = debounced(spark, folder, 20)
    job.expire(spark)
    opened, expected = None, {}
    for i, t in enumerate(times):
        if opened is None or t >= opened + 20_000:
            opened = t
        expected[opened, f"/r/f{i % 7}"] = expected.get((opened, f"/r/f{i % 7}"), 0) + 1
    assert told(job, spark) == sorted((o, p, n, False) for (o, p), n in expected.items())
    seen = {"oldest": BASE, "newest": BASE + 4_000_000}
    table = change_table(spark, data)
    bins = SC.debounce(table, 20, job._bin_ms(seen, 8)).select((F.unix_micros("ts") / (job._bin_ms(seen, 8) * 1000)).cast("long")).distinct().count()
    assert bins > 16  # one root, many bins for eight tasks


def test_late_changes_come_out_and_the_rest_waits_for_its_time(spark):
    first = [("/r", 1, BASE + 0, "/r/a.txt", None, "modified"), ("/r", 2, BASE + 900_000, "/r/b.txt", None, "modified")]
    untimed = change_table(spark, [("/r", 9, None, "/r/when.txt", None, "created")]).withColumn("ts", F.lit(None).cast("timestamp"))
    second = [("/r", 3, BASE + 100, "/r/late.txt", None, "created"), ("/r", 4, BASE + 950_000, "/r/b.txt", None, "deleted"), ("/r", 5, BASE + 960_000, None, None, "modified")]
    folder = stream_of(spark, first, second)
    untimed.coalesce(1).write.mode("append").parquet(folder)
    job = debounced(spark, folder, 200)
    early = [(0, "/r/a.txt", 1, False), (100, "/r/late.txt", 1, True)]
    assert [(r.path, r.late) for r in job.batches(spark).where("batch_opened is null").collect()] == [("/r/when.txt", True)]
    assert told(job, spark) == early
    job.expire(spark, BASE + 1_000_000)  # the end of the open batch has not come yet
    assert told(job, spark) == early
    job.expire(spark, BASE + 1_200_000)
    job.expire(spark, BASE + 1_300_000)  # nothing is open any more
    whole = sorted([*early, (900_000, "/r/b.txt", 2, False)])
    assert told(job, spark) == whole
    change_table(spark, [("/r", 6, BASE + 950_001, "/r/c.txt", None, "created"), ("/r", 7, BASE + 2_000_000, "/r/d.txt", None, "created")]).write.mode(
        "append").parquet(folder)
    debounced(spark, folder, 200, job=job)  # goes on where it ended; a batch that came out is not opened again
    job.expire(spark)
    assert told(job, spark) == sorted([*whole, (950_001, "/r/c.txt", 1, True), (2_000_000, "/r/d.txt", 1, False)])


def test_heartbeats_let_the_last_batch_out(spark):
    data = [("/r", i, BASE + t, f"/r/f{i % 2}", None, "modified") for i, t in enumerate([0, 500, 2500, 2600])]
    folder = stream_of(spark, data)
    job = SC.DebouncedStream(folder + "-out", folder + "-state", 2)
    running = job.start(SC.with_heartbeat(SC.read_changes(spark, folder, "parquet")), {"processingTime": "1 second"})
    try:
        wait_for(lambda: job.batches(spark).collect(), 4)
        assert told(job, spark) == [(0, "/r/f0", 1, False), (0, "/r/f1", 1, False), (2500, "/r/f0", 1, False), (2500, "/r/f1", 1, False)]
    finally:
        running.stop()


def test_repeated_micro_batch_writes_the_same(spark):
    folder = stream_of(spark, [("/r", 1, BASE, "/r/a.txt", None, "created")])
    job = debounced(spark, folder, 2)
    batch = change_table(spark, [("/r", 2, BASE + 5000, "/r/b.txt", None, "created")])
    job._apply(batch, 1)
    job._apply(batch, 1)
    assert told(job, spark) == [(0, "/r/a.txt", 1, False)]
    job.expire(spark)
    assert told(job, spark) == [(0, "/r/a.txt", 1, False), (5000, "/r/b.txt", 1, False)]


def test_late_rows_apart_over_restarts(spark):
    folder = stream_of(spark, [("/r", 1, BASE + 10_000, "/a", None, "x")], [("/r", 2, BASE + 8_999, "/b", None, "x"), ("/r", 3, BASE + 9_000, "/c", None, "x")])
    out = folder + "-split"
    schema = SC.read_changes(spark, folder, "parquet").schema

    def run():
        SC.run_split_late(SC.read_changes(spark, folder, "parquet", files_per_trigger=1), out, folder + "-state", 1).awaitTermination(120)

    run()
    change_table(spark, [("/r", 4, BASE + 1, "/d", None, "x")]).withColumn("ts", F.when(F.col("seq") == 4, F.lit(None)).otherwise(F.col("ts"))).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = sorted((r.batch, r.watermark and r.watermark - BASE, r.late, r.on_time) for r in SC.late_log(spark, out).collect())
    assert got == [(0, None, 0, 1), (1, 9_000, 1, 1), (2, 9_000, 0, 1)]
    assert [r.path for r in SC.split_late_rows(spark, out, schema).where("late").collect()] == ["/b"]


def test_streamed_replies_come_once_and_leave_no_state(spark):
    """Ended in order, ended before its tokens came, aborted, aborted without text, and abandoned."""
    folder, out = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    files = [
        [(1, 1, 0, "token", "a "), (1, 1, 1, "token", "b"), (1, 1, 2, "finish", None), (1, 2, 2, "finish", None), (1, 2, 0, "token", "late <memory>"),
         (2, 1, 0, "token", "half <memory>x</memory> "), (3, 1, 0, "token", "never ended"), (4, 1, 0, "abort", None)],
        [(1, 2, 1, "token", "y</memory>text"), (2, 1, 1, "abort", None), (3, 1, 1, "token", " at all"), (5, 1, 0, "finish", None)],
    ]
    for i, data in enumerate(files):
        spark.createDataFrame(data, schemas.TOKENS).coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(schemas.TOKENS).option("maxFilesPerTrigger", 1).json(folder)
    with stateful_streams(spark):
        job = TK.assemble_stream(stream, idle_ms=4000).writeStream.format("parquet").option("path", out + "/o").option(
            "checkpointLocation", out + "/c").trigger(processingTime="1 second").start()
        try:
            got = wait_for(lambda: spark.read.parquet(out + "/o").collect(), 5)
            time.sleep(2)
            progress = job.lastProgress
        finally:
            job.stop()
    assert sorted((r.chat_id, r.reply_id, r.content, r.finish_reason) for r in got) == [
        (1, 1, "a b", "finish"), (1, 2, "late text", "finish"), (2, 1, "half <memory>x</memory> ", "abort"), (3, 1, "never ended at all", "abandoned"),
        (5, 1, "", "finish")]
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_assembled_replies(spark):
    data = [
        (1, 1, 2, "token", "b"), (1, 1, 1, "token", "a "), (1, 1, 3, "finish", None),
        (1, 2, 1, "token", "cut <memory>x</memory>"), (1, 2, 2, "abort", None), (2, 1, 1, "abort", None),
        (3, 1, 1, "finish", None), (4, 1, 1, "token", "still going"),
    ]
    df = spark.createDataFrame(data, schemas.TOKENS)
    got = {(r.chat_id, r.reply_id): (r.content, r.finish_reason) for r in TK.assemble(df).collect()}
    assert got == {(1, 1): ("a b", "finish"), (1, 2): ("cut <memory>x</memory>", "abort"), (3, 1): ("", "finish"), (4, 1): ("still going", "open")}


def test_chat_commands(spark):
    chats = spark.createDataFrame([(1, "one", "idle", 5, 5), (2, "two", "idle", 5, 6)], "id bigint, title string, status string, c int, u int")
    chats = chats.select("id", "title", "status", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("u").alias("updated_at"))
    data = [(1, "update", 1, "new", None, 10), (2, "delete", 2, None, None, 11), (3, "create", 3, "three", "idle", 12),
            (4, "update", 3, None, "generating", 13), (5, "update", 2, "late", None, 14), (6, "delete", 9, None, None, 15)]
    commands = spark.createDataFrame(data, "seq bigint, op string, id bigint, title string, status string, t int").withColumn(
        "at", F.timestamp_seconds("t")).drop("t")
    got = {r.id: (r.title, r.status, r.u) for r in CH.apply_commands(chats, commands).select(
        "id", "title", "status", F.unix_seconds("updated_at").alias("u")).collect()}
    assert got == {1: ("new", "idle", 10), 3: ("three", "generating", 13)}


def test_pairs_cross_bucket_borders(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1020, 1030)] + [(2, 0, "user", "alone"), (3, 0, "system", "s")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(rows(CH.question_answer_pairs(df)))
    assert got == [(1, i, f"t{i}", f"t{i + 1}") for i in range(1020, 1030, 2)]


def test_full_system_report(spark):
    df = spark.sql("""select 'h' as host, '2024-01-01 10:00:00' as as_of, 5.5D as uptime_hours,
      named_struct('percent', 12.5D, 'cores_physical', 4, 'cores_logical', 8, 'frequency_mhz', 2400.4D) as cpu,
      named_struct('total_gb', 8.0D, 'used_gb', 6.0D, 'available_gb', 2.0D, 'percent', 75.0D, 'swap_total_gb', 1.0D,
        'swap_used_gb', 0.5D, 'swap_percent', 50.0D) as memory,
      array(named_struct('mount_point', '/', 'free_gb', 10.0D, 'total_gb', 20.0D, 'percent', 50.0D)) as disks,
      array(named_struct('name', 'a', 'pid', 1, 'ram_mb', 9.0D, 'cpu_percent', 1.0D)) as top_by_ram,
      array(named_struct('name', 'b', 'pid', 2, 'ram_mb', 3.0D, 'cpu_percent', 9.0D)) as top_by_cpu,
      named_struct('percent', 80, 'charging', false, 'plugged_in', false, 'time_remaining_mins', 0) as battery""")
    text = C.system_report(df).first().context
    assert text == (
        "\n## System Information (as of 2024-01-01 10:00:00)\n\n**Uptime:** 5.5 hours\n\n### CPU\n- **Usage:** 12.5%\n"
        "- **Cores:** 4 physical, 8 logical\n- **Frequency:** 2400 MHz\n\n### Memory (RAM)\n- **Total:** 8.0 GB\n"
        "- **Used:** 6.0 GB (75.0%)\n- **Available:** 2.0 GB\n- **Swap:** 0.5 / 1.0 GB (50.0%)\n\n### Storage\n"
        "- **/:** 10.0 GB free of 20.0 GB (50.0% used)\n\n### Top Processes (by RAM)\n- **a** (PID 1): 9.0 MB RAM, 1.0% CPU\n\n"
        "### Top Processes (by CPU)\n- **b** (PID 2): 9.0% CPU, 3.0 MB RAM\n\n### Battery\n- **Level:** 80% (On battery)\n"
    )


def test_second_stream_on_one_store(spark):
    """A stream with a new checkpoint counts its batches from 0 again and still gets through; a replay changes nothing."""
    from quarry.plans.snapshot import Store

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = Store(spark, folder + "/store")
    for i in (1, 2):
        change_table(spark, [("/r", 1, i, f"/r/f{i}.txt", None, "created")]).write.json(f"{folder}/changes{i}")
        files = spark.createDataFrame([(f"/r/f{i}.txt", f"text {i}", None)], "path string, text string, mtime timestamp")
        for _ in range(2):  # the second start finds nothing new
            job = SC.run_incremental(SC.read_changes(spark, f"{folder}/changes{i}"), store, lambda _, f=files: f, "/home/u", f"{folder}/state{i}")
            job.awaitTermination()
    assert {r.path for r in store.paths().collect()} == {"/r/f1.txt", "/r/f2.txt"}
    assert store.status(refresh=True)["versions"] == 2
    job = SC.run_incremental(SC.read_changes(spark, f"{folder}/changes1"), store, lambda _: files, "/home/u", f"{folder}/state3", fold_after=2)
    job.awaitTermination()
    assert store.status(refresh=True)["versions"] == 1  # folded


def _event_folder(spark, events):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events.write.parquet(f"{folder}/events.parquet")
    return folder


def test_debounce_stream_with_numbers_out_of_order(spark):
    """Copies of the log with later numbers and the same times: changes arrive by their times, and none is late."""
    import duckdb

    from workload.catalog import ORACLES, QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1_000_000))
    folder = _event_folder(spark, copies)
    columns = ["root", "opened_us", "path", "change_type", "n_changes", "late"]
    got = sorted(rows(QUERIES["debounce_stream"](spark, folder).select(columns)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['debounce_stream']})").fetchall())


def test_debounce_stream_with_times_ahead_of_the_clock(spark):
    """Copies of the log with later times, the last of them years ahead: the newest batch of every path comes out too."""
    import duckdb

    from workload.catalog import ORACLES, QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    later = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "ts": F.expr("ts + INTERVAL 30 YEARS")})
    folder = _event_folder(spark, events.unionByName(later))
    columns = ["root", "opened_us", "path", "change_type", "n_changes", "late"]
    got = sorted(rows(QUERIES["debounce_stream"](spark, folder).select(columns)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['debounce_stream']})").fetchall())


def test_late_changes_whose_times_add_up_to_much(spark):
    """The sum of the late times is exact where a bigint does not hold it."""
    from workload.catalog import QUERIES

    far = 250_000_000_000_000_000  # micros, in the year 9892
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(far) + F.col("id") * 1_000_000).alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"), F.lit("click").alias("event_type"))
    got = QUERIES["late_changes"](spark, _event_folder(spark, events)).collect()
    arrived = {i: (far + i * 1_000_000) // 60_000_000 + i * 7919 % 100 for i in range(4000)}
    low, high = min(arrived.values()), max(arrived.values())
    batches = {}
    for i, a in arrived.items():
        batches.setdefault((a - low) * 4 // (high - low + 1), []).append(far + i * 1_000_000)
    watermark, want = None, {}
    for b in sorted(batches):
        late = [us for us in batches[b] if watermark is not None and us < watermark]
        want[b] = (len(late), len(batches[b]) - len(late), sum(late) or None)
        watermark = max([watermark or 0, max(batches[b]) - 300_000_000])
    assert max(s or 0 for _, _, s in want.values()) >= 2**63
    assert {r.batch: (r.late, r.on_time, None if r.late_us is None else int(r.late_us)) for r in got} == want


def test_records_of_a_reply_are_put_together_before_the_state(spark):
    import pyarrow as pa

    data = [(2, 1, 3, "token", "d"), (1, 1, 0, "token", "a"), (1, None, 0, "token", "n"), (2, 1, 5, "finish", None), (1, 1, 1, "token", "b"),
            (1, 1, 0, "token", "again"), (2, 1, 4, "abort", None), (0, 0, 0, "finish", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*data), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                       ["chat_id", "reply_id", "seq", "kind", "token"])
    got = [tuple(r.values()) for out in TK._pack([batch, batch.slice(0, 0)]) for r in out.to_pylist()]
    assert got == [(0, 0, [], [], "finish", 0), (1, 1, [0, 1, 0], ["a", "b", "again"], None, None), (1, None, [0], ["n"], None, None),
                   (2, 1, [3], ["d"], "abort", 4)]
