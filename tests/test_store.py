import json
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import store as S
from quarry.plans import index as I
from quarry.plans.snapshot import Store
from quarry.sources import files as SF
from tests.conftest import rows

HOME = "/home/u"


def scan(spark, files):
    data = [(p, t, None) for p, t in files.items()]
    return spark.createDataFrame(data, "path string, text string, error_type string").withColumn(
        "mtime", F.lit("2024-01-01").cast("timestamp")
    )


def new_store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store")


def refresh(store, spark, files, batch, roots=("/r",)):
    return I.full_refresh(store, scan(spark, files), HOME, list(roots), batch).first().asDict()


def paths(store):
    return {r.path for r in store.paths().collect()}


def test_dedupe_move_stale_and_replay(spark):
    store = new_store(spark)
    assert not store.status()["indexed"]
    first = refresh(store, spark, {"/r/original.txt": "same", "/r/copy.txt": "same", "/r/other.txt": "x" * 1500}, "b1")
    assert (first["files_scanned"], first["files_indexed"], first["files_skipped"], first["chunks_created"]) == (3, 2, 0, 3)
    assert paths(store) == {"/r/original.txt", "/r/copy.txt", "/r/other.txt"}
    assert store.content().count() == 2 and store.chunks().count() == 3

    again = refresh(store, spark, {"/r/original.txt": "same", "/r/copy.txt": "same", "/r/other.txt": "x" * 1500}, "b2")
    assert (again["files_indexed"], again["files_skipped"], again["chunks_created"]) == (0, 3, 0)

    moved = refresh(store, spark, {"/r/original.txt": "same", "/r/new/other.txt": "x" * 1500}, "b3")
    assert moved["files_indexed"] == 0 and paths(store) == {"/r/original.txt", "/r/new/other.txt"}

    version = store.status()["version"]
    refresh(store, spark, {"/r/z.txt": "z"}, "b3")  # replay of a committed batch
    assert store.status(refresh=True)["version"] == version and paths(store) == {"/r/original.txt", "/r/new/other.txt"}


def test_scan_of_one_root_keeps_the_others(spark):
    store = new_store(spark)
    refresh(store, spark, {"/r/a.txt": "a", "/q/b.txt": "b"}, "b1", ["/r", "/q"])
    refresh(store, spark, {"/r/c.txt": "c"}, "b2", ["/r"])
    assert paths(store) == {"/r/c.txt", "/q/b.txt"}


def test_unreadable_files_count_as_present(spark):
    store = new_store(spark)
    refresh(store, spark, {"/r/a.txt": "a", "/r/b.txt": "b"}, "b1")
    rows_now = scan(spark, {"/r/a.txt": "a", "/r/b.txt": None}).withColumn(
        "error_type", F.when(F.col("path") == "/r/b.txt", "PermissionError")
    )
    stats = I.full_refresh(store, rows_now, HOME, ["/r"], "b2").first()
    assert stats.errors == 1 and stats.files_scanned == 2 and paths(store) == {"/r/a.txt", "/r/b.txt"}


def test_incremental_equals_full(spark):
    before = {f"/r/f{i}.txt": f"text {i}" for i in range(12)}
    after = {f"/r/f{i}.txt": f"text {i}" for i in range(4)}
    after |= {"/r/f4.txt": "edited", "/r/moved/f5.txt": "text 5", "/r/new.txt": "text 1", "/r/f6.txt": "back again"}
    store, whole = new_store(spark), new_store(spark)
    refresh(store, spark, before, "b1")
    changes = spark.createDataFrame(
        [("/r/f4.txt", None, "modified"), ("/r/moved/f5.txt", "/r/f5.txt", "moved"), ("/r/new.txt", None, "created"),
         ("/r/f6.txt", None, "created"), ("/r/gone.txt", None, "created")] + [(f"/r/f{i}.txt", None, "deleted") for i in range(7, 12)],
        "path string, old_path string, change_type string",
    )
    I.apply_changes(store, changes, scan(spark, after), HOME, "c1")
    refresh(whole, spark, after, "b1")
    key = lambda s: sorted(rows(s.paths().select("path", "content_hash")))
    assert key(store) == key(whole)
    store.compact("compact")
    assert key(store) == key(whole) and store.status()["versions"] == 1
    ids = lambda s: sorted(rows(s.content().select("content_hash")))
    assert ids(store) == ids(whole)
    assert sorted(rows(store.chunks().select("content_hash", "chunk_index", "text"))) == sorted(
        rows(whole.chunks().select("content_hash", "chunk_index", "text"))
    )


def test_uncommitted_version_is_invisible(spark):
    store = new_store(spark)
    refresh(store, spark, {"/r/a.txt": "a"}, "b1")
    store.paths().withColumns({"deleted": F.lit(True), "version": F.lit(1).cast("bigint")}).write.parquet(store.root + "/paths/v=1")
    assert paths(Store(spark, store.root)) == {"/r/a.txt"}


def test_index_rows_have_one_row_per_chunk_and_path(spark):
    store = new_store(spark)
    refresh(store, spark, {"/r/a.txt": "y" * 1500, "/r/b.txt": "y" * 1500}, "b1")
    got = sorted(rows(I.current_index(store).select("type", "file_path", F.coalesce("chunk_index", F.lit(-1)))))
    assert got == [("chunk", p, i) for p in ("/r/a.txt", "/r/b.txt") for i in (0, 1)] + [("file", "/r/a.txt", -1), ("file", "/r/b.txt", -1)]


def test_small_batches_give_the_same_known_flags(spark):
    stored = spark.createDataFrame([("a",), ("b",), ("b",)], "content_hash string")
    files = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3), ("c", 4)], "content_hash string, n int")
    one, two = (sorted(rows(S.flag_known(files, stored, small_batch=b))) for b in (False, True))
    assert one == two == [("a", 1, True), ("b", 3, True), ("c", 2, False), ("c", 4, False)]


def test_changed_files(spark):
    t = lambda s: f"2024-01-01 00:00:0{s}"
    old = spark.createDataFrame([("a", t(1), "h"), ("b", t(1), "h"), ("c", t(1), "h")], "path string, mtime string, content_hash string")
    new = spark.createDataFrame(
        [("a", t(1), "h"), ("b", t(2), "h"), ("c", t(2), "x"), ("d", t(1), "h")], "path string, mtime string, content_hash string"
    )
    got = {r.path: r.status for r in S.changed_files(new, old).collect()}
    assert got == {"a": "unchanged", "b": "touched", "c": "modified", "d": "new"}


def test_scan_read_and_extract(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "nested").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "sample.txt").write_text("This is a sample text file.\nline 2\nline 3")
    (root / "sub" / "nested" / "deep.txt").write_text("deep")
    (root / "copy.txt").write_text("deep")
    (root / ".hidden").write_text("x")
    (root / ".DS_Store").write_bytes(b"x")
    (root / "node_modules" / "package.json").write_text("{}")
    (root / ".document.pdf.icloud").write_bytes(b"")
    (root / "binary.bin").write_bytes(bytes(range(256)))
    (root / "bad.pdf").write_bytes(b"broken")
    (root / "link.txt").symlink_to(root / "sample.txt")
    found = SF.scan_files(spark, [str(root), str(tmp_path / "missing")])
    names = {r.name: r for r in found.collect()}
    assert set(names) == {"sample.txt", "deep.txt", "copy.txt", ".document.pdf.icloud", "binary.bin", "bad.pdf", "missing"}
    assert names["missing"].error_type == "FileNotFoundError"
    assert names[".document.pdf.icloud"].is_placeholder and names[".document.pdf.icloud"].extension == ".pdf"
    (root / "copy.txt").unlink()  # deleted between scan and read
    read = SF.read_files(found)
    hashes = {r.name: r for r in read.collect()}
    assert hashes["copy.txt"].error_type == "FileNotFoundError" and hashes["copy.txt"].content_hash is None
    import hashlib

    assert hashes["binary.bin"].content_hash == hashlib.sha256(bytes(range(256))).hexdigest()

    def parse(_, content):
        raise ValueError("cannot read")

    text = SF.extract_text(read, [SF.Extractor(frozenset([".pdf"]), parse)])
    got = {r.name: r for r in text.collect()}
    assert got["sample.txt"].first_line == "This is a sample text file."
    assert got["bad.pdf"].error_type == "ValueError" and got["bad.pdf"].text == ""
    assert got["copy.txt"].error_type == "FileNotFoundError" and got["copy.txt"].text == ""
    assert got["missing"].error_type == "FileNotFoundError" and got["binary.bin"].error_type is None


def test_empty_root(spark, tmp_path):
    assert SF.scan_files(spark, [str(tmp_path)]).count() == 0


def test_refresh_from_disk(spark, tmp_path):
    """New contents go through their extractor once; what cannot be read or listed keeps what is stored."""
    root, calls = tmp_path / "root", tmp_path / "calls"
    calls.mkdir()
    deep = root.joinpath(*["n"] * 80)
    deep.mkdir(parents=True)
    (deep / "deep.txt").write_text("deep")
    (root / "a.pdf").write_bytes(b"one")
    (root / "copy.pdf").write_bytes(b"one")
    (root / "sub").mkdir()
    (root / "sub" / "b.pdf").write_bytes(b"two")
    (root / "bad.pdf").write_bytes(b"bad")
    where = str(calls)

    def parse(_, content):
        import uuid

        with open(f"{where}/{uuid.uuid4().hex}", "wb") as out:
            out.write(content)
        if content == b"bad":
            raise ValueError("cannot read")
        return "text of " + content.decode()

    def seen():
        out = sorted(p.read_bytes() for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return out

    store, extractors = new_store(spark), [SF.Extractor(frozenset([".pdf"]), parse)]

    def run(batch):
        return I.refresh_from_disk(store, SF.scan_files(spark, [str(root)]), str(root), [str(root)], batch, extractors)

    first = run("one")
    assert (first["files_scanned"], first["files_read"], first["files_indexed"], first["errors"]) == (5, 5, 4, 1)
    assert seen() == [b"bad", b"one", b"two"] and len(paths(store)) == 5
    again = run("two")
    assert (again["files_scanned"], again["files_read"], again["files_indexed"], again["chunks_created"]) == (5, 0, 0, 0) and seen() == []
    assert store.version("paths", store.status()["version"]).count() == 0  # nothing changed, so no row is written
    (root / "a.pdf").unlink()
    (root / "sub" / "new.pdf").write_bytes(b"three")
    third = run("three")
    assert (third["files_read"], third["files_indexed"]) == (1, 1) and seen() == [b"three"]
    assert str(root / "a.pdf") not in paths(store) and len(paths(store)) == 5
    root.rename(tmp_path / "away")
    lost = run("four")
    assert lost["errors"] == 1 and len(paths(store)) == 5  # a root that cannot be reached deletes nothing


def test_walk_in_many_rounds(spark, tmp_path, monkeypatch):
    for i in range(40):
        folder = tmp_path / f"d{i % 5}" / f"e{i}"
        folder.mkdir(parents=True)
        (folder / f"f{i}.txt").write_text("x")
    monkeypatch.setattr(SF, "WALK", 3)
    assert SF.scan_files(spark, [str(tmp_path)]).filter("not is_dir").count() == 40


def test_two_writers(spark):
    from quarry.plans import snapshot

    one = new_store(spark)
    refresh(one, spark, {"/r/a.txt": "a"}, "b1")
    two = Store(spark, one.root)
    taken = two._next_version()
    two._next_version = lambda: taken  # planned before the other writer commits
    refresh(one, spark, {"/r/a.txt": "a", "/r/b.txt": "b"}, "b2")
    try:
        refresh(two, spark, {"/r/c.txt": "c"}, "b3")
        raise AssertionError("the second writer must not commit")
    except snapshot.CommitConflict:
        pass
    assert paths(Store(spark, one.root)) == {"/r/a.txt", "/r/b.txt"}
    del two._next_version
    snapshot.retried(lambda: refresh(two, spark, {"/r/a.txt": "a", "/r/c.txt": "c"}, "b3"), two)
    assert paths(Store(spark, one.root)) == {"/r/a.txt", "/r/c.txt"}
    assert Store(spark, one.root).content().count() == 3


def test_distractors_of_a_single_context(spark):
    from quarry.operators import examples as X

    rows_ = [(1, "ctx", "q", ["a"], False), (2, "ctx", "r", ["b"], False)]
    qa = spark.createDataFrame(rows_, "id long, context string, question string, answers array<string>, is_impossible boolean")
    assert [r.chunks for r in X.attach_distractors(qa).collect()] == ["[1] document.txt: ctx"] * 2


def test_many_small_batches_read_a_checkpoint_and_its_tail(spark, tmp_path):
    """500 versions: the log is one checkpoint and the commits after it, paths are few runs, a lookup opens its buckets only."""
    from quarry.plans import snapshot

    store = Store(spark, str(tmp_path / "store"))
    shape = schemas.PATHS
    expected = {}
    for i in range(500):  # versions as a writer leaves them, without a Spark job for each
        path, gone = f"/r/f{i % 90}.txt", i % 7 == 0 and i > 90
        folder = tmp_path / "store" / "paths" / f"v={i}-x"
        folder.mkdir(parents=True)
        row = [[path], [None if gone else f"h{i}"], *[[None] for _ in range(5)], [gone], [i]]
        names = ["path", "content_hash", "file_name", "extension", "source", "folder", "sync_status", "deleted", "version"]
        types = [pa.string()] * 7 + [pa.bool_(), pa.int64()]
        pq.write_table(pa.table([pa.array(v, t) for v, t in zip(row, types)], names=names), folder / "part-0.parquet")
        store._create("commits", i, json.dumps({"version": i, "batch_id": f"b{i}", "is_base": i == 0, "folder": f"v={i}-x", "tables": ["paths"]}))
        expected[path] = None if gone else f"h{i}"
        if i in (60, 140, 300, 455):
            store._seen = None
            store.checkpoint()
    expected = {p: h for p, h in expected.items() if h}
    fresh = Store(spark, str(tmp_path / "store"))
    assert {r.path: r.content_hash for r in fresh.paths().collect()} == expected
    assert fresh.status()["version"] == 499 and len(fresh._versions("log")) == 2
    assert len(fresh._tail()) == 44 and 1 <= len(fresh._runs()) <= 3
    assert fresh.has_batch("b3") and fresh.has_batch("b460") and not fresh.has_batch("other")
    asked = spark.createDataFrame([("/r/f5.txt",)], "path string")
    some = fresh.paths(asked)
    assert {r.path: r.content_hash for r in some.where("path = '/r/f5.txt'").collect()} == {p: h for p, h in expected.items() if p == "/r/f5.txt"}
    plan = fresh._path_rows([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "= 3" in plan
    fresh.commit("more", paths=spark.createDataFrame([("/r/new.txt", "h", *[None] * 7)], shape), removed=asked)
    assert {r.path for r in fresh.paths().collect()} == (set(expected) | {"/r/new.txt"}) - {"/r/f5.txt"}
    fresh.compact("fold")
    fresh.checkpoint()
    again = Store(spark, str(tmp_path / "store"))
    assert {r.path for r in again.paths().collect()} == (set(expected) | {"/r/new.txt"}) - {"/r/f5.txt"}
    assert again.status()["versions"] == 1 and again.has_batch("b3") and len(again._runs()) == 1
    assert snapshot.CHECKPOINT_EVERY == 50


def test_commits_write_checkpoints_by_themselves(spark, tmp_path, monkeypatch):
    from quarry.plans import snapshot

    monkeypatch.setattr(snapshot, "CHECKPOINT_EVERY", 3)
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    for i in range(7):
        store.commit(f"b{i}", paths=spark.createDataFrame([(f"/r/{i}", f"h{i}", *[None] * 7)], schemas.PATHS))
    assert {r.path for r in other.paths().collect()} == {f"/r/{i}" for i in range(7)}
    assert other._versions("log") == [2, 5] and store.commit("b1") == 6


def test_extractor_frames_follow_the_bytes_of_their_texts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(SF, "FRAME_BYTES", 1000)
    batch = pd.DataFrame({"extension": [".pdf"] * 6 + [".x"], "content": [b"ab"] * 7})
    run = SF._run_extractors([SF.Extractor(frozenset([".pdf"]), lambda _, content: content.decode() * 250)])
    frames = list(run(iter([batch])))
    assert [len(f) for f in frames] == [2, 2, 2, 1]
    whole = pd.concat(frames)
    assert list(whole["text"]) == ["ab" * 250] * 6 + [None] and list(whole["error_type"])[-1] == "StopIteration"


def test_files_are_written_and_parsed_in_batches_of_few_bytes(spark):
    from workload.catalog import QUERIES

    for name in ("read_and_fingerprint", "extract_with_plug_in"):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20
