import gzip
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quarry.operators import examples as X
from quarry.operators.ordering import seeded_hash, take_quota, with_successor
from tests.conftest import rows


@pytest.mark.parametrize("quota", [0, 1, 7, 300, 10_000])
def test_quota_equals_sorting_each_group(spark, quota):
    data = [(i, "hot" if i % 3 else f"g{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(data, "id int, g string").withColumn("k", seeded_hash(1, F.col("id")))
    got = {(r.id, r.g) for r in take_quota(df, ["g"], "k", quota, ["id"]).collect()}
    want = set()
    for g in {g for _, g in data}:
        ids = sorted((i for i, x in data if x == g), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
        want |= {(i, g) for i in ids[:quota]}
    assert got == want


@pytest.mark.parametrize("quota", [0, 1, 250, 2999, 3000, 9000])
def test_quota_over_everything(spark, quota):
    df = spark.range(3000).withColumn("k", seeded_hash(1, F.col("id")))
    got = {r.id for r in take_quota(df, [], "k", quota, ["id"]).collect()}
    assert got == set(sorted(range(3000), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))[:quota])


def test_quota_with_equal_keys(spark):
    df = spark.createDataFrame([(i, "g", "abcd00") for i in range(50)], "id int, g string, k string")
    assert sorted(r.id for r in take_quota(df, ["g"], "k", 20, ["id"]).collect()) == list(range(20))


@pytest.mark.parametrize("cyclic", [False, True])
def test_successor_across_buckets(spark, cyclic):
    random.seed(3)
    data = sorted({("hot" if random.random() < 0.5 else f"g{random.randrange(6)}", random.randrange(500)) for _ in range(600)})
    df = spark.createDataFrame(data, "g string, n int").repartition(7)
    out = with_successor(df, ["g"], ["n"], F.floor(F.col("n") / 10), ["n"], cyclic)
    got = {(r.g, r.n): r.successor.n if r.successor else None for r in out.collect()}
    want = {}
    for g in {g for g, _ in data}:
        ns = [n for x, n in data if x == g]
        for a, b in zip(ns, ns[1:] + [ns[0] if cyclic else None]):
            want[(g, a)] = b
    assert got == want


def test_negatives_never_repeat_the_context(spark):
    same = [(i, "common context", f"q{i}", ["a"], False) for i in range(40)]
    other = [(100 + i, f"context {i}", f"q{i}", ["a"], False) for i in range(5)]
    qa = spark.createDataFrame(same + other, "id int, context string, question string, answers array<string>, is_impossible boolean")
    pairs = X.negative_pairs(qa).collect()
    assert len(pairs) == 45 and all(r.context != r.wrong_context for r in pairs)
    assert X.negative_pairs(qa.filter("id < 100")).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    qa = spark.range(300).select(
        "id", F.concat(F.lit("ctx "), (F.col("id") % 37).cast("string")).alias("context"), F.lit("q").alias("question"),
        F.array(F.lit("a")).alias("answers"), F.lit(False).alias("is_impossible"),
    )
    one = sorted(rows(X.curriculum(qa.coalesce(1), 100)))
    many = sorted(rows(X.curriculum(qa.repartition(13), 100)))
    assert one == many and len(one) > 0


def test_failing_batches_are_tried_again_and_halved(spark, tmp_path):
    """A plug-in that fails once per task recovers; bad rows fail alone; wrong lengths and short answers fall back."""
    df = spark.createDataFrame([(i, f"in {i}", f"answer {i}") for i in range(200)], "id int, input string, output string").repartition(3)

    def open_rewriter():
        calls = []

        def rewriter(rows):
            calls.append(len(rows))
            if len(calls) == 1:
                raise RuntimeError("warming up")
            if any(a == "answer 77" for _, a in rows):
                raise ValueError("bad")
            if any(a == "answer 5" for _, a in rows):
                return ["one too many"] * (len(rows) + 1)
            return ["no" if a == "answer 9" else None if a == "answer 10" else a.upper() for _, a in rows]

        return rewriter

    seen = Observation()
    got = {r.id: r for r in X.rewrite_batches(df, open_rewriter, seen, batch_rows=16, attempts=2).collect()}
    assert len(got) == 200 and {i for i, r in got.items() if r.failed} == {77, 5}
    assert {i for i, r in got.items() if r.fell_back} == {77, 5, 9, 10}
    assert got[3].output == "ANSWER 3" and got[3].original_extractive == "answer 3" and got[77].output == "answer 77"
    assert seen.get == {"rows": 200, "fell_back": 4, "failed": 2}


def test_polarity_outputs_and_scaled_layers(spark, tmp_path):
    from quarry.plans import dataset as D

    rows_ = [(i, f"in {i}", "Not found in provided context." if i % 4 == 0 else f"a{i}", ["squad_v2", "hotpotqa", "drop", "coqa"][i % 4], 1 if i % 4 == 0 else 2) for i in range(400)]
    df = spark.createDataFrame(rows_, "id int, input string, output string, source string, layer int")
    counts = {r.part: r.n for r in D.write_polarities(df, str(tmp_path / "out")).collect()}
    assert counts == {"polarity=positive": 300, "polarity=negative": 100}
    assert spark.read.json(str(tmp_path / "out" / "polarity=negative")).count() == 100
    capped = D.cap_layers(df, {1: 30, 2: 60})
    assert {(r.layer, r.source): r["count"] for r in capped.groupBy("layer", "source").count().collect()} == {
        (1, "squad_v2"): 30, (2, "hotpotqa"): 20, (2, "drop"): 20, (2, "coqa"): 20}
    assert D.cap_layers(df, {1: 0, 2: 10_000}).count() == 300
    assert D.scaled_sizes(110_000, 0.5) == {1: 15000, 2: 15000, 3: 10000, 4: 10000, 5: 5000}


def _shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {b for b in blocks if b.startswith("shuffle_")}


def test_dataset_is_written_slice_by_slice(spark, tmp_path, monkeypatch):
    """Several slices give the whole set in one order, and nothing that they shuffled stays on disk."""
    from quarry.plans import dataset as D

    monkeypatch.setattr(D, "SLICE_ROWS", 500, raising=False)
    layers = [None, 1, 2, 2, 3, 3, 3, 3, 3]
    data = [(i, f"in {i} {j}", "out", f"s{j}", layer) for i in range(300) for j, layer in enumerate(layers)]
    df = spark.createDataFrame(data, "id int, input string, output string, source string, layer int")
    before, out = _shuffled(spark), tmp_path / "set"
    sizes = D.build(df, str(out))
    end = time.time() + 20
    while _shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffled(spark) - before
    assert {(r.layer, r.source): r.n for r in sizes.collect()} == {(layer, f"s{j}"): 300 for j, layer in enumerate(layers)}
    assert (out / "_SUCCESS").exists()
    for layer in set(layers):
        files = sorted((out / f"layer={layer or '__HIVE_DEFAULT_PARTITION__'}").glob("*.gz"))
        got = [json.loads(line)["input"] for f in files for line in gzip.open(f, "rt")]
        place = lambda r: hashlib.md5(":".join(str(x) for x in (42, r[4], r[3], r[0]) if x is not None).encode()).hexdigest()
        assert got == [r[1] for r in sorted((r for r in data if r[4] == layer), key=place)]
    assert D.build(df.limit(0), str(tmp_path / "none")).count() == 0


def test_phase_plan_keeps_only_its_outputs(spark, tmp_path, monkeypatch):
    """Polarities are written next to the layers from the rows, the formats of a row together; joined rows and shuffles go."""
    from workload import dataset as WD
    from workload.catalog import QUERIES

    monkeypatch.setattr(WD, "new_folder", lambda spark, label: str(tmp_path / label))
    before = _shuffled(spark)
    plan = QUERIES["phase_plan"](spark, "/root/testdata/sf0.001")
    size = {f.name: sum(x.stat().st_size for x in f.rglob("*.gz")) for f in tmp_path.iterdir()}
    assert set(size) == {"dataset", "polarities"} and 0 < size["polarities"] < 0.6 * size["dataset"]
    n = {r.part: r.n for r in plan.collect()}
    assert sum(n.values()) > 0
    written = spark.read.json(str(tmp_path / "polarities")).groupBy("polarity").count().collect()
    assert sum(r["count"] for r in written) == spark.read.json(str(tmp_path / "dataset")).count()
    texts = [b for b in _shuffled(spark) - before if b.endswith(".data")]
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    assert sum(disk.getFile(b).length() for b in texts) < size["polarities"]


def test_cap_layers_ends_inside_a_bucket(spark):
    """The last row to keep lies in a bucket of the hash that stays in part; ids are bigints."""
    from quarry.plans import dataset as D

    ids = [(i, f"in {i}", "out", source, layer) for i in range(3000) for source, layer in (("a", 1), ("b", 2), ("c", 2))]
    # ids whose hashes share their first four digits, so that a limit can fall between them
    key = lambda s, i: hashlib.md5(f"42:{s}:{i}".encode()).hexdigest()
    examples = spark.createDataFrame(ids, "id bigint, input string, output string, source string, layer int")
    ordered = {s: sorted((key(s, i), s, i) for i in range(3000)) for s in "abc"}
    shared = next(n for n in range(1, 3000) if ordered["a"][n - 1][0][:4] == ordered["a"][n][0][:4])
    got = sorted(rows(D.cap_layers(examples, {1: shared, 2: 300}).select("source", "id")))
    want = sorted((s, i) for name, n in (("a", shared), ("b", 100), ("c", 100)) for _, s, i in ordered[name][:n])
    assert got == want


def test_distractors_of_cut_contexts(spark):
    """Rows whose contexts are cut after their key was taken get the chunks of the whole ones."""
    qa = spark.range(40).select("id", F.concat(F.lit("x" * 900), F.col("id").cast("string")).alias("context"), F.lit("q").alias("question"))
    contexts = X.keyed_contexts(qa)[1]
    whole = {r.id: r.chunks for r in X.attach_distractors(qa, contexts).collect()}
    cut = qa.withColumn("context_key", F.md5("context")).withColumn("context", F.substring("context", 1, 500))
    assert {r.id: r.chunks for r in X.attach_distractors(cut, contexts).collect()} == whole
    assert all("other_file" in chunks for chunks in whole.values())
