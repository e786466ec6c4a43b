import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import photos as PH
from quarry.operators import search as SE
from quarry.operators.clusters import cluster_tree
from tests.conftest import rows

INDEX = "row_id int, type string, source string, folder string, embedding array<float>"


def table(spark, n=400, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)).astype(np.float32)
    vectors[10:20] = vectors[10]  # equal scores
    data = [(i, "chunk" if i % 2 else "file", f"s{i % 3}", f"Desktop/f{i % 4}", vectors[i].tolist()) for i in range(n)]
    return vectors, spark.createDataFrame(data, INDEX).repartition(6)


def brute(vectors, query, k, allowed=lambda i: True):
    scores = np.round(vectors.astype(np.float64) @ np.asarray(query, dtype=np.float64), 9)
    order = sorted((i for i in range(len(vectors)) if allowed(i)), key=lambda i: (-scores[i], i))
    return order[:k]


@pytest.mark.parametrize("tiles", [(1 << 14, 1 << 12), (40, 2)])
def test_knn_equals_brute_force_in_one_or_many_tiles(spark, monkeypatch, tiles):
    monkeypatch.setattr(SE, "ENTRY_TILE", tiles[0])
    monkeypatch.setattr(SE, "QUERY_TILE", tiles[1])
    vectors, entries = table(spark)
    queries = spark.createDataFrame([(q, vectors[q * 5].tolist()) for q in range(9)], "qid int, vector array<float>")
    got = {(r.qid, r["rank"]): r.row_id for r in SE.knn(queries, entries, 15).collect()}
    for q in range(9):
        assert [got[(q, r)] for r in range(1, 16)] == brute(vectors, vectors[q * 5], 15)


def test_filters_zero_and_null_vectors(spark):
    vectors, entries = table(spark)
    extra = spark.createDataFrame([(9000, "file", "s0", "Desktop/f0", None), (9001, "file", "s0", "Desktop/f0", [0.0] * 8)], INDEX)
    queries = spark.createDataFrame(
        [(1, vectors[0].tolist(), "file", "s0", "Desktop/f0"), (2, vectors[0].tolist(), "file", None, None),
         (3, vectors[0].tolist(), "file", "nowhere", None)],
        "qid int, vector array<float>, type string, source string, folder string",
    )
    got = SE.knn(queries, entries.unionByName(extra), 200).collect()
    mine = [r.row_id for r in sorted((r for r in got if r.qid == 1), key=lambda r: r["rank"])]
    assert 9001 in mine and 9000 not in mine
    mine.remove(9001)
    assert mine == brute(vectors, vectors[0], 200, lambda i: i % 2 == 0 and i % 3 == 0 and i % 4 == 0)
    assert not [r for r in got if r.qid == 3]
    two = [r.row_id for r in sorted((r for r in got if r.qid == 2), key=lambda r: r["rank"])]
    assert [i for i in two if i < 9000] == brute(vectors, vectors[0], 200, lambda i: i % 2 == 0)[: len([i for i in two if i < 9000])]


def test_no_queries_no_hits(spark):
    _, entries = table(spark, 30)
    assert SE.knn(spark.createDataFrame([], "qid int, vector array<float>"), entries, 3).count() == 0


def test_cells_reach_most_true_neighbours(spark):
    entries = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    queries = entries.select(F.col("row_id").alias("qid"), F.col("embedding").alias("vector"))
    centroids = SE.train_cells(entries, 16, seed=7, iterations=5)
    celled = SE.assign_cells(entries, centroids)
    exact = {(r.qid, r.row_id) for r in SE.knn(queries, entries, 5).collect()}
    near = {(r.qid, r.row_id) for r in SE.knn_in_cells(queries, celled, centroids, 5, 6).collect()}
    every = {(r.qid, r.row_id) for r in SE.knn_in_cells(queries, celled, centroids, 5, 16).collect()}
    assert every == exact
    assert len(exact & near) / len(exact) > 0.6


def test_hybrid_merge(spark):
    kw = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2), (2, "c", 3)], "qid int, path string, rank int")
    vec = spark.createDataFrame(
        [(1, "b", 1), (1, "x", 2), (1, "y", 3), (2, "z", 1), (3, "q", 1)], "qid int, path string, rank int"
    )
    got = {(r.qid, r["rank"]): (r.path, r.method) for r in SE.hybrid_merge(kw, vec, 3, 3).collect()}
    assert got == {
        (1, 1): ("a", "keyword"), (1, 2): ("b", "keyword"), (1, 3): ("x", "vector"),
        (2, 1): ("a", "keyword"), (2, 2): ("b", "keyword"), (2, 3): ("c", "keyword"), (3, 1): ("q", "vector"),
    }


def test_photo_scores(spark):
    data = [
        ("p1", ["snow", "snowman"], ["Ann Lee"], "Oslo, Norway", "2024-01-01", ["trip"]),
        ("p2", [], ["ann"], "", "2024-02-01", []),
        ("p3", ["sun"], [], "Oslo", "2024-03-01", ["Snow"]),
        ("p4", ["dog"], [], "Rome", None, []),
    ]
    photos = spark.createDataFrame(data, "file_path string, keywords array<string>, persons array<string>, location string, "
                                         "date string, album_names array<string>").withColumn("date", F.to_timestamp("date"))
    terms = spark.createDataFrame([(1, "snow"), (1, "ann"), (2, "oslo"), (3, "nothing")], "qid int, term string")
    got = rows(PH.search_photos(photos, terms, 2).select("qid", "file_path", "score", "rank"))
    # p1: snow exact 2, snowman partial 1, ann partial 2; p2: ann exact 3; p3: album 1 (cut by k)
    assert sorted(got) == [(1, "p1", 5, 1), (1, "p2", 3, 2), (2, "p1", 1, 2), (2, "p3", 1, 1)]


def test_photo_location_and_text(spark):
    df = spark.createDataFrame([("Park", None, "Italy", None, None), (None, None, None, 45.5019, -73.5674), (None,) * 5],
                               "n string, c string, k string, lat double, lon double")
    got = rows(df.select(PH.photo_location(*[F.col(x) for x in ("n", "c", "k", "lat", "lon")])))
    assert got == [("Park, Italy",), ("45.50, -73.57",), ("",)]


def test_cluster_tree_limits(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).astype(float).tolist(), str(i)) for i in range(700)]
    items = spark.createDataFrame(data, "id int, vector array<double>, content string")
    nodes, leaves = cluster_tree(items, 4, iterations=2)
    tree = nodes.collect()
    assert leaves.count() == 700
    assert max(r.depth for r in tree) <= 4 and sum(r.n_items for r in tree if r.depth == 1) == 700
    children = {}
    for r in tree:
        children.setdefault(r.parent, []).append(r)
    for r in tree:
        if r.node in children:
            assert sum(c.n_items for c in children[r.node]) == r.n_items and len(children[r.node]) <= 15
        else:
            assert r.n_items <= 50 or r.depth == 4
    same, _ = cluster_tree(items.repartition(9), 4, iterations=2)
    assert sorted((r.node, r.item_hash) for r in same.collect()) == sorted((r.node, r.item_hash) for r in tree)


def vectors(seed, n, dims=8, groups=6):
    """(row_id, unit vector) around a few directions."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    v = centers[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def entry_table(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, embedding array<double>")


def hits_of(df):
    return sorted((r.qid, r.rank, r.row_id) for r in df.collect())


def test_stored_cells_give_exact_hits_and_skip_cells(spark, tmp_path):
    from quarry.plans.cells import CellIndex

    rows = [*vectors(1, 900), (5000, None)]
    entries = entry_table(spark, rows)
    stored = CellIndex.write(entries, SE.train_cells(entries.where("embedding is not null"), 12, seed=3, iterations=4), f"{tmp_path}/cells")
    queries = entry_table(spark, vectors(2, 40)).selectExpr("row_id as qid", "embedding as vector").unionByName(
        spark.createDataFrame([(999, None)], "qid bigint, vector array<double>"))
    hits, probed = stored.top_k(queries, 7)
    assert hits_of(hits) == hits_of(SE.knn(queries, entries, 7))
    n_cells, n_probed = stored.cells.count(), probed.count()
    assert probed.distinct().count() == n_probed < 0.7 * 40 * n_cells
    some = probed.where("qid = 0")
    opened = {f.split("cell=")[1].split("/")[0] for f in stored.entries(some).inputFiles()}
    assert "PartitionFilters: [" in stored.entries(some)._jdf.queryExecution().executedPlan().toString() and opened
    assert hits_of(stored.top_k(queries, 2000)[0]) == hits_of(SE.knn(queries, entries, 2000))  # more than any cell holds
    asked = queries.withColumn("minimum", F.lit(0.9))
    near = {(r.qid, r.row_id) for r in stored.within(asked).collect()}
    q, v = ({r[0]: np.array(r[1]) for r in t.where(c + " is not null").collect()} for t, c in ((queries, "vector"), (entries, "embedding")))
    assert near == {(a, b) for a in q for b in v if round(float(q[a] @ v[b]), 9) >= 0.9}


def test_descent_with_a_wide_beam_is_exact(spark):
    """Through folders that hold entries at every level, and through a cluster tree."""
    rows = vectors(4, 400)
    folder = {i: [None, "a", "a/b", "a/c", "d", "d/e/f"][i % 6] for i, _ in rows}
    entries = spark.createDataFrame([(i, v, folder[i]) for i, v in rows], "row_id bigint, embedding array<double>, node string")
    mean = entries.where("node is not null").groupBy("node").agg(V.mean_vector(F.col("embedding"), 8).alias("vector"))
    inner = spark.createDataFrame([("d/e", [0.1] * 8)], "node string, vector array<double>")
    parent = F.when(F.col("node").contains("/"), F.regexp_replace("node", "/[^/]+$", ""))
    nodes = mean.unionByName(inner).select("node", parent.alias("parent"), "vector")
    queries = entry_table(spark, vectors(5, 20)).selectExpr("row_id as qid", "embedding as vector")
    exact = hits_of(SE.knn(queries, entries, 9))
    assert hits_of(SE.beam_search(queries, nodes, entries, 9, beam=3)) == exact
    narrow = SE.beam_search(queries, nodes, entries, 9, beam=1)
    assert narrow.groupBy("qid").count().where("count > 9").isEmpty() and narrow.count() == 180
    items = entries.selectExpr("row_id as id", "embedding as vector", "cast(row_id as string) as content")
    tree, placed = cluster_tree(items, 8)
    leaves = placed.selectExpr("id as row_id", "vector as embedding", "node")
    assert hits_of(SE.beam_search(queries, tree, leaves, 9, beam=150)) == exact
    found = {(q, i) for q, _, i in hits_of(SE.beam_search(queries, tree, leaves, 9, beam=4))}
    assert len(found & {(q, i) for q, _, i in exact}) >= 0.7 * len(exact)


def test_hybrid_search_finds_every_row_of_the_sum(spark):
    rng = np.random.default_rng(8)
    names = ["report", "budget", "photo", "notes", "draft"]
    rows = [(i, f"{rng.choice(names)}_{i % 13}.txt" if i % 9 else None, " ".join(rng.choice(names, 3)) + " all", v if i % 50 else None) for i, v in vectors(6, 500)]
    index = spark.createDataFrame(rows, "row_id bigint, file_name string, text string, embedding array<double>")
    asked = [(i, v, [["Report", "7"], ["budget", "all"], [], ["photo"], ["all"]][i % 5]) for i, v in vectors(7, 15)]
    queries = spark.createDataFrame(asked, "qid bigint, vector array<double>, terms array<string>")
    weights = {"filename": 0.35, "content": 0.40, "keyword": 0.25}

    def words(text):
        return set(re.findall("[a-z0-9]+", (text or "").lower()))

    expected = set()
    for q, qv, terms in asked:
        ts = {x.lower() for x in terms}
        for i, name, text, v in rows:
            if v is not None:
                f, k = (len(ts & words(x)) / len(ts) if ts else 0.0 for x in (name, text))
                if round(0.35 * f + 0.40 * round(float(np.dot(qv, v)), 9) + 0.25 * k, 6) >= 0.35:
                    expected.add((q, i))
    for hot in (3, 100_000):
        got = SE.hybrid_search(queries, index, lambda asked: SE.within(asked, index), weights, 0.35, hot_rows=hot)
        assert {(r.qid, r.row_id) for r in got.collect()} == expected and expected


def test_a_word_in_every_photo_lets_k_rows_a_tile_through(spark):
    rng = np.random.default_rng(9)
    words = ["dog", "park", "summer", "sea"]
    data = [(f"/p{i % 290}", ["Beach", *rng.choice(words, 2)], [str(rng.choice(["Ann", "Bob", ""]))], "Beach road" if i % 3 else "", int(rng.integers(0, 5)) if i % 7 else None, ["beach"])
            for i in range(300)]
    photos = spark.createDataFrame(data, "file_path string, keywords array<string>, persons array<string>, location string, d int, album_names array<string>")
    photos = photos.withColumn("date", F.timestamp_seconds("d")).drop("d")
    asked = {"a": ["beach"], "b": ["beach", "dog", "dog"], "c": ["ann", "sea"], "d": ["nothing"], "e": ["each"]}
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid string, term string")
    score, date = {}, {}
    for path, keywords, persons, location, d, albums in data:
        for q, ws in asked.items():
            n = sum(2 if w.lower() in ws else any(x in w.lower() for x in ws) for w in keywords)
            n += sum(3 if w.lower() in ws else 2 * any(x in w.lower() for x in ws) for w in persons)
            n += sum(x in location.lower() for x in ws) + sum(a in ws for a in albums)
            score[q, path] = score.get((q, path), 0) + n
        date[path] = max(date.get(path, -1), -1 if d is None else d)
    expected = []
    for q in asked:
        best = sorted((-n, -date[p], p) for (r, p), n in score.items() if r == q and n)[:6]
        expected += [(q, p, -n, i + 1) for i, (n, _, p) in enumerate(best)]
    got = PH.search_photos(photos, terms, 6, tile=40).select("qid", "file_path", "score", "rank")
    assert sorted(rows(got)) == sorted(expected)
    per_query = PH.photo_hits(photos, terms, 6, tile=40).groupBy("qid").count().collect()
    assert max(r["count"] for r in per_query) <= 6 * 8 and len(per_query) == 4


def test_cells_of_another_integer_type(spark):
    """Queries meet the entries of their cells in every task, also where the centroids' cells are no bigint as the entries' are."""
    vectors, entries = table(spark)
    centroids = spark.createDataFrame([(c, vectors[c * 30].tolist()) for c in range(12)], "cell int, vector array<float>")
    queries = spark.createDataFrame([(q, vectors[q * 5].tolist()) for q in range(60)], "qid int, vector array<float>")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        celled = SE.assign_cells(entries.select("row_id", "embedding"), centroids)
        got = {(r.qid, r["rank"]): r.row_id for r in SE.knn_in_cells(queries, celled, centroids, 5, 12).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for q in range(60):
        assert [got.get((q, r)) for r in range(1, 6)] == brute(vectors, vectors[q * 5], 5)


def test_dispatch_searches_once_for_all_queries_that_ask_the_same(spark, monkeypatch):
    from quarry.plans import retrieval as RP
    from workload.catalog import QUERIES

    asked, plain = [], RP.search
    monkeypatch.setattr(RP, "search", lambda queries, *rest: asked.append(queries.count()) or plain(queries, *rest))
    assert QUERIES["dispatch"](spark, "/root/testdata/sf0.001").count() > 200
    assert asked and asked[0] <= 30  # three searches of ten labels


def test_answers_of_shared_searches_and_of_a_query_without_a_vector(spark):
    from quarry import schemas
    from quarry.plans import retrieval as RP

    vectors, entries = table(spark, 60)
    index = entries.selectExpr("*", "concat('f', row_id) as file_name", "concat('/f', row_id) as file_path", "1 as chunk_index", "concat('t', row_id) as text")
    planned = spark.createDataFrame(
        [(f"q{i}", "local_query", "files", "files", "x", None if i == 9 else i % 3) for i in range(10)],
        "qid string, tool string, branch string, target string, query string, label int")
    known = spark.createDataFrame([(0, vectors[0].tolist()), (1, vectors[4].tolist())], "key int, vector array<float>")
    got = {r.qid: r.context for r in RP.answer(planned, index, spark.createDataFrame([], schemas.PHOTOS), {}, (known, "label"), 5).collect()}
    assert len(got) == 10
    for i in range(10):
        best = [] if i == 9 or i % 3 == 2 else brute(vectors, vectors[(0, 4)[i % 3]], 5, lambda n: n % 2 == 0)
        lines = "\n".join(f"{r}. **f{n}** - /f{n}" for r, n in enumerate(best, 1))
        assert got[f"q{i}"] == "\n\n## File Search Results\n" + lines
