import random

import corpus_pipeline as cp
import pytest
from quarry.session import new_folder
from tests.llm import data, plain


@pytest.fixture(scope="module")
def folder(spark):
    """Tables with clean texts, junk, near copies, shared lines and leaked test items."""
    rng = random.Random(21)
    texts = [data.prose(rng, rng.randint(60, 120)).replace("\n", " ") for _ in range(120)]
    items = [(i, data.prose(rng, 25)) for i in range(4)]
    line = data.prose(rng, 12).replace("\n", " ")
    rows = [(i, t + ("\n" + line if i % 6 == 0 else ""), "src", "en") for i, t in enumerate(texts)]
    rows += [(200 + i, " | ".join(w.upper() + "$$%%" for w in texts[i].split()), "src", None) for i in range(40)]
    rows += [(300 + i, texts[i + 1] + " tail", None, "en") for i in range(0, 30, 3)]
    rows += [(400 + i, texts[i + 50] + " " + items[i][1], "src", "en") for i in range(4)]
    rows += [(500, None, None, None), (501, "", "s", "en"), (None, texts[70] + " without an id", "s", "en")]
    path = new_folder(spark, "tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("score", cp.F.lit("own")).withColumn("N_lines", cp.F.lit("own"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 0 if 200 <= i < 300 else 1, 0) for i, *_ in rows if i is not None and i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def test_stages_take_effect(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, docs, path), name)
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "quality":
            clean = [i for i in range(120)]
            assert sum(i in now for i in clean) >= 0.97 * len(clean) and sum(200 <= (i or 0) < 300 for i in now) <= 6
        if name == "line_dedup":
            expected = {i: t for i, _, _, t in plain.dropped_lines(list(before.items()), 10)}
            assert {i: t or "" for i, t in now.items()} == expected
        if name == "near_copies":
            groups = plain.jaccard_components(list(before.items()), 5, 80)
            assert set(now) == {i for i in before if i is None or groups[i] == i} and len(now) < len(before)
        if name == "decontamination":
            assert set(now) == {i for i, t in before.items() if not plain.leaks(t, items, 10)[1]} and not any(400 <= (i or 0) < 404 for i in now)
        if name == "byte_bpe":
            assert {i: t or "" for i, t in now.items()} == {i: t or "" for i, t in before.items()}
            assert set(columns) <= set(out.columns) and {"ids", "n_tokens"} <= set(out.columns)
        docs, before = out, now
    assert len(before) > 90


def test_run_and_empty_table(spark, folder):
    path, _, _ = folder
    ran = cp.run(spark, path)
    assert ran.count() > 90 and None in {r[0] for r in ran.select("doc_id").collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
