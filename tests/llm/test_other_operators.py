import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, language, near_vectors, quality, warc
from quarry.session import new_folder
from tests.llm import data, plain

VECTORS = "vec_id long, embedding array<float>"


def clashing(df, *names):
    for i, n in enumerate(names):
        df = df.withColumn(n.upper() if i % 2 else n, F.lit("own"))
    return df


# ------------------------------------------------------------------ near vectors


def exact_links(rows, cosine):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            unit[k] = a / np.linalg.norm(a)
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    parts = plain.components({i for i, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in pairs])
    return links, parts


def vectors(seed=3, dims=32, groups=12):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for g in range(groups):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 9)) if g else 60):
            rows.append((at, (base + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.3, 0.5])).tolist()))
            at += 1
    rows += [(at + i, rng.standard_normal(dims).tolist()) for i in range(80)]
    at += 80
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [float("inf")] * dims, [1.0, 2.0], [2.0, 4.0], [-0.0] + [1.0] * (dims - 1),
           [0.0] + [1.0] * (dims - 1), [3e30] * dims, [1e-30] * dims]
    return rows + [(at + i, v) for i, v in enumerate(odd)]


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    rows = vectors()
    links, parts = exact_links(rows, 0.9)
    df = clashing(spark.createDataFrame(rows, VECTORS), "n_links", "kept")
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    mine = np.array([got[i]["n_links"] for i, _ in rows])
    assert (mine <= np.array(links)).all()  # nothing below the threshold, nothing twice
    assert mine.sum() >= 0.97 * sum(links) > 1000
    assert np.mean([got[i]["component_id"] == c for i, c in parts.items()]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    monkeypatch.setattr(near_vectors, "BLOCK", 16)  # the large group in many blocks
    again = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(df).collect()}
    assert again == {i: r["n_links"] for i, r in got.items()}


def test_near_vectors_odd_tables(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(5, [1.0, 2.0, 3.0]), (5, [-3.0, 1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (9, [-3.0, 1.0, 0.0]), (7, None)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [("2", 1, 2, True), ("5", 1, 2, False), ("5", 1, 2, False), ("7", 0, 7, True), ("9", 1, 2, False), ("None", 0, None, True)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    y = near_vectors.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(near_vectors.hadamard(y), x)


# -------------------------------------------------------------------------- warc


def test_archives(spark):
    rng = np.random.default_rng(2)
    long = "".join(chr(c) for c in rng.choice([65, 233, 0x4E2D, 10, 13, 0x1F600], 30_000))
    pages = [(i, f"http://a/{i}", t) for i, t in enumerate(
        ["x" * 100, "x" * 99, None, "", long, "WARC/1.1\r\n\r\nno record\r\n\r\n0\r\n\r\n" * 9, "é" * 50, "x" * 100, "x" * 99, long, "é" * 50, "", "x" * 100])]
    pages += [(None, None, "x" * 100), (40, "bad\r\nurl: a", "y" * 300), (40, "u", "x" * 100), (40, "u", "x" * 100)]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "digest", "first")
    folder = new_folder(spark, "warc")
    warc.write_archives(df, folder, segment_bytes=1000, chunk_bytes=333, records_per_archive=3)
    records = warc.read_archives(spark, folder)
    assert records.where("status <> 'ok'").count() == 0 and records.count() == len(pages)
    got = sorted((tuple(r) for r in warc.resolve(records).collect()), key=str)
    first: dict = {}
    for i, _, t in pages:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    expected = []
    for i, _, t in pages:
        raw = (t or "").encode()
        revisit = len(raw) >= 100 and i is not None and i > first[t or ""]
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[t or ""] if revisit else None))
    assert got == sorted(expected, key=str)
    empty = new_folder(spark, "warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.resolve(warc.read_archives(spark, empty)).collect() == []


def test_broken_segments_are_told(spark):
    block = warc._HTTP + warc.chunked(b"abc" * 100, 50)

    def record(kind, name, number, body, total=None, origin=None):
        heads = [(b"WARC-Type", kind), (b"WARC-Record-ID", name), (b"WARC-Segment-Number", b"%d" % number), (b"WARC-Page-Number", b"1")]
        heads += [(b"WARC-Segment-Total-Length", b"%d" % total)] if total else []
        return warc._record(heads + ([(b"WARC-Segment-Origin-ID", origin)] if origin else []), body).decode()

    def read(*records):
        folder = new_folder(spark, "warc")
        spark.createDataFrame([(r,) for r in records], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
        return [(r["status"], r["payload"]) for r in warc.read_archives(spark, folder).collect()]

    a, b, n = block[:100], block[100:], len(block)
    assert read(record(b"continuation", b"<b>", 2, b, n, b"<a>"), record(b"response", b"<a>", 1, a)) == [("ok", bytearray(b"abc" * 100))]
    assert read(record(b"response", b"<a>", 1, a))[0][0] == "last segment missing"
    assert read(record(b"response", b"<a>", 1, a), record(b"continuation", b"<b>", 2, b, n + 1, b"<a>"))[0][0] == "total length differs"
    assert read(record(b"response", b"<a>", 1, a), record(b"continuation", b"<b>", 3, b, n, b"<a>"))[0][0] == "segments missing or repeated"
    assert read(record(b"continuation", b"<b>", 1, b, n, b"<a>"))[0][0] != "ok"


# ----------------------------------------------------------------------- quality


def test_quality_separates_and_reads_text_only(spark):
    rows = data.texts(11, 150)
    good = [(i, t, 1) for i, t in rows[:150]]
    junk = [(1000 + i, " | ".join(w.upper() + "$$%%" for w in (t or "").split()), 0) for i, t in rows[:40]]
    odd = [(2000, None, None), (2001, "", None), (None, "text", None), (3, rows[3][1], 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + junk + odd], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + junk] + [(77777, 1), (None, 1), (5, None)], "doc_id long, quality int")
    scorer = quality.fit(docs, labels, common.remainder("id", 5) != 0)
    assert 0.6 < scorer.prior < 0.95
    out = quality.score(clashing(docs, "score", "predicted"), scorer).collect()
    assert len(out) == len(good + junk + odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [(r["doc_id"] < 1000, r["predicted"]) for r in out if r["doc_id"] is not None and r["doc_id"] < 2000 and plain.crc(r["doc_id"], 5) == 0]
    assert np.mean([p == y for y, p in held]) > 0.9
    assert quality.score(docs.limit(0), scorer).collect() == []


def test_quality_risk_and_priors():
    rng = np.random.default_rng(4)
    positive = rng.standard_normal((400, quality.WIDTH)).astype(np.float32) + 0.3
    mixed = np.concatenate([rng.standard_normal((300, quality.WIDTH)) + 0.3, rng.standard_normal((300, quality.WIDTH)) - 0.3]).astype(np.float32)
    scorer = quality.train(positive, mixed, 0.5)
    s = scorer.score(mixed)
    assert (s[:300] > 0.5).mean() > 0.9 and (s[300:] < 0.5).mean() > 0.9
    assert 0.25 < quality.train(positive, mixed, None).prior < 0.75  # estimated without labelled negatives
    empty = quality.train(positive[:0], mixed[:0], None)
    assert empty.score(mixed)[0] == pytest.approx(0.5)
    d, o = common.text_bytes(pa.array(["ab", None, "a" * 3_000_000]))
    x = quality.features(d, o)
    assert x.shape == (3, quality.WIDTH) and not x[1].any() and np.isfinite(x).all()


# ---------------------------------------------------------------------- language


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = language.train([(b"abc", "x"), (b"def", "y")], steps=1)
    text, target = rng.integers(97, 105, (5, 3)).astype(np.uint8), np.array([0, 1, 1])
    real = np.ones((5, 3), np.float32)
    real[3:, 1] = 0
    _, grads = language._gradients(net, text, target, real)
    weights = [*net.inputs, *net.recurrent, net.output, net.bias]
    for w, g in zip(weights, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step, losses = w[at], 1e-2, []
        for sign in (1, -1):
            w[at] = old + sign * step
            losses.append(language._gradients(net, text, target, real)[0])
        w[at] = old
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(g[at]), rel=0.05, abs=2e-4)


def test_language(spark):
    rng = np.random.default_rng(6)
    syllables = {"aa": ["ba", "na", "ko"], "bb": ["thr", "ing", "est"], "cc": ["éè", "oui", "ç"]}
    rows = []
    for i in range(240):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(int(rng.integers(3, 200)))), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "bana " * 20_000, None), (None, "ingest", None), (904, "bana kona", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, common.remainder("id", 4) != 2, steps=150)
    assert net.languages == ["aa", "bb", "cc"]
    got = language.predict(clashing(docs, "lang_pred", "score"), net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    held = [i for i, _, _ in rows[:240] if plain.crc(i, 4) == 2]
    assert np.mean([by_id[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    alone = {r["doc_id"]: r["score"] for r in language.predict(docs.where("doc_id in (903, 904, 5)"), net).collect()}
    assert all(by_id[i]["score"] == pytest.approx(s, abs=2e-6) for i, s in alone.items())  # whatever lies in the same batch
    assert language.predict(docs.limit(0), net).collect() == []
    none = language.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language.predict(docs.where("doc_id = 5"), none).collect()} == {"und"}


def test_language_samples_the_whole_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, **_: seen.extend(texts))
    language.fit(spark.createDataFrame([(1, "h" * 4000 + "b" * 36000, "x"), (2, "short", "y")], "doc_id long, text string, lang string"))
    by_language = {lang: pieces for pieces, lang in seen}
    assert by_language["y"] == [b"short"]
    assert sum(len(p) for p in by_language["x"]) <= 4000 and len(by_language["x"]) == 62
    assert sum(p == b"b" * 64 for p in by_language["x"]) > 40  # nine tenths of the text lie behind the header
    assert language._pieces(b"abc" * 3000, 5, 64, 4000) == language._pieces(b"abc" * 3000, 5, 64, 4000)
