import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, common, decontaminate, jaccard_join, katz, line_dedup, rans, spans
from quarry.session import new_folder
from tests.llm import data, plain

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def clashing(df, *names):
    """With extra columns named like the outputs, in another case too."""
    for i, n in enumerate(names):
        df = df.withColumn(n.upper() if i % 2 else n, F.lit("own"))
    return df


def test_spans_of_odd_texts():
    import pyarrow as pa

    d, o = common.text_bytes(pa.array(["A b\tc", None, "", "  x", "y"]))
    s, e, r = spans.words(d, o, spans.NOT_BLANK)
    assert [bytes(d[a:b]) for a, b in zip(s, e)] == [b"A", b"b", b"c", b"x", b"y"] and r.tolist() == [0, 0, 0, 3, 4]
    h = spans.hashes(d, s, e)
    assert len(set(h.tolist())) == 5
    d2, o2 = common.text_bytes(pa.array(["zz a"]))
    s2, e2, _ = spans.words(d2, o2, spans.NOT_BLANK)
    assert spans.hashes(d2, s2, e2)[1] == h[0]  # case and place do not matter


@pytest.mark.parametrize("limit", [1 << 21, 0])  # both ways for the repeated keys
def test_line_dedup(spark, limit):
    rows = data.texts()
    df = clashing(frame(spark, rows), "kept_text", "n_lines")
    out = line_dedup.drop_repeated_lines(df, min_docs=10, max_broadcast_keys=limit)
    assert len(out.columns) == 5
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in out.collect())
    expected = plain.dropped_lines(rows, 10)
    assert got == expected and sum(x[2] for x in expected) > 10


def test_line_dedup_small_filter_is_exact(spark):
    rows = data.texts(2)
    got = sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(frame(spark, rows), min_docs=2, filter_bits=1 << 16).collect())
    assert got == [(a, c) for a, _, c, _ in plain.dropped_lines(rows, 2)]


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_line_dedup_keeps_first(spark, limit):
    rows = [(3, "a\nb\na"), (1, "x\nA "), (2, "b"), (None, "a"), (None, None)]
    out = line_dedup.drop_repeated_lines(frame(spark, rows), min_docs=2, keep_first=True, max_broadcast_keys=limit)
    assert {(r["doc_id"], r["kept_text"]) for r in out.collect()} == {(3, ""), (1, "x\nA "), (2, "b"), (None, "")}
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == []


@pytest.mark.parametrize("windows", [1 << 20, 15])  # one block of the benchmark, several blocks
def test_decontamination(spark, windows):
    rows = data.texts(3)
    items = [(1, " ".join(rows[4][1].split()[:14])), (2, "no such words in any text at all, surely none"), (2, "again"), (None, rows[7][1]), (30, "Changed"),
             (4, None), (5, " .,; "), (6, rows[20][1]), (6, rows[20][1])]
    df = clashing(frame(spark, rows), "n_words", "leak_spans")
    found = decontaminate.find_leaks(df, frame(spark, items, "item_id long, text string"), max_windows=windows)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["leaked_items"]) for r in found.collect())
    expected = [(i, *plain.leaks(t, items, 10)) for i, t in rows]
    assert got == expected and sum(x[2] > 0 for x in expected) > 10
    assert decontaminate.remove_leaks(found).count() == sum(x[2] == 0 for x in expected)
    cut = decontaminate.remove_leaks(found, whole_documents=False)
    assert cut.columns == found.columns and cut.count() == len(rows)
    for r in cut.collect():
        n, hit, _ = plain.leaks(dict(rows)[r["doc_id"]], items, 10)
        assert plain.leaks(r["text"], [], 10)[0] == n - hit
    assert decontaminate.find_leaks(frame(spark, []), frame(spark, items, "item_id long, text string")).collect() == []
    assert decontaminate.find_leaks(frame(spark, rows), frame(spark, [], "item_id long, text string")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(spark, size, percent):
    rows = data.texts(4, 80)
    expected = plain.jaccard_components(rows, size, percent)
    df = clashing(frame(spark, rows), "n_shingles", "component_id", "node", "n")
    got = {r["doc_id"]: r for r in jaccard_join.similar_components(df, size, percent).collect()}
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["n_shingles"] == len(plain.shingles(dict(rows)[i], size)) for i, r in got.items())
    assert sum(c != i for i, c in expected.items()) > 15


def test_jaccard_join_chains_and_large_groups(spark):
    """Near copies of one text in which neighbours link and others do not, and ids that repeat or are null."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base[:]
        for k in range(i % 40):
            w[(k * 7) % 120] = f"v{k}-{i // 40 if i % 3 else 0}"
        rows.append((rng.randrange(140), " ".join(w)))
    rows += [(None, " ".join(base)), (None, None), (7, "other words than those above, five or more")]
    expected = plain.jaccard_components(rows, 4, 85)
    got = jaccard_join.similar_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert jaccard_join.similar_components(frame(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_join.similar_components(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_tree_join_is_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    sets = []
    for _ in range(200):
        own = base[rng.random(len(base)) > 0.1]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])))
    for probe in sets[:20]:
        p = set(probe.tolist())
        expected = [i for i, s in enumerate(sets) if 100 * len(p & set(s.tolist())) >= 85 * len(p | set(s.tolist()))]
        assert sorted(jaccard_join.tree_join(probe, sets, 85)) == expected


def test_byte_bpe_matches_the_library(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = data.texts(5) + [(None, "again again"), (None, None)]
    out = byte_bpe.decode(byte_bpe.encode(clashing(frame(spark, rows), "ids", "decoded"), RANKS, PATTERN), RANKS, PATTERN)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(frame(spark, []), RANKS, PATTERN).collect() == []


def test_byte_bpe_backtracks():
    coder = byte_bpe.Coder({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"ca": 6}, r"\w+")
    for raw in (b"abc", b"ab", b"cab", b"abcab", b"bcabca", b"aabbccabcabbca" * 3):
        assert coder.piece(raw) == coder._merged(raw)


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = data.texts(6)
    df = clashing(frame(spark, rows[::-1]), "start", "ids")
    folder = new_folder(spark, "ids")
    rans.write_ids(df, folder, path, end=2)
    got = {r["doc_id"]: r for r in rans.read_ids(spark, folder).collect()}
    at = 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], list(got[i]["ids"])) == (at, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(got) == len(rows)
    empty = new_folder(spark, "ids")
    rans.write_ids(frame(spark, []), empty, path, end=2)
    assert rans.read_ids(spark, empty).collect() == []
    repeated = new_folder(spark, "ids")
    rans.write_ids(frame(spark, [(None, "a"), (1, "b"), (1, "b"), (None, None)]), repeated, path, end=2)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rans.read_ids(spark, repeated).collect()) == [("1", 2), ("1", 2), ("None", 1), ("None", 2)]


def test_rans_blocks_and_sections():
    rng = np.random.default_rng(1)
    long = np.minimum(rng.geometric(0.01, rans.BLOCK + 5000) - 1, 70_000).astype(np.uint32)
    documents = [(5, long, True), (None, np.array([70_001], np.uint32), True), (9, np.array([3] * 10, np.uint32), False)]
    raw = b"".join(r + b"\n" for r in rans.write_section(documents))
    back: dict = {}
    for name, ids, _ in rans.read_file(raw):
        back.setdefault(name, []).append(ids)
    assert {k: np.concatenate(v).tolist() for k, v in back.items()} == {k: v.tolist() for k, v, _ in documents}
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        list(rans.read_file(bytes(broken)))
    only = b"".join(r + b"\n" for r in rans.write_section([(1, np.zeros(3000, np.uint32), True)]))
    assert [x[1].tolist() for x in rans.read_file(only)] == [[0] * 3000]


def test_katz_base_and_known(spark):
    rows = data.texts(7)
    got = {r["id"]: r for r in katz.score_documents(clashing(frame(spark, rows), "n_tokens", "score"), "crc32(cast(id as string)) % 5 <> 1", vocabulary=40).collect()}
    expected, total = plain.base_scores(rows, lambda i: plain.crc(i, 5) != 1)
    for (i, _), (n, known, base) in zip(rows, expected):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["score"] < 0


def test_katz_is_normalised_and_agrees_with_recursion(spark):
    rows = data.texts(8)
    texts = frame(spark, rows, "id long, text string")
    fitted = katz.fit(texts.where("id % 4 <> 0"), vocabulary=30)
    model, words, pairs, _ = fitted
    n = len(model.p1)
    assert model.p1.sum() == pytest.approx(1)
    counts: dict[int, int] = {}
    for r in pairs.select("keys", "counts").collect():
        counts |= dict(zip(np.frombuffer(r[0], np.uint32).tolist(), np.frombuffer(r[1], np.uint32).tolist()))
    seen: dict[int, int] = {}
    for r in words.select("keys", "counts").collect():
        seen |= dict(zip(np.frombuffer(r[0], np.uint64).tolist(), np.frombuffer(r[1], np.uint32).tolist()))
    for h in range(n):
        c = np.array([counts.get(h << 16 | w, 0) for w in range(n)])
        assert model.pair(np.full(n, h), np.arange(n), c).sum() == pytest.approx(1, abs=1e-9)
    other = sum(float(model.word_mass(np.array([c]))[0]) for w, c in seen.items() if w not in set(model.words.tolist())) + model.unseen
    assert other == pytest.approx(model.p1[model.other], rel=1e-9)  # the class of other words spells its words exactly
    for r in katz.score(texts, fitted).collect():
        import pyarrow as pa

        t = katz._Texts(model, pa.array([dict(rows)[r["id"]]]))
        c = np.array([counts.get(int(p), 0) for p in t.pairs])
        value = np.log10(model.pair(t.context, t.classes, c)).sum()
        value += sum(np.log10(model.word_mass(np.array([seen.get(int(h), 0)]))[0] / model.p1[model.other]) for h in t.hashes[t.rare])
        assert r["score"] == pytest.approx(float(value), abs=1e-6)


def test_katz_odd_tables(spark):
    texts = [(1, "a b"), (1, "a b"), (None, None), (3, "c")]
    got = katz.score_documents(frame(spark, texts), "id = 1").collect()
    assert len(got) == 4
    assert len({(r["base_score"], r["score"]) for r in got if r["id"] == 1}) == 1
    nothing = katz.score_documents(frame(spark, texts), "false").collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and -3 < r["score"] < 0 for r in nothing)
    assert katz.score_documents(frame(spark, []), "true").collect() == []


def test_good_turing_factors():
    n = np.array([0, 100, 40, 22, 13, 9, 6.0])
    d = katz.discounts(n)
    assert (0 < d[1:]).all() and (d[1:] <= 1).all()
    assert sum(n[r] * r * (1 - d[r]) for r in range(1, 6)) == pytest.approx(n[1])  # what is taken away is the mass of one-timers


def test_hashes_of_queries(spark):
    """The digests of a registered query come from the operator's outputs."""
    from quarry.llm.queries import QUERIES

    rows = QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001").limit(3).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in rows)


def test_katz_pairs_of_all_words(spark):
    rows = data.texts(8)
    trained = [(i, t) for i, t in rows if i % 4 != 0]
    tokens = {i: plain.words(t) + [None] for i, t in rows}  # None: the end
    single, pair, after = {}, {}, {}
    for i, _ in trained:
        for h, w in zip(["<s>"] + tokens[i], tokens[i]):
            single[w], pair[h, w] = single.get(w, 0) + 1, pair.get((h, w), 0) + 1
            after.setdefault(h, set()).add(w)
    of_counts = lambda c: np.array([0] + [sum(v == r for v in c.values()) for r in range(1, 7)], float)
    d1, d2 = katz.discounts(of_counts(single)), katz.discounts(of_counts(pair))
    cut = lambda c, d: c * (d[c] if c <= 5 else 1.0)
    total = sum(single.values())
    kept = sum(cut(c, d1) for c in single.values())
    unseen = 1 - kept / total if kept < total - 1e-9 else 1 / (total + 1)
    p = {w: (1 - unseen) * cut(c, d1) / kept for w, c in single.items()}
    share, bow = {}, {}
    for h, own in after.items():
        n, k = sum(pair[h, w] for w in own), sum(cut(pair[h, w], d2) for w in own)
        left = 1 - k / n if k < n - 1e-9 else 1 / (n + 1)
        share[h], bow[h] = (1 - left) / k, left / (1 - sum(p[w] for w in own))
        assert sum(share[h] * cut(pair[h, w], d2) if w in own else bow[h] * p[w] for w in p) + bow[h] * unseen == pytest.approx(1)
    got = {}
    for hot in (1, 30, 65_000):  # how many words are at hand in every task does not change a score
        got = {r["id"]: r["score"] for r in katz.score_documents(frame(spark, rows), "id % 4 <> 0", vocabulary=hot).collect()}
        for i, _ in rows:
            value = 0.0
            for h, w in zip(["<s>"] + tokens[i], tokens[i]):
                value += np.log10(share[h] * cut(pair[h, w], d2) if (h, w) in pair else bow.get(h, 1.0) * p.get(w, unseen))
            assert got[i] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("least", [5, 6, 7, 8])
def test_katz_any_number_of_buckets(spark, monkeypatch, least):
    """Words and pairs lie in the same buckets, whatever the number of tasks or of bytes asks for."""
    rows = data.texts(8)
    size = sum(len((t or "").encode()) for i, t in rows if plain.crc(i, 5) != 1)
    monkeypatch.setattr(katz, "BUCKET_PAIRS", -(-size // 4 // (10 + least)))  # 15 to 18 buckets and more
    expected, total = plain.base_scores(rows, lambda i: plain.crc(i, 5) != 1)
    got = {r["id"]: r for r in katz.score_documents(frame(spark, rows), "crc32(cast(id as string)) % 5 <> 1", vocabulary=40).collect()}
    monkeypatch.undo()
    same = {r["id"]: r["score"] for r in katz.score_documents(frame(spark, rows), "crc32(cast(id as string)) % 5 <> 1", vocabulary=40).collect()}
    for (i, _), (n, known, base) in zip(rows, expected):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["score"] == pytest.approx(same[i], abs=1e-6)


def test_a_worker_remembers_half_a_million_words():
    from quarry.llm import byte_bpe

    memo, made = byte_bpe.WordMemo(), []
    runs = [[f"{run}.{i}" for i in range(100_000)] for run in range(5)]
    for words in [*runs, runs[0]]:
        memo.results(words, lambda new: made.append(len(new)) or [w.encode() for w in new])
    assert made == [100_000] * 5


def test_a_worker_remembers_words_in_few_bytes():
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    memo = byte_bpe.WordMemo()
    for run in range(7):
        memo.results([f" {run}.{i}" for i in range(100_000)], lambda new: [w.encode() for w in new])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80e6


@pytest.mark.parametrize("clash", [False, True])
def test_a_full_memo_and_equal_keys_change_nothing(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(spans, "hashes", lambda data, starts, ends, *_: np.full(len(starts), 7, np.uint64))
    memo, rng = byte_bpe.WordMemo(10), np.random.default_rng(3)
    for _ in range(30):
        words = ["Aa" * int(n) + str(n) for n in rng.integers(0, 40, 25)] + ["aA", "AA", "", "\u00e9" * 90]
        assert memo.results(words, lambda new: [w.encode()[::-1] for w in new]) == [w.encode()[::-1] for w in words]


def test_words_of_texts_with_odd_blanks():
    import pyarrow as pa
    import regex

    cut = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
    rng = np.random.default_rng(4)
    signs = list("aB.\n\t\x1c\x1f\x00\u00e9\u0085\u00a0\u00c5\u1680\u2009\u2019\u2028\u202f\u205f\u3000\u3042\U0001f600") + [" "] * 8
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 30, 4000)] + [None, "", " ", "a b"]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, first = byte_bpe.split_words(data, offsets)
    ends, raw = np.append(starts[1:], len(data)), data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    expected = [cut.split(t) if t else [] for t in texts]
    assert got == [[w if k == 0 else " " + w for k, w in enumerate(x)] for x in expected]


def test_token_files_encode_as_the_library_with_odd_blanks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    definition = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    rng = np.random.default_rng(5)
    signs = [*"ab\n\t.'s\u00e9\u00a0\u3000\u4e2d7", "the", "The", "<|endoftext|>", "x" * 70] + [" "] * 8
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 500)] + [None, ""]
    tokenizer = Tokenizer.from_str(definition)
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for by_word in (True, False):
        for _ in range(2):  # the second time words are remembered
            ids, ends = rans._encoder(definition, by_word).encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected


def test_a_worker_keeps_its_words_for_the_next_task(monkeypatch):
    import pyarrow as pa

    definition = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    rans._encoder(definition, True).encode(pa.array(["one two three"]))
    monkeypatch.setattr(rans.WordEncoder, "_encode", lambda self, texts: pytest.fail("encoded again"))
    ids, ends = rans._encoder(definition, True).encode(pa.array(["one two", "one three"]))
    assert len(ids) and ends.tolist() == [0, 2, 4]


def test_byte_bpe_decodes_in_the_worker_that_encodes(spark):
    rows = data.texts(5) + [(None, "again again"), (None, None)]
    df = clashing(frame(spark, rows), "ids", "decoded")
    once = byte_bpe.encode(df, RANKS, PATTERN, decoded="decoded")
    twice = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN).drop("text"), RANKS, PATTERN)
    assert once.schema == twice.schema and sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_worker_gives_up_what_an_operator_kept():
    kept = common.held("some operator", lambda: [1])
    assert common.held("some operator", lambda: [2]) is kept
    common.held("another operator", list)
    assert common.held("some operator", lambda: [3]) == [3]
    common.release()
    assert common.held("some operator", lambda: [4]) == [4]
    common.release()
