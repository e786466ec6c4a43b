"""URL rules, Merkle manifest and fill-in-middle against plain versions, on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, merkle, queries, url_rules
from tests.llm.data import prose, texts
from tools.check import digest, oracle_rows

FOLDER = "/root/testdata/sf0.001"
Rule = url_rules.Rule


@pytest.mark.parametrize("name", ["op11_url_rules", "op12_merkle_manifest", "op13_fill_in_middle"])
def test_query_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns, _, expected = oracle_rows(FOLDER, queries.ORACLES[name])
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, expected)[0]


# ---- URL rules

URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "https://a.b.Example.ORG/es/x?y#z", "http://example.org/es",
    "http://example.org/en/1", "http://example.org/en/139.html", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/",
    "http://x.com/de/?q=://org/", "http://x.com/DE/", "http://x.com?/de/", "http://x.com#/de/", "http://com/de/", "http://xcom/de/",
    "http://com:80/de/", "http://É.com/de/ü", "http://İ.example.org/es/\n", "a://b://c/d", "http://..org//", "http://example.org./es/",
    "http://x.com/fr/" + "y" * 100_000, "http://x.com/de/", "http://x.com/de/",
]


def plain_verdict(url, rules, otherwise="allow"):
    """Every rule tried in turn, by string comparison."""
    rest = "" if url is None or "://" not in url else url[url.index("://") + 3:]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (host, path, best.host + best.path if best else None, best.action if best else otherwise)


def test_url_rules_agree_with_trying_every_rule(spark):
    rows = [(i, u, "mine", 1) for i, u in enumerate(URLS)] + [(None, "http://x.com/de/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, Host string, size int")
    got = url_rules.judge(df, queries.URL_RULES).collect()
    assert sorted(got[0].asDict()) == ["host", "page_id", "path", "rule", "size", "url", "verdict"] and len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, queries.URL_RULES), r.url


def test_url_rules_in_many_blocks_give_the_same_rows(spark):
    rng = np.random.default_rng(3)
    names = ["org", "com", "example.org", "a.example.org", "b.com", "x.com", "news.x.com"]
    paths = ["/", "/a/", "/a/b", "/a/b/c", "/b/", "/c-d/", "/c-d/e.f", ""]
    rules = list({(h, p): Rule("allow" if rng.random() < 0.5 else "block", h, p) for h in names for p in paths if rng.random() < 0.7}.values())
    hosts = [*names, "sub.a.example.org", "other.net"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/y', '?q'])}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    one = {r.page_id: tuple(r) for r in url_rules.judge(df, rules, otherwise="unknown").collect()}
    many = {r.page_id: tuple(r) for r in url_rules.judge(df, rules, otherwise="unknown", limit=60).collect()}
    assert one == many and len(one) == 300
    rank = {r.text: i for i, r in enumerate(url_rules.in_order(rules))}
    for i, url in rows:
        host, path, rule, verdict = plain_verdict(url, rules, "unknown")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: rank[r.text], default=None)
        assert one[i][2:] == (host, path, best and best.text, best.action if best else "unknown")


def test_url_rules_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, queries.URL_RULES).count() == 0
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_rules.judge(df, []).first()["verdict"] == "allow"


def test_rule_tokens_index_and_wildcards(spark):
    assert Rule("block", "example.org", "/en/1").tokens() == {".example", ".org", "en"}
    assert Rule("block", "", "/ads*track/x").tokens() == {"ads*track".split("*")[0], "track"}  # literal stars
    assert Rule("block", "", "/ads*track/x", wildcards=True).tokens() == set()
    assert Rule("block", "", "/a/*/b/$", wildcards=True).tokens() == {"a", "b"}
    pattern = Rule("block", "", "/a/*.gif$", wildcards=True).pattern()
    assert pattern.match("x.y/a/b/c.gif") and not pattern.match("x.y/a/b/c.gif2") and not pattern.match("x.y/b/a/c.gif")
    rules = [Rule("block", "com", "/rare/"), Rule("block", "com", "/often/"), Rule("block", "", "/")]
    filed, always = url_rules.index_by_rarest(rules, {".com": 50, "rare": 1, "often": 80})
    assert filed == {"rare": [0], ".com": [1]} and always == [2]
    judge = url_rules.Judge(rules, {".com": 50, "rare": 1, "often": 80})
    assert judge.candidates("a.net", "/rare/") == [0, 2] and judge.candidates("a.com", "/x") == [1, 2]
    urls = spark.createDataFrame([("http://a.com/rare/rare/",), ("http://b.com/",), (None,)], "url string")
    assert url_rules.token_counts(urls, [".com", "rare", "often"]) == {".com": 2, "rare": 1, "often": 0}


# ---- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0]


def beside(nodes, i):
    """Siblings of node i, level by level."""
    out = []
    while len(nodes) > 1:
        start = i - i % 8
        run = nodes[start:start + 8]
        out += run[:i - start] + run[i - start + 1:]
        nodes = [sha(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
        i //= 8
    return out


def plain_leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_manifest(rows):
    """Whole trees in memory: {(doc_id, leaf): (subroot, root, proof, folded root)}, each fold by building all trees anew."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(((r[0] is not None, r[0] or 0), plain_leaf(r), r) for r in map(tuple, groups[g])) for g in order}
    nodes = {g: [x[1] for x in leaves[g]] for g in order}
    tops = [up(nodes[g]) for g in order]
    out = []
    for k, g in enumerate(order):
        for i, (_, leaf, r) in enumerate(leaves[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            new = plain_leaf((*r[:4], text)) if changed else leaf
            again = up(nodes[g][:i] + [new] + nodes[g][i + 1:])
            folded = up(tops[:k] + [again] + tops[k + 1:])
            proof = sha(*beside(nodes[g], i), *beside(tops, k))
            out.append((r[0], leaf, tops[k], up(tops), proof, folded, folded == up(tops)))
    return sorted(out, key=str)


def manifest_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def document_rows():
    langs = ["en"] * 5 + ["fr", None, "", "ß", "de"]
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", langs[i % 10], None if i % 11 == 0 else i, t) for i, t in texts(4, 70)]
    rows += [(None, "s", "en", 1, "ABC"), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "same"), (500, "s", "alone", 1, "X")]
    return rows


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_agrees_with_whole_trees(spark, tmp_path, monkeypatch, height):
    """Also with small blocks, so that the passes above the first have several blocks."""
    build = merkle.build
    monkeypatch.setattr(merkle, "build", lambda *a: build(*a, height=height))
    rows = document_rows()
    assert manifest_rows(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_many_groups_and_of_nothing(spark, tmp_path):
    rows = [(i, "s", f"l{i % 40:02d}", i, f"Text {i}") for i in range(130)]
    assert manifest_rows(spark, tmp_path / "many", rows) == plain_manifest(rows)
    assert manifest_rows(spark, tmp_path / "none", []) == []
    one = [(1, "s", "en", 3, "Abc")]
    assert manifest_rows(spark, tmp_path / "one", one) == plain_manifest(one)


def test_manifest_general_interface(spark):
    df = spark.createDataFrame([(i, i % 3, f"v{i}", "x") for i in range(30)], "key int, part int, value string, Leaf string")
    manifest = merkle.build(df, F.col("part"), merkle.leaf_hash([F.col("value")]), "key", {"Leaf": F.col("Leaf"), "part": F.col("part")})
    got = manifest.verify().collect()
    assert set(got[0].asDict()) == {"key", "part", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}
    assert len(got) == 30 and all(r.verified and r.leaf == plain_leaf([f"v{r.key}"]) for r in got)
    assert {r.root for r in got} == {manifest.root().first()["root"]}


# ---- fill-in-middle

def plain_example(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_examples_agree_with_plain_cuts(spark):
    import random

    rng = random.Random(5)
    rows = texts(2, 60)
    odd = ["<P>", "a <S> b", "x<M", "<<S>", "<P", "a" * 255, "a" * 256, "a" * 257, "é" * 128, "é" * 700, "a" * 10_000 + "é", "\U0001f600" * 999,
           "\x00\n\r" * 300, prose(rng, 300_000), "1" * 1_500_000]
    rows += [(1000 + i, t) for i, t in enumerate(odd * 2)] + [(None, "some text"), (None, None), (7, "some text"), (7, "some text")]
    df = spark.createDataFrame([(k, t, "kept", 3) for k, t in rows], "doc_id long, text string, Form string, extra int").repartition(4)
    got = fim.restore(fim.transform(df)).collect()
    assert len(got) == len(rows) and "Form" not in got[0].asDict() and "extra" in got[0].asDict()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_example(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    forms = {r.form for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_examples_of_an_empty_table(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("size", [1, 3, 16, 256])
def test_block_trees_find_every_cut(size):
    texts_ = ["", "a", "ab cd", "aé b", "é", "wörd—word 12 " * 9, "x" * 100, "\U0001f600 abc\n" * 20]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts_])
    trees = fim.BlockTrees(data, offsets, size)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts_]
    assert trees.total_units().tolist() == [len(u) for u in units]
    for k in range(max(map(len, units)) + 1):
        after = np.array([min(k, len(u)) for u in units])
        cut, points = trees.cut(after)
        before = ["".join(u[:a]) for u, a in zip(units, after)]
        assert cut.tolist() == [len(b.encode()) for b in before] and points.tolist() == [len(b) for b in before]


def test_restoring_a_null_form_is_the_output(spark):
    df = spark.createDataFrame([("abc", None), (None, "plain")], "output string, form string")
    assert [r.restored for r in fim.restore(df).collect()] == ["abc", ""]
