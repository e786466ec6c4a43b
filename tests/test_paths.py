import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as P
from tests.conftest import rows


def keep(spark, paths, mode, root=None):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r[0] for r in rows(df.filter(P.keep(F.col("path"), mode, root)))}


def test_scan_rule_tests_every_folder_below_the_root(spark):
    good = ["/r/sample.txt", "/r/sub/nested/deep.txt", "/r/.document.pdf.icloud", "/r/a.PY"]
    bad = ["/r/.hidden", "/r/node_modules/package.json", "/r/.DS_Store", "/r/x/.git/y", "/r/a/b.zip", "/r/a.LOCK", "/r/Thumbs.db"]
    assert keep(spark, good + bad, "scan", "/r") == set(good)
    assert keep(spark, ["/home/.cache/r/a.txt"], "scan", "/home/.cache/r") == {"/home/.cache/r/a.txt"}


def test_watcher_rule(spark):
    bad = ["/tmp/.DS_Store", "/tmp/.hidden", "/project/node_modules/package/index.js", "/project/.git/objects/abc"]
    good = ["/tmp/.file.txt.icloud", "/tmp/document.pdf", "/Users/me/Desktop/script.py"]
    assert keep(spark, good + bad, "any_part") == set(good)


def test_legacy_rule_drops_placeholders_too(spark):
    assert keep(spark, ["/a/.x.txt.icloud", "/a/b.txt", "/a/.h/b.txt", "/a/venv/b.txt"], "legacy") == {"/a/b.txt"}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        P.keep(F.lit("x"), "other")


def test_placeholders(spark):
    cases = {
        "/c/.document.pdf.icloud": (True, "document.pdf", "/c/document.pdf", ".pdf", "placeholder"),
        "/c/plain.txt": (False, "plain.txt", "/c/plain.txt", ".txt", "local"),
        "/c/.hidden": (False, ".hidden", "/c/.hidden", "", "local"),
        "/c/.my.archive.tar.gz.icloud": (True, "my.archive.tar.gz", "/c/my.archive.tar.gz", ".gz", "placeholder"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    name = P.base_name(F.col("path"))
    got = rows(df.select(
        "path", P.is_placeholder(name), P.real_name(name), P.real_path(F.col("path")), P.extension(name), P.sync_status(name)
    ))
    assert {r[0]: r[1:] for r in got} == cases


def test_suffix_like_a_path_library(spark):
    from pathlib import PurePosixPath

    names = ["a.txt", "a.tar.gz", ".bashrc", "noext", "a.", "..a", "A.TXT", "a.b.c d", ".a.b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(rows(df.select("n", P.suffix(F.col("n")))))
    want = {n: PurePosixPath(n).suffix if not n.endswith(".") else "" for n in names}
    assert got == want


def test_folder_source_and_description(spark):
    df = spark.createDataFrame(
        [("/home/u/a.txt",), ("/home/u/Documents/x/b.md",), ("/opt/c.zzz",), ("/home/u2/Documents/d.py",),
         ("/home/u/Library/Mobile Documents/com~apple~CloudDocs/e.pdf",)], "path string",
    )
    got = rows(df.select(
        P.relative_folder(F.col("path"), "/home/u"), P.classify_source(F.col("path"), "/home/u"),
        P.type_description(P.extension(P.base_name(F.col("path")))),
    ))
    assert got == [
        (".", "desktop", "text"), ("Documents/x", "documents", "markdown"), ("/opt", "desktop", "zzz"),
        ("/home/u2/Documents", "desktop", "Python code"),
        ("Library/Mobile Documents/com~apple~CloudDocs", "icloud", "PDF document"),
    ]
