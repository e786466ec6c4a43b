import pytest
from pyspark.sql import functions as F

from quarry.functions import routing as R
from tests.conftest import rows

CORPUS = [
    ("find my resume", "local_query", "files"),
    ("open the spreadsheet", "local_query", "files"),
    ("show me all my python scripts", "local_query", "files"),
    ("open the most recent document I worked on", "local_query", "files"),
    ("my Mac is running really slow", "local_query", "system"),
    ("how much RAM do I have", "multi_query", None),
    ("am I running low on memory", "local_query", "system"),
    ("why is my fan spinning loud", "local_query", "system"),
    ("is there a new macOS update available", "web_query", None),
    ("when does WWDC 2024 start", "web_query", None),
    ("how do I fix a kernel panic", "web_query", None),
    ("current Bitcoin price", "web_query", None),
    ("is 8GB RAM enough for video editing", "multi_query", None),
    ("can my computer run Stable Diffusion", "multi_query", None),
    ("compare my specs to Cyberpunk 2077 requirements", "multi_query", None),
    ("what LLM should I download for my 8GB Mac", "multi_query", None),
    ("check if my system meets requirements for Xcode", "multi_query", None),
    ("hey what's up", "conversation", None),
    ("thanks for the help", "conversation", None),
    ("bye see you later", "conversation", None),
    ("find the weather report I downloaded", "local_query", "files"),
    ("open my notes app", "local_query", "files"),
    # branches the corpus leaves out
    ("look at a map", "see", None),
    ("look at the thing", "conversation", None),  # "thing" holds "hi"
    ("what do you know about me", "local_query", "memory"),
    ("clean up large files now", "local_query", "disk"),
    ("free up space", "local_query", "system"),  # the system rule comes first
    ("clean up soon", "local_query", "disk"),
    ("what is in the tax report folder", "local_query", "files"),
    ("zzz qqq", "local_query", "files"),
    ("is this ok", "conversation", None),
    ("seed catalogue", "see", None),
]


def routed(spark, queries, **options):
    df = spark.createDataFrame([(i, q, u) for i, (q, u) in enumerate(queries)], "qid int, query string, username string")
    return R.route(df, **options).orderBy("qid").collect()


def test_corpus(spark):
    got = routed(spark, [(q, None) for q, _, _ in CORPUS])
    wrong = [(r.query, r.tool, r.target) for r, (_, tool, target) in zip(got, CORPUS) if (r.tool, r.target) != (tool, target)]
    assert wrong == []


def test_whole_words_do_not_fire_inside_words(spark):
    got = routed(spark, [("is this ok", None), ("seed catalogue", None), ("hi there", None)], whole_words=True)
    assert [r.tool for r in got] == ["local_query", "local_query", "conversation"]


def test_search_terms(spark):
    df = spark.createDataFrame(
        [("What does my resume say?", "casey18"), ("my my Résumé, café-2 a", "x9"), ("the THE", None)], "q string, u string"
    )
    got = rows(df.select(R.search_terms(F.col("q"), F.col("u"))))
    assert got == [(["resume", "casey"],), (["résumé", "café"],), ([],)]


def test_multi_queries_name_their_tools(spark):
    row = routed(spark, [("can i run this game", None)])[0]
    assert row.tool == "conversation"  # "this" holds a greeting
    row = routed(spark, [("can i run doom", None)])[0]
    assert (row.tool, row.tools, row.combine_strategy) == ("multi_query", ["local_query:system", "web_query"], "parallel")


@pytest.mark.parametrize("query,expected", [
    ("battery and gpu slow", ["cpu", "processes", "battery", "gpu"]), ("noisy", ["all"]), ("ram on disk", ["memory", "disk"]),
])
def test_metrics(spark, query, expected):
    assert rows(spark.createDataFrame([(query,)], "q string").select(R.metrics(F.col("q")))) == [(expected,)]


def test_smart_defaults(spark):
    df = spark.createDataFrame(
        [("photos of the document I downloaded yesterday", "search_files", None), ("desktop", "web_search", None),
         ("old code", "open_file", "home")], "q string, tool string, loc string",
    )
    d = R.smart_defaults(F.col("q"), F.col("tool"), F.lit(None).cast("array<string>"), F.col("loc"), F.lit(None).cast("string"))
    got = [tuple(r[0]) for r in df.select(d).collect()]
    assert got == [(["image", "pdf", "document"], "downloads", "week"), ([], None, None), (["code"], "home", None)]


def test_fallback_and_tool_names(spark):
    df = spark.createDataFrame([("weather today", "NO_TOOL "), ("my weather file", "mcp_search"), ("hi", "x"), ("zz", "see")],
                               "q string, n string")
    got = rows(df.select(R.route_fallback(F.col("q")), R.normalize_tool(F.col("n"))))
    assert got == [("web_query", "conversation"), ("local_query", "web_query"), ("conversation", "no_tool"),
                   ("local_query", "see")]
