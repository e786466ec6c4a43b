"""From a table of queries to context text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import routing as R
from quarry.operators import context as C
from quarry.operators import photos as PH
from quarry.operators import search as SE
from quarry.session import materialize

# ---------------------------------------------------------------- fixed values
# What a query is told when its branch has no answer.
_NO_ANSWER = {
    "files": "\n\n## File Search Results\n",
    "content": "\n\n## File Content Results\n",
    "photos": "\n\n## Photo Search\nNo matching photos found.",
    "memory": "\n\n## About You\nI don't know much about you yet. Tell me about yourself!",
    "system": "\n\n## System Info\nNo system information available.",
    "web": "\n\n## Web Search\nNo web search results found.",
    "multi": "\n\n## Context\nNo additional context available.",
    "disk": "\n\n## Disk Analysis\nDisk analysis not yet implemented.",
    "see": "\n\n## Screen Description\nFailed to capture or analyze screen.",
    "none": "",
}


def plan_queries(queries: DataFrame) -> DataFrame:
    """Route every query and name the branch that answers it."""
    routed = R.route(queries).withColumn(
        "embedding_query", R.embedding_query(F.col("query"), F.col("search_terms"))
    )
    branch = (
        F.when(F.col("tool") == "web_query", "web")
        .when(F.col("tool") == "multi_query", "multi")
        .when(F.col("tool") == "see", "see")
        .when(F.col("tool") != "local_query", "none")
        .when(F.col("target") == "files", F.when(F.col("intent") == "read", "content").otherwise("files"))
        .when(F.col("target").isin("photos", "memory", "system", "disk"), F.col("target"))
        .otherwise("unknown")
    )
    return routed.withColumn("branch", branch)


def dispatch(planned: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Answer every planned query from its branch: (qid, tool, branch, success, context).

    ``branches``: per branch name (files, content, photos, memory, system, web)
    a DataFrame (qid, context).  A query asks one section, a multi query the
    system and the web section; one join and one aggregation serve all branches.
    Queries without an answer get the text for no hits.
    """
    sections = F.when(F.col("branch") == "multi", F.array(F.lit("system"), F.lit("web"))).otherwise(F.array("branch"))
    asked = planned.select("qid", "tool", "branch", "target", F.posexplode(sections).alias("position", "section"))
    answers = reduce(
        DataFrame.unionByName,
        [c.select("qid", F.lit(name).alias("section"), "context") for name, c in branches.items()],
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("context").isNotNull(), F.struct("position", "context"))))
    found = asked.join(answers, ["qid", "section"], "left").groupBy("qid").agg(
        F.first("tool").alias("tool"), F.first("branch").alias("branch"), F.first("target").alias("target"),
        F.array_join(F.transform(parts, lambda p: p["context"]), "\n").alias("_found"), F.count("context").alias("_n"),
    )
    nothing = None
    for name, text in _NO_ANSWER.items():
        nothing = (F.when if nothing is None else nothing.when)(F.col("branch") == name, text)
    unknown = F.concat(F.lit("Unknown target: "), F.coalesce("target", F.lit("")))
    return found.select(
        "qid", "tool", "branch", (~F.col("branch").isin("unknown", "see")).alias("success"),
        F.when(F.col("_n") > 0, F.col("_found")).otherwise(nothing.otherwise(unknown)).alias("context"),
    )


def hybrid_photo_search(
    photos: DataFrame, queries: DataFrame, index: DataFrame, limit: int = 10, variant: str = "client"
) -> DataFrame:
    """Keyword photo search, filled up with vector hits where it finds too little.

    ``queries``: qid, query, vector; ``index``: rows of the vector index.
    """
    terms = queries.select("qid", F.explode(R.photo_keywords(F.col("query"), variant)).alias("term"))
    keyword = PH.search_photos(photos, terms, limit).select("qid", F.col("file_path").alias("path"), "rank")
    asked = SE.with_preset(queries.select("qid", "vector"), "photos")
    hits = SE.knn(asked, index, limit)
    vector = hits.join(index.select("row_id", F.col("file_path").alias("path")), "row_id").select("qid", "path", "rank")
    return SE.hybrid_merge(keyword, vector, limit, fv.HYBRID_MIN_KEYWORD_HITS)


def answer(
    planned: DataFrame, index: DataFrame, photos: DataFrame, told: dict[str, tuple[DataFrame, str]], vectors: tuple[DataFrame, str], k: int = 10
) -> DataFrame:
    """Every planned query answered by its own branch: (qid, tool, branch, success, context).

    ``planned``: :func:`plan_queries`; ``index``: rows of the vector index; ``photos``: photo records; ``told``: for the
    sections ``system`` and ``web`` a table (key, context) and the name of the column of ``planned`` that holds the key;
    ``vectors``: in the same way a table (key, vector), unique by key. File, content and memory queries are one filtered
    vector search, whose hits go to the three renderers; queries of one branch and key share a search and its text, so the
    index meets distinct searches, however many ask. A query without a vector has no hits. Photo queries are searched by
    keyword and by vector.
    """
    table, key = vectors
    table = table.select("key", "vector")
    planned = materialize(planned, "planned").withColumn("key", F.col(key))
    render = {"files": C.file_list, "content": C.content_groups, "memory": C.memory_list}
    name_of = F.concat_ws(":", "branch", F.col("key").cast("string"))
    asked = planned.filter(F.col("branch").isin(*render)).select("branch", "key").distinct().join(table, "key")
    asked = materialize(asked.select(name_of.alias("qid"), "branch", "vector"), "asked")
    local = [SE.with_preset(asked.filter(F.col("branch") == name), name) for name in render]
    local = reduce(DataFrame.unionByName, local)
    hits = materialize(search(local, index, k).join(asked.select("qid", "branch"), "qid"), "hits")
    branches = {}
    for name, make in render.items():
        contexts = make(hits.filter(F.col("branch") == name)).withColumnRenamed("qid", "_search")
        wants = planned.filter(F.col("branch") == name).select("qid", name_of.alias("_search"))
        branches[name] = wants.join(contexts, "_search").select("qid", "context")
    pictured = planned.filter(F.col("branch") == "photos").join(table, "key", "left").select("qid", "query", "vector")
    found = hybrid_photo_search(photos, pictured, index, k)
    shown = F.struct("file_name", "persons", "keywords", "file_path")
    pictures = found.join(photos.select(F.col("file_path").alias("path"), shown.alias("p")), "path").select("qid", "rank", "method", "p.*")
    branches["photos"] = C.photo_list(pictures)
    for name, (contexts, key) in told.items():
        wants = planned.filter(F.col("branch").isin(name, "multi")).select("qid", F.col(key).alias("key"))
        branches[name] = wants.join(contexts.select("key", "context"), "key").select("qid", "context")
    return dispatch(planned, branches)


def search(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """Filtered vector search with hit metadata; ``queries``: qid, vector and filter columns."""
    return SE.hit_projection(SE.knn(queries, index, k), index)
