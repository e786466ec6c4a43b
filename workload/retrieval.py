"""Routing, vectors, search, photos, context text."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import paths as P
from quarry.functions import routing as R
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.embedding import hashing_embedding, model_embedding
from quarry.operators import clusters as CL
from quarry.operators import context as C
from quarry.operators import filters as FI
from quarry.operators import folders as FO
from quarry.operators import photos as PH
from quarry.operators import search as SE
from quarry.operators.ordering import top_k
from quarry.plans import retrieval as RP
from quarry.plans.cells import CellIndex
from quarry.session import new_folder
from workload import bindings as B
from workload.registry import query, sql_list, sql_text

DIMS = 64


def joined(column):
    return F.array_join(column, "|")


# ----------------------------------------------------------------------- routing


def s_any(words, q="q"):
    return "(" + " OR ".join(f"contains({q}, {sql_text(w)})" for w in words) + ")"


def s_hits(words, q="q"):
    return f"len(list_filter({sql_list(words)}, lambda w: contains({q}, w)))"


def s_terms(q="query", user="username"):
    words = f"string_split_regex(lower({q}), '[^\\p{{L}}\\p{{N}}]+')"
    kept = f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(fv.SEARCH_STOPWORDS)}, w))"
    owner = f"regexp_replace(coalesce({user}, ''), '\\p{{Nd}}', '', 'g')"
    every = (
        f"CASE WHEN list_contains({words}, 'my') AND length({owner}) > 1 THEN list_append({kept}, {owner}) ELSE {kept} END"
    )
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


def s_metrics(q="q"):
    parts = ", ".join(f"CASE WHEN {s_any(words, q)} THEN {sql_list(names)} ELSE [] END" for names, words in fv.METRIC_WORDS)
    return f"(SELECT CASE WHEN len(m) > 0 THEN m ELSE ['all'] END FROM (SELECT flatten([{parts}]) AS m))"


@query("search_terms", f"WITH {B.ASKED} SELECT qid, array_to_string({s_terms()}, '|') AS terms FROM asked")
def search_terms(t):
    return B.asked(t).select("qid", joined(R.search_terms(F.col("query"), F.col("username"))).alias("terms"))


_SIGNALS = f"""signals AS (SELECT *, lower(query) AS q FROM asked), counted AS (SELECT *,
  {s_hits(fv.FILE_WORDS)} AS f, {s_hits(fv.SYSTEM_WORDS)} AS s, {s_hits(fv.WEB_WORDS)} AS w,
  {s_any(fv.AMBIGUOUS_WORDS)} AS unsure FROM signals), ruled AS (SELECT *, CASE
  WHEN {s_any(fv.CASUAL_WORDS)} AND NOT {s_any(fv.CASUAL_FILE_SUFFIXES)} THEN 'casual'
  WHEN {s_any(fv.SEE_WORDS)} THEN 'see'
  WHEN {s_any(fv.MEMORY_WORDS)} AND f = 0 THEN 'memory'
  WHEN {s_any(fv.MULTI_PATTERNS)} THEN 'multi'
  WHEN s >= 1 AND (f = 0 OR s > f) THEN 'system'
  WHEN w >= 1 AND f = 0 THEN 'web'
  WHEN w >= 1 THEN 'mixed'
  WHEN {s_any(fv.DISK_WORDS)} THEN 'disk'
  WHEN f >= 2 AND NOT unsure AND {s_any(fv.READ_WORDS)} THEN 'read'
  WHEN f >= 2 AND NOT unsure AND {s_any(fv.OPEN_WORDS)} THEN 'open'
  WHEN f >= 2 AND NOT unsure THEN 'find'
  WHEN unsure OR f = 1 THEN 'multi'
  ELSE 'default' END AS rule FROM counted)"""


@query("route", f"""
WITH {B.ASKED}, {_SIGNALS} SELECT qid,
  CASE rule WHEN 'casual' THEN 'conversation' WHEN 'see' THEN 'see' WHEN 'multi' THEN 'multi_query' WHEN 'web' THEN
    'web_query' ELSE 'local_query' END AS tool,
  CASE WHEN rule = 'memory' THEN 'recall' WHEN rule IN ('system', 'disk') THEN 'analyze' WHEN rule = 'web' THEN 'search'
    WHEN rule IN ('read', 'open') THEN rule WHEN rule IN ('mixed', 'find', 'default') THEN 'find' ELSE '' END AS intent,
  CASE WHEN rule IN ('memory', 'system', 'disk') THEN rule
    WHEN rule IN ('mixed', 'read', 'open', 'find', 'default') THEN 'files' ELSE '' END AS target,
  CASE WHEN rule IN ('read', 'open', 'find', 'default') THEN array_to_string({s_terms()}, '|') ELSE '' END AS search_terms,
  CASE WHEN rule = 'system' THEN array_to_string({s_metrics()}, '|') ELSE '' END AS metrics,
  CASE WHEN rule = 'multi' THEN 'local_query:system|web_query' ELSE '' END AS tools,
  CASE WHEN rule = 'multi' THEN 'parallel' ELSE '' END AS combine_strategy
FROM ruled""")
def route(t):
    empty = F.lit("")
    r = R.route(B.asked(t))
    return r.select(
        "qid", "tool", F.coalesce("intent", empty).alias("intent"), F.coalesce("target", empty).alias("target"),
        *[joined(c).alias(c) for c in ("search_terms", "metrics", "tools")],
        F.coalesce("combine_strategy", empty).alias("combine_strategy"),
    )


@query("keyword_hits", f"""
WITH {B.ASKED}, signals AS (SELECT qid, lower(query) AS q FROM asked)
SELECT qid, {s_hits(fv.SYSTEM_WORDS)}::INTEGER AS n_system, {s_hits(fv.FILE_WORDS)}::INTEGER AS n_file,
  {s_hits(fv.WEB_WORDS)}::INTEGER AS n_web FROM signals""")
def keyword_hits(t):
    q = F.lower("query")
    return B.asked(t).select(
        "qid", R.substring_hits(q, fv.SYSTEM_WORDS).alias("n_system"), R.substring_hits(q, fv.FILE_WORDS).alias("n_file"),
        R.substring_hits(q, fv.WEB_WORDS).alias("n_web"),
    )


def s_re(pattern, q="q"):
    return f"regexp_matches({q}, {sql_text(pattern)})"


@query("route_fallback", f"""
WITH {B.ASKED}, s AS (SELECT qid, lower(query) AS q FROM asked) SELECT qid, CASE
  WHEN {s_re(fv.FALLBACK_LOCAL)} OR {s_re(fv.FALLBACK_SYSTEM)} OR {s_re(fv.FALLBACK_MEMORY)} THEN 'local_query'
  WHEN {s_re(fv.FALLBACK_WEB)} AND NOT {s_re(fv.FALLBACK_NOT_WEB)} THEN 'web_query'
  WHEN {s_re(fv.FALLBACK_CHAT)} THEN 'conversation' ELSE 'local_query' END AS tool FROM s""")
def route_fallback(t):
    return B.asked(t).select("qid", R.route_fallback(F.col("query")).alias("tool"))


_NAMES = [*fv.TOOL_ALIASES, " Search_Files ", "whatever"]


@query("normalize_tool", f"""
WITH n AS (SELECT event_id, {sql_list(_NAMES)}[(event_id % {len(_NAMES)} + 1)::BIGINT] AS name FROM events)
SELECT event_id, coalesce(MAP {{{', '.join(f'{sql_text(k)}: {sql_text(v)}' for k, v in fv.TOOL_ALIASES.items())}}}[
  trim(lower(name))], 'no_tool') AS tool FROM n""")
def normalize_tool(t):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.pmod("event_id", F.lit(len(_NAMES))).cast("int"))
    return t.events.select("event_id", R.normalize_tool(name).alias("tool"))


_TOOLS3 = ["search_files", "open_file", "web_search"]


def _s_defaults():
    types = ", ".join(f"CASE WHEN {s_any(words)} THEN {sql_list(names)} ELSE [] END" for names, words in fv.FILE_TYPE_HINTS)
    place = " ".join(
        f"WHEN {s_any(words)}{' AND len(file_types) = 0' if name == 'documents' else ''} THEN {sql_text(name)}"
        for name, words in fv.LOCATION_HINTS
    )
    dates = " ".join(f"WHEN {s_any(words)} THEN {sql_text(name)}" for name, words in fv.DATE_RANGE_HINTS)
    return f"""d AS (SELECT qid, lower(query) AS q, {sql_list(_TOOLS3)}[(length(query) % 3 + 1)::BIGINT] AS tool,
    CASE WHEN length(query) % 5 = 0 THEN 'home' END AS location FROM asked),
  e AS (SELECT *, CASE WHEN tool = 'web_search' THEN [] ELSE flatten([{types}]) END AS file_types FROM d)
SELECT qid, array_to_string(list_sort(list_distinct(file_types)), '|') AS file_types,
  coalesce(location, CASE WHEN tool <> 'web_search' THEN CASE {place} END END, '') AS location,
  coalesce(CASE WHEN tool <> 'web_search' THEN CASE {dates} END END, '') AS date_range FROM e"""


@query("smart_defaults", f"WITH {B.ASKED}, {_s_defaults()}")
def smart_defaults(t):
    rows = B.asked(t)
    tool = F.get(F.array(*[F.lit(x) for x in _TOOLS3]), F.pmod(F.length("query"), F.lit(3)))
    given = F.when(F.length("query") % 5 == 0, "home")
    none = F.lit(None).cast("array<string>")
    d = R.smart_defaults(F.col("query"), tool, none, given, F.lit(None).cast("string"))
    return rows.select("qid", d.alias("d")).select(
        "qid", joined(F.array_sort("d.file_types")).alias("file_types"),
        F.coalesce("d.location", F.lit("")).alias("location"), F.coalesce("d.date_range", F.lit("")).alias("date_range"),
    )


_SECTIONS = ", ".join(f"CASE WHEN {s_any(words)} THEN {sql_text(name)} END" for name, words in fv.SECTION_WORDS)


@query("system_sections", f"""
WITH {B.ASKED}, s AS (SELECT qid, lower(query) AS q FROM asked),
f AS (SELECT qid, list_filter([{_SECTIONS}], lambda x: x IS NOT NULL) AS x FROM s)
SELECT qid, CASE WHEN len(x) = 0 THEN 'all' ELSE array_to_string(x, '|') END AS sections FROM f""")
def system_sections(t):
    return B.asked(t).select("qid", joined(R.system_sections(F.col("query"))).alias("sections"))


def s_photo_words(q, stop):
    return (
        f"list_filter(string_split_regex(lower({q}), '[\\s\\x0b]+'), lambda w: length(w) > 2 AND NOT list_contains("
        f"{sql_list(stop)}, w))"
    )


@query("photo_keywords", f"""
WITH {B.ASKED} SELECT qid, array_to_string({s_photo_words('query', fv.PHOTO_STOPWORDS_CLIENT)}, '|') AS client,
  array_to_string({s_photo_words('query', fv.PHOTO_STOPWORDS_SERVER)}, '|') AS server FROM asked""")
def photo_keywords(t):
    return B.asked(t).select(
        "qid", joined(R.photo_keywords(F.col("query"))).alias("client"),
        joined(R.photo_keywords(F.col("query"), "server")).alias("server"),
    )


@query("embedding_query", f"""
WITH {B.ASKED}, x AS (SELECT qid, query, {s_terms()} AS terms FROM asked)
SELECT qid, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE query END AS embedding_query FROM x""")
def embedding_query(t):
    terms = R.search_terms(F.col("query"), F.col("username"))
    return B.asked(t).select("qid", R.embedding_query(F.col("query"), terms).alias("embedding_query"))


@query("answer_prompt", f"""
WITH {B.PAIRS}, p AS (SELECT conv_id, turn, question, CASE WHEN turn % 4 = 0 THEN ' ' ELSE answer END AS context FROM pairs)
SELECT conv_id, turn, CASE WHEN {B.s_strip('context')} <> '' THEN 'Context: ' || context || chr(10) || chr(10) ||
  'Question: ' || question ELSE question END AS prompt FROM p""")
def answer_prompt(t):
    context = F.when(F.col("turn") % 4 == 0, " ").otherwise(F.col("answer"))
    return B.pairs(t).select("conv_id", "turn", T.answer_prompt(context, F.col("question")).alias("prompt"))


# ----------------------------------------------------------------------- vectors


@query("l2_normalize", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE abs(x / n) END)), 5) AS l1,
  round(CASE WHEN n = 0 THEN 0 ELSE v[1] / n END, 6) AS first FROM n""")
def l2_normalize(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.pmod("vec_id", F.lit(5)))
    unit = t.embeddings.select("vec_id", V.l2_normalize(scaled).alias("u"))
    return unit.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"),
        F.round(F.get("u", F.lit(0)), 6).alias("first"),
    )


@query("quantize_int8", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM v)
SELECT vec_id, array_to_string(list_transform(v, lambda x: trunc(x * 127.0 / m)::INTEGER), ',') AS codes,
  round(127.0 / m, 6) AS scale FROM n""")
def quantize_int8(t):
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.array_join(F.transform(V.quantize_int8(v), lambda x: x.cast("string")), ",").alias("codes"),
        F.round(V.quantize_scale(v), 6).alias("scale"),
    )


@query("embed_texts", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""")
def embed_texts(t):
    """Model-free embedder on whole documents: every vector has unit length."""
    out = hashing_embedding(DIMS)(t.documents, "text")
    return out.select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("embed_with_model", """
SELECT doc_id, length(text)::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words FROM documents""")
def embed_with_model(t):
    """Embedder plug-in: a model is loaded once per worker and called in batches."""

    def load():
        return lambda texts: np.array([[len(x), len(x.split(" "))] for x in texts], dtype=np.float32)

    out = model_embedding(load)(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("n_chars", "n_words"))])


def index(t):
    """embeddings as rows of the vector index: every third a chunk, label as source, folder by id."""
    i = F.col("vec_id")
    kind = F.when(F.pmod(i, F.lit(3)) == 0, "chunk").otherwise("file")
    source = F.when(F.pmod(i, F.lit(5)) == 0, "photos").when(F.pmod(i, F.lit(5)) == 1, "memory").otherwise("desktop")
    return t.embeddings.select(
        i.alias("row_id"), kind.alias("type"), source.alias("source"),
        F.concat(F.lit("/home/u/f"), F.pmod(i, F.lit(40)).cast("string"), F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("f"), F.pmod(i, F.lit(40)).cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("Desktop/g"), F.pmod(i, F.lit(7)).cast("string")).alias("folder"),
        F.when(F.pmod(i, F.lit(3)) == 0, i.cast("int")).alias("chunk_index"),
        F.concat(F.lit(" text of "), i.cast("string"), F.lit("\n")).alias("text"), "embedding",
    )


_INDEX = """idx AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 3 = 0 THEN 'chunk' ELSE 'file' END AS type,
  CASE vec_id % 5 WHEN 0 THEN 'photos' WHEN 1 THEN 'memory' ELSE 'desktop' END AS source,
  '/home/u/f' || (vec_id % 40) || '.txt' AS file_path, 'f' || (vec_id % 40) || '.txt' AS file_name,
  'Desktop/g' || (vec_id % 7) AS folder, ' text of ' || vec_id || chr(10) AS text,
  list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


def label_queries(t):
    """Query vectors: the mean vector of every label."""
    return t.embeddings.groupBy(F.col("label").alias("qid")).agg(V.mean_vector(F.col("embedding"), DIMS).alias("vector"))


_LABELS = """parts AS (SELECT label AS qid, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT qid, i, avg(x) AS x FROM parts GROUP BY 1, 2),
queries AS (SELECT qid, list(x ORDER BY i) AS qv FROM means GROUP BY 1)"""


def _s_knn(k, where="true", name="hits"):
    return f"""scored AS (SELECT qid, row_id, round(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])), 9)
    AS score FROM queries, idx WHERE {where}),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM scored)
    WHERE rank <= {k})"""


@query("knn_join", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(10)} SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM hits""")
def knn_join(t):
    hits = SE.knn(label_queries(t), index(t), 10)
    return hits.select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("knn_filtered", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(5, "type = CASE WHEN qid % 2 = 0 THEN 'chunk' ELSE 'file' END AND "
"(qid % 3 > 0 OR source = 'desktop') AND (qid % 5 > 1 OR starts_with(folder, 'Desktop/g1'))")}
SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM hits""")
def knn_filtered(t):
    q = F.col("qid")
    asked = label_queries(t).withColumns(
        {"type": F.when(q % 2 == 0, "chunk").otherwise("file"), "source": F.when(q % 3 == 0, "desktop"),
         "folder": F.when(q % 5 <= 1, "Desktop/g1")}
    )
    hits = SE.knn(asked, index(t), 5)
    return hits.select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("metadata_filter", f"""
WITH {_INDEX} SELECT row_id, type, source, folder FROM idx
WHERE type = 'file' AND source = 'desktop' AND starts_with(folder, 'Desktop/g1')""")
def metadata_filter(t):
    return index(t).filter(SE.metadata_filter("find", "desktop", "Desktop/g1")).select("row_id", "type", "source", "folder")


_PRESET_WHERE = {
    "files": "type = 'file'", "content": "type = 'chunk'", "memory": "type = 'chunk' AND source = 'memory'",
    "photos": "type = 'file' AND source = 'photos'", "in_folder": "type = 'file' AND starts_with(folder, 'Desktop/g2')",
}


@query("search_presets", f"WITH {_INDEX}, {_LABELS} " + " UNION ALL ".join(
    f"""SELECT * FROM (WITH {_s_knn(3, where)} SELECT '{name}' AS preset, qid, row_id, rank::INTEGER AS rank FROM hits)"""
    for name, where in _PRESET_WHERE.items()))
def search_presets(t):
    asked, out = label_queries(t), None
    for name in _PRESET_WHERE:
        folder = "Desktop/g2" if name == "in_folder" else None
        one = SE.with_preset(asked, name, folder).withColumn("qid", F.concat(F.lit(name + "#"), F.col("qid").cast("string")))
        out = one if out is None else out.unionByName(one)
    hits = SE.knn(out, index(t), 3)
    return hits.select(
        F.substring_index("qid", "#", 1).alias("preset"), F.substring_index("qid", "#", -1).cast("int").alias("qid"),
        "row_id", "rank",
    )


@query("hit_projection", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(10)} SELECT qid, rank::INTEGER AS rank, text, source, type, file_path, file_name, folder,
  CASE WHEN type = 'chunk' THEN row_id ELSE -1 END::INTEGER AS chunk_index, round(score, 4) AS score
FROM hits JOIN idx USING (row_id)""")
def hit_projection(t):
    out = RP.search(label_queries(t), index(t), 10)
    return out.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)))


_DOT = "round(list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2])), 9)"


@query("knn_in_cells", f"""
WITH {_INDEX}, {_LABELS}, sc AS (SELECT row_id, qid AS cell, {_DOT.format('qv', 'v')} AS s FROM idx, queries),
nearest AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, cell) AS r FROM sc),
pairs AS (SELECT p.row_id AS qid, c.row_id, {_DOT.format('a.v', 'b.v')} AS score FROM nearest p JOIN idx a ON a.row_id = p.row_id
  JOIN nearest c ON c.cell = p.cell AND c.r = 1 JOIN idx b ON b.row_id = c.row_id WHERE p.r <= 2)
SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY score DESC, row_id) AS rank FROM pairs) WHERE rank <= 5""")
def knn_in_cells(t):
    """Every entry asks in its two best cells; the label means are the centroids."""
    rows = index(t)
    centroids = label_queries(t).select(F.col("qid").alias("cell"), "vector")
    celled = SE.assign_cells(rows.select("row_id", "embedding"), centroids)
    every = rows.select(F.col("row_id").alias("qid"), F.col("embedding").alias("vector"))
    return SE.knn_in_cells(every, celled, centroids, 5, 2).select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("knn_every_cell", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(5)} SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM hits""")
def knn_every_cell(t):
    """Cell search that probes every cell is exact."""
    rows = index(t)
    centroids = SE.train_cells(rows, 8, seed=7, iterations=3)
    celled = SE.assign_cells(rows.select("row_id", "embedding"), centroids)
    hits = SE.knn_in_cells(label_queries(t), celled, centroids, 5, 8)
    return hits.select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("knn_stored_cells", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(10)} SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM hits""")
def knn_stored_cells(t):
    """Exact search over an index stored by cells, in the cells that can hold a hit."""
    rows = index(t).select("row_id", "embedding")
    stored = CellIndex.write(rows, SE.train_cells(rows, 16, seed=7, iterations=3), new_folder(t.spark, "cells"))
    hits, _ = stored.top_k(label_queries(t), 10)
    return hits.select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("cluster_tree")
def cluster_tree(t):
    items = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("content")
    )
    nodes, _ = CL.cluster_tree(items, DIMS)
    return nodes.select("node", "parent", "depth", "n_items", "item_hash")


_PAGES = """paged AS (SELECT rtrim(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', ''), '/') AS path,
  page_id % (SELECT count(*) FROM embeddings) AS vec_id FROM pages)"""


def pages_with_vectors(t):
    n = t.embeddings.count()
    path = F.regexp_replace(F.regexp_replace("url", "/?([?#].*)?$", ""), "^https?://", "")
    paged = t.pages.select(path.alias("path"), F.pmod("page_id", F.lit(n)).alias("vec_id"), "page_id")
    return paged.join(t.embeddings, "vec_id").select("path", F.col("embedding").alias("vector"), "page_id")


@query("folder_tree", f"""
WITH {_PAGES}, x AS (SELECT {B.s_parent('path')} AS folder, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS i FROM paged JOIN embeddings USING (vec_id)),
l2 AS (SELECT folder, i, avg(x) AS x, count(*) AS n FROM x WHERE contains(folder, '/') GROUP BY 1, 2),
c1 AS (SELECT {B.s_parent('folder')} AS folder, i, x, n FROM l2
  UNION ALL SELECT folder, i, x, 1 FROM x WHERE NOT contains(folder, '/')),
l1 AS (SELECT folder, i, avg(x) AS x, sum(n)::BIGINT AS n FROM c1 GROUP BY 1, 2),
a AS (SELECT *, 2 AS depth FROM l2 UNION ALL SELECT *, 1 FROM l1)
SELECT folder, depth::INTEGER AS depth, max(n) AS n_files, round(sum(abs(x)), 5) AS l1,
  round(sum(x) FILTER (i = 1), 5) AS first FROM a GROUP BY 1, 2""")
def folder_tree(t):
    tree = FO.folder_tree(pages_with_vectors(t), DIMS)
    return tree.select(
        "folder", "depth", "n_files", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"),
        F.round(F.get("vector", F.lit(0)), 5).alias("first"),
    )


@query("tree_search", f"""
WITH {_PAGES.replace('AS vec_id FROM', 'AS vec_id, page_id AS row_id FROM')}, {_LABELS},
x AS (SELECT {B.s_parent('path')} AS folder, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM paged JOIN embeddings USING (vec_id)),
l2 AS (SELECT folder, i, avg(x) AS x FROM x WHERE contains(folder, '/') GROUP BY 1, 2),
c1 AS (SELECT {B.s_parent('folder')} AS folder, i, x FROM l2 UNION ALL SELECT folder, i, x FROM x WHERE NOT contains(folder, '/')),
l1 AS (SELECT folder, i, avg(x) AS x FROM c1 GROUP BY 1, 2),
v1 AS (SELECT folder, list(x ORDER BY i) AS nv FROM l1 GROUP BY 1), v2 AS (SELECT folder, list(x ORDER BY i) AS nv FROM l2 GROUP BY 1),
s1 AS (SELECT qid, folder, {_DOT.format('qv', 'nv')} AS s FROM queries, v1),
k1 AS (SELECT qid, folder FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, folder) AS r FROM s1) WHERE r <= 6),
s2 AS (SELECT q.qid, v2.folder, {_DOT.format('qv', 'nv')} AS s FROM k1 JOIN queries q USING (qid) JOIN v2 ON {B.s_parent('v2.folder')} = k1.folder),
k2 AS (SELECT qid, folder FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, folder) AS r FROM s2) WHERE r <= 6),
k AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2),
c AS (SELECT qid, row_id, {_DOT.format('qv', 'list_transform(embedding, lambda x: x::DOUBLE)')} AS score
  FROM k JOIN queries USING (qid) JOIN paged ON {B.s_parent('path')} = k.folder JOIN embeddings USING (vec_id))
SELECT qid, row_id, rank::INTEGER AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY score DESC, row_id) AS rank FROM c) WHERE rank <= 10""")
def tree_search(t):
    """Descent through the folder tree of the pages, six folders a level, then the pages of the folders that were kept."""
    pages = pages_with_vectors(t)
    nodes = FO.folder_tree(pages, DIMS).select(F.col("folder").alias("node"), F.nullif(P.parent(F.col("folder")), F.lit("")).alias("parent"), "vector")
    entries = pages.select(F.col("page_id").alias("row_id"), F.col("vector").alias("embedding"), P.parent(F.col("path")).alias("node"))
    hits = SE.beam_search(label_queries(t), nodes, entries, 10, 6)
    return hits.select("qid", "row_id", "rank", F.round("score", 4).alias("score"))


@query("hybrid_score", f"""
WITH {_INDEX}, {_LABELS}, unit AS (SELECT qid, list_transform(qv, lambda x: x / sqrt(list_sum(list_transform(qv, lambda y: y * y)))) AS qv FROM queries),
s AS (SELECT qid, row_id, {_DOT.format('qv', 'v')} AS content_score,
  len(list_intersect(['f' || qid, 'text'], string_split_regex(file_name, '[^a-z0-9]+'))) / 2.0::DOUBLE AS filename_score,
  len(list_intersect(['f' || qid, 'text'], string_split_regex(text, '[^a-z0-9]+'))) / 2.0::DOUBLE AS keyword_score FROM unit, idx),
h AS (SELECT *, round(0.35::DOUBLE * filename_score + 0.40::DOUBLE * content_score + 0.25::DOUBLE * keyword_score, 6) AS score FROM s)
SELECT qid, row_id, round(score, 4) AS score FROM h WHERE score >= 0.35""")
def hybrid_score(t):
    """All entries are candidates: by name, by keyword, or by a near vector from the stored cells; "text" is in every entry."""
    rows = index(t)
    asked = label_queries(t).select(
        "qid", V.l2_normalize(F.col("vector")).alias("vector"), F.array(F.concat(F.lit("f"), F.col("qid").cast("string")), F.lit("Text")).alias("terms"))
    stored = CellIndex.write(rows.select("row_id", "embedding"), SE.train_cells(rows, 16, seed=7, iterations=3), new_folder(t.spark, "cells"))
    out = SE.hybrid_search(asked, rows, stored.within, fv.HYBRID_WEIGHTS, fv.HYBRID_MIN_SCORE, hot_rows=100)
    return out.select("qid", "row_id", F.round("score", 4).alias("score"))


_TYPE_GROUPS = {
    "pdf": [".pdf"], "image": fv.IMAGE_EXTENSIONS, "document": [".txt", ".md", ".doc", ".docx", ".rtf"],
    "code": [".py", ".js", ".ts", ".json", ".html", ".css"],
}


@query("file_filters", f"""
WITH {B.FILES}, d AS (SELECT path, {B.s_ext(B.s_name('path'))} AS ext, {B.s_folder('path')} AS folder, mtime_s FROM files),
m AS (SELECT max(mtime_s) AS now FROM d)
SELECT path FROM d, m WHERE list_contains({sql_list(_TYPE_GROUPS['code'])}, ext) AND starts_with(folder, 'Documents')
  AND mtime_s >= now - 600""")
def file_filters(t):
    from quarry.operators.entries import describe_files

    rows = describe_files(B.files(t), B.HOME)
    now = rows.agg(F.max("mtime")).first()[0]
    test = FI.file_filter(["code"], "documents", F.lit(now) - F.expr("interval 600 seconds"))
    return rows.filter(test).select("path")


@query("named_date_ranges", """
WITH p AS (SELECT 'Documents/f' || user_id || '.txt' AS path, max(ts) AS mtime FROM events WHERE event_type <> 'error' GROUP BY 1),
n AS (SELECT max(ts) AS now FROM events), r(date_range, days) AS (VALUES ('today', 1), ('week', 7), ('month', 30), ('year', 365), ('any', 100000))
SELECT date_range, path FROM p, n, r WHERE mtime >= now - to_days(days)""")
def named_date_ranges(t):
    """Files by the ranges that queries name; a file's last event that is no error stands for its modification."""
    files = t.events.where("event_type <> 'error'").groupBy(F.concat(F.lit("Documents/f"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path")).agg(
        F.max("ts").cast("timestamp").alias("mtime"))
    rows = files.withColumns({"extension": F.lit(".txt"), "folder": F.lit("Documents")})
    now = F.lit(t.events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    named = [rows.filter(FI.file_filter(["document"], "documents", FI.since(name, now))).select(F.lit(name).alias("date_range"), "path")
             for name in [*FI.RANGE_DAYS, "any"]]
    return reduce(DataFrame.unionByName, named)


# ------------------------------------------------------------------------ photos


@query("photo_source", f"""
WITH {B.PHOTOS}, raw AS (SELECT *, CASE WHEN date_s % 2 = 0 THEN file_name ELSE '' END AS fn,
  CASE WHEN length(file_path) % 9 = 0 THEN '' ELSE file_path END AS fp FROM photos)
SELECT fp AS file_path, CASE WHEN fn <> '' THEN fn WHEN length(uuid) % 2 = 0 THEN uuid ELSE 'Unknown' END AS file_name,
  array_to_string(persons, '|') AS persons FROM raw WHERE fp <> ''""")
def photo_source(t):
    raw = B.photos(t).withColumns(
        {
            "file_name": F.when(F.pmod(F.unix_seconds("date"), F.lit(2)) == 0, F.col("file_name")).otherwise(""),
            "file_path": F.when(F.length("file_path") % 9 != 0, F.col("file_path")),
            "original_name": F.when(F.length("uuid") % 2 == 0, F.col("uuid")),
            "persons": F.concat("persons", F.array(F.lit(""))),
        }
    )
    return PH.photo_rows(raw).select("file_path", "file_name", joined("persons").alias("persons"))


@query("photo_text", f"""
WITH {B.PHOTOS} SELECT uuid, 'Photo' || CASE WHEN length(uuid) % 2 = 0 THEN ' of ' || array_to_string(persons, ' and ')
  ELSE '' END || ' ' || array_to_string(keywords, ' ') || ' at ' || location || ' on ' ||
  strftime(make_timestamp(date_s * 1000000), '%B %Y') AS text FROM photos""")
def photo_text(t):
    rows = B.photos(t).withColumn(
        "persons", F.when(F.length("uuid") % 2 == 0, F.col("persons")).otherwise(F.array().cast("array<string>"))
    )
    return rows.select("uuid", PH.photo_text().alias("text"))


@query("photo_location", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN printf('%.2f, %.2f', p_retailprice / 100, -p_retailprice / 7)
  WHEN p_partkey % 4 = 1 THEN p_type || ', ' || p_brand WHEN p_partkey % 4 = 2 THEN p_name ELSE '' END AS location
FROM part""")
def photo_location(t):
    k, n = F.pmod("p_partkey", F.lit(4)), F.lit(None).cast("string")
    return t.part.select(
        "p_partkey",
        PH.photo_location(
            F.when(k == 1, F.col("p_type")), F.when(k == 2, F.col("p_name")).otherwise(n), F.when(k == 1, F.col("p_brand")),
            F.when(k == 0, F.col("p_retailprice") / 100), F.when(k == 0, -F.col("p_retailprice") / 7),
        ).alias("location"),
    )


_PHOTO_SCORED = f"""terms AS (SELECT qid, {s_photo_words('query', fv.PHOTO_STOPWORDS_CLIENT)} AS ks FROM photo_queries),
graded AS (SELECT qid, file_path, date_s,
  list_sum(list_transform(keywords, lambda w: CASE WHEN list_contains(ks, lower(w)) THEN 2
    WHEN len(list_filter(ks, lambda k: contains(lower(w), k))) > 0 THEN 1 ELSE 0 END))
  + list_sum(list_transform(persons, lambda w: CASE WHEN list_contains(ks, lower(w)) THEN 3
    WHEN len(list_filter(ks, lambda k: contains(lower(w), k))) > 0 THEN 2 ELSE 0 END))
  + len(list_filter(ks, lambda k: contains(lower(location), k)))
  + len(list_filter(album_names, lambda a: list_contains(ks, lower(a)))) AS score FROM photos, terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, date_s DESC, file_path) AS rank FROM graded
  WHERE score > 0)"""


@query("photo_search", f"""
WITH {B.PHOTOS}, {B.PHOTO_QUERIES}, {_PHOTO_SCORED}
SELECT qid, file_path, score::BIGINT AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 20""")
def photo_search(t):
    terms = B.photo_queries(t).select("qid", F.explode(R.photo_keywords(F.col("query"))).alias("term"))
    return PH.search_photos(B.photos(t), terms, 20).select("qid", "file_path", "score", "rank")


def _photo_vector_hits(t, queries=None):
    """Vector hits of every photo query from the index, by the label the query name hashes to."""
    labels = t.embeddings.agg(F.max("label") + 1).first()[0]
    queries = B.photo_queries(t) if queries is None else queries
    asked = queries.withColumn("label", F.pmod(F.length("query"), F.lit(labels)))
    return SE.with_preset(label_queries(t).withColumnRenamed("qid", "label").join(asked, "label"), "photos")


_MORE_QUERIES = """asked AS (SELECT * FROM photo_queries UNION ALL SELECT 'nation-' || n_name, 'Show me photos of ' || n_name FROM nation)"""


@query("hybrid_merge", f"""
WITH {B.PHOTOS}, {B.PHOTO_QUERIES}, {_MORE_QUERIES}, {_PHOTO_SCORED.replace('FROM photo_queries', 'FROM asked')}, {_INDEX},
{_LABELS.replace('queries AS', 'lq AS')},
queries AS (SELECT p.qid, qv FROM asked p JOIN lq ON lq.qid = length(p.query) % (SELECT max(label) + 1 FROM embeddings)),
{_s_knn(10, "type = 'file' AND source = 'photos'")},
kw AS (SELECT qid, file_path AS path, rank FROM ranked WHERE rank <= 10),
few AS (SELECT p.qid FROM asked p LEFT JOIN kw USING (qid) GROUP BY 1 HAVING count(kw.path) < 3),
vec AS (SELECT h.qid, i.file_path AS path, min(h.rank) AS rank FROM hits h JOIN idx i USING (row_id) GROUP BY 1, 2),
allh AS (SELECT qid, path, rank, 0 AS part FROM kw UNION ALL SELECT qid, path, rank, 1 FROM vec
  WHERE qid IN (SELECT qid FROM few) AND (qid, path) NOT IN (SELECT (qid, path) FROM kw))
SELECT * FROM (SELECT qid, path, CASE part WHEN 0 THEN 'keyword' ELSE 'vector' END AS method,
  row_number() OVER (PARTITION BY qid ORDER BY part, rank, path)::INTEGER AS rank FROM allh) WHERE rank <= 10""")
def hybrid_merge(t):
    """All keyword hits; also asked for the nations' names, of which photos know few, so that vectors have to help."""
    more = t.nation.select(F.concat(F.lit("nation-"), "n_name").alias("qid"), F.concat(F.lit("Show me photos of "), "n_name").alias("query"))
    asked = B.photo_queries(t).unionByName(more)
    terms = asked.select("qid", F.explode(R.photo_keywords(F.col("query"))).alias("term"))
    kw = PH.search_photos(B.photos(t), terms, 10).select("qid", F.col("file_path").alias("path"), "rank")
    vectors = _photo_vector_hits(t, asked).select("qid", "vector", "type", "source", "folder")
    hits = SE.knn(vectors, index(t), 10).join(index(t).select("row_id", "file_path"), "row_id")
    vec = hits.groupBy("qid", F.col("file_path").alias("path")).agg(F.min("rank").alias("rank"))
    return SE.hybrid_merge(kw, vec, 10, fv.HYBRID_MIN_KEYWORD_HITS)


# ----------------------------------------------------------------------- context


def _hits(t, k=10):
    return RP.search(label_queries(t), index(t), k)


_HITS = f"{_INDEX}, {_LABELS}, {_s_knn(10)}, h AS (SELECT * FROM hits JOIN idx USING (row_id))"


@query("render_file_list", f"""
WITH {_HITS} SELECT qid, chr(10) || chr(10) || '## File Search Results' || chr(10) ||
  string_agg(rank || '. **' || file_name || '** - ' || file_path, chr(10) ORDER BY rank) AS context
FROM h WHERE rank <= 5 GROUP BY 1""")
def render_file_list(t):
    return C.file_list(_hits(t))


@query("chunks_per_file", f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY rank) AS n FROM h)
SELECT qid, file_path, min(rank)::INTEGER AS first_rank,
  string_agg('> ' || {B.s_strip('text')}, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY rank) AS content
FROM r WHERE n <= 2 GROUP BY 1, 2""")
def chunks_per_file(t):
    return C.best_chunks(_hits(t)).select("qid", "file_path", "first_rank", "content")


@query("render_content_groups", f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY rank) AS n FROM h),
g AS (SELECT qid, file_path, max(file_name) AS file_name, min(rank) AS fr,
  string_agg('> ' || {B.s_strip('text')}, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY rank) AS c
  FROM r WHERE n <= 2 GROUP BY 1, 2)
SELECT qid, chr(10) || chr(10) || '## File Content Results' || chr(10) || string_agg('### ' || file_name || chr(10) || '*Path: ' ||
  file_path || '*' || chr(10) || chr(10) || '**Relevant content:**' || chr(10) || c || chr(10) || chr(10), '' ORDER BY fr)
  AS context FROM g GROUP BY 1""")
def render_content_groups(t):
    return C.content_groups(_hits(t))


@query("render_memory", f"""
WITH {_HITS} SELECT qid, chr(10) || chr(10) || '## What I Know About You' || chr(10) ||
  string_agg('- ' || text, chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 5 GROUP BY 1""")
def render_memory(t):
    return C.memory_list(_hits(t))


@query("render_web", """
WITH r AS (SELECT page_id, split_part(url, '/', 3) AS qid, url,
  row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS rank FROM pages)
SELECT qid, chr(10) || chr(10) || '## Web Search' || chr(10) || string_agg(rank || '. **Page ' || page_id || '**' || chr(10) ||
  '   ' || length(url) || ' chars' || chr(10) || '   Source: ' || url, chr(10) || chr(10) ORDER BY rank) AS context
FROM r WHERE rank <= 5 GROUP BY 1""")
def render_web(t):
    host = F.element_at(F.split("url", "/"), 3)
    ranked = top_k(t.pages.withColumn("qid", host), ["qid"], [F.asc("page_id")], 5)
    return C.web_list(ranked.select(
        "qid", "rank", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.concat(F.length("url").cast("string"), F.lit(" chars")).alias("snippet"), F.col("url").alias("link"),
    ))


@query("render_photos", f"""
WITH {B.PHOTOS}, {B.PHOTO_QUERIES}, {_PHOTO_SCORED}
SELECT qid, chr(10) || chr(10) || '## Photo Search Results (keyword search)' || chr(10) || string_agg(rank || '. **' ||
  file_name || '** (' || array_to_string(persons, ', ') || ') - ' || array_to_string(keywords[1:3], ', ') || chr(10) ||
  '   Path: ' || file_path, chr(10) ORDER BY rank) AS context
FROM ranked JOIN photos USING (file_path) WHERE rank <= 5 GROUP BY 1""")
def render_photos(t):
    terms = B.photo_queries(t).select("qid", F.explode(R.photo_keywords(F.col("query"))).alias("term"))
    found = PH.search_photos(B.photos(t), terms, 10).select("qid", "file_path", "rank").withColumn("method", F.lit("keyword"))
    return C.photo_list(found.join(B.photos(t), "file_path"))


@query("fallback_source", f"""
WITH {_INDEX}, {_LABELS}, {_s_knn(3, "type = 'file' AND starts_with(folder, 'Desktop/g' || qid)", 'a')},
b AS (SELECT * FROM (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM (
  SELECT qid, row_id, round(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])), 9) AS score
  FROM queries, idx WHERE type = 'chunk' AND source = 'memory')) WHERE rank <= 3)
SELECT qid, row_id, rank::INTEGER AS rank, 'primary' AS origin FROM a
UNION ALL SELECT qid, row_id, rank::INTEGER, 'fallback' FROM b WHERE qid NOT IN (SELECT qid FROM a)""")
def fallback_source(t):
    """Every label asks both sources; the primary one in the folder of the label's name, which not every label has."""
    rows, asked = index(t), label_queries(t)
    mine = SE.with_preset(asked, "files").withColumn("folder", F.concat(F.lit("Desktop/g"), F.col("qid").cast("string")))
    primary = SE.knn(mine, rows, 3)
    fallback = SE.knn(SE.with_preset(asked, "memory"), rows, 3)
    return C.first_with_hits(primary, fallback).select("qid", "row_id", "rank", "origin")


_SECTIONS = ["click", "error", "purchase", "signup", "view"]


@query("combine_sections", f"""
WITH p AS (SELECT user_id AS qid, event_type AS section, coalesce(list_position({sql_list(_SECTIONS)}, event_type), 99) AS position,
  max(event_type || ' ' || event_id) AS context, count(*) % 2 = 0 AS success FROM events GROUP BY 1, 2, 3)
SELECT qid, coalesce(string_agg(context, chr(10) ORDER BY position, section) FILTER (success),
  chr(10) || chr(10) || '## Context' || chr(10) || 'No additional context available.') AS context FROM p GROUP BY 1""")
def combine_sections(t):
    """The event types of a user as sections, of which those with an even number of events succeed."""
    parts = t.events.groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("section")).agg(
        F.max(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("context"),
        (F.count("*") % 2 == 0).alias("success"))
    place = F.array_position(F.array(*[F.lit(x) for x in _SECTIONS]), F.col("section"))
    return C.combine_sections(parts.withColumn("position", F.when(place == 0, 99).otherwise(place).cast("int")))


_BRANCH = """planned AS (SELECT qid, rule, length(query) AS n, CASE rule WHEN 'web' THEN 'web' WHEN 'multi' THEN 'multi'
  WHEN 'see' THEN 'see' WHEN 'casual' THEN 'none' WHEN 'read' THEN 'content' WHEN 'memory' THEN 'memory'
  WHEN 'system' THEN 'system' WHEN 'disk' THEN 'disk' ELSE 'files' END AS branch FROM ruled)"""


@query("dispatch", f"""
WITH {B.ASKED}, {_SIGNALS}, {_BRANCH}, {_INDEX}, {_LABELS.replace('queries AS', 'lq AS')},
q AS (SELECT p.qid, branch, qv FROM planned p JOIN lq ON lq.qid = p.n % (SELECT max(label) + 1 FROM embeddings)),
scored AS (SELECT q.qid, branch, row_id, {_DOT.format('qv', 'v')} AS score FROM q JOIN idx ON CASE branch
  WHEN 'files' THEN type = 'file' WHEN 'content' THEN type = 'chunk' WHEN 'memory' THEN type = 'chunk' AND source = 'memory' ELSE false END),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM scored) JOIN idx USING (row_id) WHERE rank <= 10),
g AS (SELECT qid, file_path, max(file_name) AS file_name, min(rank) AS fr,
  string_agg('> ' || {B.s_strip('text')}, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY rank) AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY rank) AS n FROM h WHERE branch = 'content') WHERE n <= 2 GROUP BY 1, 2),
sites AS (SELECT page_id % 40 AS topic, page_id, url, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS rank FROM pages),
webs AS (SELECT topic, chr(10) || chr(10) || '## Web Search' || chr(10) || string_agg(rank || '. **Page ' || page_id || '**' || chr(10) ||
  '   ' || length(url) || ' chars' || chr(10) || '   Source: ' || url, chr(10) || chr(10) ORDER BY rank) AS web FROM sites WHERE rank <= 5 GROUP BY 1),
reports AS (SELECT host, 'System of host ' || host || ': ' || n || ' samples' AS report FROM (SELECT user_id AS host, count(*) AS n FROM events GROUP BY 1)),
local AS (SELECT qid, chr(10) || chr(10) || '## File Search Results' || chr(10) || string_agg(rank || '. **' || file_name || '** - ' || file_path, chr(10)
    ORDER BY rank) AS context FROM h WHERE branch = 'files' AND rank <= 5 GROUP BY 1
  UNION ALL SELECT qid, chr(10) || chr(10) || '## What I Know About You' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY rank)
    FROM h WHERE branch = 'memory' AND rank <= 5 GROUP BY 1
  UNION ALL SELECT qid, chr(10) || chr(10) || '## File Content Results' || chr(10) || string_agg('### ' || file_name || chr(10) || '*Path: ' ||
    file_path || '*' || chr(10) || chr(10) || '**Relevant content:**' || chr(10) || c || chr(10) || chr(10), '' ORDER BY fr) FROM g GROUP BY 1)
SELECT qid, branch, branch <> 'see' AS success, CASE
  WHEN branch IN ('none') THEN ''
  WHEN branch = 'disk' THEN chr(10) || chr(10) || '## Disk Analysis' || chr(10) || 'Disk analysis not yet implemented.'
  WHEN branch = 'see' THEN chr(10) || chr(10) || '## Screen Description' || chr(10) || 'Failed to capture or analyze screen.'
  WHEN branch = 'multi' AND coalesce(report, web) IS NOT NULL THEN concat_ws(chr(10), report, web)
  WHEN branch = 'multi' THEN chr(10) || chr(10) || '## Context' || chr(10) || 'No additional context available.'
  WHEN branch = 'web' THEN coalesce(web, chr(10) || chr(10) || '## Web Search' || chr(10) || 'No web search results found.')
  WHEN branch = 'system' THEN coalesce(report, chr(10) || chr(10) || '## System Info' || chr(10) || 'No system information available.')
  WHEN context IS NOT NULL THEN context
  WHEN branch = 'files' THEN chr(10) || chr(10) || '## File Search Results' || chr(10)
  WHEN branch = 'content' THEN chr(10) || chr(10) || '## File Content Results' || chr(10)
  ELSE chr(10) || chr(10) || '## About You' || chr(10) || 'I don''t know much about you yet. Tell me about yourself!' END AS context
FROM planned LEFT JOIN local USING (qid) LEFT JOIN reports ON host = n % 200 LEFT JOIN webs ON topic = n % 40""")
def dispatch(t):
    """All queries answered by the file, content, memory, photo, system and web operators; the index, photos, host samples
    and pages stand in for the sources."""
    n, labels = F.length("query"), t.embeddings.agg(F.max("label") + 1).first()[0]
    planned = RP.plan_queries(B.asked(t)).withColumns({"label": F.pmod(n, F.lit(labels)), "host": n % 200, "topic": n % 40})
    topic = F.pmod("page_id", F.lit(40)).alias("qid")
    sites = top_k(t.pages.select(topic, "page_id", "url"), ["qid"], [F.asc("page_id")], 5).select(
        "qid", "rank", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.concat(F.length("url").cast("string"), F.lit(" chars")).alias("snippet"), F.col("url").alias("link"))
    reports = t.events.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")).select(
        "key", F.concat(F.lit("System of host "), F.col("key").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" samples")).alias("context"))
    told = {"system": (reports, "host"), "web": (C.web_list(sites).withColumnRenamed("qid", "key"), "topic")}
    vectors = (label_queries(t).withColumnRenamed("qid", "key"), "label")
    return RP.answer(planned, index(t), B.photos(t), told, vectors).select("qid", "branch", "success", "context")
