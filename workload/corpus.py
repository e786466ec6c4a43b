"""Files, entries, content-addressed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import fixed_values as fv
from quarry.functions import paths as P
from quarry.functions import telemetry as U
from quarry.functions import text as T
from quarry.operators import entries as E
from quarry.operators import store as S
from quarry.plans import index as I
from quarry.plans.snapshot import Store
from quarry.session import new_folder
from quarry.sources import files as SF
from workload import bindings as B
from workload import trees
from workload.registry import query, sql_list, sql_text

HOME = B.HOME


@query("chunk_statistics", f"""
WITH d AS (SELECT sha256(text) AS h, min(source) AS source, any_value(text) AS text FROM documents GROUP BY 1),
c AS (SELECT source, unnest({B.s_chunks('text', 1000, 200)}) AS c FROM d)
SELECT source, count(*) AS n_chunks, sum(length(c))::BIGINT AS n_chars FROM c GROUP BY source""")
def chunk_statistics(t):
    single = t.documents.groupBy(T.fingerprint(F.col("text")).alias("h")).agg(
        F.min("source").alias("source"), F.any_value("text").alias("text")
    )
    chunks = single.select("source", F.explode(T.chunk_array(F.col("text"))).alias("c"))
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("c")).alias("n_chars"))


# ------------------------------------------------------------------------- files


_SKIP_FILE = (
    f"list_contains({sql_list(fv.SYSTEM_FILES)}, n) OR (starts_with(n, '.') AND NOT ends_with(n, '.icloud')) "
    f"OR list_contains({sql_list(fv.SKIP_EXTENSIONS)}, lower({B.s_suffix('n')}))"
)


@query("skip_filter", f"""
WITH {B.FILES}, p AS (SELECT path, {B.s_name('path')} AS n,
  string_split(substring({B.s_parent('path')}, {len(HOME) + 2}), '/') AS dirs FROM files)
SELECT path FROM p WHERE NOT ({_SKIP_FILE}) AND len(list_filter(dirs, lambda x:
  (starts_with(x, '.') AND NOT ends_with(x, '.icloud')) OR list_contains({sql_list(fv.SKIP_DIRS)}, x))) = 0""")
def skip_filter(t):
    return B.files(t).filter(P.keep(F.col("path"), "scan", HOME)).select("path")


@query("skip_filter_any_part", f"""
WITH {B.FILES}, p AS (SELECT path, {B.s_name('path')} AS n, string_split(path, '/') AS parts FROM files)
SELECT path FROM p WHERE NOT ({_SKIP_FILE}) AND NOT list_has_any(parts, {sql_list(fv.SKIP_DIRS)})""")
def skip_filter_any_part(t):
    return B.files(t).filter(P.keep(F.col("path"), "any_part")).select("path")


@query("skip_filter_legacy", f"""
WITH {B.FILES}, p AS (SELECT path, string_split(path, '/') AS parts FROM files)
SELECT path FROM p WHERE NOT list_has_any(parts, {sql_list(fv.LEGACY_SKIP_DIRS)})
  AND len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0""")
def skip_filter_legacy(t):
    return B.files(t).filter(P.keep(F.col("path"), "legacy")).select("path")


@query("placeholder_parse", f"""
WITH {B.FILES}, p AS (SELECT path, {B.s_name('path')} AS n FROM files)
SELECT path, {B.s_placeholder('n')} AS is_placeholder, {B.s_real('n')} AS real_name,
  {B.s_parent('path')} || '/' || ({B.s_real('n')}) AS real_path, {B.s_ext('n')} AS extension,
  CASE WHEN {B.s_placeholder('n')} THEN 'placeholder' ELSE 'local' END AS sync_status FROM p""")
def placeholder_parse(t):
    name = P.base_name(F.col("path"))
    return B.files(t).select(
        "path", P.is_placeholder(name).alias("is_placeholder"), P.real_name(name).alias("real_name"),
        P.real_path(F.col("path")).alias("real_path"), P.extension(name).alias("extension"),
        P.sync_status(name).alias("sync_status"),
    )


@query("fingerprint", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", T.fingerprint(F.encode("text", "UTF-8")).alias("content_hash"))


@query("extract_text", f"""
WITH {B.FILES} SELECT path, md5(text) AS text_md5, length(text) AS n, {B.s_first_line('text')} AS first_line FROM files""")
def extract_text(t):
    raw = B.files(t).select(
        "path", P.extension(P.base_name(F.col("path"))).alias("extension"), F.encode("text", "UTF-8").alias("content")
    )
    out = SF.extract_text(raw)
    return out.select("path", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"), "first_line")


@query("extract_with_plug_in", f"""
WITH {B.FILES}, p AS (SELECT path, {B.s_ext(B.s_name('path'))} AS ext, text, length(text) % 5 = 0 AS bad FROM files)
SELECT path, CASE WHEN ext <> '.pdf' THEN md5(text) WHEN bad THEN md5('') ELSE md5('pdf:' || text) END AS text_md5,
  CASE WHEN ext = '.pdf' AND bad THEN 'ValueError' ELSE '' END AS error_type FROM p""")
def extract_with_plug_in(t):
    def parse(_, content):
        text = content.decode("utf-8")
        if len(text) % 5 == 0:
            raise ValueError("damaged file")
        return "pdf:" + text

    raw = B.files(t).select(
        "path", P.extension(P.base_name(F.col("path"))).alias("extension"), F.encode("text", "UTF-8").alias("content")
    )
    out = SF.extract_text(raw, [SF.Extractor(frozenset([".pdf"]), parse)])
    return out.select("path", F.md5("text").alias("text_md5"), F.coalesce("error_type", F.lit("")).alias("error_type"))


@query("extract_errors", f"""
WITH {B.FILES}, p AS (SELECT path, ['PermissionError', 'FileNotFoundError', 'UnicodeDecodeError', 'OSError', 'ValueError'][
  (doc_id % 7 + 1)::BIGINT] AS e FROM files), q AS (SELECT *,
  CASE e WHEN 'PermissionError' THEN 'Permission denied: ' || path
    WHEN 'FileNotFoundError' THEN 'File not found (possibly deleted): ' || path
    WHEN 'UnicodeDecodeError' THEN 'Cannot decode file (binary?): ' || path
    WHEN 'OSError' THEN 'OS error reading file: ' || path || ' - boom'
    WHEN 'ValueError' THEN 'Unexpected error: ' || path || ' - boom' ELSE '' END AS message,
  CASE WHEN e IN ('PermissionError', 'OSError') THEN 'WARNING' WHEN e = 'ValueError' THEN 'ERROR'
    WHEN e IS NULL THEN '' ELSE 'DEBUG' END AS log_level FROM p)
SELECT path, message, log_level, CASE WHEN e IS NULL THEN '' ELSE 'SKIP' END AS action FROM q""")
def extract_errors(t):
    kinds = ["PermissionError", "FileNotFoundError", "UnicodeDecodeError", "OSError", "ValueError"]
    rows = B.files(t).select(
        "path", F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod("doc_id", F.lit(7)).cast("int")).alias("error_type"),
        F.lit("boom").alias("error_detail"),
    )
    out = SF.classify_errors(rows)
    return out.select("path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("message", "log_level", "action")])


# ----------------------------------------------------------------------- entries

_DESCRIBED = f"""{B.FILES}, described AS (
  SELECT *, {B.s_name('path')} AS file_name, {B.s_folder('path')} AS folder, {B.s_source('path')} AS source,
    {B.s_ext(B.s_name('path'))} AS extension, sha256(text) AS content_hash FROM files)"""
_TYPES = "MAP {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in fv.TYPE_DESCRIPTIONS.items()) + "}"
_TYPE = f"coalesce({_TYPES}[extension], ltrim(extension, '.'))"


@query("type_description", f"""
WITH {_DESCRIBED} SELECT extension, {_TYPE} AS description, count(*) AS n FROM described GROUP BY 1, 2""")
def type_description(t):
    rows = E.describe_files(B.files(t), HOME)
    return rows.groupBy("extension", P.type_description(F.col("extension")).alias("description")).agg(
        F.count("*").alias("n")
    )


@query("relative_folder", f"WITH {B.FILES} SELECT path, {B.s_folder('path')} AS folder FROM files")
def relative_folder(t):
    return B.files(t).select("path", P.relative_folder(F.col("path"), HOME).alias("folder"))


@query("classify_source", f"WITH {B.FILES} SELECT path, {B.s_source('path')} AS source FROM files")
def classify_source(t):
    return B.files(t).select("path", P.classify_source(F.col("path"), HOME).alias("source"))


def _described(t):
    return E.describe_files(B.files(t), HOME).withColumn("content_hash", T.fingerprint(F.col("text")))


@query("file_entries", f"""
WITH {_DESCRIBED} SELECT file_name || ' - ' || {_TYPE} || ' file' AS text, 'file' AS entry_type, source,
  path AS file_path, file_name, folder, content_hash, extension FROM described""")
def file_entries(t):
    return E.file_entries(_described(t)).select(
        "text", "entry_type", "source", "file_path", "file_name", "folder", "content_hash",
        F.col("extra_metadata")["extension"].alias("extension"),
    )


def _chunk_sql(size, overlap, where=""):
    return f"""c AS (SELECT path, source, content_hash, {B.s_chunks('text', size, overlap)} AS cs FROM described {where}),
u AS (SELECT path, source, content_hash, len(cs) AS total, unnest(cs) AS text,
  generate_subscripts(cs, 1) - 1 AS chunk_index FROM c)"""


@query("chunk_text", f"""
WITH {_DESCRIBED}, {_chunk_sql(1000, 200)}
SELECT path AS file_path, chunk_index::INTEGER AS chunk_index, total::VARCHAR AS total, md5(text) AS text_md5,
  length(text)::INTEGER AS n, source FROM u""")
def chunk_text(t):
    return E.chunk_entries(_described(t)).select(
        "file_path", "chunk_index", F.col("extra_metadata")["total_chunks"].alias("total"),
        F.md5("text").alias("text_md5"), F.length("text").alias("n"), "source",
    )


@query("text_entries", f"""
WITH {_DESCRIBED}, {_chunk_sql(512, 128, 'WHERE list_contains(' + sql_list(fv.TEXT_EXTENSIONS) + ', extension)')}
SELECT path AS file_path, 'chunk' AS entry_type, 'desktop' AS source, chunk_index::INTEGER AS chunk_index,
  md5(text) AS text_md5 FROM u
UNION ALL SELECT path, 'file', 'desktop', -1, md5(file_name || ' - ' || {_TYPE} || ' file') FROM described
  WHERE list_contains({sql_list(fv.TEXT_EXTENSIONS)}, extension)""")
def text_entries(t):
    return E.text_entries(_described(t)).select(
        "file_path", "entry_type", "source", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        F.md5("text").alias("text_md5"),
    )


@query("image_entries", f"""
WITH {_DESCRIBED} SELECT path AS file_path, 'photos' AS source, folder, file_name || ' - Photo. Image named ' ||
  translate(substring(file_name, 1, length(file_name) - length({B.s_suffix('file_name')})), '_-', '  ') AS text
FROM described WHERE list_contains({sql_list(fv.IMAGE_EXTENSIONS)}, extension)""")
def image_entries(t):
    return E.image_entries(_described(t)).select("file_path", "source", "folder", "text")


@query("memory_entries", f"""
SELECT text, CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE role END AS memory_source, 'memory' AS source,
  'chunk' AS entry_type FROM (SELECT conv_id, role, CASE WHEN turn % 5 = 4 THEN chr(10) || ' ' ELSE text END AS text
  FROM conversations) WHERE {B.s_strip('text')} <> ''""")
def memory_entries(t):
    facts = t.conversations.select(
        F.when(F.col("turn") % 5 == 4, "\n ").otherwise(F.col("text")).alias("content"),
        F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("source"),
    )
    return E.memory_entries(facts).select(
        "text", F.col("extra_metadata")["memory_source"].alias("memory_source"), "source", "entry_type"
    )


@query("read_preview", f"""
WITH {_DESCRIBED}, p AS (SELECT path, text, CASE WHEN list_contains({sql_list(fv.PREVIEW_EXTENSIONS)}, extension)
  THEN 'text' WHEN extension = '.pdf' THEN 'pdf' END AS file_type FROM described)
SELECT path, CASE WHEN file_type IS NULL THEN '' ELSE md5(substring(text, 1, 4000)) END AS text_md5,
  file_type IS NOT NULL AND length(text) > 4000 AS truncated, coalesce(file_type, '') AS file_type FROM p""")
def read_preview(t):
    p = T.read_preview(F.col("text"), F.col("extension"))
    return _described(t).select(
        "path", F.coalesce(F.md5(p["text"]), F.lit("")).alias("text_md5"),
        F.coalesce(p["truncated"], F.lit(False)).alias("truncated"), F.coalesce(p["file_type"], F.lit("")).alias("file_type"),
    )


@query("unit_convert", """
SELECT doc_id, round_even(n_chars * 1000003.0 / 1073741824.0, 1) AS gb, round_even(n_chars * 997.0 / 1048576.0, 1) AS mb
FROM documents""")
def unit_convert(t):
    n = F.col("n_chars")
    return t.documents.select(
        "doc_id", U.bytes_to_gb(n * F.lit(1000003.0)).alias("gb"), U.bytes_to_mb(n * F.lit(997.0)).alias("mb")
    )


# ------------------------------------------------------------ content-addressed store


def _stored_and_current(t):
    """Two states of the corpus that together hold every document: odd ones are new, every 14th is gone."""
    rows = _described(t)
    return rows.filter(F.col("doc_id") % 2 == 0), rows.filter(F.col("doc_id") % 14 != 0)


_SIDES = f"""{_DESCRIBED}, stored AS (SELECT * FROM described WHERE doc_id % 2 = 0),
cur AS (SELECT * FROM described WHERE doc_id % 14 <> 0)"""


@query("known_new_split", f"""
WITH {_SIDES} SELECT path, content_hash, content_hash IN (SELECT content_hash FROM stored) AS is_known FROM cur""")
def known_new_split(t):
    stored, current = _stored_and_current(t)
    return S.flag_known(current.select("path", "content_hash"), stored).select("path", "content_hash", "is_known")


@query("group_by_content", f"""
WITH {_DESCRIBED} SELECT content_hash, count(*) AS n_paths, min(path) AS file_path,
  arg_min(file_name, path) AS file_name FROM described GROUP BY 1""")
def group_by_content(t):
    return S.first_per_content(E.file_entries(_described(t))).select(
        F.col("content_key").alias("content_hash"), "n_paths", "file_path", "file_name"
    )


@query("duplicate_groups", f"""
WITH {_DESCRIBED} SELECT content_hash, count(*) AS n_paths, min(path) AS first_path, max(path) AS last_path
FROM described GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(t):
    return S.duplicate_groups(_described(t))


@query("duplicate_paths", f"""
WITH {_DESCRIBED}, g AS (SELECT content_hash, count(*) AS n_paths, min(path) AS first_path FROM described
  GROUP BY 1 HAVING count(*) > 1) SELECT content_hash, path, n_paths, first_path FROM described JOIN g USING (content_hash)""")
def duplicate_paths(t):
    return S.duplicate_paths(_described(t))


def _content(rows):
    return rows.groupBy("content_hash").agg(F.min("path").alias("first_path"))


@query("content_join_paths", f"""
WITH {_DESCRIBED}, content AS (SELECT content_hash, {B.s_first_line('any_value(text)')} AS first_line
  FROM described GROUP BY 1)
SELECT content_hash, first_line, path, source FROM content JOIN described USING (content_hash)""")
def content_join_paths(t):
    rows = _described(t)
    content = rows.groupBy("content_hash").agg(T.first_line(F.any_value("text")).alias("first_line"))
    return S.content_paths(content, rows.select("content_hash", "path", "source"))


@query("chunk_join_paths", f"""
WITH {_DESCRIBED}, {_chunk_sql(1000, 200)}, k AS (SELECT DISTINCT content_hash, chunk_index, text FROM u)
SELECT content_hash, chunk_index::INTEGER AS chunk_index, md5(k.text) AS text_md5, path
FROM k JOIN described USING (content_hash)""")
def chunk_join_paths(t):
    rows = _described(t)
    single = rows.groupBy("content_hash").agg(F.any_value("text").alias("text"))
    chunks = single.select("content_hash", F.posexplode(T.chunk_array(F.col("text"))).alias("chunk_index", "text"))
    joined = S.chunk_paths(chunks, rows.select("content_hash", "path"))
    return joined.select("content_hash", "chunk_index", F.md5("text").alias("text_md5"), "path")


@query("stale_paths", f"""
WITH {_SIDES} SELECT path FROM stored WHERE (starts_with(path, '{HOME}/Desktop/') OR starts_with(path, '{HOME}/Documents/'))
  AND path NOT IN (SELECT path FROM cur)""")
def stale_paths(t):
    stored, current = _stored_and_current(t)
    return S.stale_paths(stored, current, [f"{HOME}/Desktop", f"{HOME}/Documents"]).select("path")


@query("orphan_content", f"""
WITH {_SIDES} SELECT DISTINCT content_hash FROM stored WHERE content_hash NOT IN (SELECT content_hash FROM cur)""")
def orphan_content(t):
    stored, current = _stored_and_current(t)
    return S.orphans(stored.select("content_hash").distinct(), current)


@query("orphan_chunks", f"""
WITH {_SIDES}, k AS (SELECT DISTINCT content_hash, text FROM stored),
u AS (SELECT content_hash, unnest({B.s_chunks('text', 1000, 200)}) AS c FROM k)
SELECT content_hash, count(*) AS n_chunks FROM u WHERE content_hash NOT IN (SELECT content_hash FROM cur) GROUP BY 1""")
def orphan_chunks(t):
    stored, current = _stored_and_current(t)
    single = stored.groupBy("content_hash").agg(F.any_value("text").alias("text"))
    chunks = single.select("content_hash", F.explode(T.chunk_array(F.col("text"))).alias("c"))
    return S.orphans(chunks, current).groupBy("content_hash").agg(F.count("*").alias("n_chunks"))


@query("live_content", f"""
WITH {_SIDES} SELECT DISTINCT content_hash FROM stored WHERE content_hash IN (SELECT content_hash FROM cur)""")
def live_content(t):
    stored, current = _stored_and_current(t)
    return S.without_orphans(stored.select("content_hash").distinct(), current)


@query("path_set_difference", f"WITH {_SIDES} SELECT path FROM stored EXCEPT SELECT path FROM cur")
def path_set_difference(t):
    stored, current = _stored_and_current(t)
    return stored.select("path").exceptAll(current.select("path"))


@query("insert_content", f"""
WITH {_SIDES}, o AS (SELECT content_hash, min(path) AS path FROM stored GROUP BY 1),
n AS (SELECT content_hash, min(path) AS path FROM cur WHERE content_hash NOT IN (SELECT content_hash FROM stored) GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n""")
def insert_content(t):
    stored, current = _stored_and_current(t)
    base = stored.groupBy("content_hash").agg(F.min("path").alias("path"))
    return S.insert_content(base, current.select("content_hash", "path"))


@query("upsert_paths", f"""
WITH {_SIDES}, old AS (SELECT path, sha256(text || 'old') AS content_hash, 1 AS last_verified, 0 AS p FROM stored),
new AS (SELECT path, content_hash, 2 AS last_verified, 1 AS p FROM cur)
SELECT path, arg_max(content_hash, p) AS content_hash, max(last_verified) AS last_verified
FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY path""")
def upsert_paths(t):
    stored, current = _stored_and_current(t)
    old = stored.select("path", T.fingerprint(F.concat("text", F.lit("old"))).alias("content_hash"),
                        F.lit(1).alias("last_verified"))
    return S.upsert_paths(old, current.select("path", "content_hash", F.lit(2).alias("last_verified")))


@query("replace_chunks", f"""
WITH {_SIDES}, o AS (SELECT DISTINCT content_hash, text FROM stored), n AS (SELECT DISTINCT content_hash, text FROM cur),
oc AS (SELECT content_hash, {B.s_chunks('text', 1000, 200)} AS cs FROM o WHERE content_hash NOT IN (SELECT content_hash FROM n)),
nc AS (SELECT content_hash, {B.s_chunks('text', 512, 128)} AS cs FROM n), a AS (SELECT * FROM oc UNION ALL SELECT * FROM nc),
u AS (SELECT content_hash, unnest(cs) AS text FROM a)
SELECT content_hash, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY 1""")
def replace_chunks(t):
    stored, current = _stored_and_current(t)

    def chunks(rows, size, overlap):
        single = rows.groupBy("content_hash").agg(F.any_value("text").alias("text"))
        return single.select(
            "content_hash", F.posexplode(T.chunk_array(F.col("text"), size, overlap)).alias("chunk_index", "text")
        )

    out = S.replace_chunks(chunks(stored, 1000, 200), chunks(current, 512, 128))
    return out.groupBy("content_hash").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query("index_stats", f"""
WITH {_SIDES} SELECT count(*) AS files_scanned,
  count(DISTINCT content_hash) FILTER (NOT k) AS files_indexed, count(*) FILTER (k) AS files_skipped,
  count(*) FILTER (k) AS files_deduplicated, 0::BIGINT AS chunks_created, count(*) FILTER (doc_id % 10 = 1) AS errors
FROM (SELECT *, content_hash IN (SELECT content_hash FROM stored) AS k FROM cur)""")
def index_stats(t):
    stored, current = _stored_and_current(t)
    flagged = S.flag_known(current, stored).withColumn("error_type", F.when(F.col("doc_id") % 10 == 1, "OSError"))
    return S.index_stats(flagged)


@query("counts_by_source_and_type", f"""
WITH {_DESCRIBED}, {_chunk_sql(1000, 200)} SELECT source, 'chunk' AS entry_type, count(*) AS n FROM u GROUP BY 1
UNION ALL SELECT source, 'file', count(*) FROM described GROUP BY 1""")
def counts_by_source_and_type(t):
    rows = _described(t)
    return E.file_entries(rows).unionByName(E.chunk_entries(rows)).groupBy("source", "entry_type").agg(
        F.count("*").alias("n")
    )


@query("distinct_keys", f"""
WITH {_DESCRIBED} SELECT count(DISTINCT content_hash) AS n_hashes, count(DISTINCT path) AS n_paths FROM described""")
def distinct_keys(t):
    return _described(t).agg(
        F.count_distinct("content_hash").alias("n_hashes"), F.count_distinct("path").alias("n_paths")
    )


@query("find_content_by_hash", f"""
WITH {_SIDES} SELECT DISTINCT content_hash FROM described WHERE content_hash IN (SELECT content_hash FROM stored)""")
def find_content_by_hash(t):
    stored, _ = _stored_and_current(t)
    return S.lookup(_described(t).select("content_hash").distinct(), stored, "content_hash")


@query("changed_files", f"""
WITH {_DESCRIBED}, old AS (SELECT path, mtime_s - CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 5 END AS m,
  sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS h FROM described WHERE doc_id % 5 <> 0)
SELECT d.path, CASE WHEN old.h IS NULL THEN 'new' WHEN old.m = d.mtime_s THEN 'unchanged'
  WHEN old.h = d.content_hash THEN 'touched' ELSE 'modified' END AS status
FROM described d LEFT JOIN old ON old.path = d.path""")
def changed_files(t):
    rows = _described(t)
    stored = rows.filter(F.col("doc_id") % 5 != 0).select(
        "path",
        F.when(F.col("doc_id") % 4 == 0, F.col("mtime")).otherwise(F.col("mtime") - F.expr("interval 5 seconds")).alias("mtime"),
        T.fingerprint(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))).alias("content_hash"),
    )
    return S.changed_files(rows, stored).select("path", "status")


# ---------------------------------------------------------------- refresh and index


def _scan(t):
    """Kept files of the binding as a scan result."""
    kept = B.files(t).filter(P.keep(F.col("path"), "scan", HOME))
    return kept.select("doc_id", "path", "text", "mtime", F.lit(None).cast("string").alias("error_type"))


_KEPT = f"""{_DESCRIBED}, kept AS (SELECT * FROM (SELECT *, file_name AS n FROM described) WHERE NOT ({_SKIP_FILE})
  AND len(list_filter(string_split(folder, '/'), lambda x: (starts_with(x, '.') AND NOT ends_with(x, '.icloud'))
  OR list_contains({sql_list(fv.SKIP_DIRS)}, x))) = 0)"""
_CONTENT_CHUNKS = f"""k AS (SELECT content_hash, any_value(text) AS text FROM kept GROUP BY 1),
kc AS (SELECT content_hash, {B.s_chunks('text', 1000, 200)} AS cs FROM k)"""


@query("scan_files", f"""
WITH {_KEPT} SELECT path, extension, {B.s_placeholder('file_name')} AS is_placeholder, strlen(text) AS size, mtime_s, NULL AS error_type
FROM kept UNION ALL SELECT '{HOME}/missing', '', false, 0, NULL, 'FileNotFoundError'""")
def scan_files(t):
    """The documents written out as files and listed."""
    root = trees.documents_tree(t)
    return SF.scan_files(t.spark, trees.roots(root)).select(
        trees.below_home("path", root).alias("path"), "extension", "is_placeholder", "size", F.unix_seconds("mtime").alias("mtime_s"), "error_type"
    )


@query("read_and_fingerprint", f"""
WITH {_KEPT} SELECT path, content_hash, strlen(text) AS bytes FROM kept UNION ALL SELECT '{HOME}/missing', NULL, NULL""")
def read_and_fingerprint(t):
    root = trees.documents_tree(t)
    read = SF.read_files(SF.scan_files(t.spark, trees.roots(root)))
    return read.select(trees.below_home("path", root).alias("path"), "content_hash", F.octet_length("content").cast("bigint").alias("bytes"))


@query("refresh_from_disk", f"""
WITH {_KEPT}, one AS (SELECT * FROM kept WHERE doc_id % 7 <> 0),
two AS (SELECT path, CASE WHEN doc_id % 5 = 2 AND doc_id % 7 <> 0 THEN sha256(text || ' edited') ELSE content_hash END AS content_hash,
  doc_id % 7 = 0 OR doc_id % 5 = 2 AS opened FROM kept WHERE doc_id % 7 = 0 OR doc_id % 5 <> 1),
counts AS (SELECT (SELECT count(*) FROM two) AS files_scanned, (SELECT count(*) FROM two WHERE opened) AS files_read,
  (SELECT count(DISTINCT content_hash) FROM two WHERE content_hash NOT IN (SELECT content_hash FROM one)) AS files_indexed,
  (SELECT count(*) FROM two) AS unchanged_scanned, 0::BIGINT AS unchanged_read, 0::BIGINT AS unchanged_indexed)
SELECT path, content_hash, counts.* FROM two, counts""")
def refresh_from_disk(t):
    """Documents as files, refreshed three times: at first, after edits, deletions and additions, and unchanged."""
    root, kind = new_folder(t.spark, "tree"), F.col("doc_id")
    files = B.files(t)
    trees.write_tree(files.filter(kind % 7 != 0), root)
    store = Store(t.spark, new_folder(t.spark, "store"))

    def run(batch):
        local = root.removeprefix("file://").removeprefix("file:")
        return local, I.refresh_from_disk(store, SF.scan_files(t.spark, trees.roots(local)), local, trees.roots(local), batch)

    run("one")
    later = F.col("mtime") + F.expr("interval 1 hour")
    edited = files.filter((kind % 5 == 2) & (kind % 7 != 0)).withColumns({"text": F.concat("text", F.lit(" edited")), "mtime": later})
    gone = files.filter((kind % 5 == 1) & (kind % 7 != 0)).withColumn("text", F.lit(None).cast("string"))
    trees.write_tree(edited.unionByName(gone).unionByName(files.filter(kind % 7 == 0)), root)
    local, second = run("two")
    _, third = run("three")
    counters = {n: second[n] for n in ("files_scanned", "files_read", "files_indexed")}
    counters |= {f"unchanged_{n[6:]}": third[n] for n in ("files_scanned", "files_read", "files_indexed")}
    return store.paths().select(
        trees.below_home("path", local).alias("path"), "content_hash", *[F.lit(v).cast("bigint").alias(k) for k, v in counters.items()])


@query("full_refresh", f"""
WITH {_KEPT}, s AS (SELECT * FROM kept WHERE doc_id % 2 = 0), c AS (SELECT * FROM kept WHERE doc_id % 14 <> 0),
k AS (SELECT content_hash, any_value(text) AS text FROM c WHERE content_hash NOT IN (SELECT content_hash FROM s) GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS files_scanned, (SELECT count(*) FROM k) AS files_indexed,
  (SELECT count(*) FROM c WHERE content_hash IN (SELECT content_hash FROM s)) AS files_skipped,
  (SELECT count(*) FROM c WHERE content_hash IN (SELECT content_hash FROM s)) AS files_deduplicated,
  (SELECT sum(len({B.s_chunks('text', 1000, 200)}))::BIGINT FROM k) AS chunks_created, 0::BIGINT AS errors""")
def full_refresh(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    rows = _scan(t)
    roots = [f"{HOME}/{f}" for f in B.FOLDERS]
    I.full_refresh(store, rows.filter("doc_id % 2 = 0"), HOME, roots, "run-1")
    return I.full_refresh(store, rows.filter("doc_id % 14 <> 0"), HOME, roots, "run-2").select(
        "files_scanned", "files_indexed", "files_skipped", "files_deduplicated", "chunks_created", "errors"
    )


@query("refreshed_paths", f"""
WITH {_KEPT} SELECT path, content_hash, source, folder, extension FROM kept WHERE doc_id % 14 <> 0""")
def refreshed_paths(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    rows = _scan(t)
    roots = [f"{HOME}/{f}" for f in B.FOLDERS]
    I.full_refresh(store, rows.filter("doc_id % 2 = 0"), HOME, roots, "run-1")
    I.full_refresh(store, rows.filter("doc_id % 14 <> 0"), HOME, roots, "run-2")
    return store.paths().select("path", "content_hash", "source", "folder", "extension")


@query("incremental_refresh", f"""
WITH {_KEPT}, moved AS (SELECT regexp_replace(path, '/([^/]*)$', '/moved_\\1') AS path, content_hash FROM kept
  WHERE doc_id % 6 = 0), edited AS (SELECT path, sha256(text || ' edited') AS content_hash FROM kept WHERE doc_id % 6 = 2)
SELECT path, content_hash FROM kept WHERE doc_id % 6 IN (4, 5) UNION ALL SELECT * FROM moved UNION ALL SELECT * FROM edited
UNION ALL SELECT path, content_hash FROM kept WHERE doc_id % 6 = 3""")
def incremental_refresh(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    rows = _scan(t)
    kind = F.col("doc_id") % 6
    I.full_refresh(store, rows.filter("doc_id % 6 <> 3"), HOME, [HOME], "run-1")
    target = F.regexp_replace("path", "/([^/]*)$", "/moved_$1")
    changes = rows.filter(kind.isin(0, 1, 2, 3)).select(
        F.when(kind == 0, target).otherwise(F.col("path")).alias("path"),
        F.when(kind == 0, F.col("path")).alias("old_path"),
        F.when(kind == 0, "moved").when(kind == 1, "deleted").when(kind == 2, "modified").otherwise("created").alias(
            "change_type"
        ),
    )
    now = rows.filter(kind.isin(0, 2, 3, 4, 5)).select(
        F.when(kind == 0, target).otherwise(F.col("path")).alias("path"),
        F.when(kind == 2, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("text"), "mtime",
    )
    I.apply_changes(store, changes, now, HOME, "batch-1")
    return store.paths().select("path", "content_hash")


_INDEX_SQL = f"""
WITH {_KEPT}, {_CONTENT_CHUNKS}, u AS (SELECT content_hash, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM kc),
r AS (SELECT 'file' AS type, source, path, -1 AS chunk_index, md5({B.s_first_line('text')}) AS text_md5 FROM kept
UNION ALL SELECT 'chunk', source, path, i, md5(c) FROM u JOIN kept USING (content_hash))
SELECT type, source, path AS file_path, chunk_index::INTEGER AS chunk_index, text_md5 FROM r"""


@query("index_documents", _INDEX_SQL)
def index_documents(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    I.full_refresh(store, _scan(t), HOME, [HOME], "run-1")
    folder = new_folder(t.spark, "index")
    I.write_index(I.current_index(store), folder)
    return t.spark.read.parquet(folder).select(
        "type", "source", "file_path", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        F.md5("text").alias("text_md5"),
    )


@query("index_all_sources", f"""
WITH {B.PHOTOS}, {_KEPT}, {_CONTENT_CHUNKS}, u AS (SELECT content_hash, unnest(cs) AS c FROM kc)
SELECT 'file' AS type, source, count(*) AS n FROM kept GROUP BY 2
UNION ALL SELECT 'chunk', source, count(*) FROM u JOIN kept USING (content_hash) GROUP BY 2
UNION ALL SELECT 'file', 'photos', (SELECT count(*) FROM photos) + (SELECT count(*) FROM kept WHERE list_contains({sql_list(fv.IMAGE_EXTENSIONS)}, extension))
UNION ALL SELECT 'chunk', 'memory', count(DISTINCT text) FROM conversations WHERE role = 'user' AND {B.s_strip('text')} <> ''""")
def index_all_sources(t):
    """Files and chunks, photo records, image files and facts in one written index, counted by type and source."""
    store = Store(t.spark, new_folder(t.spark, "store"))
    rows = _scan(t)
    I.full_refresh(store, rows, HOME, [HOME], "run-1")
    facts = t.conversations.filter("role = 'user'").select(F.col("text").alias("content"), F.lit("chat").alias("source"))
    images = E.describe_files(rows.select("path", T.fingerprint(F.col("text")).alias("content_hash")), HOME)
    folder = new_folder(t.spark, "index")
    I.write_index(I.whole_index(store, HOME, B.photos(t), facts, images), folder)
    return t.spark.read.parquet(folder).groupBy("type", "source").agg(F.count("*").alias("n"))


@query("force_rebuild", f"""
WITH {_KEPT}, {_CONTENT_CHUNKS} SELECT true AS indexed, 1::BIGINT AS version, 1::BIGINT AS versions,
  (SELECT count(*) FROM kept) AS n_paths, (SELECT count(*) FROM k) AS n_content,
  (SELECT sum(len(cs))::BIGINT FROM kc) AS n_chunks""")
def force_rebuild(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    rows = _scan(t)
    I.full_refresh(store, rows.filter("doc_id % 3 = 0"), HOME, [HOME], "run-1")
    I.force_rebuild(store, rows, HOME, "rebuild")
    state = store.status()
    counts = [getattr(store, name)().agg(F.count("*").alias(f"n_{name}")) for name in ("paths", "content", "chunks")]
    every = counts[0].unionByName(counts[1], allowMissingColumns=True).unionByName(counts[2], allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in every.columns]).select(
        F.lit(state["indexed"]).alias("indexed"), F.lit(state["version"]).cast("bigint").alias("version"),
        F.lit(state["versions"]).cast("bigint").alias("versions"), "n_paths", "n_content", "n_chunks",
    )


@query("index_status", f"""
WITH {_KEPT}, {_CONTENT_CHUNKS}, u AS (SELECT content_hash, unnest(cs) AS c FROM kc)
SELECT 'file' AS type, source, count(*) AS n FROM kept GROUP BY 2
UNION ALL SELECT 'chunk', source, count(*) FROM u JOIN kept USING (content_hash) GROUP BY 2""")
def index_status(t):
    store = Store(t.spark, new_folder(t.spark, "store"))
    I.full_refresh(store, _scan(t), HOME, [HOME], "run-1")
    return I.current_index(store).groupBy("type", "source").agg(F.count("*").alias("n"))
