"""The registered queries of this subpackage, each through its operator, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, common, decontaminate, fim, jaccard_join, katz, language, line_dedup, merkle, near_vectors, quality, rans, url_rules, warc
from quarry.session import new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_near_vectors")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(common.table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op2_line_dedup", r"""
WITH lines AS (SELECT doc_id, pos, line, lower_ascii AS key FROM (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
repeated AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN r.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines LEFT JOIN repeated r USING (key) GROUP BY doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(common.table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_decontaminate")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(common.table(spark, folder, "documents").select("doc_id", "text"), common.table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("leaked_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaked_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_components(common.table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha256(raw) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM r""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_folder(spark, "warc")
    warc.write_archives(common.table(spark, folder, "pages"), archives)
    return warc.resolve(warc.read_archives(spark, archives))


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "token-ids")
    rans.write_ids(common.table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return rans.read_ids(spark, files, with_ids=False)


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.encode(common.table(spark, folder, "documents").select("doc_id", "text"), vocabulary, pattern, decoded="decoded")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_katz_backoff")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    scored = katz.score_documents(docs, "coalesce(crc32(cast(id as string)) % 5, -1) <> 1")
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id", (common.remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    scorer = quality.fit(docs, common.table(spark, folder, "labels"), common.remainder("id", 5) != 0)
    return quality.score(docs, scorer).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang")
    net = language.fit(docs, common.remainder("id", 4) != 2)
    return language.predict(docs.select("doc_id", "text"), net).select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: The rules that the query judges by: action, host, path.
URL_RULES = [
    url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"), url_rules.Rule("block", "example.org", "/en/1"),
    url_rules.Rule("allow", "com", "/fr/"), url_rules.Rule("block", "com", "/de/"),
]


@query("op11_url_rules", """
WITH u AS (SELECT row_number() OVER () AS row, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(action, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(action, length(rule_host || rule_path)) AS action
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN fits USING (row)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(common.table(spark, folder, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op12_merkle_manifest", """
WITH RECURSIVE
steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, documents.*, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
  coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit FROM documents, steps),
l AS (SELECT row, doc_id, coalesce('+' || lang, '') AS g, hit,
  sha256(array_to_string([coalesce(strlen(v) || ':' || v, '-') for v in [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]], '')) AS leaf,
  sha256(array_to_string([coalesce(strlen(v) || ':' || v, '-') for v in [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, lowered]], '')) AS lower_leaf FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM l),
tree AS (SELECT g, 0 AS lvl, pos, total, leaf AS h FROM leaves UNION ALL
  SELECT g, lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE total > 1 GROUP BY g, lvl, pos // 8, total),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM tree WHERE total = 1),
top AS (SELECT 0 AS lvl, place AS pos, total, subroot AS h FROM subroots UNION ALL
  SELECT lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE total > 1 GROUP BY lvl, pos // 8, total),
beside AS (
  SELECT a.g, a.lvl AS seq, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|'
    || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS way
  FROM tree a JOIN tree b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.total > 1 GROUP BY ALL UNION ALL
  SELECT NULL, 1000 + a.lvl, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|'
    || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.total > 1 GROUP BY ALL),
ways AS (
  SELECT row, seq, way FROM leaves JOIN beside ON leaves.g = beside.g AND beside.pos = leaves.pos >> (3 * lvl) UNION ALL
  SELECT row, seq, way FROM leaves JOIN subroots USING (g) JOIN beside ON beside.g IS NULL AND beside.pos = place >> (3 * lvl)),
up AS (SELECT row, list(way ORDER BY seq) AS ways FROM ways GROUP BY row),
folded AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE total = 1) AS root,
  sha256(coalesce(replace(array_to_string(ways, ''), '|', ''), '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN hit THEN lower_leaf ELSE leaf END, coalesce(ways, [])),
    lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM leaves JOIN subroots USING (g) LEFT JOIN up USING (row))
SELECT *, folded_root = root AS verified FROM folded""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_hash([F.col(c) for c in names[:-1]] + [lowered]))
    manifest = merkle.build(docs, F.col("lang"), merkle.leaf_hash([F.col(c) for c in names]), "doc_id", {"tampered": tampered})
    return manifest.verify("tampered").drop("tampered")


@query("op13_fill_in_middle", """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
  ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
  coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    examples = fim.restore(fim.transform(common.table(spark, folder, "documents").select("doc_id", "text"), using=["text"]))
    sha = {f"{c}_sha256": F.sha2(F.col(c).cast("binary"), 256) for c in ("output", "restored")}
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[v.alias(k) for k, v in sha.items()])
