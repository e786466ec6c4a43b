"""How the given tables stand in for files, photos, chats and question-answering rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import BLANKS
from workload.registry import Tables, sql_text

HOME = "/home/u"
FOLDERS = ["Desktop", "Documents", "Library/Mobile Documents/com~apple~CloudDocs"]
NAMES = [
    ("doc_", ".txt"), ("doc_", ".md"), ("doc_", ".py"), ("doc_", ".js"), ("doc_", ".json"), ("doc_", ".html"),
    (".doc_", ".pdf.icloud"), ("doc_", ".PDF"), ("doc_", ".zip"), (".doc_", ".txt"), ("pic-no_", ".jpg"),
]
EPOCH = 1704067200


def _pick(index, values):
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def files(t: Tables) -> DataFrame:
    """documents as files: doc_id, path, text, mtime, n_chars, lang."""
    d = t.documents
    n = F.pmod("doc_id", F.lit(len(NAMES)))
    name = F.concat(_pick(n, [a for a, _ in NAMES]), F.col("doc_id").cast("string"), _pick(n, [b for _, b in NAMES]))
    sub = F.when(F.pmod("doc_id", F.lit(13)) == 0, "/node_modules").when(F.pmod("doc_id", F.lit(17)) == 0, "/.cache")
    path = F.concat(
        F.lit(HOME + "/"), _pick(F.pmod("doc_id", F.lit(3)), FOLDERS), sub.otherwise(""), F.lit("/"), F.col("source"),
        F.lit("/"), name,
    )
    return d.select(
        "doc_id", path.alias("path"), "text", F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id")).alias("mtime"),
        "n_chars", "lang",
    )


def _case(index: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {sql_text(v)}" for i, v in enumerate(values)) + " END"


FILES = f"""files AS (
  SELECT doc_id, text, n_chars, lang, {EPOCH} + doc_id AS mtime_s,
    '{HOME}/' || {_case('doc_id % 3', FOLDERS)}
    || CASE WHEN doc_id % 13 = 0 THEN '/node_modules' WHEN doc_id % 17 = 0 THEN '/.cache' ELSE '' END
    || '/' || source || '/' || {_case(f'doc_id % {len(NAMES)}', [a for a, _ in NAMES])} || doc_id
    || {_case(f'doc_id % {len(NAMES)}', [b for _, b in NAMES])} AS path
  FROM documents)"""


# SQL fragments that restate the path and text rules
def s_strip(x: str) -> str:
    return f"trim({x}, {sql_text(BLANKS)})"


def s_name(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def s_parent(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def s_suffix(n: str) -> str:
    return f"regexp_extract({n}, '^.+(\\.[^.]+)$', 1)"


def s_placeholder(n: str) -> str:
    return f"(starts_with({n}, '.') AND ends_with({n}, '.icloud'))"


def s_real(n: str) -> str:
    return f"CASE WHEN {s_placeholder(n)} THEN substring({n}, 2, greatest(length({n}) - 8, 0)) ELSE {n} END"


def s_ext(n: str) -> str:
    return f"lower({s_suffix('(' + s_real(n) + ')')})"


def s_source(p: str) -> str:
    return (
        f"CASE WHEN starts_with({p}, '{HOME}/{FOLDERS[2]}/') THEN 'icloud' "
        f"WHEN starts_with({p}, '{HOME}/Documents/') THEN 'documents' ELSE 'desktop' END"
    )


def s_folder(p: str) -> str:
    f = s_parent(p)
    return (
        f"CASE WHEN {f} = '{HOME}' THEN '.' WHEN starts_with({f}, '{HOME}/') THEN substring({f}, {len(HOME) + 2}) "
        f"ELSE {f} END"
    )


def s_first_line(x: str) -> str:
    return f"substring(split_part({s_strip(x)}, chr(10), 1), 1, 200)"


def s_chunks(x: str, size: int, overlap: int) -> str:
    return (
        f"list_filter(list_transform(range(0, greatest(length({x}) - {overlap + 1}, 0) + 1, {size - overlap}), "
        f"lambda p: {s_strip(f'substring({x}, (p + 1)::BIGINT, {size})')}), lambda c: c <> '')"
    )


def with_position(df: DataFrame) -> DataFrame:
    """``df`` with ``position``: the place of each row in the order in which the rows come out, from 0."""
    from quarry.session import materialize

    numbered = materialize(df.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_m", 33).alias("_part")
    counts = numbered.groupBy(part).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = numbered.withColumn("_part", F.shiftright("_m", 33)).join(before, "_part")
    return rows.withColumn("position", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_before")


# ------------------------------------------------------------------ conversations


def messages(t: Tables) -> DataFrame:
    """conversations as chat messages; every seventh assistant text carries memory tags."""
    c = t.conversations
    key = F.col("conv_id") * 1000 + F.col("turn")
    fact = F.concat(F.lit(" <memory> fact "), key.cast("string"), F.lit("\nline </memory> tail <memory> </memory>"))
    tagged = F.when((F.col("role") == "assistant") & (F.pmod(key, F.lit(7)) == 0), F.concat("text", fact)).otherwise(
        F.col("text")
    )
    return c.select(
        key.alias("id"), F.col("conv_id").alias("chat_id"), "role", tagged.alias("content"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )


MESSAGES = f"""messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id, role, {EPOCH} + conv_id * 100 + turn AS created_s,
    CASE WHEN role = 'assistant' AND (conv_id * 1000 + turn) % 7 = 0
      THEN text || ' <memory> fact ' || (conv_id * 1000 + turn) || chr(10) || 'line </memory> tail <memory> </memory>'
      ELSE text END AS content
  FROM conversations)"""


def chats(t: Tables) -> DataFrame:
    """One chat per conversation: title from its first text, updated at its last message."""
    m = messages(t)
    title = F.min_by("content", F.struct("created_at", "id"))
    return m.groupBy("chat_id").agg(
        title.alias("prompt"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    ).withColumnRenamed("chat_id", "id").withColumn("status", F.lit("idle"))


CHATS = """chats AS (
  SELECT chat_id AS id, arg_min(content, created_s) AS prompt, min(created_s) AS created_s, max(created_s) AS updated_s
  FROM messages GROUP BY chat_id)"""


# ------------------------------------------------------------ question answering


def pairs(t: Tables) -> DataFrame:
    from quarry.operators.chat import question_answer_pairs

    return question_answer_pairs(t.conversations)


PAIRS = """nexts AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM nexts
  WHERE role = 'user' AND next_role = 'assistant')"""


def numbered_pairs(t: Tables) -> tuple[DataFrame, int]:
    """The pairs with ``k``, the running number of their conversation among those that have pairs, and how many there are.

    Conversations are counted per thousand ids first; only the thousands' sums are added up in order.
    """
    asked = pairs(t)
    ids = asked.select("conv_id").distinct().withColumn("_thousand", F.floor(F.col("conv_id") / 1000))
    sums = ids.groupBy("_thousand").agg(F.count("*").alias("_n"))
    before = sums.select("_thousand", (F.sum("_n").over(Window.orderBy("_thousand")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_thousand").orderBy("conv_id")) - 1 + F.col("_before")
    numbers = ids.join(before, "_thousand").select("conv_id", place.alias("k"))
    return asked.join(numbers, "conv_id"), max(1, ids.count())


NUMBERED = PAIRS + """, numbered AS (
  SELECT p.*, n.k FROM pairs p JOIN (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k
    FROM (SELECT DISTINCT conv_id FROM pairs)) n USING (conv_id))"""


def qa(t: Tables) -> DataFrame:
    """Every document with the question-answer pairs of one conversation; low quality means unanswerable."""
    asked, n = numbered_pairs(t)
    docs = t.documents.select("doc_id", F.col("text").alias("context"), F.pmod("doc_id", F.lit(n)).alias("k"))
    bad = t.labels.filter("quality = 0").select("doc_id").distinct().withColumn("is_impossible", F.lit(True))
    rows = docs.join(bad, "doc_id", "left").join(asked, "k")
    impossible = F.coalesce("is_impossible", F.lit(False))
    return rows.select(
        (F.col("doc_id") * 100 + F.col("turn")).alias("id"), "context", "question",
        F.when(impossible, F.array().cast("array<string>")).otherwise(F.array("answer")).alias("answers"),
        impossible.alias("is_impossible"),
    )


QA = (
    NUMBERED
    + """, qa AS (
  SELECT d.doc_id * 100 + p.turn AS id, d.text AS context, p.question,
    l.doc_id IS NOT NULL AS is_impossible, CASE WHEN l.doc_id IS NULL THEN p.answer END AS answer
  FROM documents d JOIN numbered p ON p.k = d.doc_id % (SELECT count(DISTINCT conv_id) FROM pairs)
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = d.doc_id)"""
)


# ------------------------------------------------------------------------ photos


def photos(t: Tables) -> DataFrame:
    """part as photos: name words are keywords, brand a person, type the location, size an album."""
    k = F.col("p_partkey")
    return t.part.select(
        F.concat(F.lit(HOME + "/Pictures/"), "p_type", F.lit("/IMG_"), k.cast("string"), F.lit(".jpg")).alias("file_path"),
        F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".jpg")).alias("file_name"),
        F.split("p_name", " ").alias("keywords"),
        F.array("p_brand").alias("persons"),
        F.col("p_type").alias("location"),
        F.timestamp_seconds(F.lit(EPOCH) - F.pmod(k * 7919, F.lit(1000)) * 86400).alias("date"),
        F.concat(F.lit("U-"), k.cast("string")).alias("uuid"),
        (F.pmod(k, F.lit(5)) == 0).alias("is_favorite"),
        (F.pmod(k, F.lit(11)) == 0).alias("is_hidden"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.array(F.concat(F.lit("album"), (F.col("p_size") % 10).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("album_names"),
    )


PHOTOS = f"""photos AS (
  SELECT '{HOME}/Pictures/' || p_type || '/IMG_' || p_partkey || '.jpg' AS file_path,
    'IMG_' || p_partkey || '.jpg' AS file_name, string_split(p_name, ' ') AS keywords, [p_brand] AS persons,
    p_type AS location, {EPOCH} - ((p_partkey * 7919) % 1000) * 86400 AS date_s, 'U-' || p_partkey AS uuid,
    CASE WHEN p_partkey % 3 = 0 THEN ['album' || (p_size % 10)] ELSE [] END AS album_names
  FROM part)"""


def photo_queries(t: Tables) -> DataFrame:
    """One photo query per distinct (last name word, type): qid, query."""
    word = F.element_at(F.split("p_name", " "), -1)
    return t.part.select(word.alias("w"), F.lower("p_type").alias("y")).distinct().select(
        F.concat_ws("-", "w", "y").alias("qid"),
        F.concat(F.lit("Show me "), F.substring("w", 1, 3), F.lit(" "), "w", F.lit(" from "), "y", F.lit(" album3")).alias(
            "query"
        ),
    )


PHOTO_QUERIES = """photo_queries AS (
  SELECT w || '-' || y AS qid, 'Show me ' || substring(w, 1, 3) || ' ' || w || ' from ' || y || ' album3' AS query
  FROM (SELECT DISTINCT string_split(p_name, ' ')[-1] AS w, lower(p_type) AS y FROM part))"""


# ------------------------------------------------------------------ routed queries

PHRASES = [
    "find my {} report", "open the {} spreadsheet", "what does my {} contract say", "is the {} machine slow today",
    "how much memory is the {} using", "current {} price", "when does the {} start", "compare my {} specs",
    "can i run {} on it", "my favorite {} is red", "I like {}", "tell me what {} costs", "look at {} on screen",
    "hello {}.txt file", "thanks for the {}", "weather for {} download", "free up space of {}", "clean up large {}",
    "should i buy {}", "which {} is better", "{}", "read the {} notes folder", "where is {}", "why is {} overheating",
    "large files {}", "cleanup {} again", "launch {} project code", "battery and gpu of {}", "show me {} photos from last year",
    "play the {} video recording", "search {} document on desktop", "zip archive of {} downloads this month",
]


def asked(t: Tables) -> DataFrame:
    """Queries to route: phrases filled with part names, and every user turn as it is: qid, query, username."""
    n = F.pmod("p_partkey", F.lit(len(PHRASES)))
    filled = _pick(n, [
        F.concat(F.lit(p.split("{}")[0]), F.col("p_name"), F.lit(p.split("{}")[1])) for p in PHRASES
    ])
    made = t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qid"), filled.alias("query"),
        F.when(F.pmod("p_partkey", F.lit(4)) > 0, F.concat(F.lit("user"), F.col("p_size").cast("string"))).alias("username"),
    )
    turns = t.conversations.filter("role = 'user'").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"), F.lit(None).cast("string").alias("username"),
    )
    return made.unionByName(turns)


ASKED = "asked AS (SELECT 'p' || p_partkey AS qid, CASE " + " ".join(
    f"WHEN p_partkey % {len(PHRASES)} = {i} THEN {sql_text(p.split('{}')[0])} || p_name || {sql_text(p.split('{}')[1])}"
    for i, p in enumerate(PHRASES)
) + """ END AS query, CASE WHEN p_partkey % 4 > 0 THEN 'user' || p_size END AS username FROM part
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text, NULL FROM conversations WHERE role = 'user')"""
