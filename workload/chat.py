"""Chats, messages and token lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chat as CH
from quarry.sources import tables as ST
from quarry.streaming import tokens as TK
from workload import bindings as B
from workload.registry import query

EPOCH = B.EPOCH


def seconds(column):
    return F.unix_seconds(column)


@query("table_source", f"WITH {B.MESSAGES} SELECT id, chat_id, role, md5(content) AS content_md5, created_s FROM messages")
def table_source(t):
    rows = ST.read_table(t.spark, t.folder, "conversations")
    assert set(rows.columns) == {"conv_id", "turn", "role", "text"}
    return B.messages(t).select("id", "chat_id", "role", F.md5("content").alias("content_md5"),
                                seconds("created_at").alias("created_s"))


@query("chat_title", f"""
WITH {B.MESSAGES}, {B.CHATS} SELECT id, CASE WHEN length(prompt) > 150 THEN substring(prompt, 1, 150) || '...'
  ELSE prompt END AS title FROM chats""")
def chat_title(t):
    return B.chats(t).select("id", T.chat_title(F.col("prompt")).alias("title"))


@query("memory_tags", f"""
WITH {B.MESSAGES}, f AS (SELECT id, list_filter(list_transform(regexp_extract_all(content, '(?s)<memory>(.*?)</memory>', 1),
  lambda m: {B.s_strip('m')}), lambda m: m <> '') AS facts FROM messages)
SELECT id, (generate_subscripts(facts, 1) - 1)::INTEGER AS fact_index, unnest(facts) AS fact FROM f""")
def memory_tags(t):
    return CH.extracted_memories(B.messages(t)).select("id", "fact_index", "fact")


@query("strip_memory_tags", f"""
WITH {B.MESSAGES} SELECT id, {B.s_strip("regexp_replace(content, '(?s)<memory>.*?</memory>', '', 'g')")} AS content
FROM messages""")
def strip_memory_tags(t):
    return B.messages(t).select("id", T.strip_memory_tags(F.col("content")).alias("content"))


@query("validate_messages", f"""
WITH {B.MESSAGES} SELECT id, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN length(content) < 1 THEN 'content'
  ELSE '' END AS problem FROM (SELECT id, role, CASE WHEN id % 10 = 3 THEN '' ELSE content END AS content FROM messages)""")
def validate_messages(t):
    rows = B.messages(t).withColumn("content", F.when(F.col("id") % 10 == 3, "").otherwise(F.col("content")))
    good, bad = CH.split_valid(CH.validate_messages(rows))
    return good.select("id", F.lit("").alias("problem")).unionByName(bad.select("id", "problem"))


@query("validate_chats", f"""
WITH {B.MESSAGES}, {B.CHATS} SELECT id, CASE WHEN length(prompt) < 1 OR length(prompt) > 255 THEN 'title'
  WHEN id % 3 = 0 THEN 'status' ELSE '' END AS problem FROM chats""")
def validate_chats(t):
    rows = B.chats(t).withColumns(
        {"title": F.col("prompt"), "status": F.when(F.col("id") % 3 == 0, "lost").otherwise("generating")}
    )
    return CH.validate_chats(rows).select("id", F.coalesce("problem", F.lit("")).alias("problem"))


@query("last_message", f"""
WITH {B.MESSAGES} SELECT chat_id, count(*) AS n_messages, max(id) AS id, arg_max(role, id) AS role,
  md5(arg_max(content, id)) AS content_md5 FROM messages GROUP BY 1""")
def last_message(t):
    return CH.last_message(B.messages(t)).select("chat_id", "n_messages", "id", "role", F.md5("content").alias("content_md5"))


@query("question_answer_pairs", f"WITH {B.PAIRS} SELECT conv_id, turn, question, answer FROM pairs")
def question_answer_pairs(t):
    return B.pairs(t)


@query("recent_chats", f"""
WITH {B.MESSAGES}, {B.CHATS} SELECT id, updated_s, row_number() OVER (ORDER BY updated_s DESC, id DESC) - 1 AS position
FROM chats ORDER BY updated_s DESC, id DESC LIMIT 10""")
def recent_chats(t):
    found = B.with_position(CH.recent_chats(B.chats(t)))
    return found.select("id", seconds("updated_at").alias("updated_s"), "position")


@query("chat_messages", f"""
WITH {B.MESSAGES} SELECT id, role, created_s, row_number() OVER (ORDER BY created_s, id) - 1 AS position
FROM messages WHERE chat_id = (SELECT max(chat_id) FROM messages)""")
def chat_messages(t):
    m = B.messages(t)
    newest = m.agg(F.max("chat_id")).first()[0]
    found = B.with_position(CH.chat_messages(m, newest))
    return found.select("id", "role", seconds("created_at").alias("created_s"), "position")


@query("cascade_delete", f"""
WITH {B.MESSAGES}, {B.CHATS}, gone AS (SELECT id FROM chats WHERE id % 4 = 1)
SELECT 'chat' AS kind, id FROM chats WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'message', id FROM messages WHERE chat_id NOT IN (SELECT id FROM gone)""")
def cascade_delete(t):
    rows = B.chats(t)
    kept_chats, kept_messages = CH.cascade_delete(rows, B.messages(t), rows.filter("id % 4 = 1"))
    return kept_chats.select(F.lit("chat").alias("kind"), "id").unionByName(
        kept_messages.select(F.lit("message").alias("kind"), "id")
    )


@query("chat_commands", f"""
WITH {B.MESSAGES}, {B.CHATS}, c AS (SELECT id, user_id % 8 AS seq0, event_id AS seq, CASE event_type WHEN 'click' THEN 'create'
    WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN event_type IN ('click', 'view') THEN 't' || event_id END AS title,
    epoch_us(ts) AS at_us FROM (SELECT *, user_id AS id FROM events)),
base AS (SELECT id, -1 AS seq, 'create' AS op, 'old' AS title, updated_s * 1000000 AS at_us FROM chats),
log AS (SELECT id, seq, op, title, at_us FROM base UNION ALL SELECT id, seq, op, title, at_us FROM c),
s AS (SELECT id, max(seq) FILTER (op = 'delete') AS d, max(seq) FILTER (op = 'create') AS cr,
  arg_max(title, seq) FILTER (title IS NOT NULL AND op <> 'delete') AS title,
  arg_max(at_us, seq) FILTER (op <> 'delete') AS updated_us FROM log GROUP BY 1)
SELECT id, title, updated_us FROM s WHERE cr IS NOT NULL AND cr > coalesce(d, -2)""")
def chat_commands(t):
    kind = F.col("event_type")
    commands = t.events.select(
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "create").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.col("user_id").alias("id"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("status"), F.col("ts").cast("timestamp").alias("at"),
    )
    chats = B.chats(t).withColumn("title", F.lit("old"))
    out = CH.apply_commands(chats, commands)
    return out.select("id", "title", F.unix_micros("updated_at").alias("updated_us"))


@query("session_topics", """
SELECT user_id AS chat_id, event_type AS topic, count(*) AS query_count, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1, 2""")
def session_topics(t):
    turns = t.events.select(
        F.col("user_id").alias("chat_id"), F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("last_used")
    )
    return CH.session_topics(turns).select("chat_id", "topic", "query_count", F.unix_micros("last_used").alias("last_us"))


def lines(t):
    """Every message as token lines: words, a finish line, and damaged or foreign lines in between."""
    c = t.conversations
    words = F.split("text", " ")
    good = c.select("conv_id", "turn", F.posexplode(words).alias("seq", "w")).select(
        "conv_id", "turn", "seq", F.concat(F.lit("data: "), F.to_json(F.struct(F.concat("w", F.lit(" ")).alias("token")))).alias(
            "value")
    )
    done = c.select("conv_id", "turn", F.size(words).alias("seq"), F.lit('data: {"done": true}').alias("value"))
    bad = c.filter(F.col("turn") % 3 == 1).select(
        "conv_id", "turn", F.lit(-1).alias("seq"), F.lit('data: {"token": "cut').alias("value")
    )
    other = c.filter(F.col("turn") % 2 == 0).select(
        "conv_id", "turn", F.lit(-2).alias("seq"), F.lit(": keep-alive").alias("value")
    )
    return good.unionByName(done).unionByName(bad).unionByName(other)


@query("event_lines", """
SELECT sum(len(string_split(text, ' ')))::BIGINT AS n_tokens, count(*) AS n_done, count(*) FILTER (turn % 3 = 1) AS n_quarantined,
  sum(length(text) + 1)::BIGINT AS n_chars FROM conversations""")
def event_lines(t):
    parsed = ST.event_lines(lines(t))
    return parsed.agg(
        F.count("token").alias("n_tokens"), F.count_if("done").alias("n_done"),
        F.count_if(~F.col("is_valid")).alias("n_quarantined"), F.sum(F.length("token")).alias("n_chars"),
    )


def tokens(t):
    parsed = ST.event_lines(lines(t)).filter("is_valid")
    return parsed.select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("reply_id"), F.col("seq").cast("bigint").alias("seq"),
        F.when(F.col("done"), "finish").otherwise("token").alias("kind"), "token",
    )


@query("assemble_tokens", f"""
SELECT conv_id AS chat_id, turn AS reply_id, 'finish' AS finish_reason, {B.s_strip('text')} AS content FROM conversations""")
def assemble_tokens(t):
    return TK.assemble(tokens(t)).select("chat_id", "reply_id", "finish_reason", "content")
