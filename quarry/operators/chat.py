"""Chats and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.ordering import with_successor

TURNS_PER_BUCKET = 1024


def recent_chats(chats: DataFrame, limit: int = 10) -> DataFrame:
    return chats.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def chat_messages(messages: DataFrame, chat: Column | int) -> DataFrame:
    return messages.filter(F.col("chat_id") == chat).orderBy("created_at", "id")


def last_message(messages: DataFrame) -> DataFrame:
    """Latest row per chat; constant-size aggregate, so long chats need no sort."""
    latest = F.max_by(F.struct("id", "role", "content"), F.struct("created_at", "id"))
    return messages.groupBy("chat_id").agg(latest.alias("m"), F.count("*").alias("n_messages")).select(
        "chat_id", "n_messages", "m.*"
    )


def question_answer_pairs(turns: DataFrame) -> DataFrame:
    """A user turn directly followed by an assistant turn: conv_id, turn, question, answer."""
    bucket = F.floor(F.col("turn") / TURNS_PER_BUCKET)
    paired = with_successor(turns, ["conv_id"], ["turn"], bucket, ["role", "text"])
    return paired.filter((F.col("role") == "user") & (F.col("successor.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("successor.text").alias("answer")
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    """Add ``problem``: null for a good row, else the first rule it breaks."""
    problem = (
        F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "role")
        .when(F.coalesce(F.length("content"), F.lit(0)) < 1, "content")
    )
    return messages.withColumn("problem", problem)


def validate_chats(chats: DataFrame) -> DataFrame:
    length = F.coalesce(F.length("title"), F.lit(0))
    problem = (
        F.when((length < 1) | (length > 255), "title")
        .when(~F.coalesce(F.col("status").isin("idle", "generating"), F.lit(False)), "status")
    )
    return chats.withColumn("problem", problem)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    return checked.filter("problem IS NULL").drop("problem"), checked.filter("problem IS NOT NULL")


def extracted_memories(messages: DataFrame) -> DataFrame:
    """One row per fact found in memory tags."""
    return messages.select("*", F.posexplode(T.memory_tags(F.col("content"))).alias("fact_index", "fact"))


def apply_commands(chats: DataFrame, commands: DataFrame) -> DataFrame:
    """Fold a batch of chat commands: create, update (bumps updated_at), delete.

    ``commands``: seq, op, id, title, status, at.  Later commands win; an update
    keeps the fields it does not name; a delete removes what came before it.
    """
    base = chats.select(
        F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("op"), "id", "title", "status",
        F.col("updated_at").alias("at"), "created_at",
    )
    log = base.unionByName(commands.withColumn("created_at", F.when(F.col("op") == "create", F.col("at"))))
    seq = F.col("seq")
    state = log.groupBy("id").agg(
        F.max(F.when(F.col("op") == "delete", seq)).alias("deleted"),
        F.max(F.when(F.col("op") == "create", seq)).alias("created"),
        F.max_by("title", F.when(F.col("title").isNotNull() & (F.col("op") != "delete"), seq)).alias("title"),
        F.max_by("status", F.when(F.col("status").isNotNull() & (F.col("op") != "delete"), seq)).alias("status"),
        F.max_by("created_at", F.when(F.col("created_at").isNotNull(), seq)).alias("created_at"),
        F.max_by("at", F.when(F.col("op") != "delete", seq)).alias("updated_at"),
    )
    alive = F.col("created").isNotNull() & (F.col("created") > F.coalesce("deleted", F.lit(-2)))
    return state.filter(alive).select("id", "title", "status", "created_at", "updated_at")


def cascade_delete(
    chats: DataFrame, messages: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove chats and the messages that belong to them; ``deleted``: id."""
    return (
        chats.join(deleted.select("id"), "id", "left_anti"),
        messages.join(deleted.select(F.col("id").alias("chat_id")), "chat_id", "left_anti"),
    )


def session_topics(turns: DataFrame) -> DataFrame:
    """Queries per chat and topic with the time of the last one."""
    return turns.groupBy("chat_id", "topic").agg(
        F.count("*").alias("query_count"), F.max("last_used").alias("last_used")
    )
