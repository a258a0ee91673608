"""Conversation rows out of turns or stored content."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import importance_from, parse_messages, summary_from
from engram.policy import ASKED_CHARS


def build_conversations(turns: DataFrame, part_turns: int | None = None) -> DataFrame:
    """Ordered messages per conversation: (conversation_id, part, messages).

    ``turns`` has (conversation_id, turn, role, text), turns counted from 0 and
    unique in a conversation. A conversation is one row, as the stored table has
    it, whatever its length. With ``part_turns`` its messages are cut into parts
    of so many turns: part k begins with turn k * part_turns. What holds for a
    whole conversation comes from ``conversation_headers``, without its messages.
    """
    message = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    return (
        turns.withColumn("part", F.lit(0) if part_turns is None else F.floor(F.col("turn") / part_turns).cast("int"))
        .groupBy("conversation_id", "part")
        .agg(F.array_sort(F.collect_list(message)).alias("ordered"))
        .select(
            "conversation_id",
            "part",
            F.transform(
                "ordered", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
            ).alias("messages"),
        )
    )


def conversation_headers(turns: DataFrame, tool_turn: Column) -> DataFrame:
    """Per conversation: message count, importance and summary, without the messages.

    ``tool_turn`` marks turns that count as tool use. All aggregates combine
    before the shuffle, whatever the length of a conversation.
    """
    is_user = F.col("role") == "user"
    return (
        turns.groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.bool_or(tool_turn).alias("has_tool_calls"),
            F.bool_or(is_user).alias("has_user"),
            F.min_by(F.when(is_user, F.substring(F.col("text"), 1, ASKED_CHARS)), F.when(is_user, F.col("turn"))).alias(
                "first_user_text"
            ),
        )
        .select(
            "conversation_id",
            "n_messages",
            importance_from(F.col("n_messages"), F.col("has_tool_calls")).alias("importance_score"),
            summary_from(F.col("first_user_text"), F.col("has_user")).alias("summary"),
        )
    )


def parsed_messages(df: DataFrame, key: str, content: str, first: Column | None = None) -> DataFrame:
    """One row per message of a stored content: (key, position, role, content).

    ``first`` is the position of a content's first message, for contents that
    are parts of a conversation; without it positions count from 0.
    """
    begin = (F.lit(0) if first is None else first).cast("int").alias("_first")
    exploded = df.select(key, begin, F.posexplode(parse_messages(F.col(content))).alias("_place", "message"))
    return exploded.select(
        key,
        (F.col("_first") + F.col("_place")).alias("position"),
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
    )
