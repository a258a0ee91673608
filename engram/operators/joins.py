"""Joins on the keys that link the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversation_facts(conversations: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Conversations with their facts (1:N); ``how`` is inner or left.

    A conversation with very many facts is a skewed key: adaptive execution
    splits its partition, the conversation row being repeated per split.
    """
    return conversations.join(facts, "conversation_id", how)


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Children whose parent is not deleted; a child without parent stays. Keys may repeat."""
    return children.join(deleted.select(F.col(key)).distinct(), key, "left_anti")


def session_overview(
    sessions: DataFrame, items: DataFrame, tasks: DataFrame, agents: DataFrame, quarantined: DataFrame
) -> DataFrame:
    """Per session the number of active items, tasks, active agents and quarantined contexts.

    Each child table is reduced to one row per session before it is joined.
    """
    children = [
        ("active_items", items.where(F.col("is_active"))),
        ("tasks", tasks),
        ("agents", agents.where(F.col("is_active"))),
        ("quarantined", quarantined.where(F.col("is_active"))),
    ]
    overview = sessions
    for name, child in children:
        counts = child.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
        overview = overview.join(counts, "session_id", "left")
    return overview.na.fill(0, [name for name, _ in children])
