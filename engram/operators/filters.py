"""Lookups and filters. Filtered results come newest or best first, id last."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import contains_pattern
from engram.functions.values import ntz


def newest(column: str) -> Column:
    return F.desc_nulls_first(column)


def oldest(column: str) -> Column:
    return F.asc_nulls_last(column)


def overlaps(column: str, wanted: Sequence[str]) -> Column:
    """True where the array shares an element with ``wanted``; never null."""
    values = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(F.col(column), values), F.lit(False))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among the keys; key payload columns are added.

    The keys are joined by size: Spark broadcasts them only below its own limit.
    They may repeat: each is passed on once, so a hot key meets one row.
    """
    if keys.columns == [key]:
        return df.join(keys.distinct(), key, "left_semi")
    return df.join(keys, key)


def facts_of(facts: DataFrame, conversations: DataFrame) -> DataFrame:
    return facts.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi")


def by_date_range(conversations: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return conversations.where(F.col("created_at").between(ntz(start), ntz(end))).orderBy(
        newest("created_at"), "conversation_id"
    )


def by_topics(conversations: DataFrame, topics: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Archived rows are included."""
    found = conversations.where(overlaps("topics", topics)).orderBy(newest("importance_score"), "conversation_id")
    return found if limit is None else found.limit(limit)


def facts_by_tags(facts: DataFrame, tags: Sequence[str], limit: int | None = 10) -> DataFrame:
    found = facts.where(overlaps("tags", tags)).orderBy(newest("confidence"), "fact_id")
    return found if limit is None else found.limit(limit)


def facts_by_text(facts: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    found = facts.where(contains_pattern(F.col("fact"), query)).orderBy(newest("confidence"), "fact_id")
    return found if limit is None else found.limit(limit)


def searchable_items(
    items: DataFrame, sessions: DataFrame | None = None, content_types: Sequence[str] | None = None
) -> DataFrame:
    """Active items, of the given sessions and content types; none given means all."""
    found = items.where(F.col("is_active"))
    if content_types:
        found = found.where(F.col("content_type").isin(list(content_types)))
    return found if sessions is None else lookup(found, sessions.select("session_id"), "session_id")


def trusted_facts(facts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return facts.where(F.col("embedding").isNotNull() & (F.col("confidence") >= min_confidence))


def tasks_by_status(tasks: DataFrame, status: str | None = None) -> DataFrame:
    found = tasks if status is None else tasks.where(F.col("status") == status)
    return found.orderBy("session_id", newest("priority"), newest("created_at"), "id")


def agents_by_type(agents: DataFrame, agent_type: str | None = None) -> DataFrame:
    found = agents.where(F.col("is_active"))
    return found if agent_type is None else found.where(F.col("agent_type") == agent_type)


def active_quarantine(quarantine: DataFrame) -> DataFrame:
    return quarantine.where(F.col("is_active")).orderBy("session_id", newest("created_at"), "id")


def pending_hil(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("status") == "pending").orderBy(
        "session_id", newest("priority"), oldest("created_at"), "id"
    )
