"""Logs folded onto the rows they change."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_given(value: Column, order: Column, given: Column | None = None) -> Column:
    """The last value in log order among the entries that give one."""
    there = value.isNotNull() if given is None else given
    return F.max_by(value, F.when(there, order))


def task_changes(updates: DataFrame, order: Sequence[str], key: Sequence[str] = ("id", "session_id")) -> DataFrame:
    """Per task what its update log amounts to; null means never given.

    ``updates`` has the key, status, progress, metadata and ts. An empty JSON
    object as metadata counts as not given. Each field is its own aggregate, so
    a task with very many updates still combines before the shuffle.
    """
    at = F.col("_at")
    completed = F.col("status") == "completed"
    metadata_given = F.col("metadata").isNotNull() & (F.col("metadata") != "{}")
    any_given = F.col("status").isNotNull() | F.col("progress").isNotNull() | metadata_given
    logged = updates.select(*key, "status", "progress", "metadata", "ts", F.struct(*order).alias("_at"))
    return logged.groupBy(*key).agg(
        latest_given(F.col("status"), at).alias("new_status"),
        latest_given(F.col("progress"), at).alias("new_progress"),
        latest_given(F.col("metadata"), at, metadata_given).alias("new_metadata"),
        latest_given(F.col("ts"), at, completed).alias("new_completed_at"),
        latest_given(F.col("ts"), at, any_given).alias("new_updated_at"),
    )


def task_current(
    tasks: DataFrame, updates: DataFrame, order: Sequence[str], key: Sequence[str] = ("id", "session_id")
) -> tuple[DataFrame, DataFrame]:
    """(tasks after their updates, changes of unknown tasks).

    An update that names another session than the task's is one of an unknown task.
    """
    changes = task_changes(updates, order, key)
    fields = ["status", "progress", "metadata", "completed_at", "updated_at"]
    joined = tasks.join(changes, list(key), "left")
    current = joined.select(
        *[
            F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in tasks.columns
        ]
    )
    return current, changes.join(tasks.select(*key), list(key), "left_anti")


def access_fold(items: DataFrame, access_log: DataFrame) -> DataFrame:
    """Items with their reads counted and the time of the last one.

    Reads naming the wrong session are ignored. The log is reduced to one row
    per item before it meets the items.
    """
    reads = access_log.groupBy(F.col("item_id").alias("id"), "session_id").agg(
        F.count(F.lit(1)).alias("_reads"), F.max("ts").alias("_last")
    )
    folded: Mapping[str, Column] = {
        "access_count": F.col("access_count") + F.coalesce(F.col("_reads"), F.lit(0)),
        "last_accessed": F.greatest("last_accessed", "_last"),
    }
    return items.join(reads, ["id", "session_id"], "left").select(
        *[folded[c].alias(c) if c in folded else F.col(c) for c in items.columns]
    )


def retrieve_items(items: DataFrame, requests: DataFrame, decompress: bool = True) -> DataFrame:
    """Requested items (id, session_id) as full text or summary."""
    text = F.col("full_content") if decompress else F.col("compressed_summary")
    return items.join(requests.select("id", "session_id").distinct(), ["id", "session_id"]).select(
        "id", "session_id", "content_type", text.alias("content")
    )
