"""Sorted lists, limits and positions inside a group.

Nulls come first in descending and last in ascending order, and every order
ends in the id.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.functions.values import iso_timestamp
from engram.operators.filters import newest, oldest
from engram.policy import POLICY
from engram.sources.shared import settled

# What the orders of the ranked lists look at.
ORDER_COLUMNS = ["priority", "last_accessed", "created_at"]
SERVING = ["conversation_id", "summary", "topics", "importance_score", "created_at"]


def recent_conversations(conversations: DataFrame, limit: int = 10, user_id: str | None = None) -> DataFrame:
    found = conversations.where(~F.col("is_archived"))
    if user_id is not None:
        found = found.where(F.col("user_id") == user_id)
    return found.orderBy(newest("created_at"), "conversation_id").limit(limit)


def important_conversations(conversations: DataFrame, threshold: float = 0.7, limit: int = 100) -> DataFrame:
    return (
        conversations.where((F.col("importance_score") >= threshold) & ~F.col("is_archived"))
        .orderBy(newest("created_at"), "conversation_id")
        .limit(limit)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group with their ``position``.

    Spark cuts each input partition to n rows per group before the shuffle, so
    a hot group arrives as at most n rows per partition.
    """
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", position).where(F.col("position") <= n)


def positions(keys: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every row of ``keys`` with its ``position`` in its group, by a sample sort.

    Rows are dealt out in ranges of the whole order (group, then ``order``)
    with sampled bounds, so a hot group, a hot priority or a hot moment is
    cut wherever its rows need it, and each task numbers its own range. Ranges
    are then told apart by their row counts: a position is the rows of the
    group in earlier ranges and the place in the own one. ``order`` should end
    in a key. The numbered rows are written out once, so ``keys`` should carry
    keys and not bodies; callers join those afterwards.
    """
    ranged = [*[F.asc_nulls_first(g) for g in group], *order]
    sorted_rows = keys.repartitionByRange(*ranged).sortWithinPartitions(*ranged)
    # Partition above, row in the partition in the lower 33 bits.
    numbered = settled(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "sorted-keys")
    numbered = numbered.withColumn("_range", F.shiftright("_place", 33))
    parts = numbered.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # At most one row per range for a group that goes over several.
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        F.col("_range").alias("_r"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(starts, same).select(
        *keys.columns, (F.col("_place") + F.col("_shift") + 1).cast("bigint").alias("position")
    )


def ranked(df: DataFrame, order: Sequence[str | Column], group: str = "session_id", key: str = "id") -> DataFrame:
    """All columns of ``df`` and the ``position``: keys and order columns are numbered, the rest is joined by ``key``.

    ``key`` is the table's key. Where the rows have nothing else than what the
    order needs, nothing is joined.
    """
    used = [group, key, *[c for c in ORDER_COLUMNS if c in df.columns and c not in (group, key)]]
    placed = positions(df.select(*used), [group], order)
    if set(df.columns) <= set(used):
        return placed.select(*df.columns, "position")
    return df.join(placed.select(key, "position"), key).select(*df.columns, "position")


def item_order() -> list[Column]:
    """Priority, then last access, highest and newest first."""
    return [newest("priority"), newest("last_accessed"), F.asc("id")]


def task_order() -> list[Column]:
    return [newest("priority"), newest("created_at"), F.asc("id")]


def hil_order() -> list[Column]:
    """Highest priority first, oldest first in it."""
    return [newest("priority"), oldest("created_at"), F.asc("id")]


def ranked_items(items: DataFrame) -> DataFrame:
    """Active items of each session with their position by priority, then last access."""
    return ranked(items.where(F.col("is_active")), item_order())


def ranked_tasks(tasks: DataFrame) -> DataFrame:
    return ranked(tasks, task_order())


def ranked_hil(interactions: DataFrame) -> DataFrame:
    """Pending requests of each session with their position."""
    return ranked(interactions.where(F.col("status") == "pending"), hil_order())


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest order values per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_latest")
    return df.groupBy(*key).agg(latest).select(*key, *[F.col(f"_latest.{c}").alias(c) for c in rest])


def latest_state(states: DataFrame) -> DataFrame:
    """The newest row of each session; of equally new ones the greatest by its other columns."""
    rest = [c for c in states.columns if c not in ("session_id", "updated_at")]
    return latest_per_key(states, ["session_id"], [F.col("updated_at"), F.to_json(F.struct(*rest))])


def recent_trainings(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.orderBy(newest("started_at"), "training_id").limit(limit)


def latest_successful_training(history: DataFrame) -> DataFrame:
    return (
        history.where(F.col("status") == "completed").orderBy(newest("completed_at"), "training_id").limit(1)
    )


def last_n_per_user(conversations: DataFrame, n: int = POLICY.ring_size) -> DataFrame:
    return top_per_group(conversations, ["user_id"], [newest("created_at"), F.asc("conversation_id")], n)


def last_n(conversations: DataFrame, n: int = POLICY.ring_size) -> DataFrame:
    return conversations.orderBy(newest("created_at"), "conversation_id").limit(n)


def serving(conversations: DataFrame) -> DataFrame:
    """The columns handed to a caller: no vector, time as ISO text."""
    return conversations.select(
        *SERVING[:-1], iso_timestamp(F.col("created_at")).alias("created_at")
    )


def recent_context(conversations: DataFrame, num_recent: int = 3, user_id: str | None = None) -> DataFrame:
    return serving(recent_conversations(conversations, num_recent, user_id))
