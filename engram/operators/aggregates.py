"""Counts, roll-ups and reports. All aggregates combine before the shuffle."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.functions.values import counters_json, iso_timestamp, ntz, range_start, token_cost
from engram.operators.filters import by_topics, newest, overlaps
from engram.operators.ranking import important_conversations, latest_successful_training
from engram.policy import POLICY, models_table

# The counters every session starts with.
COUNTERS = ["compressions", "decompressions", "cache_hits"]


def count_conversations(conversations: DataFrame, user_id: str | None = None) -> DataFrame:
    found = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    return found.agg(F.count("conversation_id").alias("n_conversations"))


def count_by_user(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("user_id").agg(F.count("conversation_id").alias("n_conversations"))


def conversation_stats(conversations: DataFrame) -> DataFrame:
    return (
        conversations.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_conversations"),
            F.avg("importance_score").alias("avg_importance"),
            F.countDistinct("user_id").alias("unique_users"),
        )
        .orderBy(F.desc("date"))
    )


def with_model_limits(df: DataFrame, models: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the limits and prices of their ``model``, rows of an unknown model).

    The built-in model list is a fixed table of a dozen rows, so it is broadcast;
    a list of the caller is joined by its size.
    """
    models = F.broadcast(models_table(df.sparkSession)) if models is None else models
    joined = df.join(models, "model", "left")
    unknown = F.col("context_length").isNull()
    return joined.where(~unknown), joined.where(unknown).select(df.columns)


def session_state(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: active totals, and context used, left and utilized.

    ``sessions`` has (session_id, model). Used context is the sum of the
    compressed sizes; what is left may be negative. A session without active
    items has zeros. The active items themselves are ``ranking.ranked_items``.
    """
    active = F.col("is_active")
    totals = items.groupBy("session_id").agg(
        F.sum(F.when(active, F.col("token_count")).otherwise(0)).alias("active_tokens"),
        F.sum(F.when(active, F.col("compressed_token_count")).otherwise(0)).alias("used_context_length"),
        F.count_if(active).alias("active_count"),
    )
    known, _ = with_model_limits(sessions)
    used = F.col("used_context_length")
    return (
        known.join(totals, "session_id", "left")
        .na.fill(0, ["active_tokens", "used_context_length", "active_count"])
        .select(
            "session_id",
            F.col("model").alias("model_name"),
            F.col("context_length").alias("total_context_length"),
            used,
            (F.col("context_length") - used).alias("available_context_length"),
            (used / F.col("context_length") * 100).alias("context_utilization_percentage"),
            "active_tokens",
            "active_count",
        )
    )


def summarize_conversations(
    conversations: DataFrame,
    as_of: datetime,
    time_range: str = "all",
    topics: Sequence[str] | None = None,
    user_id: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row: count, mean importance, ten most frequent topics, first five summaries.

    All filters that are given apply. The strict form with ``topics`` is a report
    on the 100 most important matches: it takes these first and only then the
    user, and does not use the time range.
    """
    start = range_start(time_range, as_of)
    in_range = F.col("created_at").between(ntz(start), ntz(as_of))
    order = [newest("created_at"), F.asc("conversation_id")]
    if topics and strict:
        found = by_topics(conversations, topics, 100)
        order = [newest("importance_score"), F.asc("conversation_id")]
    elif topics:
        found = conversations.where(overlaps("topics", topics) & in_range)
    else:
        found = conversations.where(in_range)
    if user_id is not None:
        found = found.where(F.col("user_id") == user_id)

    count_type, none = "bigint", F.lit(None)
    topic_row = "struct<n:bigint,topic:string>"
    stats = found.agg(
        F.count(F.lit(1)).alias("total_conversations"), F.avg("importance_score").alias("average_importance")
    ).select(
        "*",
        none.cast(topic_row).alias("topic_row"),
        none.cast("int").alias("place"),
        none.cast("string").alias("first_summary"),
    )
    frequent = (
        found.select(F.explode("topics").alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("topic"))
        .limit(10)
        .select(
            none.cast(count_type).alias("total_conversations"),
            none.cast("double").alias("average_importance"),
            F.struct("n", "topic").cast(topic_row).alias("topic_row"),
            none.cast("int").alias("place"),
            none.cast("string").alias("first_summary"),
        )
    )
    # Five rows, numbered in one task.
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    summaries = found.orderBy(*order).limit(5).select(
        none.cast(count_type).alias("total_conversations"),
        none.cast("double").alias("average_importance"),
        none.cast(topic_row).alias("topic_row"),
        place.alias("place"),
        F.col("summary").alias("first_summary"),
    )
    rows = stats.unionByName(frequent).unionByName(summaries)
    most_first = F.array_sort(
        F.collect_list("topic_row"),
        lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1))
        .when(a["topic"] < b["topic"], -1)
        .when(a["topic"] > b["topic"], 1)
        .otherwise(0),
    )
    placed = F.array_sort(
        F.collect_list(F.when(F.length("first_summary") > 0, F.struct("place", "first_summary")))
    )
    return rows.agg(
        F.max("total_conversations").alias("total_conversations"),
        F.coalesce(F.max("average_importance"), F.lit(0.0)).alias("average_importance"),
        most_first.alias("top_topics"),
        F.transform(placed, lambda s: s["first_summary"]).alias("recent_summaries"),
    ).select(
        F.lit(time_range).alias("time_range"),
        iso_timestamp(ntz(start)).alias("start_date"),
        iso_timestamp(ntz(as_of)).alias("end_date"),
        "*",
    )


def token_usage(log: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Token totals and cost per session; events of unknown models are not priced here."""
    priced, _ = with_model_limits(log, models)
    cost = token_cost(
        F.col("input_tokens"), F.col("output_tokens"), F.col("cost_per_1k_input"), F.col("cost_per_1k_output")
    )
    return priced.groupBy("session_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(cost).alias("total_cost"),
    )


def access_metrics(access_log: DataFrame) -> DataFrame:
    """Access log as counter increments: full reads and summary reads."""
    name = F.when(F.col("decompress"), "decompressions").otherwise("cache_hits")
    return access_log.select("session_id", name.alias("metric"), F.lit(1).alias("increment"))


def metric_counts(increments: DataFrame) -> DataFrame:
    """(session_id, metric, n); an unseen metric name starts at 0."""
    return increments.groupBy("session_id", "metric").agg(F.sum("increment").alias("n"))


def performance_metrics(increments: DataFrame) -> DataFrame:
    """Per session a JSON object of all its counters; the three standard ones are always there."""
    starting = F.array(*[F.lit(c) for c in COUNTERS])
    starts = (
        increments.select("session_id")
        .distinct()
        .select("session_id", F.explode(starting).alias("metric"), F.lit(0).alias("increment"))
    )
    counts = metric_counts(increments.select("session_id", "metric", "increment").unionByName(starts))
    pairs = F.array_sort(F.collect_list(F.struct("metric", "n")))
    return counts.groupBy("session_id").agg(pairs.alias("pairs")).select(
        "session_id",
        counters_json(F.col("pairs.metric"), F.col("pairs.n")).alias("performance_metrics"),
    )


def recent_entry_stats(
    entries: DataFrame, contexts: DataFrame, max_size: int = POLICY.ring_size
) -> DataFrame:
    """One row over the ring entries (timestamp) and the per-user contexts (user_id, last_updated)."""
    none = F.lit(None)
    counted = entries.agg(
        F.count(F.lit(1)).alias("num_conversations"), F.max("timestamp").alias("last_updated")
    ).select("num_conversations", none.cast("bigint").alias("num_users"), "last_updated")
    users = contexts.agg(
        F.countDistinct("user_id").alias("num_users"), F.max("last_updated").alias("last_updated")
    ).select(none.cast("bigint").alias("num_conversations"), "num_users", "last_updated")
    return counted.unionByName(users).agg(
        F.max("num_conversations").alias("num_conversations"),
        F.lit(max_size).alias("max_size"),
        F.max("num_users").alias("num_users"),
        F.max("last_updated").alias("last_updated"),
    )


def training_needed(
    conversations: DataFrame, history: DataFrame, as_of: datetime, force: bool = False
) -> DataFrame:
    """One row: enough important conversations, or long enough since the last success, or forced."""
    none = F.lit(None)
    counts = ~F.col("is_archived") & (F.col("importance_score") >= POLICY.retrain_importance)
    important = conversations.agg(F.count_if(counts).alias("n_important")).select(
        "n_important", none.cast("timestamp_ntz").alias("last_success")
    )
    last = latest_successful_training(history).select(
        none.cast("bigint").alias("n_important"), F.col("completed_at").alias("last_success")
    )
    both = important.unionByName(last).agg(
        F.max("n_important").alias("n_important"), F.max("last_success").alias("last_success")
    )
    now = ntz(as_of).cast("timestamp")
    seconds = F.unix_micros(now) - F.unix_micros(F.col("last_success").cast("timestamp"))
    hours = F.coalesce(seconds / F.lit(3_600_000_000.0), F.lit(float("inf")))
    return both.select("n_important", hours.alias("hours_since")).select(
        "*",
        (
            F.lit(force)
            | (F.col("n_important") >= POLICY.retrain_conversations)
            | (F.col("hours_since") >= POLICY.retrain_hours)
        ).alias("should_train"),
    )


def compression_report(items: DataFrame, by: Sequence[str] = ("session_id", "content_type")) -> DataFrame:
    """Full over compressed tokens per group; null where nothing is stored."""
    return items.groupBy(*by).agg(
        F.sum("token_count").alias("total_tokens"),
        F.sum("compressed_token_count").alias("compressed_tokens"),
        (F.sum("token_count") / F.nullif(F.sum("compressed_token_count"), F.lit(0))).alias("ratio"),
    )
