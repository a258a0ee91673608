"""Windowed roll-ups of append-only streams.

Timestamps without zone are read as UTC: run with spark.sql.session.timeZone=UTC.
Rows later than the watermark delay are dropped; a window is emitted once, when
the watermark has passed its end. What is open at the end of input is had by
``still_open``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.functions.values import token_cost
from engram.operators.aggregates import with_model_limits

DELAY = "1 hour"
SKETCH_BITS = 14


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def usage_by_window(
    log: DataFrame, window: str = "1 hour", delay: str = DELAY, models: DataFrame | None = None
) -> DataFrame:
    """Tokens and cost per session and tumbling window."""
    priced, _ = with_model_limits(event_time(log, "ts", delay), models)
    cost = token_cost(
        F.col("input_tokens"), F.col("output_tokens"), F.col("cost_per_1k_input"), F.col("cost_per_1k_output")
    )
    return (
        priced.groupBy(F.window("ts", window).alias("w"), "session_id")
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(cost).alias("total_cost"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "session_id",
            "input_tokens",
            "output_tokens",
            "total_cost",
            "n_events",
        )
    )


def daily_conversation_stats(conversations: DataFrame, delay: str = DELAY, error: float = 0.05) -> DataFrame:
    """Count, mean importance and approximate distinct users per day."""
    return (
        event_time(conversations, "created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_conversations"),
            F.avg("importance_score").alias("avg_importance"),
            F.approx_count_distinct("user_id", error).alias("unique_users"),
        )
        .select(
            F.to_date("w.start").alias("date"), "total_conversations", "avg_importance", "unique_users",
            F.col("w.end").alias("window_end"),
        )
    )


def daily_user_sketches(conversations: DataFrame, delay: str = DELAY, log_k: int = SKETCH_BITS) -> DataFrame:
    """(date, users, window_end): a sketch of each day's users, of a stream or a table; sketches of parts can be united."""
    days = event_time(conversations, "created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"))
    sketch = F.hll_sketch_agg("user_id", F.lit(log_k)).alias("users")
    return days.agg(sketch).select(F.to_date("w.start").alias("date"), "users", F.col("w.end").alias("window_end"))


def distinct_users(sketches: DataFrame, unit: str = "week") -> DataFrame:
    """(start, users): distinct users of each week, month, ... out of daily sketches, wherever they were made.

    Rows without a user do not count. The estimate is within about
    ``1.04 / sqrt(2 ** SKETCH_BITS)`` of the count (one standard error), whatever
    the number of days.
    """
    start = F.to_date(F.date_trunc(unit, "date")).alias("start")
    return sketches.groupBy(start).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def still_open(df: DataFrame, query: StreamingQuery, window_end: str) -> DataFrame:
    """The end-of-input step: of the same roll-up over the table, the windows a finished stream has not emitted.

    A stream appends the windows up to the watermark of its last batch, and
    takes every row of those that end later, late ones too: together with these
    they are all windows once. The watermark is read from the query's progress.
    """
    progress = query.lastProgress
    watermark = (progress["eventTime"] or {}).get("watermark") if progress else None
    return df if watermark is None else df.where(F.col(window_end) > F.lit(watermark).cast("timestamp"))
