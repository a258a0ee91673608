"""Adding items: the summary of each depends on how full its session already is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.functions.hooks import Hook, default_embedder, default_summarizer, default_tokenizer
from engram.functions.text import compression_ratio, truncate_summary
from engram.operators.spread import salts_for
from engram.policy import POLICY, model_limits
from engram.sources.shared import settled


def _utilization(tokens, context_length: int):
    return tokens / F.lit(context_length) * 100


def trigger_points(
    sized: DataFrame, context_length: int, trigger: float, prior: DataFrame | None = None, salts: int | None = None
) -> DataFrame:
    """(session_id, base, crossed_at, crossed_id): the item that lifts a session over the trigger.

    ``sized`` has (session_id, arrived_at, id, size), the sizes stored as long
    as the session is below the trigger; ``prior`` has (session_id, used).
    Items with no size cannot cross. Behind the crossing item the running total
    of any salt that already passed the trigger decides nothing, so only the
    leading items of each salt reach the total of the whole session.
    """
    def over(x):
        return _utilization(x, context_length) > trigger * 100

    positive = sized.where(F.col("size") > 0)
    if prior is None:
        based = positive.withColumn("base", F.lit(0).cast("bigint"))
    else:
        used = prior.select("session_id", F.col("used").alias("base"))
        based = positive.join(used, "session_id", "left").na.fill(0, ["base"])
    order = [F.asc("arrived_at"), F.asc("id")]
    salted = W.partitionBy("session_id", F.pmod(F.xxhash64("id"), F.lit(salts or salts_for(sized)))).orderBy(*order)
    before = F.coalesce(F.sum("size").over(salted.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    leading = based.withColumn("_before", before).where(~over(F.col("base") + F.col("_before")))
    whole = W.partitionBy("session_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = leading.withColumn("_running", F.col("base") + F.sum("size").over(whole))
    return (
        running.where(over(F.col("_running")))
        .groupBy("session_id")
        .agg(F.min(F.struct("arrived_at", "id")).alias("crossed"))
    )


def ingest_items(
    new_items: DataFrame,
    model: str,
    prior: DataFrame | None = None,
    auto_compress: bool = True,
    tokenizer: Hook = default_tokenizer,
    summarizer: Hook = default_summarizer,
    embedder: Hook = default_embedder,
    salts: int | None = None,
) -> DataFrame:
    """New items with sizes, summary and vector, in arrival order per session.

    ``new_items`` has (id, session_id, arrived_at, full_content) and any other
    columns. An item is compressed if its session was over the trigger before
    it (and ``auto_compress``), or if it is longer than 2000 tokens; else its
    summary is its first 500 characters. Stored sizes never shrink a session's
    total, so a session over the trigger stays over: one crossing item per
    session decides for all items after it. The crossing items are written out
    first, so that where they are few the texts are not shuffled. Summaries of
    long texts, needed to find them, are written out with the items, so that a
    text is summarized once.
    """
    limits = model_limits(model)
    text = F.col("full_content")
    counted = new_items.withColumn("token_count", tokenizer(text))
    is_long = F.col("token_count") > POLICY.always_compress_above
    counted = counted.withColumn("_long_summary", F.when(is_long, summarizer(F.when(is_long, text))))
    if summarizer is not default_summarizer:
        counted = settled(counted, "summaries")
    if auto_compress:
        below = F.when(is_long, F.col("_long_summary")).otherwise(truncate_summary(text))
        sized = counted.select("session_id", "arrived_at", "id", tokenizer(below).alias("size"))
        points = trigger_points(sized, limits.context_length, limits.compression_trigger, prior, salts)
        marked = counted.join(settled(points, "trigger-points"), "session_id", "left")
        over = F.coalesce(F.struct("arrived_at", "id") > F.col("crossed"), F.lit(False))
        if prior is not None:
            full = prior.where(
                _utilization(F.col("used"), limits.context_length) > limits.compression_trigger * 100
            ).select("session_id", F.lit(True).alias("_full"))
            marked = marked.join(full, "session_id", "left")
            over = over | F.coalesce(F.col("_full"), F.lit(False))
        marked = marked.withColumn("over_trigger", over).drop("crossed", "_full")
    else:
        marked = counted.withColumn("over_trigger", F.lit(False))
    compress = F.col("over_trigger") | is_long
    late = F.col("over_trigger") & ~is_long
    summary = F.when(is_long, F.col("_long_summary")).when(late, summarizer(F.when(late, text))).otherwise(truncate_summary(text))
    return (
        marked.withColumn("was_compressed", compress)
        .withColumn("compressed_summary", summary)
        .withColumn("compressed_token_count", tokenizer(F.col("compressed_summary")))
        .withColumn(
            "compression_ratio", compression_ratio(F.col("compressed_token_count"), F.col("token_count"))
        )
        .withColumn("embedding", embedder(F.col("compressed_summary")))
        .drop("_long_summary")
    )
