"""What fits in a token budget: per session over items, per text over chunks."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engram.functions.hooks import Hook, default_embedder, embed_text
from engram.functions.text import chunk_text, estimate_tokens, retrieval_hint
from engram.functions.vectors import once
from engram.operators.ranking import item_order
from engram.operators.search import score_chunks
from engram.operators.spread import salts_for
from engram.policy import CHUNK_SEPARATOR, POLICY
from engram.sources.shared import settled

FULL, COMPRESSED = "full", "compressed"


def _with_budget(items: DataFrame, budget: int | DataFrame) -> DataFrame:
    if isinstance(budget, DataFrame):
        return items.join(budget.select("session_id", F.col("max_tokens").cast("bigint")), "session_id")
    return items.withColumn("max_tokens", F.lit(budget).cast("bigint"))


def packing_candidates(items: DataFrame, budget: int | DataFrame, salts: int | None = None) -> DataFrame:
    """The active items that the packing of their session can depend on, numbers only.

    What is left of a budget only shrinks, so among items of one smallest size v
    those taken are the first ones in order, and at most budget/v of them fit.
    Later ones are out whatever else happens. That leaves at most about
    budget * ln(budget) rows per session, for any number of items. Hot
    (session, size) groups are cut by salt first, then as a whole; by default
    there are as many salts as shuffle partitions.

    Items that cost nothing need no candidate: an empty full text is always
    taken; an empty summary is always taken at least as a summary, and can be
    full only among the first budget/full items of that full size.
    """
    full, small = F.col("token_count"), F.least("token_count", "compressed_token_count")
    unit = F.when(small > 0, small).otherwise(full)
    sized = (
        _with_budget(items.where(F.col("is_active")), budget)
        .select(
            "session_id",
            "id",
            "priority",
            "last_accessed",
            full.alias("full_tokens"),
            F.col("compressed_token_count").alias("summary_tokens"),
            (small > 0).alias("has_cost"),
            unit.alias("unit"),
            "max_tokens",
        )
        .where((F.col("unit") > 0) & (F.col("unit") <= F.col("max_tokens")))
    )
    group = ["session_id", "has_cost", "unit"]
    fits = F.floor(F.col("max_tokens") / F.col("unit"))
    salted = W.partitionBy(*group, F.pmod(F.xxhash64("id"), F.lit(salts or salts_for(items)))).orderBy(*item_order())
    whole = W.partitionBy(*group).orderBy(*item_order())
    first = sized.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= fits)
    return first.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= fits).drop("_n")


_TAKEN = "session_id string, id string, form string, tokens int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions one after the other, each in order; only what is left of the budget is kept."""
    session, left = object(), 0
    for batch in batches:
        taken: list[tuple] = []
        columns = ["session_id", "id", "full_tokens", "summary_tokens", "max_tokens"]
        for owner, name, full, summary, budget in zip(*(batch.column(c).to_pylist() for c in columns)):
            if owner != session:
                session, left = owner, budget
            if full <= left:
                taken.append((owner, name, FULL, full))
                left -= full
            elif summary <= left:
                taken.append((owner, name, COMPRESSED, summary))
                left -= summary
        owners, names, forms, tokens = zip(*taken) if taken else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(owners, pa.string()),
                pa.array(names, pa.string()),
                pa.array(forms, pa.string()),
                pa.array(tokens, pa.int32()),
            ],
            names=["session_id", "id", "form", "tokens"],
        )


def working_context(items: DataFrame, budget: int | DataFrame, salts: int | None = None) -> DataFrame:
    """(session_id, id, form, tokens): the packing of each session's active items.

    In order of priority and last access, an item goes in whole if it still
    fits, else as its summary if that fits, else it is passed over and the next
    one is tried. ``budget`` is one number or (session_id, max_tokens) rows.
    """
    candidates = packing_candidates(items, budget, salts)
    in_order = candidates.repartition("session_id").sortWithinPartitions("session_id", *item_order())
    packed = in_order.mapInArrow(_pack, _TAKEN)
    active = items.where(F.col("is_active"))
    free = active.where(F.col("token_count") == 0).select(
        "session_id", "id", F.lit(FULL).alias("form"), F.lit(0).alias("tokens")
    )
    empty_summary = active.where((F.col("token_count") > 0) & (F.col("compressed_token_count") == 0)).select(
        "session_id", "id"
    )
    as_summary = empty_summary.join(
        candidates.where(~F.col("has_cost")).select("session_id", "id"), ["session_id", "id"], "left_anti"
    ).select("session_id", "id", F.lit(COMPRESSED).alias("form"), F.lit(0).alias("tokens")
    )
    return packed.unionByName(free).unionByName(as_summary)


def context_totals(taken: DataFrame, items: DataFrame, budget: int | DataFrame) -> DataFrame:
    """Items and tokens used and left per session; a session with nothing taken has all left."""
    sessions = _with_budget(items.select("session_id").distinct(), budget)
    used = taken.groupBy("session_id").agg(
        F.count_if(F.col("form") == FULL).alias("full_items"),
        F.count_if(F.col("form") == COMPRESSED).alias("compressed_items"),
        F.sum("tokens").alias("total_tokens"),
    )
    zero = ["full_items", "compressed_items", "total_tokens"]
    return (
        sessions.join(used, "session_id", "left")
        .na.fill(0, zero)
        .select("session_id", *zero, (F.col("max_tokens") - F.col("total_tokens")).alias("available_tokens"))
    )


def context_content(taken: DataFrame, items: DataFrame) -> DataFrame:
    """Taken items with their text and, for summaries, the retrieval hint.

    The packing is written out first: where it is small enough to broadcast,
    the texts are read in place and only the taken ones kept.
    """
    is_full = F.col("form") == FULL
    texts = items.select("session_id", "id", "content_type", "full_content", "compressed_summary")
    return texts.join(settled(taken, "packing"), ["session_id", "id"]).select(
        "session_id",
        "id",
        F.col("content_type").alias("type"),
        "form",
        "tokens",
        F.when(is_full, F.col("full_content")).otherwise(F.col("compressed_summary")).alias("content"),
        F.when(~is_full, retrieval_hint(F.col("id"))).alias("retrieval_hint"),
    )


def _leading(chunks: Column, available: int) -> Column:
    """The chunks up to the first that no longer fits, joined."""
    def step(state: Column, chunk: Column) -> Column:
        used = state["used"] + estimate_tokens(chunk)
        fits = state["open"] & (used <= available)
        return F.struct(
            F.when(fits, used).otherwise(state["used"]).alias("used"),
            F.when(fits, state["n"] + 1).otherwise(state["n"]).alias("n"),
            fits.alias("open"),
        )

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    kept = F.slice(chunks, F.lit(1), F.aggregate(chunks, start, step, lambda state: state["n"]))
    return F.array_join(kept, CHUNK_SEPARATOR)


def fit_to_window(
    df: DataFrame,
    key: str,
    text: str,
    query: str | None = None,
    max_tokens: int = POLICY.window_tokens,
    reserve: int = POLICY.reserve_tokens,
    size: int = POLICY.chunk_tokens,
    overlap: int = POLICY.chunk_overlap,
    embedder: Hook = default_embedder,
) -> DataFrame:
    """(key, fitted): each text cut to the window, ``key`` unique.

    A text that fits stays whole. Otherwise its chunks, in order or by
    similarity to ``query``, are taken until the first that does not fit and
    joined with " [...] "; if none fits the result is empty. Without a query
    this needs no shuffle. With one, only the long texts are moved, before they
    are cut, so that their chunks are scored, ranked and joined where they are.
    """
    available = max_tokens - reserve
    body = F.col(text)
    fits = F.coalesce(estimate_tokens(body) <= available, F.lit(True))  # a null text stays null
    chunked = chunk_text(body, size, overlap)
    if query is None:
        cut = once(chunked, lambda chunks: _leading(chunks, available))
        return df.select(key, F.when(fits, body).otherwise(cut).alias("fitted"))
    vector = embed_text(df.sparkSession, query, embedder)
    long = df.where(~fits).select(key, text).repartition(key)
    chunks = long.select(key, F.posexplode(chunked).alias("position", "chunk"))
    scored = score_chunks(chunks.withColumn("embedding", embedder(F.col("chunk"))), vector, [key])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    joined = (
        scored.groupBy(key)
        .agg(ordered.alias("ordered"))
        .select(key, _leading(F.transform("ordered", lambda c: c["chunk"]), available).alias("fitted"))
    )
    return df.where(fits).select(key, body.alias("fitted")).unionByName(joined)
