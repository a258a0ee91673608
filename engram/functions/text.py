"""Text sizes, summaries, chunks and message rules as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.vectors import once
from engram.policy import (
    ANSWER_MARKER,
    ANSWER_PREVIEW_CHARS,
    ASKED_CHARS,
    ASKED_PREFIX,
    ELLIPSIS,
    NO_USER_SUMMARY,
    POLICY,
    RETRIEVAL_HINT,
    THREAD_PREFIX,
    strategy_ratio,
)
from engram.schemas import MESSAGES


def estimate_tokens(text: Column) -> Column:
    """Characters (code points) divided by four, rounded down."""
    return tokens_of_length(F.length(text))


def tokens_of_length(chars: Column) -> Column:
    return F.floor(chars / F.lit(POLICY.chars_per_token)).cast("int")


def compress_target(tokens: Column, ratio: Column) -> Column:
    """Token target of a summary; the product is taken in double and truncated."""
    return (tokens * ratio.cast("double")).cast("int")


def truncate_summary(text: Column, chars: int = POLICY.summary_chars) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ELLIPSIS))).otherwise(text)


def compress_text(text: Column, strategy: str = "balanced", tokens: Column | None = None) -> Column:
    """Deterministic stand-in for a summarizer: the leading part of the target size."""
    tokens = estimate_tokens(text) if tokens is None else tokens
    target = compress_target(tokens, F.lit(strategy_ratio(strategy)))
    return F.substring(text, F.lit(1), target * POLICY.chars_per_token)


def default_summary(text: Column, tokens: Column, limit: int = POLICY.always_compress_above) -> Column:
    """Summary of an item stored while its session is below the compression trigger."""
    return F.when(tokens > limit, compress_text(text, tokens=tokens)).otherwise(truncate_summary(text))


def compression_ratio(compressed: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, compressed / tokens).otherwise(F.lit(1.0))


def chunk_text(
    text: Column, size: int = POLICY.chunk_tokens, overlap: int = POLICY.chunk_overlap
) -> Column:
    """Overlapping windows of a text as an array, sizes in tokens.

    The text is cut once into blocks of one step, in time linear in its length;
    each window is its own block plus the head of the blocks that follow.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    chars = size * POLICY.chars_per_token
    step = (size - overlap) * POLICY.chars_per_token
    reach = -(-chars // step)
    pattern = F.lit(f"(?s).{{1,{step}}}")

    def windows(blocks: Column) -> Column:
        def window(_, i: Column) -> Column:
            return F.substring(F.array_join(F.slice(blocks, i + 1, F.lit(reach)), ""), 1, chars)

        return F.transform(blocks, window)

    return once(F.regexp_extract_all(text, pattern, F.lit(0)), windows)


def parse_messages(content: Column) -> Column:
    """Messages of a JSON array; any other content is one user message."""
    plain = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    return F.when(content.isNotNull(), F.coalesce(F.from_json(content, MESSAGES), plain))


def importance_from(n_messages: Column, has_tool_calls: Column) -> Column:
    bonus = F.when(has_tool_calls, 0.2).otherwise(0.0) + F.when(n_messages > 3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + bonus)


def importance_score(messages: Column, has_tool_calls: Column) -> Column:
    return importance_from(F.size(messages), has_tool_calls)


def summary_from(first_user_text: Column, has_user: Column) -> Column:
    head = F.substring(F.coalesce(first_user_text, F.lit("")), 1, ASKED_CHARS)
    asked = F.concat(F.lit(ASKED_PREFIX), head, F.lit(ELLIPSIS))
    return F.when(has_user, asked).otherwise(F.lit(NO_USER_SUMMARY))


def first_user_summary(messages: Column) -> Column:
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))
    return summary_from(first["content"], F.coalesce(first.isNotNull(), F.lit(False)))


def retrieval_hint(item_id: Column) -> Column:
    return F.format_string(RETRIEVAL_HINT, item_id)


def answer_after_marker(
    content: Column, marker: str = ANSWER_MARKER, preview: int = ANSWER_PREVIEW_CHARS
) -> Column:
    """Text after the first colon of the first line with the marker, else a preview."""
    line = F.get(F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit(marker))), F.lit(0))
    after = F.regexp_replace(F.substring(line, F.locate(":", line) + 1, F.length(line)), r"^\s+|\s+$", "")
    return F.when(line.isNotNull(), after).otherwise(F.substring(content, 1, preview))


def thread_id(key: Column) -> Column:
    return F.concat(F.lit(THREAD_PREFIX), F.substring(F.md5(key.cast("string")), 1, 8))


def contains_pattern(column: Column, query: str) -> Column:
    """Case-blind substring match; % and _ of the caller stay wildcards."""
    return F.ilike(column, F.lit(f"%{query}%"))
