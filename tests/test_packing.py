"""Packing, window fitting and ingest against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions.hooks import embed_text
from engram.operators import packing as P
from engram.operators.ingest import ingest_items
from engram.policy import model_limits

T0 = datetime(2024, 1, 1)
ITEMS = (
    "session_id string, id string, token_count int, compressed_token_count int, priority int, "
    "last_accessed timestamp_ntz, is_active boolean"
)


def greedy(rows, budget):
    """What a loop over the sorted items takes: {id: (form, tokens)}."""
    def rank(r):
        return (
            (0, 0) if r[4] is None else (1, -r[4]),
            (0, timedelta(0)) if r[5] is None else (1, T0 - r[5]),
            r[1],
        )

    taken, used = {}, 0
    for r in sorted((r for r in rows if r[6]), key=rank):
        if used + r[2] <= budget:
            taken[r[1]], used = ("full", r[2]), used + r[2]
        elif used + r[3] <= budget:
            taken[r[1]], used = ("compressed", r[3]), used + r[3]
    return taken


def random_items(seed, sessions, size):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        n = size * 6 if s == 0 else rng.randint(0, size)
        for i in range(n):
            full = rng.choice([0, 1, 2, 3, 5, 8, 20, 60, 300])
            summary = rng.choice([0, 0, 1, 2, 3, 5, 25, full])
            rows.append(
                (
                    f"s{s}",
                    f"i{s}-{i}",
                    full,
                    summary,
                    rng.choice([None, 0, 1, 5, 9]),
                    rng.choice([None, T0 + timedelta(minutes=rng.randint(0, 9))]),
                    rng.random() < 0.9,
                )
            )
    return rows


def taken_of(df):
    found = {}
    for r in df.collect():
        assert r["id"] not in found.setdefault(r["session_id"], {})
        found[r["session_id"]][r["id"]] = (r["form"], r["tokens"])
    return found


@pytest.mark.parametrize("seed,budget,salts", [(1, 40, 3), (2, 150, 2), (3, 7, 5), (4, 0, 2), (5, 3000, 3)])
def test_working_context_equals_loop(spark, seed, budget, salts):
    rows = random_items(seed, 25, 60)
    found = taken_of(P.working_context(spark.createDataFrame(rows, ITEMS), budget, salts))
    for session in {r[0] for r in rows}:
        want = greedy([r for r in rows if r[0] == session], budget)
        assert found.get(session, {}) == want
        assert sum(t for _, t in want.values()) <= budget


def test_candidates_stay_bounded(spark):
    items = spark.range(20000).select(
        F.lit("hot").alias("session_id"),
        F.col("id").cast("string").alias("id"),
        F.lit(50).alias("token_count"),
        F.lit(10).alias("compressed_token_count"),
        F.lit(1).alias("priority"),
        F.lit(T0).cast("timestamp_ntz").alias("last_accessed"),
        F.lit(True).alias("is_active"),
    )
    assert P.packing_candidates(items, 500, 7).count() == 50


def test_budget_per_session(spark):
    rows = [("a", "1", 5, 1, 0, T0, True), ("b", "2", 5, 1, 0, T0, True)]
    budgets = spark.createDataFrame([("a", 5), ("b", 4)], "session_id string, max_tokens int")
    items = spark.createDataFrame(rows, ITEMS)
    found = P.working_context(items, budgets)
    assert taken_of(found) == {"a": {"1": ("full", 5)}, "b": {"2": ("compressed", 1)}}
    totals = {r["session_id"]: r for r in P.context_totals(found, items, budgets).collect()}
    assert (totals["b"]["total_tokens"], totals["b"]["available_tokens"]) == (1, 3)


def test_skipped_then_taken_and_empty_session(spark):
    rows = [
        ("a", "1", 90, 95, 9, T0, True),  # summary larger than full
        ("a", "2", 50, 40, 8, T0, True),  # neither fits
        ("a", "3", 10, 10, 7, T0, True),  # exact fit
        ("b", "4", 10, 10, 7, T0, False),
    ]
    items = spark.createDataFrame(rows, ITEMS)
    found = P.working_context(items, 100)
    assert taken_of(found) == {"a": {"1": ("full", 90), "3": ("full", 10)}}
    totals = {r["session_id"]: r["available_tokens"] for r in P.context_totals(found, items, 100).collect()}
    assert totals == {"a": 0, "b": 100}


def chunks_of(text, size=1024, overlap=128):
    step = (size - overlap) * 4
    return [text[i : i + size * 4] for i in range(0, len(text), step)]


TEXTS = ["", "x", "a" * 3584, "b" * 3585, "c" * 4096, "ab😀é" * 2500, "line\n" * 3000, "😀" * 4097]


@pytest.mark.parametrize("size,overlap", [(1024, 128), (16, 12), (8, 0)])
def test_chunks(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in df.select("id", X.chunk_text(F.col("text"), size, overlap).alias("c")).collect():
        assert r["c"] == chunks_of(TEXTS[r["id"]], size, overlap)


def test_chunks_reject_full_overlap():
    with pytest.raises(ValueError):
        X.chunk_text(None, 16, 16)


def fitted_of(text, available, order=None):
    if len(text) // 4 <= available:
        return text
    kept, used = [], 0
    chunks = chunks_of(text)
    for chunk in chunks if order is None else [chunks[i] for i in order]:
        if used + len(chunk) // 4 > available:
            break
        kept.append(chunk)
        used += len(chunk) // 4
    return " [...] ".join(kept)


@pytest.mark.parametrize("max_tokens", [2048, 600, 4000])
def test_fit_to_window(spark, max_tokens):
    texts = TEXTS + ["word %d " % i * 900 for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in P.fit_to_window(df, "id", "text", max_tokens=max_tokens).collect():
        assert r["fitted"] == fitted_of(texts[r["id"]], max_tokens - 500)


def test_fit_to_window_by_query(spark):
    words = ["alpha beta gamma", "storage index query", "river mountain lake"]
    text = "".join((w + " ") * 300 for w in words)
    df = spark.createDataFrame([(0, text), (1, "short")], "id int, text string")
    found = {r["id"]: r["fitted"] for r in P.fit_to_window(df, "id", "text", "mountain lake river").collect()}
    assert found[1] == "short"
    assert found[0].startswith(chunks_of(text)[-1][:100]) or "mountain" in found[0][:400]
    assert len(embed_text(spark, "mountain lake")) == 64


NEW = "id string, session_id string, arrived_at timestamp_ntz, full_content string"


def ingest_loop(rows, context, trigger, auto=True, used=0):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens = len(r[3]) // 4
        over = auto and used / context * 100 > trigger * 100
        if over or tokens > 2000:
            summary = r[3][: int(tokens * 0.25) * 4]
        else:
            summary = r[3][:500] + "..." if len(r[3]) > 500 else r[3]
        out[r[0]] = summary
        used += len(summary) // 4
    return out


@pytest.mark.parametrize("auto,start", [(True, 0), (False, 0), (True, 6000), (True, 6144), (True, 6145)])
def test_ingest_equals_loop(spark, auto, start):
    rng = random.Random(start + auto)
    rows = []
    for s in range(6):
        for i in range(150 if s == 0 else 40):
            size = rng.choice([0, 3, 40, 500, 501, 800, 2400, 8000, 8003, 8004, 9000])
            rows.append((f"{s}-{i}", f"s{s}", T0 + timedelta(minutes=rng.randint(0, 30)), "word " * (size // 5) + "x" * (size % 5)))
    limits = model_limits("gpt-4")
    prior = spark.createDataFrame([(f"s{s}", start) for s in range(6)], "session_id string, used long")
    done = ingest_items(spark.createDataFrame(rows, NEW), "gpt-4", prior, auto, salts=3)
    found = {r["id"]: r["compressed_summary"] for r in done.select("id", "compressed_summary").collect()}
    want = {}
    for s in range(6):
        mine = [r for r in rows if r[1] == f"s{s}"]
        want.update(ingest_loop(mine, limits.context_length, limits.compression_trigger, auto, start))
    assert found == want


def test_ingest_sizes_and_ratio(spark):
    rows = [("e", "s", T0, ""), ("a", "s", T0, "y" * 501), ("b", "s", T0, "y" * 500)]
    done = {r["id"]: r for r in ingest_items(spark.createDataFrame(rows, NEW), "gpt-4o-mini").collect()}
    assert done["e"]["compression_ratio"] == 1.0
    assert done["a"]["compressed_summary"] == "y" * 500 + "..."
    assert done["b"]["compressed_summary"] == "y" * 500
    with pytest.raises(ValueError):
        ingest_items(spark.createDataFrame(rows, NEW), "no-such-model")


def test_empty_inputs(spark):
    items = spark.createDataFrame([], ITEMS)
    assert P.working_context(items, 10).count() == 0
    assert ingest_items(spark.createDataFrame([], NEW), "gpt-4").count() == 0
    texts = spark.createDataFrame([], "id int, text string")
    assert P.fit_to_window(texts, "id", "text", "query").count() == 0
