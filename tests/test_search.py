"""Vector search against brute force, and its approximate form."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions import vectors as VEC
from engram.operators import list_index as LI
from engram.operators import search as S
from engram.sources.shared import shared_folder

ITEMS = "id string, session_id string, is_active boolean, content_type string, embedding array<float>"
QUERIES = "query_id string, session_id string, embedding array<float>"


def data(seed, n_items, n_queries, width=6):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(width)]
    items = []
    for i in range(n_items):
        embedding = None if i % 17 == 0 else [0.0] * width if i % 13 == 0 else vector()
        session = "s0" if i % 3 else f"s{i % 5}"
        items.append((f"i{i}", session, i % 7 != 0, f"t{i % 2}", embedding))
    queries = [(f"q{q}", f"s{q % 5}", [0.0] * width if q == 3 else vector()) for q in range(n_queries)]
    return items, queries


def brute(items, queries, k, scoped=True):
    found = set()
    for name, session, q in queries:
        ranked = []
        for i, s, _, _, e in items:
            if scoped and s != session:
                continue
            if e is None:
                ranked.append((2, 0.0, i))
                continue
            a, b = np.array(e, dtype=np.float64), np.array(q, dtype=np.float64)
            lengths = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            ranked.append((0, 1.0 - (a * b).sum() / lengths, i) if lengths > 0 else (1, 0.0, i))
        ranked.sort(key=lambda r: (r[0], round(r[1], 9), r[2]))
        found |= {(name, i, p + 1) for p, (_, _, i) in enumerate(ranked[:k])}
    return found


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 4, "group_rows": 20}])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_scoped_search(spark, bounds, k):
    items, queries = data(1, 300, 12)
    active = [i for i in items if i[2]]
    found = S.search_items(
        spark.createDataFrame(queries, QUERIES),
        spark.createDataFrame(items, ITEMS).repartition(5),
        k,
        whole_rows=False,
        **bounds,
    )
    # Exact ties in real arithmetic may differ by rounding, so compare on rounded distances.
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    want = {(q, i) for q, i, _ in brute(active, queries, k)}
    distance = distances(active, queries)
    assert len(got) == len(want)
    for q, i in got ^ want:
        edge = max(distance[x] for x in want if x[0] == q)
        assert distance[(q, i)] == pytest.approx(edge, abs=1e-9)


def distances(items, queries):
    table = {}
    for name, session, q in queries:
        for i, s, _, _, e in items:
            if s == session:
                a, b = np.array(e or [0.0], dtype=np.float64), np.array(q, dtype=np.float64)
                if e is None:
                    table[(name, i)] = 8.0
                else:
                    lengths = np.sqrt((a * a).sum() * (b * b).sum())
                    table[(name, i)] = 1.0 - (a * b).sum() / lengths if lengths > 0 else 4.0
    return table


def test_small_and_shuffled_search_agree(spark):
    items, queries = data(2, 500, 40)
    df, asked = spark.createDataFrame(items, ITEMS), spark.createDataFrame(queries, QUERIES)
    held = df.where(F.col("embedding").isNotNull())
    rows = [
        sorted(
            (r["query_id"], r["id"], r["position"], repr(r["distance"]))
            for r in S.nearest(asked, held, 6, "id", **b).collect()
        )
        for b in ({}, {"max_queries": 7, "group_rows": 60})
    ]
    assert rows[0] == rows[1]


def test_null_and_zero_come_last(spark):
    rows = [
        ("far", "s", True, "t", [-1.0, 0.0]),
        ("near", "s", True, "t", [1.0, 0.1]),
        ("none", "s", True, "t", None),
        ("zero", "s", True, "t", [0.0, 0.0]),
        ("a-copy", "s", True, "t", [1.0, 0.1]),
    ]
    asked = spark.createDataFrame([("q", "s", [1.0, 0.0])], QUERIES)
    found = S.search_items(asked, spark.createDataFrame(rows, ITEMS), 5, whole_rows=False).orderBy("position")
    assert [r["id"] for r in found.collect()] == ["a-copy", "near", "far", "zero", "none"]


@pytest.mark.parametrize("bounds", [{}, {"max_queries": 0}])
def test_dimension_mismatch_raises(spark, bounds):
    rows = [("a", "s", True, "t", [1.0, 0.0, 0.0])]
    asked = spark.createDataFrame([("q", "s", [1.0, 0.0])], QUERIES)
    with pytest.raises(Exception, match="dimensions differ"):
        S.search_items(asked, spark.createDataFrame(rows, ITEMS), **({"max_queries": 1} if bounds else {})).collect()


def test_cosine_expressions(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r["d"] for r in df.select(VEC.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == pytest.approx(1 - 2**-0.5)
    assert np.isnan(got[1]) and got[2] is None
    with pytest.raises(Exception, match="dimensions differ"):
        df.select(VEC.cosine_distance(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_approximate_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    points = [(centres[i % 12] + 0.1 * rng.normal(size=16)).astype("float32").tolist() for i in range(900)]
    items = spark.createDataFrame([(f"i{i}", "s", True, "t", p) for i, p in enumerate(points)], ITEMS)
    asked = spark.createDataFrame([(f"q{i}", "s", p) for i, p in enumerate(points[:40])], QUERIES)
    exact = S.search_items(asked, items, 5, whole_rows=False)
    trained = S.train_centres(items, 12)
    found = S.search_items_approx(asked, items, trained, 5, probes=2)
    assert S.recall(found, exact).first()["recall"] >= 0.95
    pivots = S.pick_pivots(items, 12, "id")
    every = S.search_items_approx(asked, items, pivots, 5, probes=12)
    assert S.recall(every, exact).first()["recall"] == 1.0


def test_stored_lists_are_pruned(spark):
    items, queries = data(6, 300, 12)
    df = spark.createDataFrame(items, ITEMS).where("is_active")
    asked = spark.createDataFrame(queries[:2], QUERIES)
    centres = S.pick_pivots(df, 8, "id")
    path = shared_folder(spark, "test-lists")
    S.assign_lists(df, centres).write.partitionBy("list").parquet(path)
    stored = spark.read.schema(ITEMS + ", list int").parquet(path)
    found = S.nearest_approx(asked, stored, centres, 5, "id", 2, scope="session_id")
    direct = S.search_items_approx(asked, df, centres, 5, 2)
    rows = [sorted((r["query_id"], r["id"], r["position"]) for r in x.collect()) for x in (found, direct)]
    assert rows[0] == rows[1] and rows[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_topic_matches(spark):
    rng = random.Random(3)
    convs = [(f"c{i}", rng.choice([None, 0.5, 0.7]), [f"t{rng.randint(0, 3)}" for _ in range(2)]) for i in range(80)]
    convs += [("cn", 0.9, None), ("ce", 0.9, [])]
    asked = [(f"q{i}", [f"t{i % 4}", "t9"]) for i in range(5)]
    found = S.topic_matches(
        spark.createDataFrame(asked, "query_id string, topics array<string>"),
        spark.createDataFrame(convs, "conversation_id string, importance_score double, topics array<string>"),
        4,
    )
    want = set()
    for q, topics in asked:
        hits = [c for c in convs if c[2] and set(c[2]) & set(topics)]
        hits.sort(key=lambda c: (c[1] is not None, -(c[1] or 0), c[0]))
        want |= {(q, c[0], p + 1) for p, c in enumerate(hits[:4])}
    assert {(r["query_id"], r["conversation_id"], r["position"]) for r in found.collect()} == want


def test_answer_lookup(spark):
    """Documents with one marked line each, found by their own subject."""
    subjects = ["token signing and rotation", "index tuning and vacuum", "cluster network layout", "metric scraping"]
    rows = []
    for i, subject in enumerate(subjects):
        body = f"# Part {i}\n{subject}\nANSWER_KEY: use {subject} : v{i} \n" + (subject + " ") * 400
        rows.append((f"d{i}", "s", True, "docs", body))
    items = spark.createDataFrame(rows, "id string, session_id string, is_active boolean, content_type string, full_content string")
    items = items.withColumn("embedding", VEC.hashed_embedding(F.col("full_content")))
    asked = spark.createDataFrame([(f"q{i}", "s", s) for i, s in enumerate(subjects)], "query_id string, session_id string, t string")
    asked = asked.withColumn("embedding", VEC.hashed_embedding(F.col("t")))
    got = {r["query_id"]: r["answer"] for r in S.answer_lookup(asked, items).collect()}
    assert got == {f"q{i}": f"use {s} : v{i}" for i, s in enumerate(subjects)}
    preview = S.answer_lookup(asked, items, marker="NO_SUCH").first()["answer"]
    assert len(preview) == 200


def test_stored_search_kinds(spark):
    convs = spark.createDataFrame(
        [("c1", "sum", 0.5, ["t1"], False, "u1", [1.0, 0.0]), ("c2", "two", 0.9, ["t1"], False, "u2", [0.0, 1.0])],
        "conversation_id string, summary string, importance_score double, topics array<string>, "
        "is_archived boolean, user_id string, embedding array<float>",
    )
    facts = spark.createDataFrame(
        [("f1", "fact", 0.9, [1.0, 0.0]), ("f2", "low", 0.1, [1.0, 0.0])],
        "fact_id string, fact string, confidence double, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [("q", "s", [1.0, 0.0], ["t1"])], QUERIES + ", topics array<string>"
    )

    def ids(kind, **more):
        return [(r["kind"], r["id"]) for r in S.stored_search(asked, convs, facts, kind, **more).orderBy("kind", "position").collect()]

    assert ids("semantic") == [("conversation", "c1"), ("conversation", "c2"), ("fact", "f1")]
    assert ids("factual") == [("fact", "f1")]
    assert ids("temporal") == [("conversation", "c2"), ("conversation", "c1")]
    assert ids("temporal", user_id="u1") == [("conversation", "c1")]
    with pytest.raises(ValueError):
        ids("other")


def test_empty_inputs(spark):
    items, queries = data(4, 30, 3)
    df, asked = spark.createDataFrame(items, ITEMS), spark.createDataFrame(queries, QUERIES)
    assert S.search_items(asked.limit(0), df).count() == 0
    assert S.search_items(asked, df.limit(0)).count() == 0
    assert S.nearest(asked, df.limit(0), 3, "id", max_queries=1).count() == 0


def index_items(spark, rng):
    """Clustered vectors of three scopes with ties, repeated vectors, zero and missing ones."""
    heads = rng.standard_normal((12, 16))
    rows = []
    for i in range(900):
        v = heads[i % 12] + 0.2 * rng.standard_normal(16)
        rows.append((f"i{i:04d}", f"s{0 if i % 3 else i % 2 + 1}", [float(x) for x in v]))
    rows += [(f"t{i}", "s0", rows[5][2]) for i in range(9)] + [("z", "s0", [0.0] * 16), ("n", "s0", None), ("bad", "s0", [float("nan")] * 16)]
    return rows, spark.createDataFrame(rows, "id string, session_id string, embedding array<float>")


@pytest.mark.parametrize("block_rows", [40, 20_000])
def test_pruned_search_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows, items = index_items(spark, rng)
    index = LI.build_list_index(items, shared_folder(spark, "test-index"), scope="session_id", lists=12, sample_rows=500)
    assert index.rows().count() == 909
    asked = [(f"q{i}", s, v) for i, (_, s, v) in enumerate(rows[::7]) if v] + [("none", "s9", rows[0][2]), ("null", "s0", None)]
    queries = spark.createDataFrame(asked, "query_id string, session_id string, embedding array<float>")
    search = LI.search_index_exact(queries, index, 6, scope="session_id", block_rows=block_rows)
    got = sorted((r["query_id"], r["position"], r["id"]) for r in search.found.collect())
    usable = items.where("id NOT IN ('z', 'n', 'bad')")
    want = S.nearest(queries.where("query_id NOT IN ('none')"), usable, 6, "id", scope="session_id")
    assert got == sorted((r["query_id"], r["position"], r["id"]) for r in want.collect())
    report = search.report().first()
    lists = {r["scope"]: r["count"] for r in index.blocks().groupBy("scope").count().collect()}
    assert report["skipped"] > 0.5 and report["n_met"] + report["n_pruned"] == sum(lists.get(a[1], 0) for a in asked if a[2])


def test_pairs_of_queries_and_blocks_come_in_bounded_batches(spark, monkeypatch):
    """However many blocks a query meets, a task holds PAIR_ROWS pairs at most; none is lost."""
    rng = np.random.default_rng(6)
    _, items = index_items(spark, rng)
    index = LI.build_list_index(items, shared_folder(spark, "test-index"), scope="session_id", lists=12, sample_rows=500)
    asked = LI.asked_of(items.where("id LIKE 'i00%'").withColumnRenamed("id", "query_id"), "session_id").withColumns({"done": F.lit(0), "reach": F.lit(None).cast("double")})
    want = asked.join(index.blocks(), "scope").where("list <> 0").agg(F.sum("rows")).first()[0]
    whole = LI.paired

    def bounded(batch, out):
        if len(out) > 50:
            raise ValueError(f"{len(out)} pairs at once")
        return whole(batch, out)

    monkeypatch.setattr(LI, "paired", bounded)
    monkeypatch.setattr(LI, "PAIR_ROWS", 50)
    # Blocks of one row: as many pairs as rows in other lists.
    pairs = LI.pairs_of(asked, index, 1, first=False)
    assert pairs.distinct().count() == want > 50


def test_index_scan_reads_probed_lists_only(spark):
    rng = np.random.default_rng(4)
    rows, items = index_items(spark, rng)
    path = shared_folder(spark, "test-index")
    LI.build_list_index(items, path, scope="session_id", lists=12, sample_rows=500)
    index = LI.open_list_index(spark, path)
    queries = spark.createDataFrame([("q", "s0", rows[1][2])], "query_id string, session_id string, embedding array<float>")
    found = LI.search_index_approx(queries, index, 5, probes=2, scope="session_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and " IN (" in plan
    many = spark.createDataFrame([(f"q{i}", s, v) for i, (_, s, v) in enumerate(rows[:300])], "query_id string, session_id string, embedding array<float>")
    approx = LI.search_index_approx(many, index, 5, probes=4, rerank=8, scope="session_id")
    exact = S.nearest(many, items.where("id NOT IN ('z', 'n', 'bad')"), 5, "id", scope="session_id")
    assert S.recall(approx, exact).first()["recall"] >= 0.9
    for block_rows in (20, 20_000):
        dealt = LI.search_index_approx(many, index, 5, probes=4, rerank=8, scope="session_id", max_queries=20, block_rows=block_rows)
        assert S.recall(dealt, exact).first()["recall"] >= 0.9
        assert dealt.groupBy("query_id").agg(F.countDistinct("position").alias("n")).where("n <> 5").isEmpty()
    empty = LI.build_list_index(items.where("false"), shared_folder(spark, "test-index"), scope="session_id")
    assert LI.search_index_exact(many, empty, 5).found.collect() == LI.search_index_approx(many, empty, 5).collect() == []


def test_rows_are_fetched_from_the_sessions_found(spark):
    """Of items stored by session only the partitions of found sessions are read, and an id of two sessions is kept apart."""
    rng = np.random.default_rng(5)
    rows = [(f"i{i % 50}", f"s{i // 50}", True, "t", f"text {i}", [float(x) for x in rng.standard_normal(4)]) for i in range(400)]
    path = shared_folder(spark, "test-items")
    schema = "id string, session_id string, is_active boolean, content_type string, full_content string, embedding array<float>"
    spark.createDataFrame(rows, schema).write.partitionBy("session_id").parquet(path)
    items = spark.read.schema(schema).parquet(path)
    queries = spark.createDataFrame([("q", "s3", rows[151][5])], QUERIES)
    found = S.search_items(queries, items, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    got = found.orderBy("position").collect()
    assert len(got) == 3 and {r["session_id"] for r in got} == {"s3"} and got[0]["full_content"] == "text 151"


def test_texts_are_embedded_in_slices_of_bounded_size(spark, monkeypatch):
    """A batch is cut by the bytes of its texts, and the cut changes no vector."""
    texts = [None, "", "one two", "ü" * 300, None, "Two  three\n" * 40, "one", " "] * 5
    runs = list(VEC.slices_of(pa.array(texts), 500))
    assert [i for start, stop in runs for i in range(start, stop)] == list(range(40)) and len(runs) > 5
    assert all(sum(len((t or "").encode()) for t in texts[start + 1 : stop]) <= 500 for start, stop in runs)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    vectors = lambda: df.select("i", VEC.hashed_embedding(F.col("t"))).orderBy("i").collect()
    whole = vectors()
    monkeypatch.setattr(VEC, "SLICE_BYTES", 16)
    assert vectors() == whole and whole[0][1] is None and not any(whole[1][1]) and sum(whole[2][1]) == pytest.approx(2**0.5)
