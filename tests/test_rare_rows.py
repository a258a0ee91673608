"""Rows that the supplied tables do not have: each case once went wrong or could."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engram.functions.hooks import summarizer_hook
from engram.functions.text import importance_score
from engram.operators import filters as L
from engram.operators import folds as FO
from engram.operators import joins as J
from engram.operators import maintenance as M
from engram.operators import ranking as R
from engram.operators import search as SE
from engram.operators.conversations import build_conversations, conversation_headers, parsed_messages
from engram.operators.ingest import ingest_items
from engram.operators.packing import fit_to_window
from engram.sources import shared
from engram.sources.tables import latest_changes, upsert

T0 = datetime(2024, 1, 1)
AS_OF = datetime(2024, 2, 2)


def test_a_long_conversation_is_one_row(spark):
    turns = spark.range(2500).select(
        F.lit("c").alias("conversation_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("m"), "id").alias("text"),
    )
    whole = build_conversations(turns).collect()
    assert len(whole) == 1 and [m["content"] for m in whole[0]["messages"]] == [f"m{i}" for i in range(2500)]
    scored = build_conversations(turns).select(importance_score(F.col("messages"), F.lit(False)).alias("s")).first()["s"]
    heads = conversation_headers(turns, F.lit(False)).collect()
    assert len(heads) == 1 and heads[0]["importance_score"] == pytest.approx(scored)
    assert heads[0]["summary"] == "User asked: m0..."
    stored = build_conversations(turns, 1000).select(
        "conversation_id", (F.col("part") * 1000).alias("first"), F.to_json("messages").alias("content")
    )
    messages = parsed_messages(stored, "conversation_id", "content", F.col("first")).collect()
    assert sorted((m["position"], m["content"]) for m in messages) == sorted((i, f"m{i}") for i in range(2500))
    assert M.compress_old(
        build_conversations(turns).withColumn("created_at", F.lit(T0).cast("timestamp_ntz")).withColumn("is_compressed", F.lit(False)), AS_OF
    ).count() == 1


def test_quarantine_of_clashing_threads(spark):
    # Two ids whose hashes begin with the same 32 bits.
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("id"))
    heads = ids.withColumn("t", F.substring(F.md5("id"), 1, 8)).groupBy("t").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one, other = heads.where(F.size("ids") > 1).orderBy("t").first()["ids"][:2]
    items = spark.createDataFrame([(one, "s", "t", "x"), (other, "s", "t", "y")], "id string, session_id string, content_type string, full_content string")
    isolated = M.quarantine(items, F.col("id") == one, "r", AS_OF)
    assert [r["id"] for r in M.without_quarantined(items, isolated).collect()] == [other]


@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [None, 1.0], [0.0, 0.0], [float("inf"), 1.0]])
def test_vectors_without_a_distance_are_found_last(spark, bad):
    rows = [("a", "s", True, [1.0, 0.0]), ("b", "s", True, bad), ("c", "s", True, [0.0, 1.0]), ("d", "s", True, None)]
    items = spark.createDataFrame(rows, "id string, session_id string, is_active boolean, embedding array<float>")
    queries = spark.createDataFrame([("1", "s", [1.0, 0.1]), ("2", "s", [1.0, 0.2])], "query_id string, session_id string, embedding array<float>")
    for most in (SE.MAX_QUERIES, 1):
        found = SE.nearest(queries, items, 10, "id", "session_id", max_queries=most).collect()
        for query in ("1", "2"):
            order = [r["id"] for r in sorted(found, key=lambda r: r["position"]) if r["query_id"] == query]
            assert order == ["a", "c", "b", "d"]


def test_null_texts_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "short"), (3, "w " * 9000)], "k int, t string")
    for query in (None, "w"):
        fitted = {r["k"]: r["fitted"] for r in fit_to_window(rows, "k", "t", query, 700, 100).collect()}
        assert sorted(fitted) == [1, 2, 3] and fitted[1] is None and fitted[2] == "short"


def test_several_preferences_of_a_user(spark):
    base = spark.createDataFrame([("u", {"a": "1", "z": "0"}, T0)], "user_id string, preferences map<string,string>, updated_at timestamp_ntz")
    changes = spark.createDataFrame(
        [("u", "a", "2", 1), ("u", "a", "1", 2), ("u", "b", "3", 1), ("v", "c", "4", 1)], "user_id string, key string, value string, ts int"
    )
    got = {r["user_id"]: r["preferences"] for r in M.set_preferences(base, changes, AS_OF).collect()}
    assert got == {"u": {"a": "1", "b": "3", "z": "0"}, "v": {"c": "4"}}


def test_answers_and_updates_of_another_session(spark):
    asked = spark.createDataFrame(
        [("1", "s", None, "pending", None)], "id string, session_id string, response string, status string, answered_at timestamp_ntz"
    )
    said = spark.createDataFrame([("1", "t", "no", T0)], "id string, session_id string, response string, ts timestamp_ntz")
    after, unmatched = M.answer_hil(asked, said)
    assert after.first()["status"] == "pending" and [r["response"] for r in unmatched.collect()] == ["no"]
    tasks = spark.createDataFrame(
        [("1", "s", "pending", 0, "{}", None, None)],
        "id string, session_id string, status string, progress int, metadata string, completed_at timestamp_ntz, updated_at timestamp_ntz",
    )
    updates = spark.createDataFrame(
        [("1", "t", 1, "completed", 5, None, T0)], "id string, session_id string, seq int, status string, progress int, metadata string, ts timestamp_ntz"
    )
    current, unknown = FO.task_current(tasks, updates, ["seq"])
    assert current.first()["status"] == "pending" and unknown.count() == 1


def test_stored_once_and_default_confidence(spark):
    rows = [("f", None, ["x"], "u"), ("f", None, ["x"], "u"), ("b|f", 0.9, None, "u"), ("f", 0.2, None, "u|b"), ("f", 0.1, None, None)]
    contents = spark.createDataFrame(rows, "content string, importance double, tags array<string>, user_id string")
    convs, facts = M.store_facts(contents, AS_OF)
    assert sorted(r["confidence"] for r in facts.collect()) == [0.1, 0.2, 0.5, 0.9]
    assert convs.select("conversation_id").distinct().count() == convs.count() == 4
    assert M.store_conversations(contents, AS_OF).count() == 4


def test_equally_new_states(spark):
    rows = [("s", T0, "b", 1), ("s", T0, "a", 2), ("t", T0, None, 3)]
    states = spark.createDataFrame(rows, "session_id string, updated_at timestamp_ntz, note string, n int")
    for table in (states, states.orderBy("n"), states.orderBy(F.desc("n")).repartition(3)):
        assert {r["session_id"]: r["n"] for r in R.latest_state(table).collect()} == {"s": 1, "t": 3}


def test_repeated_keys(spark):
    facts = spark.createDataFrame([("f1", "c1"), ("f2", "c2")], "fact_id string, conversation_id string")
    keys = spark.createDataFrame([("c1",), ("c1",), (None,)], "conversation_id string")
    assert [r["fact_id"] for r in L.lookup(facts, keys, "conversation_id").collect()] == ["f1"]
    assert [r["fact_id"] for r in L.facts_of(facts, keys).collect()] == ["f1"]
    assert [r["fact_id"] for r in J.cascade_delete(facts, keys).collect()] == ["f2"]
    base = spark.createDataFrame([("k", 1, T0)], "id string, n int, updated_at timestamp_ntz")
    rows = [("k", 2, 9, "a"), ("k", 5, 1, "z"), ("new", 7, 3, "x"), ("new", None, 4, "y"), ("one", 1, 1, "w"), (None, 1, 1, "v")]
    changes = spark.createDataFrame(rows, "id string, n int, at int, note string")
    base = base.withColumn("note", F.lit("old"))
    # The latest row as a whole, not the greatest of each column; a null in it leaves what was there.
    got = upsert(base, changes, "id", AS_OF, order=["at"]).collect()
    assert sorted((r["id"], r["n"], r["note"]) for r in got) == [("k", 2, "a"), ("new", None, "y"), ("one", 1, "w")]
    # Nothing says which row came last: the keys stay as they were and their rows are rejects.
    got = upsert(base, changes, "id", AS_OF).collect()
    assert sorted((r["id"], r["n"], r["note"]) for r in got) == [("k", 1, "old"), ("one", 1, "w")]
    accepted, rejected = latest_changes(changes, "id")
    assert accepted.count() == 1 and sorted((r["id"] or "", r["note"]) for r in rejected.collect()) == [
        ("", "v"), ("k", "a"), ("k", "z"), ("new", "x"), ("new", "y")]
    tied = spark.createDataFrame([("t", 1, 5, "a"), ("t", 2, 5, "b")], changes.schema)
    assert [r["note"] for r in upsert(base.where("false"), tied, "id", AS_OF, order=["at"]).collect()] == ["b"]


def test_the_shared_folder_is_the_one_that_is_set(spark):
    assert shared.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/")


def test_a_text_is_summarized_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return texts.str[:10]

        return model

    rows = [(f"{i:02d}", "s", T0, "w" * (9000 if i < 11 else 40)) for i in range(30)]
    new = spark.createDataFrame(rows, "id string, session_id string, arrived_at timestamp_ntz, full_content string")
    done = ingest_items(new, "gpt-4o", summarizer=summarizer_hook(load)).collect()
    assert len(done) == 30 and sum(r["was_compressed"] for r in done) == 11
    assert calls.value == 11
