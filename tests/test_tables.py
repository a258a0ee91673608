"""Sources, defaults, filters, folds, reports and maintenance on edge rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.functions import hooks as H
from engram.functions import text as X
from engram.functions import values as N
from engram.operators import aggregates as A
from engram.operators import export as E
from engram.policy import ITEMS_SECTION, STATE_FIELD
from engram.operators import filters as L
from engram.operators import folds as FO
from engram.operators import maintenance as M
from engram.operators import ranking as R
from engram.operators import trigrams as TG
from engram.operators.conversations import build_conversations, conversation_headers, parsed_messages
from engram.sources import tables as S
from engram.sources.shared import shared_folder
from engram.sources.recent_entries import read_recent_entries, write_recent_entries

T0 = datetime(2024, 1, 1)
AS_OF = datetime(2024, 2, 2)


def ago(**d):
    return AS_OF - timedelta(**d)


def test_defaults_and_rejects(spark):
    rows = [("1", "s", "t", None, None), ("2", None, "t", "done", 3), ("3", "s", None, None, None)]
    df = spark.createDataFrame(rows, "id string, session_id string, title string, status string, priority int")
    good, bad = S.apply_defaults(df, "tasks", AS_OF)
    row = good.first()
    assert (row["status"], row["priority"], row["dependencies"], row["progress"]) == ("pending", 0, "[]", 0)
    assert row["created_at"] == AS_OF and row["completed_at"] is None
    assert sorted(r["id"] for r in bad.collect()) == ["2", "3"]
    users, _ = S.apply_defaults(spark.createDataFrame([("u",)], "user_id string"), "user_preferences", AS_OF)
    assert users.first()["preferences"] == {}


def test_dimension_split(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<float>")
    good, bad = S.split_by_dimension(df, "v", 2)
    assert sorted(r["id"] for r in good.collect()) == [1, 3]
    assert [r["id"] for r in bad.collect()] == [2]


MESSAGES = [
    ("array", '[{"role":"user","content":"hi"},{"role":"system","content":"yo"}]', [("user", "hi"), ("system", "yo")]),
    ("plain", "just text", [("user", "just text")]),
    ("object", '{"role":"assistant","content":"one"}', [("assistant", "one")]),
    ("empty", "[]", []),
    ("scalar", "12", [("user", "12")]),
    ("null", None, []),
]


def test_parse_messages(spark):
    df = spark.createDataFrame([m[:2] for m in MESSAGES], "k string, c string")
    found = {}
    for r in parsed_messages(df, "k", "c").orderBy("k", "position").collect():
        found.setdefault(r["k"], []).append((r["role"], r["content"]))
    assert found == {k: v for k, _, v in MESSAGES if v}


def test_conversation_parts_and_headers(spark):
    rows = [("c", t, "user" if t % 2 else "system", f"m{t}") for t in range(25)] + [("d", 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conversation_id string, turn long, role string, text string")
    parts = build_conversations(turns, 10).where("conversation_id = 'c'").orderBy("part").collect()
    assert [len(p["messages"]) for p in parts] == [10, 10, 5]
    assert [m["content"] for p in parts for m in p["messages"]] == [f"m{t}" for t in range(25)]
    heads = {r["conversation_id"]: r for r in conversation_headers(turns, F.col("role") == "system").collect()}
    assert heads["c"]["importance_score"] == pytest.approx(0.8)
    assert heads["c"]["summary"] == "User asked: m1..."
    assert heads["d"]["summary"] == "Conversation" and heads["d"]["importance_score"] == 0.5


def test_message_rules_on_arrays(spark):
    kind = "array<struct<role:string,content:string>>"
    rows = [([],), ([("user", "q" * 150)],), ([("system", "a")] * 4,)]
    df = spark.createDataFrame(rows, f"m {kind}")
    got = df.select(
        X.first_user_summary(F.col("m")).alias("s"), X.importance_score(F.col("m"), F.lit(True)).alias("i")
    ).collect()
    assert [r["s"] for r in got] == ["Conversation", "User asked: " + "q" * 100 + "...", "Conversation"]
    assert [round(r["i"], 6) for r in got] == [0.7, 0.7, 0.8]


def test_text_sizes(spark):
    df = spark.createDataFrame([("",), ("😀" * 9,), ("z" * 501,), ("z" * 500,)], "t string")
    got = df.select(X.estimate_tokens(F.col("t")).alias("n"), F.length(X.truncate_summary(F.col("t"))).alias("l")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (2, 9), (125, 503), (125, 500)]


def test_wildcards_and_overlaps(spark):
    rows = [("1", "100% sure", 0.5, ["a", None]), ("2", "a_b Quote's", None, None), ("3", "axb", 0.9, []), ("4", "MIXed", 0.1, ["b"])]
    facts = spark.createDataFrame(rows, "fact_id string, fact string, confidence double, tags array<string>")

    def ids(df):
        return [r["fact_id"] for r in df.collect()]

    assert ids(L.facts_by_text(facts, "a_b")) == ["2", "3"]
    assert ids(L.facts_by_text(facts, "mixED")) == ["4"]
    assert ids(L.facts_by_text(facts, "0%s")) == ["1"]
    assert ids(L.facts_by_text(facts, "")) == ["2", "3", "1", "4"]
    assert ids(L.facts_by_tags(facts, ["b", "zz"])) == ["4"]
    assert ids(L.facts_by_tags(facts, [])) == []
    flags = facts.orderBy("fact_id").select(L.overlaps("tags", ["zz"]).alias("o")).collect()
    assert [r["o"] for r in flags] == [False] * 4


def test_date_range_includes_both_ends(spark):
    rows = [(str(i), T0 + timedelta(days=i)) for i in range(5)]
    convs = spark.createDataFrame(rows, "conversation_id string, created_at timestamp_ntz")
    found = L.by_date_range(convs, T0 + timedelta(days=1), T0 + timedelta(days=3)).collect()
    assert [r["conversation_id"] for r in found] == ["3", "2", "1"]


def test_positions_equal_row_number(spark):
    rows = [("s", str(i), i % 3 if i % 5 else None, T0 + timedelta(minutes=37 * (i % 11)), True) for i in range(120)]
    items = spark.createDataFrame(rows, "session_id string, id string, priority int, last_accessed timestamp_ntz, is_active boolean")
    got = [r["id"] for r in R.ranked_items(items).orderBy("position").collect()]
    order = sorted(rows, key=lambda r: ((0, 0) if r[2] is None else (1, -r[2]), T0 - r[3], r[1]))
    assert got == [r[1] for r in order]
    assert R.ranked_items(items).agg(F.max("position")).first()[0] == 120


def test_positions_of_one_moment_are_spread(spark):
    """All rows of one session with one priority and one time: every range gets its share, positions go on over ranges."""
    n = 4000
    hot = spark.range(n).selectExpr("'s' AS session_id", "format_string('agent_%05d', id) AS id", "1 AS priority",
                                    "timestamp_ntz'2024-01-01 00:00:00' AS last_accessed", "true AS is_active")
    small = spark.range(30).selectExpr("concat('t', id % 3) AS session_id", "concat('x', id) AS id", "1 AS priority",
                                       "timestamp_ntz'2024-01-01 00:00:00' AS last_accessed", "true AS is_active")
    lone = spark.range(2).selectExpr("CAST(NULL AS STRING) AS session_id", "concat('n', id) AS id", "CAST(NULL AS INT) AS priority",
                                     "CAST(NULL AS TIMESTAMP_NTZ) AS last_accessed", "true AS is_active")
    names = ["spark.sql.adaptive.coalescePartitions.enabled"]
    spark.conf.set(names[0], "false")
    try:
        placed = R.ranked_items(hot.unionByName(small).unionByName(lone)).collect()
        sizes = [r["count"] for r in R.positions(hot.select("session_id", "id"), ["session_id"], [F.asc("id")])
                 .groupBy(F.floor((F.col("position") - 1) / (n / 8))).count().collect()]
        spread = hot.repartitionByRange("session_id", F.asc("id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(names[0])
    assert len(sizes) == 8 and max(r["count"] for r in spread) < n / 4
    got = sorted((r["position"], r["id"]) for r in placed if r["session_id"] == "s")
    assert got == [(i + 1, f"agent_{i:05d}") for i in range(n)]
    assert sorted(r["position"] for r in placed if r["session_id"] == "t1") == list(range(1, 11))
    assert sorted((r["position"], r["id"]) for r in placed if r["session_id"] is None) == [(1, "n0"), (2, "n1")]
    assert R.ranked_items(small.where("false")).collect() == []


def test_null_order_of_limits(spark):
    rows = [("a", None, False), ("b", 0.9, False), ("c", 0.2, True)]
    convs = spark.createDataFrame(rows, "conversation_id string, importance_score double, is_archived boolean")
    convs = convs.withColumn("topics", F.array(F.lit("t")))
    assert [r["conversation_id"] for r in L.by_topics(convs, ["t"], 2).collect()] == ["a", "b"]


def test_upsert_and_idempotence(spark):
    base = spark.createDataFrame([("1", "a", T0), ("2", "b", T0)], "id string, v string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([("2", "B", None), ("3", "c", T0)], base.schema)
    once = S.upsert(base, changes, "id", AS_OF)
    got = {r["id"]: (r["v"], r["updated_at"]) for r in once.collect()}
    assert got == {"1": ("a", T0), "2": ("B", AS_OF), "3": ("c", T0)}
    twice = {r["id"]: r["v"] for r in S.upsert(once, changes, "id", AS_OF).collect()}
    assert twice == {"1": "a", "2": "B", "3": "c"}


def test_recent_entry_files(spark):
    path = shared_folder(spark, "test-wm")
    good, bad = read_recent_entries(spark, path)
    assert good.count() == 0 and bad.count() == 0
    entries = spark.createDataFrame(
        [("c", "u", "s", [("user", "hé")], "2024")],
        "conversation_id string, user_id string, summary string, messages array<struct<role:string,content:string>>, timestamp string",
    )
    write_recent_entries(entries, path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    good, bad = read_recent_entries(spark, path)
    assert good.first()["messages"][0]["content"] == "hé"
    assert [r[0] for r in bad.collect()] == ["{broken"]


def test_snapshot_refuses_overwrite(spark):
    path = shared_folder(spark, "test-snap")
    S.snapshot_tables({"t": spark.range(3)}, path, "r1")
    assert S.read_snapshot(spark, path, "r1", "t").count() == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        S.snapshot_tables({"t": spark.range(3)}, path, "r1")
    stats = S.table_stats({"t": S.read_snapshot(spark, path, "r1", "t")}, with_bytes=True).first()
    assert stats["n_rows"] == 3 and stats["size_bytes"] > 0


def test_unknown_model_is_rejected(spark):
    log = spark.createDataFrame([("s", "gpt-4", 1000, 1000), ("s", "nope", 5, 5)], "session_id string, model string, input_tokens long, output_tokens long")
    known, unknown = A.with_model_limits(log)
    assert known.count() == 1 and [r["model"] for r in unknown.collect()] == ["nope"]
    assert A.token_usage(log).first()["total_cost"] == pytest.approx(0.09)


def test_session_state_edges(spark):
    items = spark.createDataFrame(
        [("a", 9000, 9000, True), ("a", 5, 5, False), ("b", 5, 5, False)],
        "session_id string, token_count int, compressed_token_count int, is_active boolean",
    )
    sessions = spark.createDataFrame([("a", "gpt-4"), ("b", "gpt-4"), ("c", "gpt-4")], "session_id string, model string")
    got = {r["session_id"]: r for r in A.session_state(items, sessions).collect()}
    assert got["a"]["available_context_length"] == -808
    assert got["b"]["used_context_length"] == 0 and got["c"]["active_count"] == 0


def test_performance_metrics(spark):
    rows = [("s", "cache_hits", 2), ("s", "new_name", 1), ("s", "cache_hits", 1)]
    got = A.performance_metrics(spark.createDataFrame(rows, "session_id string, metric string, increment int")).first()
    assert json.loads(got["performance_metrics"]) == {"cache_hits": 3, "compressions": 0, "decompressions": 0, "new_name": 1}


@pytest.mark.parametrize(
    "n,hours,force,want",
    [(24, 23.9, False, False), (25, 1, False, True), (0, 24, False, True), (0, None, False, True), (0, 1, True, True)],
)
def test_training_needed(spark, n, hours, force, want):
    convs = spark.range(max(n, 1)).select(
        F.col("id").cast("string").alias("conversation_id"),
        F.lit(0.7 if n else 0.1).alias("importance_score"),
        F.lit(False).alias("is_archived"),
        F.lit(T0).cast("timestamp_ntz").alias("created_at"),
    )
    rows = [("f", "failed", ago(hours=0))] + ([("t", "completed", ago(hours=hours))] if hours is not None else [])
    history = spark.createDataFrame(rows, "training_id string, status string, completed_at timestamp_ntz")
    assert A.training_needed(convs, history, AS_OF, force).first()["should_train"] is want


def test_summary_strict_and_not(spark):
    rows = [(f"c{i:03d}", AS_OF - timedelta(days=i), 0.5 + i / 1000, ["x"], f"u{i % 2}", "" if i == 0 else f"s{i}") for i in range(150)]
    convs = spark.createDataFrame(
        rows, "conversation_id string, created_at timestamp_ntz, importance_score double, topics array<string>, user_id string, summary string"
    )
    strict = A.summarize_conversations(convs, AS_OF, "day", ["x"], "u0", strict=True).first()
    assert strict["total_conversations"] == 50 and strict["recent_summaries"][0] == "s148"
    loose = A.summarize_conversations(convs, AS_OF, "week", ["x"], "u0", strict=False).first()
    assert loose["total_conversations"] == 4 and loose["recent_summaries"] == ["s2", "s4", "s6"]
    empty = A.summarize_conversations(convs.where("false"), AS_OF).first()
    assert (empty["total_conversations"], empty["average_importance"], empty["top_topics"]) == (0, 0.0, [])
    assert empty["start_date"] == "2000-01-01T00:00:00"


def test_task_fold(spark):
    tasks = spark.createDataFrame(
        [("1", "pending", 0, "{}", None, None)],
        "id string, status string, progress int, metadata string, completed_at timestamp_ntz, updated_at timestamp_ntz",
    )
    rows = [
        ("1", 1, "completed", None, "{}", T0),
        ("1", 2, None, 50, '{"a":1}', T0 + timedelta(1)),
        ("1", 3, "in_progress", None, "{}", T0 + timedelta(2)),
        ("9", 1, "completed", None, None, T0),
    ]
    updates = spark.createDataFrame(rows, "id string, seq int, status string, progress int, metadata string, ts timestamp_ntz")
    current, unknown = FO.task_current(tasks, updates, ["seq"], ["id"])
    row = current.first()
    assert (row["status"], row["progress"], row["metadata"]) == ("in_progress", 50, '{"a":1}')
    assert row["completed_at"] == T0 and row["updated_at"] == T0 + timedelta(2)
    assert [r["id"] for r in unknown.collect()] == ["9"]


def test_access_fold_ignores_wrong_session(spark):
    items = spark.createDataFrame([("1", "a", 2, T0)], "id string, session_id string, access_count int, last_accessed timestamp_ntz")
    log = spark.createDataFrame([("1", "b", AS_OF), ("1", "a", T0 - timedelta(1))], "item_id string, session_id string, ts timestamp_ntz")
    row = FO.access_fold(items, log).first()
    assert (row["access_count"], row["last_accessed"]) == (3, T0)


def test_retrieve_full_or_summary(spark):
    items = spark.createDataFrame([("1", "s", "t", "full", "sum")], "id string, session_id string, content_type string, full_content string, compressed_summary string")
    asked = spark.createDataFrame([("1", "s"), ("1", "s"), ("2", "s")], "id string, session_id string")
    assert [r["content"] for r in FO.retrieve_items(items, asked).collect()] == ["full"]
    assert [r["content"] for r in FO.retrieve_items(items, asked, False).collect()] == ["sum"]


def test_hygiene_edges(spark):
    rows = [
        ("exact7", ago(days=7), 1, 100, 10), ("over7", ago(days=7, seconds=1), 1, 100, 10), ("half", ago(days=8), 1, 20, 10),
        ("exact30", ago(days=30), 4, 1, 1), ("p4", ago(days=31), 4, 1, 1), ("p5", ago(days=31), 5, 1, 1), ("pn", ago(days=31), None, 1, 1),
    ]
    items = spark.createDataFrame(rows, "id string, last_accessed timestamp_ntz, priority int, token_count int, compressed_token_count int")
    items = items.withColumn("is_active", F.lit(True)).withColumn("session_id", F.lit("s"))
    assert [r["id"] for r in M.hygiene_candidates(items, AS_OF).collect()] == ["over7"]
    once = M.prune(items, AS_OF)
    assert [r["id"] for r in once.where("not is_active").collect()] == ["p4"]
    assert M.prune(once, AS_OF).collect() == once.collect()


def test_retention_tiers(spark):
    rows = [("k", 29, 0.1), ("c", 30, 0.1), ("a", 90, 0.1), ("d", 365, 0.1), ("important", 90, 0.5)]
    convs = spark.createDataFrame([(i, ago(days=n), s) for i, n, s in rows], "conversation_id string, created_at timestamp_ntz, importance_score double")
    got = {r["conversation_id"]: r["tier"] for r in M.retention_tiers(convs, AS_OF).collect()}
    assert got == {"k": "keep", "c": "compress", "a": "archive", "d": "delete", "important": "compress"}


def test_quarantine_leaves_items(spark):
    items = spark.createDataFrame([("1", "s", "t", "bad text"), ("2", "s", "t", "good")], "id string, session_id string, content_type string, full_content string")
    isolated = M.quarantine(items, F.contains("full_content", F.lit("bad")), "why", AS_OF)
    row = isolated.first()
    assert (row["isolated_content"], row["token_count"], row["reason_for_isolation"]) == ("bad text", 2, "why")
    assert [r["id"] for r in M.without_quarantined(items, isolated).collect()] == ["2"]
    assert M.thread_collisions(isolated.unionByName(isolated)).count() == 1


def test_hil_answers(spark):
    asked = spark.createDataFrame([("1", "s", None, "pending", None), ("2", "s", None, "pending", None)], "id string, session_id string, response string, status string, answered_at timestamp_ntz")
    given = spark.createDataFrame([("1", "s", "first", T0), ("1", "s", "second", AS_OF), ("7", "s", "lost", T0)], "id string, session_id string, response string, ts timestamp_ntz")
    after, unmatched = M.answer_hil(asked, given)
    got = {r["id"]: (r["response"], r["status"], r["answered_at"]) for r in after.collect()}
    assert got == {"1": ("second", "answered", AS_OF), "2": (None, "pending", None)}
    assert [r["id"] for r in unmatched.collect()] == ["7"]


def test_inserts_and_marks(spark):
    base = spark.createDataFrame([("1", "s", "n", "t", "[]", True)], "id string, session_id string, agent_name string, agent_type string, capabilities string, is_active boolean")
    after, rejected = M.create_agents(base, spark.createDataFrame([("2", "s", "m", "t"), ("3", "s", None, "t")], "id string, session_id string, agent_name string, agent_type string"), AS_OF)
    assert {r["id"]: r["capabilities"] for r in after.collect()} == {"1": "[]", "2": "[]"}
    assert [r["id"] for r in rejected.collect()] == ["3"]
    convs = spark.createDataFrame([("c1", False), ("c2", False)], "conversation_id string, is_archived boolean")
    marked, found = M.mark_archived(convs, spark.createDataFrame([("c2",), ("c9",)], "conversation_id string"))
    assert {r["conversation_id"]: r["is_archived"] for r in marked.collect()} == {"c1": False, "c2": True}
    assert {r["conversation_id"]: r["found"] for r in found.collect()} == {"c2": True, "c9": False}


def test_training_status_found_flags(spark):
    history = spark.createDataFrame([("t1", "running", None, "old")], "training_id string, status string, completed_at timestamp_ntz, error_message string")
    updates = spark.createDataFrame([("t1", "completed", "", T0), ("t1", "failed", "", AS_OF), ("zz", "failed", "x", T0)], "training_id string, status string, error_message string, ts timestamp_ntz")
    after, found = M.training_status(history, updates)
    row = after.first()
    assert (row["status"], row["completed_at"], row["error_message"]) == ("failed", T0, "old")
    assert {r["training_id"]: r["found"] for r in found.collect()} == {"t1": True, "zz": False}


def test_preferences(spark):
    prefs = spark.createDataFrame([("u1", {"a": "1", "b": "2"}, None), ("u2", {}, None)], "user_id string, preferences map<string,string>, updated_at timestamp_ntz")
    changes = spark.createDataFrame([("u1", "a", "9"), ("u3", "x", "y")], "user_id string, key string, value string")
    got = {r["user_id"]: (r["preferences"], r["updated_at"]) for r in M.set_preferences(prefs, changes, AS_OF).collect()}
    assert got == {"u1": ({"a": "9", "b": "2"}, AS_OF), "u2": ({}, None), "u3": ({"x": "y"}, AS_OF)}
    whole = spark.createDataFrame([("u1", {"z": "0"}), ("u9", {"z": "0"})], "user_id string, preferences map<string,string>")
    got = {r["user_id"]: r["preferences"] for r in M.replace_preferences(prefs, whole, AS_OF).collect()}
    assert got == {"u1": {"z": "0"}, "u2": {}}


def test_export_pages(spark):
    when = "2024-01-01 00:00:00"
    items = spark.range(25).select(
        F.lit('s"1').alias("session_id"), F.format_string("i%02d", "id").alias("id"), F.lit("t").alias("content_type"),
        F.lit("sum").alias("compressed_summary"), F.lit("full").alias("full_content"), F.lit(4).alias("token_count"), F.lit(2).alias("compressed_token_count"),
        F.col("id").cast("int").alias("priority"), F.lit(0).alias("access_count"),
        F.lit(when).cast("timestamp_ntz").alias("last_accessed"), F.lit(True).alias("is_active"),
    )
    states = spark.createDataFrame(
        [('s"1', "m", 9, 5, 4, 55.5), ("s2", "m", 9, 0, 9, 0.0)],
        "session_id string, model_name string, total_context_length int, used_context_length int, available_context_length int, context_utilization_percentage double",
    )
    usage = spark.createDataFrame([('s"1', 3, 4, 0.5)], "session_id string, input_tokens long, output_tokens long, total_cost double")
    metrics = spark.createDataFrame([('s"1', '{"cache_hits":2}')], "session_id string, performance_metrics string")
    chosen = spark.createDataFrame([("s2", "slm", True, None)], "session_id string, memory_approach string, use_slm boolean, use_lora_finetuning boolean")
    states = E.state_sections(states, usage, metrics, AS_OF, chosen)
    empty = items.where("false").select("session_id", "id", "priority", F.col("last_accessed").alias("created_at"), "is_active")
    pages = E.export_state(states, items, empty, empty, empty, page_rows=10)
    docs = [json.loads(r["document"]) for r in pages.orderBy("session_id", "section", "page").collect()]
    rows = [row for d in docs if d["section"] == ITEMS_SECTION for row in d["body"]]
    assert [r["priority"] for r in rows] == list(range(24, -1, -1)) and "full_content" not in rows[0]
    assert sorted(d["page"] for d in docs if d["section"] == ITEMS_SECTION) == [0, 1, 2]
    own = {d["session_id"]: d["body"] for d in docs if d["section"] == "session_state"}
    assert own['s"1'][STATE_FIELD]["token_usage"] == {"input_tokens": 3, "output_tokens": 4, "total_cost": 0.5}
    assert own['s"1'][STATE_FIELD]["performance_metrics"] == {"cache_hits": 2} and own["s2"][STATE_FIELD]["token_usage"] == {}
    assert (own["s2"]["use_slm"], own["s2"]["use_lora_finetuning"]) == (True, False)
    path = shared_folder(spark, "test-export")
    E.write_export(pages, path)
    assert E.read_export(spark, path).count() == len(docs)


def test_store_facts(spark):
    given = spark.createDataFrame([("fact one", 0.7, None, None)], "content string, importance double, tags array<string>, user_id string")
    convs, facts = M.store_facts(given, AS_OF)
    c, f = convs.first(), facts.first()
    assert c["conversation_id"] == f["conversation_id"] and c["importance_score"] == 0.3
    assert (c["messages"][0]["role"], f["confidence"], f["tags"]) == ("system", 0.7, [])


def test_hooks(spark):
    df = spark.createDataFrame([("one two",), (None,), ("boom",), ("",)], "t string")
    count = H.tokenizer_hook(lambda s: s.str.split().str.len())
    assert [r[0] for r in df.select(count(F.col("t"))).collect()] == [2, None, 1, 0]

    def load():
        def model(texts):
            if (texts == "boom").any():
                raise RuntimeError("model failed")
            return texts.map(lambda t: [float(len(t))])

        return model

    vectors = [r[0] for r in df.select(H.embedder_hook(load)(F.col("t"))).collect()]
    assert vectors == [[7.0], None, None, [0.0]]
    new = H.embed_new_texts(df, "t", H.embedder_hook(load), H.embed_new_texts(df.where("t = ''"), "t", H.embedder_hook(load)))
    assert sorted(map(str, (r["embedding"] for r in new.collect()))) == ["None", "[7.0]"]


def test_small_values(spark):
    row = spark.range(1).select(
        N.iso_timestamp(F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).alias("a"),
        N.iso_timestamp(F.lit("2024-01-01 10:00:00.5").cast("timestamp_ntz")).alias("b"),
        X.thread_id(F.lit("x")).alias("t"),
        X.compress_target(F.lit(29), F.lit(0.1)).alias("n"),
    ).first()
    assert (row["a"], row["b"], row["n"]) == ("2024-01-01T10:00:00", "2024-01-01T10:00:00.500000", 2)
    assert len(row["t"]) == len("thread_") + 8
    assert N.range_start("year", AS_OF) == datetime(2000, 1, 1)


def test_store_conversations(spark):
    rows = [('[{"role":"assistant","content":"a"}]', 0.9, ["t"], "u"), ("plain", None, None, None)]
    given = spark.createDataFrame(rows, "content string, importance double, tags array<string>, user_id string")
    got = {r["user_id"]: r for r in M.store_conversations(given, AS_OF).collect()}
    assert got["u"]["messages"][0]["role"] == "assistant" and got["u"]["topics"] == ["t"]
    assert got[None]["importance_score"] == 0.5 and got[None]["messages"][0]["content"] == "plain"


def test_patterns_equal_a_nested_loop(spark):
    texts = ["The quick brown fox", "100% sure", "a_b and a\\b", "QUICKLY done", "ab", "", None, "xquixck", "naïve Überfox", "the the the"]
    facts = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("f0b", texts[0])], "fact_id string, fact string")
    patterns = ["quick", "THE", "q%k", "100\\%", "a\\_b", "a_b", "fox", "zzz", "ab", "%", "", "brown fox", "überfox", "'", "qui_k", None]
    asked = spark.createDataFrame([(p,) for p in [*patterns, "fox"]], "pattern string")
    got = sorted((r["pattern"], r["fact_id"]) for r in TG.facts_by_patterns(facts, TG.trigrams(facts), asked).collect())
    want = []
    for p in patterns:
        if p is not None:
            want += [(p, r["fact_id"]) for r in facts.where(F.col("fact").ilike(f"%{p}%")).collect()]
    assert got == sorted(want) and ("q%k", "f7") in got and len(got) > 30
    assert TG.facts_by_patterns(facts.where("false"), TG.trigrams(facts.where("false")), asked).collect() == []


def test_patterns_are_searched_for_in_linear_time(spark):
    """``holds`` is ILIKE for every kind of text and pattern, without its backtracking over a long text."""
    texts = ["The ΣΑΣ", "İstanbul", "STRASSE straße", "a\\b", "a%b", "a_b", "\U0001f600ab x\U0001f600aB", "", "line\nbreak"]
    patterns = ["the", "σας", "ΣΑ", "i", "İS", "SS", "ß", "a\\\\b", "a\\%b", "a_b", "%", "", "\U0001f600AB", "E\nB", "e_b", "t%Σ", "s%sse s%e", "_T%_", "a%%b", "i_T.*", "%x__b%"]
    both = spark.createDataFrame([(t, p) for t in texts for p in patterns], "t string, p string")
    same = F.col("a").eqNullSafe(F.col("b"))
    checked = both.select("t", "p", TG.holds(F.col("t"), F.col("p")).alias("a"), F.expr("t ILIKE concat('%', p, '%')").alias("b"))
    assert checked.where(~same).collect() == [] and checked.where("a").count() > 20
    # Quadratic steps, here 10 ** 10, would not end within the time of a test.
    assert spark.range(1).select(TG.holds(F.repeat(F.lit("a"), 100_000), F.lit("a%ing%a%ing"))).first()[0] is False
    grams = [r[0] for r in spark.createDataFrame([("ABCAbc",), ("ab",), ("\U0001f600",)], "t string").select(TG.grams_of(F.col("t"))).collect()]
    assert grams == [["abc", "bca", "cab"], [], []]
