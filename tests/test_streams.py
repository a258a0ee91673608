"""Streams against their batch forms, late rows and replayed batches."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.operators import aggregates as A
from engram.operators.ingest import ingest_items
from engram.plans import stream_queries  # noqa: F401
from engram.plans.registry import QUERIES
from engram.sources.shared import shared_folder
from engram.streaming import rollups as RO
from engram.streaming import stateful as ST
from engram.streaming.batch_log import TieredLog

SF_DIR = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 1)
LOG = "event_id string, session_id string, model string, input_tokens long, output_tokens long, ts timestamp_ntz"


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{name}")


def stream(spark, path, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    )


def run(writer, path):
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def to_files(df, path):
    run(df.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), path)


def test_usage_drops_only_late_rows(spark):
    path = shared_folder(spark, "test-t1")
    base = [(str(i), f"s{i % 2}", "gpt-4", 1000, 100, T0 + timedelta(minutes=10 * i)) for i in range(60)]
    put(spark, path, "a", base, LOG)
    # Spark compares a batch with the watermark known one batch earlier.
    put(spark, path, "a2", [("mid", "s0", "gpt-4", 1000, 100, T0 + timedelta(minutes=595))], LOG)
    late = [("late", "s0", "gpt-4", 10**6, 0, T0), ("inside", "s0", "gpt-4", 7, 0, T0 + timedelta(hours=9, minutes=20))]
    put(spark, path, "b", late, LOG)
    put(spark, path, "c", [("end", "s9", "gpt-4", 1, 1, T0 + timedelta(days=2))], LOG)
    # Files are taken in the order of their time; make that the order written.
    df = RO.usage_by_window(stream(spark, path, LOG))
    to_files(df, path)
    rows = spark.read.schema(df.schema).parquet(f"{path}/out").collect()
    assert sum(r["input_tokens"] for r in rows) == 61 * 1000 + 7
    assert len({(r["window_start"], r["session_id"]) for r in rows}) == len(rows)


def test_access_totals_parity_and_replay(spark):
    path = shared_folder(spark, "test-t2")
    rng = random.Random(1)
    schema = "event_id string, item_id string, session_id string, ts timestamp_ntz"
    rows = [(str(i), f"i{rng.randint(0, 5)}", "s", T0 + timedelta(seconds=rng.randint(0, 999))) for i in range(90)]
    for n in range(3):
        put(spark, path, f"f{n}", rows[n * 30 : n * 30 + 30], schema)
    run(ST.access_counts(stream(spark, path, schema), f"{path}/log"), path)
    want = {}
    for _, item, _, ts in rows:
        reads, last = want.get(item, (0, T0))
        want[item] = (reads + 1, max(last, ts))

    def got(where):
        return {r["item_id"]: (r["reads"], r["last_read"]) for r in ST.access_totals(spark, where).collect()}

    assert got(f"{path}/log") == want
    log = ST.access_log(spark, f"{path}/log")
    again = log.read().where("batch_id = 2").drop("batch_id").collect()
    log.write(spark.createDataFrame(again, ST.ACCESS), 2)
    assert got(f"{path}/log") == want


def test_a_log_of_many_batches_is_read_from_few_folders(spark):
    """120 batches: every read opens a bounded number of folders and sums all rows once, replays and lost runs included."""
    path = shared_folder(spark, "test-log")

    def fold(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("batch_id").alias("batch_id"))

    log = TieredLog(spark, path, "k string, n long", fold, fan=4)
    want, widest, retired = {}, 0, 0
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").coalesce(1)
    for batch in range(120):
        rows = one.selectExpr(f"concat(k, {batch % 3}) AS k", "n")
        log.write(rows, batch)
        for k, n in ((f"a{batch % 3}", 1), (f"b{batch % 3}", 2)):
            want[k] = want.get(k, 0) + n
        if batch % 20 == 19:
            retired += log.retire()
            widest = max(widest, len(list(log.cover(before=batch))))
        if batch == 68:
            # A run whose write was not committed does not count and is written again.
            import os

            os.remove(f"{path.removeprefix('file://')}/{log.name(1, 64)}/_SUCCESS")
            assert {r["k"]: r["n"] for r in log.totals().collect()} == want
            log.write(rows, batch)
    assert widest <= 3 * 4 + 4
    assert {r["k"]: r["n"] for r in log.totals().collect()} == want
    assert retired > 80 and len(log.finished()) < 60
    assert {r["k"]: r["n"] for r in log.totals().collect()} == want
    log.write(rows, 119)
    assert {r["k"]: r["n"] for r in log.totals().collect()} == want


@pytest.mark.parametrize(("ttl", "second"), [(600_000, ["c2"]), (50, ["c2", "c3"])])
def test_ring_entries_expire_and_only_changes_are_emitted(spark, ttl, second):
    path = shared_folder(spark, "test-t3-ttl")
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    emitted = []

    def step(name, rows):
        put(spark, path, name, rows, ST.RING)
        source = session.readStream.schema(ST.RING).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        rings = ST.ring_updates(source, 2, salts=1, ttl_ms=ttl)
        emitted.clear()
        run(rings.writeStream.outputMode("update").foreachBatch(lambda df, _: emitted.extend(r["conversation_id"] for r in df.collect())), path)
        return sorted(emitted)

    assert step("f0", [("u", "c0", T0 + timedelta(minutes=10), "s"), ("u", "c1", T0 + timedelta(minutes=9), "s")]) == ["c0", "c1"]
    time.sleep(0.1)
    # Of four the newest two are kept; where the first two have expired, there are only the new ones.
    assert step("f1", [("u", "c2", T0 + timedelta(minutes=9, seconds=30), "s"), ("u", "c3", T0, "s")]) == second


def test_rings_over_batches(spark):
    path = shared_folder(spark, "test-t3")
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "u1", None]), f"c{i:03d}", T0 + timedelta(minutes=rng.randint(0, 500)), f"s{i}") for i in range(120)]
    for n in range(3):
        put(spark, path, f"f{n}", rows[n * 40 : n * 40 + 40], ST.RING)
    run(ST.ring_log(stream(spark, path, ST.RING), f"{path}/log", 4), path)
    found = {}
    for r in ST.last_n_of(spark, f"{path}/log", 4).orderBy("position").collect():
        found.setdefault(r["user_id"], []).append(r["conversation_id"])
    for user in ("hot", "u1", None):
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (T0 - r[2], r[1]))[:4]
        assert found[user] == [r[1] for r in mine]


def test_a_conversation_seen_again_counts_once(spark):
    path = shared_folder(spark, "test-t3-again")
    first = [("u", f"c{i}", T0 + timedelta(minutes=i), "old") for i in range(4)]
    put(spark, path, "f0", first, ST.RING)
    put(spark, path, "f1", [("u", "c3", T0 + timedelta(minutes=9), "new")], ST.RING)
    run(ST.ring_log(stream(spark, path, ST.RING), f"{path}/log", 3), path)
    rows = ST.last_n_of(spark, f"{path}/log", 3).orderBy("position").collect()
    assert [(r["conversation_id"], r["summary"]) for r in rows] == [("c3", "new"), ("c2", "old"), ("c1", "old")]


def test_the_last_n_need_no_state_store(spark):
    """The log is the only state, and what a batch says of a held conversation counts, also beyond the batch's last n."""
    path = shared_folder(spark, "test-t3-log")
    at = lambda hours: T0 + timedelta(hours=hours)
    put(spark, path, "f0", [(u, f"c{i}", at(i), "old") for i in range(1, 5) for u in ("u", None)], ST.RING)
    put(spark, path, "f1", [("u", "c5", at(9), "s"), ("u", "c6", at(0.5), "s"), ("u", "c7", at(0.4), "s"), ("u", "c4", at(0.1), "s")], ST.RING)
    run(ST.ring_log(stream(spark, path, ST.RING), f"{path}/log", 3), path)
    rows = ST.last_n_of(spark, f"{path}/log", 3).orderBy("position").collect()
    assert [r["conversation_id"] for r in rows if r["user_id"]] == ["c5", "c3", "c2"]
    assert [r["conversation_id"] for r in rows if not r["user_id"]] == ["c4", "c3", "c2"]
    assert not os.path.exists(f"{path.removeprefix('file://')}/checkpoint/state")


def test_ingest_stream_equals_batch(spark):
    path = shared_folder(spark, "test-t4")
    schema = "id string, session_id string, arrived_at timestamp_ntz, full_content string"
    rng = random.Random(3)
    rows = [(f"{i:03d}", f"s{i % 3 if i % 2 else 0}", T0 + timedelta(minutes=i), "w" * rng.choice([10, 499, 900, 8400])) for i in range(150)]
    for n in range(3):
        put(spark, path, f"f{n}", rows[n * 50 : n * 50 + 50], schema)
    run(ST.ingest_stream(stream(spark, path, schema), "gpt-4", f"{path}/items", f"{path}/usage"), path)
    columns = ["id", "over_trigger", "compressed_summary"]
    streamed = spark.read.parquet(f"{path}/items").select(columns)
    whole = ingest_items(spark.createDataFrame(rows, schema), "gpt-4")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert whole.where("over_trigger").count() > 0
    alarms = {r["session_id"] for r in ST.utilization_alarms(spark, f"{path}/usage", "gpt-4").collect()}
    used = whole.groupBy("session_id").agg(F.sum("compressed_token_count").alias("u"))
    assert alarms == {r["session_id"] for r in used.where(F.col("u") / 8192 * 100 > 75).collect()}


@pytest.mark.parametrize("name", ["t4_ingest_stream", "t4_utilization_alarms"])
def test_a_table_in_many_files_is_streamed_whole(spark, name):
    """The same rows, stored as one file and as a folder of files, give the same result."""
    folder = shared_folder(spark, "test-folders")
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(f"{folder}/{table}.parquet")
    of_file, of_folder = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (SF_DIR, folder))
    assert of_file == of_folder and of_file


def test_daily_stats_parity(spark):
    path = shared_folder(spark, "test-t5")
    schema = "conversation_id string, created_at timestamp_ntz, importance_score double, user_id string"
    rows = [(str(i), T0 + timedelta(hours=i), (i % 10) / 10, f"u{i % 9}" if i % 4 else None) for i in range(24 * 4)]
    put(spark, path, "a", rows, schema)
    df = RO.daily_conversation_stats(stream(spark, path, schema))
    to_files(df, path)
    streamed = {r["date"]: r for r in spark.read.schema(df.schema).parquet(f"{path}/out").collect()}
    batch = {r["date"]: r for r in A.conversation_stats(spark.createDataFrame(rows, schema)).collect()}
    assert len(streamed) == 3 and set(streamed) < set(batch)
    sketches = RO.daily_user_sketches(spark.createDataFrame(rows, schema))
    # Sketches of two halves of a day unite to the day's users; rows without user do not count.
    halves = [spark.createDataFrame(rows[k::2], schema) for k in (0, 1)]
    parts = RO.daily_user_sketches(halves[0]).unionByName(RO.daily_user_sketches(halves[1]))
    for unit, n in (("day", None), ("month", 9)):
        whole, united = ({r["start"]: r["users"] for r in RO.distinct_users(s, unit).collect()} for s in (sketches, parts))
        assert whole == united and (n is None or list(whole.values()) == [n])
    for day, row in streamed.items():
        assert row["total_conversations"] == batch[day]["total_conversations"] == 24
        assert abs(row["avg_importance"] - batch[day]["avg_importance"]) < 1e-9
        assert abs(row["unique_users"] - batch[day]["unique_users"]) <= 1
