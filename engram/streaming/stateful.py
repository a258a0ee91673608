"""Streams that keep state per key: access counts, last-N rings, ingest."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from engram.operators.filters import newest
from engram.operators.ingest import ingest_items
from engram.operators.ranking import top_per_group
from engram.policy import POLICY, model_limits
from engram.streaming.batch_log import TieredLog, write_batch

ACCESS = "item_id string, session_id string, reads long, last_read timestamp_ntz"
RING = "user_id string, conversation_id string, created_at timestamp_ntz, summary string"
USAGE = "session_id string, used long"
RING_SALTS = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run over what is there now and stop; the caller waits for the end."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_log(spark: SparkSession, path: str) -> TieredLog:
    """Reads and last read per item and batch, summed where batches are folded."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("item_id", "session_id").agg(
            F.sum("reads").alias("reads"), F.max("last_read").alias("last_read"), F.max("batch_id").alias("batch_id")
        )

    return TieredLog(spark, path, ACCESS, fold)


def access_counts(log: DataFrame, path: str) -> DataStreamWriter:
    """Reads and last read per item and batch, written to a tiered log."""

    def save(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy("item_id", "session_id").agg(
            F.count(F.lit(1)).alias("reads"), F.max("ts").alias("last_read")
        )
        access_log(batch.sparkSession, path).write(counted, batch_id)

    return log.writeStream.foreachBatch(save)


def access_totals(spark: SparkSession, path: str) -> DataFrame:
    """Running totals over all batches so far."""
    return access_log(spark, path).totals()


class Ring(StatefulProcessor):
    """The last n conversations of a key in map state, an entry per conversation; emits what changed in it.

    A conversation seen again replaces its entry. With a time to live, entries
    not touched for so long (processing time) leave the state by themselves.
    """

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "created_at long, summary string"
        self.held = handle.getMapState("ring", "conversation_id string", value, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if self.held.exists() else {}
        before = dict(ring)
        for chunk in rows:
            times = chunk["created_at"].astype("datetime64[us]")
            # A time that is missing is the newest, as in every falling order.
            micros = [None if t is pd.NaT else int(t.value // 1000) for t in times.map(pd.Timestamp)]
            arrived = zip(chunk["conversation_id"], micros, chunk["summary"], strict=True)
            ring.update((c, (t, None if pd.isna(s) else s)) for c, t, s in arrived)
            first = sorted(ring, key=lambda c: (ring[c][0] is not None, -(ring[c][0] or 0), c))[: self.n]
            ring = {c: ring[c] for c in first}
        for gone in before.keys() - ring.keys():
            self.held.removeKey((gone,))
        changed = [c for c in ring if before.get(c) != ring[c]]
        for c in changed:
            self.held.updateValue((c,), ring[c])
        user = key[0]
        yield pd.DataFrame(
            {
                "user_id": pd.Series([user] * len(changed), dtype=object),
                "conversation_id": pd.Series(changed, dtype=object),
                "created_at": pd.Series([pd.NaT if ring[c][0] is None else pd.Timestamp(ring[c][0], unit="us") for c in changed], dtype="datetime64[us]"),
                "summary": pd.Series([ring[c][1] for c in changed], dtype=object),
            }
        )

    def close(self) -> None:
        pass


def ring_updates(
    conversations: DataFrame, n: int = POLICY.ring_size, salts: int = RING_SALTS, ttl_ms: int | None = None
) -> DataFrame:
    """Conversations that come into, or change in, the last n per (user, salt).

    A user is cut into ``salts`` rings so that a busy one is kept by several
    tasks; the last n of the user are among the rings' rows (``last_n_of``).
    State is kept in RocksDB, entry by entry: what a batch does not change is
    neither read into Python's memory for other keys nor written again.
    """
    conf = conversations.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if ttl_ms is not None:
        # A stream by processing time would otherwise run empty batches without end; entries expire with the next rows.
        conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    salted = conversations.select(
        "user_id",
        F.pmod(F.xxhash64("conversation_id"), F.lit(salts)).alias("salt"),
        "conversation_id",
        "created_at",
        "summary",
    )
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return salted.groupBy("user_id", "salt").transformWithStateInPandas(Ring(n, ttl_ms), RING, "Update", mode)


def _newest_states(rows: DataFrame) -> DataFrame:
    """The newest state of each conversation of a user."""
    state = F.max_by(F.struct("created_at", "summary", "batch_id"), F.struct("batch_id", "created_at", "summary")).alias("s")
    seen = rows.groupBy("user_id", "conversation_id").agg(state)
    return seen.select("user_id", "conversation_id", "s.created_at", "s.summary", "s.batch_id")


def _newest_rows(states: DataFrame, n: int) -> DataFrame:
    return top_per_group(states, ["user_id"], [newest("created_at"), F.asc("conversation_id")], n).drop("position")


def ring_batches(spark: SparkSession, path: str, n: int = POLICY.ring_size) -> TieredLog:
    """Ring changes per batch; folded to the newest state of each user's last n."""
    return TieredLog(spark, path, RING, lambda rows: _newest_rows(_newest_states(rows), n))


def ring_log(
    conversations: DataFrame, path: str, n: int = POLICY.ring_size, ttl_ms: int | None = None
) -> DataStreamWriter:
    """The last n conversations per user as a tiered log.

    A batch is cut to each user's last n and to what it says of conversations
    already among the last n; the log folds batches the same way, so it is all
    the state there is, and a busy user is cut before it is gathered. Only
    entries with a time to live need rings in a state store (``ring_updates``),
    which costs a call per entry.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        log = ring_batches(batch.sparkSession, path, n)
        states = _newest_states(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        held = log.totals(before=batch_id).select(F.col("user_id").alias("_user"), F.col("conversation_id").alias("_held"))
        again = states.join(
            held, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("conversation_id").eqNullSafe(F.col("_held")), "left_semi"
        )
        log.write(_newest_rows(states, n).unionByName(again).distinct(), batch_id)

    def save_changes(batch: DataFrame, batch_id: int) -> None:
        ring_batches(batch.sparkSession, path, n).write(batch, batch_id)

    if ttl_ms is None:
        return conversations.writeStream.foreachBatch(save)
    return ring_updates(conversations, n, ttl_ms=ttl_ms).writeStream.outputMode("update").foreachBatch(save_changes)


def last_n_of(spark: SparkSession, path: str, n: int = POLICY.ring_size) -> DataFrame:
    """The last n conversations per user out of the written rings; of one seen again its newest state counts."""
    rows = ring_batches(spark, path, n).totals()
    return top_per_group(rows, ["user_id"], [newest("created_at"), F.asc("conversation_id")], n)


def ingest_stream(new_items: DataFrame, model: str, items_path: str, usage_path: str) -> DataStreamWriter:
    """Each batch is ingested with what its sessions used before it, read from the tiers of the usage log.

    The batch's own totals are read back from the written items, so the texts
    are summarized once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        usage = usage_log(spark, usage_path)
        done = ingest_items(batch, model, usage.totals(before=batch_id))
        write_batch(done, items_path, batch_id)
        written = spark.read.schema(done.schema).parquet(f"{items_path}/batch_id={batch_id}")
        usage.write(written.groupBy("session_id").agg(F.sum("compressed_token_count").alias("used")), batch_id)

    return new_items.writeStream.foreachBatch(save)


def usage_log(spark: SparkSession, path: str) -> TieredLog:
    """Tokens each session took per batch."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session_id").agg(F.sum("used").alias("used"), F.max("batch_id").alias("batch_id"))

    return TieredLog(spark, path, USAGE, fold)


def session_usage(spark: SparkSession, usage_path: str) -> DataFrame:
    return usage_log(spark, usage_path).totals()


def utilization_alarms(spark: SparkSession, usage_path: str, model: str) -> DataFrame:
    """Sessions over the compression trigger of the model."""
    limits = model_limits(model)
    percent = (F.col("used") / F.lit(limits.context_length) * 100).alias("utilization")
    usage = session_usage(spark, usage_path).select("session_id", "used", percent)
    return usage.where(F.col("utilization") > limits.compression_trigger * 100)
