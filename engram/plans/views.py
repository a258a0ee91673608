"""The supplied tables seen as the engine's tables.

These views are inputs of the registered queries, the same rows as the SQL
views in ``sql_views``.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import compress_target, default_summary, estimate_tokens, tokens_of_length
from engram.operators.conversations import build_conversations, conversation_headers
from engram.policy import MODELS, POLICY, strategy_ratio

AS_OF = datetime(2024, 2, 2)
MODEL_NAMES = sorted(row[0] for row in MODELS)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def _after_start(amount, unit: str):
    return F.timestamp_add(unit, amount.cast("int"), _start())


def _session(key) -> Column:
    return F.concat(F.lit("s"), (key % 8).cast("string"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def memory_items(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Documents as items; the stored sizes come from n_chars, so the text is read only where used."""
    doc = F.col("doc_id")
    tokens = tokens_of_length(F.col("n_chars"))
    target = compress_target(tokens, F.lit(strategy_ratio("balanced")))
    shown = F.when(F.col("n_chars") > POLICY.summary_chars, POLICY.summary_chars + 3).otherwise(F.col("n_chars"))
    summary_tokens = F.when(tokens > POLICY.always_compress_above, target).otherwise(tokens_of_length(shown))
    docs = raw(spark, sf_dir, "documents")
    items = docs.select(
        doc.cast("string").alias("id"),
        _session(doc).alias("session_id"),
        F.col("source").alias("content_type"),
        F.col("text").alias("full_content"),
        default_summary(F.col("text"), tokens).alias("compressed_summary"),
        tokens.alias("token_count"),
        summary_tokens.cast("int").alias("compressed_token_count"),
        F.when(doc % 97 == 0, None).otherwise(doc % 11).cast("int").alias("priority"),
        (doc % 13 != 0).alias("is_active"),
        F.lit(0).alias("access_count"),
        _after_start(doc, "MINUTE").alias("created_at"),
        _after_start((doc * 7919) % 43200, "MINUTE").alias("last_accessed"),
        doc.alias("_key"),
    )
    if vectors:
        v = _vectors(spark, sf_dir)
        items = items.join(v, items["_key"] == v["vec_id"], "left").drop("vec_id")
    return items.drop("_key")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"), "conv_id", "turn", "role", "text"
    )


def conversations(
    spark: SparkSession, sf_dir: str, messages: bool = False, vectors: bool = False
) -> DataFrame:
    said = turns(spark, sf_dir)
    heads = conversation_headers(said, F.col("role") == "system")
    conv = F.col("conversation_id").cast("bigint")

    def topic(n):
        return F.concat(F.lit("t"), (conv % n).cast("string"))

    table = heads.select(
        "conversation_id",
        _after_start(conv * 7, "HOUR").alias("created_at"),
        F.when(conv % 10 == 0, None).otherwise(F.concat(F.lit("u"), (conv % 7).cast("string"))).alias("user_id"),
        F.when(conv % 17 == 0, None).otherwise(F.array(topic(5), topic(3))).alias("topics"),
        "importance_score",
        "summary",
        (conv % 9 == 0).alias("is_archived"),
        F.lit(False).alias("is_compressed"),
    )
    if messages:
        table = table.join(build_conversations(said).drop("part"), "conversation_id")
    if vectors:
        v = _vectors(spark, sf_dir).withColumn("conversation_id", F.col("vec_id").cast("string"))
        table = table.join(v.drop("vec_id"), "conversation_id", "left")
    return table


def memory_facts(spark: SparkSession, sf_dir: str, vectors: bool = False, all_documents: bool = False) -> DataFrame:
    """Labelled documents as facts; with ``all_documents`` the unlabelled ones have no confidence."""
    labels = raw(spark, sf_dir, "labels")
    confidence = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.9).when(
        F.col("quality") == 1, 0.6
    )
    docs = raw(spark, sf_dir, "documents").join(labels, "doc_id", "left" if all_documents else "inner")
    facts = docs.select(
        F.col("doc_id").cast("string").alias("fact_id"),
        (F.col("doc_id") % 120).cast("string").alias("conversation_id"),
        F.substring_index("text", "\n", 1).alias("fact"),
        F.when(F.col("quality").isNotNull(), F.coalesce(confidence, F.lit(0.4))).alias("confidence"),
        F.array("lang", "source").alias("tags"),
        _after_start(F.col("doc_id"), "MINUTE").alias("created_at"),
    )
    if vectors:
        v = _vectors(spark, sf_dir).withColumn("fact_id", F.col("vec_id").cast("string"))
        facts = facts.join(v.drop("vec_id"), "fact_id", "left")
    return facts


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a query of its session, with topics."""
    vec = F.col("vec_id")
    return raw(spark, sf_dir, "embeddings").select(
        vec.cast("string").alias("query_id"),
        _session(vec).alias("session_id"),
        "embedding",
        F.array(
            F.concat(F.lit("t"), (vec % 5).cast("string")), F.concat(F.lit("t"), ((vec + 1) % 5).cast("string"))
        ).alias("topics"),
    )



def access_log(source: DataFrame) -> DataFrame:
    """View and click events as reads; ``source`` is the events table or stream."""
    return source.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("item_id"),
        _session(F.col("user_id")).alias("session_id"),
        (F.col("event_type") == "click").alias("decompress"),
        "ts",
    )


def token_log(source: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return source.select(
        F.col("event_id").cast("string").alias("event_id"),
        _session(F.col("user_id")).alias("session_id"),
        F.element_at(names, (F.col("user_id") % len(MODEL_NAMES) + 1).cast("int")).alias("model"),
        (k * 100).alias("input_tokens"),
        (k * 10).alias("output_tokens"),
        "ts",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "P", "in_progress")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("pending")
    )
    return raw(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        _session(F.col("o_custkey")).alias("session_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        status.alias("status"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_custkey").cast("string").alias("assigned_agent"),
        F.lit(0).alias("progress"),
        F.lit("{}").alias("metadata"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )


# The order of a task's updates; these columns stand for the sequence number of the log.
UPDATE_ORDER = ["ts", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def task_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return raw(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(line % 3 != 0, line * 10).alias("progress"),
        F.when(F.col("l_linestatus") == "F", "completed").alias("status"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("l_shipdate").alias("ts"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        _session(F.col("s_suppkey")).alias("session_id"),
        F.col("s_name").alias("agent_name"),
        F.concat(F.lit("type"), (F.col("s_nationkey") % 4).cast("string")).alias("agent_type"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )


def context_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = raw(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    doc = F.col("doc_id")
    return raw(spark, sf_dir, "documents").join(labels, "doc_id").select(
        doc.cast("string").alias("id"),
        _session(doc).alias("session_id"),
        F.concat(F.lit("thread_"), F.substring(F.md5(doc.cast("string")), 1, 8)).alias("thread_id"),
        F.col("source").alias("context_type"),
        F.col("text").alias("isolated_content"),
        F.lit("toxic label").alias("reason_for_isolation"),
        estimate_tokens(F.col("text")).alias("token_count"),
        F.lit(True).alias("is_active"),
        _after_start(doc, "MINUTE").alias("created_at"),
    )


def hil_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.col("event_id").cast("string").alias("id"),
        _session(F.col("user_id")).alias("session_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("question"),
        F.lit(None).cast("string").alias("response"),
        F.when(F.col("value") > 50, "answered").otherwise("pending").alias("status"),
        (F.col("user_id") % 5).cast("int").alias("priority"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("answered_at"),
    )


def hil_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as responses to the request ten events before them, many naming another session than the request's."""
    return raw(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        (F.col("event_id") - 10).cast("string").alias("id"),
        _session(F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))).alias("session_id"),
        F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("response"),
        "ts",
    )


def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    region = F.col("n_regionkey")
    started = _after_start(n, "DAY")
    status = (
        F.when(region.isin(0, 4), "completed")
        .when(region == 1, "failed")
        .when(region == 2, "running")
        .otherwise("pending")
    )
    return raw(spark, sf_dir, "nation").select(
        F.concat(F.lit("train_"), n.cast("string")).alias("training_id"),
        started.alias("started_at"),
        F.when(region.isin(0, 4), F.timestamp_add("HOUR", F.lit(1), started)).alias("completed_at"),
        (n + 25).cast("int").alias("num_conversations"),
        status.alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def user_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.create_map(
            F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")
        ).alias("preferences"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def session_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the items, each with a model of the list by its number."""
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    sessions = memory_items(spark, sf_dir).select("session_id").distinct()
    number = F.substring("session_id", 2, 9).cast("int")
    return sessions.select("session_id", F.element_at(names, number % len(MODEL_NAMES) + 1).alias("model"))
