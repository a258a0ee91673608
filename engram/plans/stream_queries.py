"""Registered queries that replay the supplied tables as streams to their end."""

from pyspark.sql import functions as F

from engram.plans import views as V
from engram.plans.item_queries import PACKING_MODEL, arrivals
from engram.plans.registry import query, r6, sql_stamp, stamp
from engram.sources.shared import settled, shared_folder
from engram.streaming import rollups as RO
from engram.streaming import stateful as ST

def replay_session(spark):
    """A session of one shuffle partition per core.

    A stateful stream keeps a state store per shuffle partition from its first
    batch on, so the number is set for the stream and not taken from the batch jobs.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def stream_of(spark, d, name):
    """A table as a stream, stored as one file or as a folder of files: only a pattern of paths may name either."""
    schema = V.raw(spark, d, name).schema
    return replay_session(spark).readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def appended(spark, d, roll_up, purpose):
    """All windows of a roll-up of the events: those the stream appends through a file sink, then those open at its end."""
    path = shared_folder(spark, purpose)
    df = roll_up(stream_of(spark, d, "events"))
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    query = ST.start_available(writer, f"{path}/checkpoint")
    query.awaitTermination()
    closed = spark.read.schema(df.schema).parquet(f"{path}/out")
    return closed.unionByName(RO.still_open(roll_up(V.raw(spark, d, "events")), query, "window_end"))


def finished(spark, writer, path):
    ST.start_available(writer, f"{path}/checkpoint").awaitTermination()


@query(
    "t1_usage_by_window",
    f"""SELECT {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, session_id,
        CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
        round(sum(input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output), 9) AS total_cost,
        count(*) AS n_events
    FROM token_log JOIN models USING (model)
    GROUP BY time_bucket(INTERVAL 1 HOUR, ts), session_id""",
    ["token_log", "models"],
)
def t1(spark, d):
    return appended(spark, d, lambda events: RO.usage_by_window(V.token_log(events)), "t1").select(
        stamp(F.col("window_start")).alias("window_start"),
        "session_id",
        "input_tokens",
        "output_tokens",
        F.round("total_cost", 9).alias("total_cost"),
        "n_events",
    )


@query(
    "t2_access_totals",
    f"""SELECT item_id, session_id, count(*) AS reads, {sql_stamp('max(ts)')} AS last_read
    FROM access_log GROUP BY item_id, session_id""",
    ["access_log"],
)
def t2(spark, d):
    path = shared_folder(spark, "t2")
    finished(spark, ST.access_counts(V.access_log(stream_of(spark, d, "events")), f"{path}/log"), path)
    return ST.access_totals(spark, f"{path}/log").withColumn("last_read", stamp(F.col("last_read")))


@query(
    "t3_last_n_per_user",
    """SELECT 'u' || user_id AS user_id, CAST(event_id AS VARCHAR) AS conversation_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS INTEGER) AS position
    FROM events QUALIFY position <= 10""",
)
def t3(spark, d):
    path = shared_folder(spark, "t3")
    said = stream_of(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_id").cast("string").alias("conversation_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("summary"),
    )
    finished(spark, ST.ring_log(said, f"{path}/log"), path)
    return ST.last_n_of(spark, f"{path}/log").select("user_id", "conversation_id", "position")


def _ingested(spark, d):
    path = shared_folder(spark, "t4")
    docs = stream_of(spark, d, "documents")
    doc = F.col("doc_id")
    new = docs.select(
        doc.cast("string").alias("id"),
        F.concat(F.lit("s"), (doc % 8).cast("string")).alias("session_id"),
        F.timestamp_add("MINUTE", doc.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias(
            "created_at"
        ),
        F.col("source").alias("content_type"),
        F.col("text").alias("full_content"),
        (doc % 11).cast("int").alias("priority"),
    )
    writer = ST.ingest_stream(arrivals(new), PACKING_MODEL, f"{path}/items", f"{path}/usage")
    finished(spark, writer, path)
    return path


@query(
    "t4_ingest_stream",
    """SELECT i.session_id, i.id, over_trigger, CAST(stored AS INTEGER) AS compressed_token_count FROM ingested i""",
    ["ingested"],
)
def t4(spark, d):
    path = _ingested(spark, d)
    return spark.read.parquet(f"{path}/items").select(
        "session_id", "id", "over_trigger", "compressed_token_count"
    )


@query(
    "t4_utilization_alarms",
    """SELECT session_id, CAST(sum(stored) AS BIGINT) AS used, round(sum(stored) / 8192 * 100, 6) AS utilization
    FROM ingested GROUP BY session_id HAVING sum(stored) / 8192 * 100 > 75""",
    ["ingested"],
)
def t4_alarms(spark, d):
    path = _ingested(spark, d)
    alarms = ST.utilization_alarms(spark, f"{path}/usage", PACKING_MODEL)
    return alarms.withColumn("utilization", r6(F.col("utilization")))


@query(
    "t5_daily_stats",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS total_conversations, round(avg(value), 6) AS avg_importance,
        TRUE AS users_within_error
    FROM events GROUP BY 1""",
)
def t5(spark, d):
    """Approximate distinct users are held against the exact count: within three of the stated errors, or one user."""
    error = 0.05

    def said(events):
        return events.select(F.col("ts").alias("created_at"), F.col("value").alias("importance_score"), "user_id")

    daily = appended(spark, d, lambda events: RO.daily_conversation_stats(said(events), error=error), "t5")
    exact = V.raw(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.countDistinct("user_id").alias("n"))
    within = F.abs(F.col("unique_users") - F.col("n")) <= F.greatest(F.lit(1.0), 3 * error * F.col("n"))
    return daily.join(exact, "date").select(
        F.col("date").cast("string").alias("date"),
        "total_conversations",
        r6(F.col("avg_importance")).alias("avg_importance"),
        within.alias("users_within_error"),
    )


@query(
    "t5_distinct_users",
    """SELECT unit, strftime(start, '%Y-%m-%d') AS start, count(DISTINCT user_id) AS n_exact, TRUE AS within_error
    FROM (SELECT 'week' AS unit, date_trunc('week', ts) AS start, user_id FROM events
        UNION ALL SELECT 'month', date_trunc('month', ts), user_id FROM events) GROUP BY 1, 2""",
)
def t5_users(spark, d):
    """Daily sketches, of a stream and of the table for the days it left open, united by week and month."""

    def said(events):
        return events.select(F.col("ts").alias("created_at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"))

    daily = settled(appended(spark, d, lambda events: RO.daily_user_sketches(said(events)), "t5-users"), "user-sketches")
    events = V.raw(spark, d, "events")

    def held(unit):
        start = F.to_date(F.date_trunc(unit, "ts")).alias("start")
        exact = events.groupBy(start).agg(F.countDistinct("user_id").alias("n_exact"))
        # Four standard errors of a sketch of this size.
        within = F.abs(F.col("users") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (RO.SKETCH_BITS / 2) * F.col("n_exact"))
        both = RO.distinct_users(daily, unit).join(exact, "start")
        return both.select(F.lit(unit).alias("unit"), F.col("start").cast("string").alias("start"), "n_exact", within.alias("within_error"))

    return held("week").unionByName(held("month"))
