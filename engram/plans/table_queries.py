"""Registered queries over sources, filters, sorted lists, joins and aggregates."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from engram.operators import aggregates as A
from engram.operators import filters as L
from engram.operators import joins as J
from engram.operators import ranking as R
from engram.operators import trigrams as TG
from engram.operators.conversations import build_conversations, parsed_messages
from engram.operators.export import export_state, state_sections
from engram.operators.search import hydrate
from engram.plans import views as V
from engram.plans.registry import query, r6, sql_stamp, stamp
from engram.plans.sql_views import AS_OF_SQL
from engram.policy import DEFAULT_SETTINGS, ITEMS_SECTION, STATE_FIELD
from engram.sources import tables as S
from engram.sources.shared import settled, shared_folder
from engram.sources.recent_entries import read_recent_entries, write_recent_entries

WEEK_AGO = V.AS_OF - timedelta(days=7)


def topic_text(column="topics"):
    return F.array_join(column, ",")


# ---- sources and sinks ----


@query("s1_read_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s1(spark, d):
    return S.read_table(spark, "events", f"{d}/events.parquet")


@query(
    "s2_apply_defaults",
    """SELECT CAST(d.doc_id AS VARCHAR) AS fact_id, CAST(d.doc_id % 120 AS VARCHAR) AS conversation_id,
        CASE WHEN quality = 1 AND toxic = 0 THEN 0.9::DOUBLE WHEN quality = 1 THEN 0.6::DOUBLE
             WHEN quality IS NOT NULL THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
        'extraction' AS source_type
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def s2(spark, d):
    accepted, _ = S.apply_defaults(V.memory_facts(spark, d, all_documents=True), "memory_facts", V.AS_OF)
    return accepted.select("fact_id", "conversation_id", "confidence", "source_type")


# Parts short enough to show that positions go on from part to part.
PART_TURNS = 3


@query(
    "s3_parse_messages",
    """SELECT 'c' || conv_id AS source_id,
        CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position,
        role, text AS content FROM conversations
    UNION ALL SELECT 't' || conv_id || '_' || turn, 0, 'user', text FROM conversations""",
)
def s3(spark, d):
    said = V.turns(spark, d)
    stored = build_conversations(said, PART_TURNS).select(
        F.concat(F.lit("c"), "conversation_id").alias("source_id"),
        (F.col("part") * PART_TURNS).alias("first"),
        F.to_json("messages").alias("content"),
    )
    plain = said.select(
        F.concat(F.lit("t"), "conversation_id", F.lit("_"), F.col("turn").cast("string")).alias("source_id"),
        F.lit(0).alias("first"),
        F.col("text").alias("content"),
    )
    return parsed_messages(stored.unionByName(plain), "source_id", "content", F.col("first"))


@query(
    "s4_build_conversations",
    """SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 0 AS part, CAST(count(*) AS INTEGER) AS n_messages,
        string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages
    FROM conversations GROUP BY conv_id""",
)
def s4(spark, d):
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return build_conversations(V.turns(spark, d)).select(
        "conversation_id", "part", F.size("messages").alias("n_messages"), F.array_join(lines, "\n").alias("messages")
    )


@query(
    "s5_recent_entries",
    f"""SELECT conversation_id, user_id, summary, {sql_stamp('created_at')} AS timestamp,
        CAST(n_messages AS INTEGER) AS n_messages FROM convs
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, conversation_id) <= 10""",
    ["convs"],
)
def s5(spark, d):
    ring = R.last_n_per_user(V.conversations(spark, d, messages=True)).withColumn(
        "timestamp", stamp(F.col("created_at"))
    )
    path = shared_folder(spark, "recent-entries")
    write_recent_entries(ring, path)
    entries, _ = read_recent_entries(spark, path)
    return entries.select(
        "conversation_id", "user_id", "summary", "timestamp", F.size("messages").alias("n_messages")
    )


def _sql_pages(section, source, fields, order, where="TRUE"):
    inner = ", ".join(f"{name} := {expr}" for name, expr in fields)
    return f"""SELECT session_id, '{section}' AS section, CAST(page AS INTEGER) AS page,
        CAST(count(*) AS INTEGER) AS n_rows,
        '{{"session_id":"' || session_id || '","section":"{section}","page":' || page || ',"body":['
            || string_agg(CAST(to_json(struct_pack({inner})) AS VARCHAR), ',' ORDER BY position) || ']}}' AS document
    FROM (SELECT *, position, (position - 1) // 1000 AS page FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS position
        FROM {source} WHERE {where}))
    WHERE session_id IN (SELECT session_id FROM session_models)
    GROUP BY session_id, page"""


def _iso(column):
    text = f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
    return f"regexp_replace({text}, '\\.000000$', '')"


_SETTINGS = json.dumps(DEFAULT_SETTINGS, separators=(",", ":"))[1:-1]


@query(
    "s6_export_state",
    f"""SELECT session_id, 'session_state' AS section, 0 AS page, 1 AS n_rows,
        '{{"session_id":"' || session_id || '","section":"session_state","page":0,"body":{{"model":"' || model
        || '",{_SETTINGS},"timestamp":"2024-02-02T00:00:00","{STATE_FIELD}":{{"total_context":' || total
        || ',"used_context":' || used || ',"available_context":' || (total - used) || ',"utilization_percentage":'
        || round(used / total * 100, 6) || ',"token_usage":' || coalesce(usage, '{{}}')
        || ',"performance_metrics":' || coalesce(metrics, '{{}}') || '}}}}}}' AS document
    FROM (SELECT session_id, any_value(model) AS model, any_value(context_length) AS total,
            CAST(coalesce(sum(compressed_token_count) FILTER (WHERE is_active), 0) AS BIGINT) AS used
        FROM session_models JOIN models USING (model) JOIN memory_items USING (session_id) GROUP BY session_id)
    LEFT JOIN (SELECT session_id, CAST(to_json(struct_pack(input_tokens := CAST(sum(input_tokens) AS BIGINT),
            output_tokens := CAST(sum(output_tokens) AS BIGINT), total_cost := round(
                sum(input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output), 6))) AS VARCHAR) AS usage
        FROM token_log JOIN models USING (model) GROUP BY session_id) USING (session_id)
    LEFT JOIN (SELECT session_id, '{{"cache_hits":' || count(*) FILTER (WHERE NOT decompress)
            || ',"compressions":0,"decompressions":' || count(*) FILTER (WHERE decompress) || '}}' AS metrics
        FROM access_log GROUP BY session_id) USING (session_id)
    UNION ALL """
    + _sql_pages(
        ITEMS_SECTION,
        "memory_items",
        [
            (c, _iso(c) if c == "last_accessed" else c)
            for c in (
                "id content_type compressed_summary token_count compressed_token_count priority access_count "
                "last_accessed"
            ).split()
        ],
        "priority DESC NULLS FIRST, last_accessed DESC NULLS FIRST, id",
        "is_active",
    )
    + " UNION ALL "
    + _sql_pages(
        "tasks",
        "tasks",
        [
            (c, _iso(c) if c.endswith("_at") else c)
            for c in (
                "id title status priority assigned_agent progress metadata created_at updated_at completed_at"
            ).split()
        ],
        "priority DESC NULLS FIRST, created_at DESC NULLS FIRST, id",
    )
    + " UNION ALL "
    + _sql_pages(
        "agents", "agents", [(c, c) for c in "id agent_name agent_type is_active".split()], "id", "is_active"
    )
    + " UNION ALL "
    + _sql_pages(
        "quarantined_contexts",
        "context_quarantine",
        [
            (c, _iso(c) if c.endswith("_at") else c)
            for c in (
                "id thread_id context_type isolated_content reason_for_isolation token_count is_active created_at"
            ).split()
        ],
        "created_at DESC NULLS FIRST, id",
    ),
    ["session_models", "models", "memory_items", "tasks", "agents", "context_quarantine", "token_log", "access_log"],
)
def s6(spark, d):
    items, events = V.memory_items(spark, d), V.raw(spark, d, "events")
    percent = "context_utilization_percentage"
    states = A.session_state(items, V.session_models(spark, d)).withColumn(percent, r6(F.col(percent)))
    usage = A.token_usage(V.token_log(events)).withColumn("total_cost", r6(F.col("total_cost")))
    metrics = A.performance_metrics(A.access_metrics(V.access_log(events)))
    states = state_sections(states, usage, metrics, V.AS_OF)
    return export_state(states, items, V.tasks(spark, d), V.agents(spark, d), V.context_quarantine(spark, d))


@query(
    "s7_snapshot_tables",
    """SELECT 'memory_items' AS table_name, id AS key, CAST(length(compressed_summary) AS INTEGER) AS n_chars
    FROM memory_items UNION ALL
    SELECT 'memory_facts', fact_id, CAST(length(fact) AS INTEGER) FROM memory_facts""",
    ["memory_items", "memory_facts"],
)
def s7(spark, d):
    path = shared_folder(spark, "snapshot")
    tables = {"memory_items": V.memory_items(spark, d), "memory_facts": V.memory_facts(spark, d)}
    S.snapshot_tables(tables, path, "run-1")

    def back(name, key, text):
        return S.read_snapshot(spark, path, "run-1", name).select(
            F.lit(name).alias("table_name"), F.col(key).alias("key"), F.length(text).alias("n_chars")
        )

    return back("memory_items", "id", "compressed_summary").unionByName(back("memory_facts", "fact_id", "fact"))


@query(
    "s8_upsert",
    f"""SELECT coalesce(b.conversation_id, c.conversation_id) AS conversation_id,
        coalesce(c.importance_score, b.importance_score) AS importance_score, b.summary,
        {sql_stamp(f"CASE WHEN b.conversation_id IS NULL THEN NULL WHEN c.conversation_id IS NULL THEN b.created_at ELSE {AS_OF_SQL} END")} AS updated_at
    FROM convs b FULL JOIN (SELECT conversation_id, arg_max(confidence, created_at) AS importance_score
        FROM memory_facts GROUP BY 1) c ON b.conversation_id = c.conversation_id""",
    ["convs", "memory_facts"],
)
def s8(spark, d):
    base = V.conversations(spark, d).select(
        "conversation_id", "importance_score", "summary", F.col("created_at").alias("updated_at")
    )
    changes = V.memory_facts(spark, d).select("conversation_id", F.col("confidence").alias("importance_score"), "created_at")
    merged = S.upsert(base, changes, "conversation_id", V.AS_OF, order=["created_at"])
    return merged.withColumn("updated_at", stamp(F.col("updated_at")))


# ---- filters ----


@query(
    "f1_lookup",
    "SELECT conversation_id, summary FROM convs WHERE conversation_id IN (SELECT conversation_id FROM memory_facts)",
    ["convs", "memory_facts"],
)
def f1(spark, d):
    keys = V.memory_facts(spark, d).select("conversation_id")
    return L.lookup(V.conversations(spark, d), keys, "conversation_id").select("conversation_id", "summary")


@query(
    "f2_facts_of",
    "SELECT conversation_id, fact_id, fact FROM memory_facts WHERE conversation_id IN (SELECT conversation_id FROM convs)",
    ["convs", "memory_facts"],
)
def f2(spark, d):
    return L.facts_of(V.memory_facts(spark, d), V.conversations(spark, d)).select(
        "conversation_id", "fact_id", "fact"
    )


@query(
    "f3_by_date_range",
    f"""SELECT conversation_id, {sql_stamp('created_at')} AS created_at FROM convs
    WHERE created_at BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL}""",
    ["convs"],
)
def f3(spark, d):
    return L.by_date_range(V.conversations(spark, d), WEEK_AGO, V.AS_OF).select(
        "conversation_id", stamp(F.col("created_at")).alias("created_at")
    )


@query(
    "f4_by_topics",
    """SELECT conversation_id, importance_score FROM convs WHERE list_has_any(topics, ['t1', 't2'])
    ORDER BY importance_score DESC NULLS FIRST, conversation_id LIMIT 10""",
    ["convs"],
)
def f4(spark, d):
    return L.by_topics(V.conversations(spark, d), ["t1", "t2"]).select("conversation_id", "importance_score")


@query(
    "f5_facts_by_tags",
    """SELECT fact_id, confidence FROM memory_facts WHERE list_has_any(tags, ['en', 'fr'])
    ORDER BY confidence DESC NULLS FIRST, fact_id LIMIT 10""",
    ["memory_facts"],
)
def f5(spark, d):
    return L.facts_by_tags(V.memory_facts(spark, d), ["en", "fr"]).select("fact_id", "confidence")


@query(
    "f6_facts_by_text",
    """SELECT fact_id, confidence, fact FROM memory_facts WHERE fact ILIKE '%the%'
    ORDER BY confidence DESC NULLS FIRST, fact_id LIMIT 10""",
    ["memory_facts"],
)
def f6(spark, d):
    return L.facts_by_text(V.memory_facts(spark, d), "the").select("fact_id", "confidence", "fact")


# Words of documents, a phrase, a wildcard, upper case, two characters, and one that no text has.
PATTERNS = ["the", "on of", "e_t", "a%ing", "TION", "er", "zqxj"]


@query(
    "f6_facts_by_patterns",
    f"""SELECT pattern, fact_id FROM (SELECT unnest({PATTERNS}) AS pattern) JOIN (
        SELECT CAST(doc_id AS VARCHAR) AS fact_id, text AS fact FROM documents) ON fact ILIKE '%' || pattern || '%'""",
)
def f6_patterns(spark, d):
    facts = V.raw(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fact_id"), F.col("text").alias("fact"))
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    grams = settled(TG.trigrams(facts), "trigrams")
    return TG.facts_by_patterns(facts, grams, patterns).select("pattern", "fact_id")


@query(
    "f7_searchable_items",
    """SELECT id, session_id, content_type FROM memory_items
    WHERE is_active AND content_type IN ('src0', 'src1', 'src2')""",
    ["memory_items"],
)
def f7(spark, d):
    items = V.memory_items(spark, d)
    return L.searchable_items(items, items, ["src0", "src1", "src2"]).select("id", "session_id", "content_type")


@query(
    "f8_tasks_by_status",
    f"""SELECT id, session_id, status, priority, {sql_stamp('created_at')} AS created_at FROM tasks
    WHERE status = 'in_progress'""",
    ["tasks"],
)
def f8(spark, d):
    return L.tasks_by_status(V.tasks(spark, d), "in_progress").select(
        "id", "session_id", "status", "priority", stamp(F.col("created_at")).alias("created_at")
    )


@query(
    "f9_agents_by_type",
    "SELECT id, session_id, agent_name FROM agents WHERE is_active AND agent_type = 'type1'",
    ["agents"],
)
def f9(spark, d):
    return L.agents_by_type(V.agents(spark, d), "type1").select("id", "session_id", "agent_name")


@query(
    "f10_active_quarantine",
    "SELECT id, session_id, thread_id, context_type, token_count FROM context_quarantine",
    ["context_quarantine"],
)
def f10(spark, d):
    return L.active_quarantine(V.context_quarantine(spark, d)).select(
        "id", "session_id", "thread_id", "context_type", "token_count"
    )


@query(
    "f11_pending_hil",
    "SELECT id, session_id, question, priority FROM hil WHERE status = 'pending'",
    ["hil"],
)
def f11(spark, d):
    return L.pending_hil(V.hil_interactions(spark, d)).select("id", "session_id", "question", "priority")


@query(
    "f12_trusted_facts",
    "SELECT fact_id, confidence FROM memory_facts WHERE embedding IS NOT NULL AND confidence >= 0.5",
    ["memory_facts"],
)
def f12(spark, d):
    return L.trusted_facts(V.memory_facts(spark, d, vectors=True)).select("fact_id", "confidence")


# ---- sorted lists and limits ----


@query(
    "o1_recent_conversations",
    f"""SELECT conversation_id, {sql_stamp('created_at')} AS created_at FROM convs WHERE NOT is_archived
    ORDER BY convs.created_at DESC NULLS FIRST, conversation_id LIMIT 10""",
    ["convs"],
)
def o1(spark, d):
    return R.recent_conversations(V.conversations(spark, d)).select(
        "conversation_id", stamp(F.col("created_at")).alias("created_at")
    )


@query(
    "o2_important_conversations",
    """SELECT conversation_id, importance_score, summary, array_to_string(topics, ',') AS topics FROM convs
    WHERE NOT is_archived AND importance_score >= 0.7
    ORDER BY created_at DESC NULLS FIRST, conversation_id LIMIT 100""",
    ["convs"],
)
def o2(spark, d):
    return R.important_conversations(V.conversations(spark, d)).select(
        "conversation_id", "importance_score", "summary", topic_text().alias("topics")
    )


@query("o3_ranked_items", "SELECT session_id, id, priority, position FROM ranked_items", ["ranked_items"])
def o3(spark, d):
    return R.ranked_items(V.memory_items(spark, d)).select("session_id", "id", "priority", "position")


@query(
    "o4_ranked_tasks",
    """SELECT session_id, id, priority, row_number() OVER (PARTITION BY session_id
        ORDER BY priority DESC NULLS FIRST, created_at DESC NULLS FIRST, id) AS position FROM tasks""",
    ["tasks"],
)
def o4(spark, d):
    return R.ranked_tasks(V.tasks(spark, d)).select("session_id", "id", "priority", "position")


@query(
    "o5_ranked_hil",
    """SELECT session_id, id, priority, row_number() OVER (PARTITION BY session_id
        ORDER BY priority DESC NULLS FIRST, created_at ASC NULLS LAST, id) AS position
    FROM hil WHERE status = 'pending'""",
    ["hil"],
)
def o5(spark, d):
    return R.ranked_hil(V.hil_interactions(spark, d)).select("session_id", "id", "priority", "position")


@query(
    "o6_latest_state",
    f"""SELECT session_id, model AS model_name, input_tokens AS used_context_length, {sql_stamp('ts')} AS updated_at
    FROM token_log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC) = 1""",
    ["token_log"],
)
def o6(spark, d):
    states = V.token_log(V.raw(spark, d, "events")).select(
        "session_id",
        F.col("model").alias("model_name"),
        F.col("input_tokens").alias("used_context_length"),
        F.col("ts").alias("updated_at"),
    )
    return R.latest_state(states).withColumn("updated_at", stamp(F.col("updated_at")))


@query(
    "o7_recent_trainings",
    """SELECT training_id, status, num_conversations FROM training_history
    ORDER BY started_at DESC NULLS FIRST, training_id LIMIT 10""",
    ["training_history"],
)
def o7(spark, d):
    return R.recent_trainings(V.training_history(spark, d)).select("training_id", "status", "num_conversations")


@query(
    "o8_latest_successful_training",
    f"""SELECT training_id, {sql_stamp('completed_at')} AS completed_at FROM training_history
    WHERE status = 'completed' ORDER BY training_history.completed_at DESC NULLS FIRST, training_id LIMIT 1""",
    ["training_history"],
)
def o8(spark, d):
    return R.latest_successful_training(V.training_history(spark, d)).select(
        "training_id", stamp(F.col("completed_at")).alias("completed_at")
    )


@query(
    "o9_last_n_per_user",
    """SELECT user_id, conversation_id, CAST(row_number() OVER (PARTITION BY user_id
        ORDER BY created_at DESC NULLS FIRST, conversation_id) AS INTEGER) AS position
    FROM convs QUALIFY position <= 10""",
    ["convs"],
)
def o9(spark, d):
    return R.last_n_per_user(V.conversations(spark, d)).select("user_id", "conversation_id", "position")


@query(
    "o10_recent_context",
    f"""SELECT conversation_id, summary, array_to_string(topics, ',') AS topics, importance_score,
        {_iso('created_at')} AS created_at
    FROM (SELECT * FROM convs WHERE NOT is_archived ORDER BY created_at DESC NULLS FIRST, conversation_id LIMIT 3)""",
    ["convs"],
)
def o10(spark, d):
    return R.recent_context(V.conversations(spark, d)).withColumn("topics", topic_text())


# ---- joins ----


@query(
    "j1_conversation_facts",
    """SELECT conversation_id, fact_id, confidence, importance_score
    FROM convs JOIN memory_facts USING (conversation_id)""",
    ["convs", "memory_facts"],
)
def j1(spark, d):
    return J.conversation_facts(V.conversations(spark, d).drop("created_at"), V.memory_facts(spark, d)).select(
        "conversation_id", "fact_id", "confidence", "importance_score"
    )


@query(
    "j1_conversation_facts_left",
    """SELECT conversation_id, fact_id, confidence, importance_score
    FROM convs LEFT JOIN memory_facts USING (conversation_id)""",
    ["convs", "memory_facts"],
)
def j1_left(spark, d):
    facts = V.memory_facts(spark, d).drop("created_at")
    return J.conversation_facts(V.conversations(spark, d), facts, "left").select(
        "conversation_id", "fact_id", "confidence", "importance_score"
    )


@query(
    "j2_hydrate",
    """SELECT conversation_id, score, summary FROM (SELECT conversation_id, max(confidence) AS score
        FROM memory_facts GROUP BY 1) JOIN convs USING (conversation_id)""",
    ["convs", "memory_facts"],
)
def j2(spark, d):
    found = (
        V.memory_facts(spark, d)
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.max("confidence").alias("score"))
    )
    return hydrate(found, V.conversations(spark, d), "conversation_id").select("conversation_id", "score", "summary")


@query(
    "j3_session_overview",
    """SELECT session_id, (SELECT count(*) FROM memory_items i WHERE i.session_id = s.session_id AND is_active) AS active_items,
        (SELECT count(*) FROM tasks t WHERE t.session_id = s.session_id) AS tasks,
        (SELECT count(*) FROM agents a WHERE a.session_id = s.session_id AND is_active) AS agents,
        (SELECT count(*) FROM context_quarantine q WHERE q.session_id = s.session_id) AS quarantined
    FROM session_models s""",
    ["session_models", "memory_items", "tasks", "agents", "context_quarantine"],
)
def j3(spark, d):
    sessions = V.session_models(spark, d).select("session_id")
    return J.session_overview(
        sessions, V.memory_items(spark, d), V.tasks(spark, d), V.agents(spark, d), V.context_quarantine(spark, d)
    )


@query(
    "j4_with_model_limits",
    """SELECT session_id, model, context_length, CAST(floor(context_length * safe_threshold) AS INTEGER) AS budget
    FROM session_models JOIN models USING (model)""",
    ["session_models", "models"],
)
def j4(spark, d):
    known, _ = A.with_model_limits(V.session_models(spark, d))
    budget = (F.col("context_length") * F.col("safe_threshold")).cast("int").alias("budget")
    return known.select("session_id", "model", "context_length", budget)


@query(
    "j5_cascade_delete",
    """SELECT fact_id, conversation_id FROM memory_facts
    WHERE conversation_id NOT IN (SELECT conversation_id FROM convs WHERE is_archived)""",
    ["convs", "memory_facts"],
)
def j5(spark, d):
    archived = V.conversations(spark, d).where("is_archived")
    return J.cascade_delete(V.memory_facts(spark, d), archived).select("fact_id", "conversation_id")


# ---- aggregates ----


@query("a1_count_conversations", "SELECT count(*) AS n_conversations FROM convs", ["convs"])
def a1(spark, d):
    return A.count_conversations(V.conversations(spark, d))


@query(
    "a1_count_by_user", "SELECT user_id, count(*) AS n_conversations FROM convs GROUP BY user_id", ["convs"]
)
def a1_by_user(spark, d):
    return A.count_by_user(V.conversations(spark, d))


@query(
    "a2_conversation_stats",
    """SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total_conversations,
        round(avg(importance_score), 6) AS avg_importance, count(DISTINCT user_id) AS unique_users
    FROM convs GROUP BY 1""",
    ["convs"],
)
def a2(spark, d):
    return A.conversation_stats(V.conversations(spark, d)).select(
        F.col("date").cast("string").alias("date"),
        "total_conversations",
        r6(F.col("avg_importance")).alias("avg_importance"),
        "unique_users",
    )


@query(
    "a3_session_state",
    """SELECT session_id, any_value(model) AS model_name, any_value(context_length) AS total_context_length,
        CAST(sum(CASE WHEN is_active THEN compressed_token_count ELSE 0 END) AS BIGINT) AS used_context_length,
        CAST(any_value(context_length) - sum(CASE WHEN is_active THEN compressed_token_count ELSE 0 END) AS BIGINT)
            AS available_context_length,
        round(sum(CASE WHEN is_active THEN compressed_token_count ELSE 0 END) / any_value(context_length) * 100, 6)
            AS context_utilization_percentage,
        CAST(sum(CASE WHEN is_active THEN token_count ELSE 0 END) AS BIGINT) AS active_tokens,
        count(*) FILTER (WHERE is_active) AS active_count
    FROM session_models JOIN models USING (model) JOIN memory_items USING (session_id) GROUP BY session_id""",
    ["session_models", "models", "memory_items"],
)
def a3(spark, d):
    state = A.session_state(V.memory_items(spark, d), V.session_models(spark, d))
    percent = "context_utilization_percentage"
    return state.withColumn(percent, r6(F.col(percent)))


@query(
    "a4_table_stats",
    """SELECT 'conversations' AS table_name, count(*) AS n_rows FROM convs
    UNION ALL SELECT 'memory_facts', count(*) FROM memory_facts
    UNION ALL SELECT 'training_history', count(*) FROM nation
    UNION ALL SELECT 'user_preferences', count(*) FROM customer""",
    ["convs", "memory_facts"],
)
def a4(spark, d):
    return S.table_stats(
        {
            "conversations": V.conversations(spark, d),
            "memory_facts": V.memory_facts(spark, d),
            "training_history": V.training_history(spark, d),
            "user_preferences": V.user_preferences(spark, d),
        }
    )


_SUMMARY_SQL = """, topic_counts AS (SELECT topic, count(*) AS n
        FROM (SELECT unnest(topics) AS topic FROM found) GROUP BY topic ORDER BY n DESC, topic LIMIT 10),
    first_five AS (SELECT * FROM found ORDER BY {order}, conversation_id LIMIT 5)
    SELECT count(*) AS total_conversations, round(coalesce(avg(importance_score), 0), 6) AS average_importance,
        coalesce((SELECT string_agg(topic || '=' || n, ',' ORDER BY n DESC, topic) FROM topic_counts), '') AS top_topics,
        coalesce((SELECT string_agg(summary, '|' ORDER BY {order}, conversation_id) FROM first_five), '') AS recent_summaries
    FROM found"""


def _summary(df):
    topics = F.transform("top_topics", lambda t: F.concat(t["topic"], F.lit("="), t["n"].cast("string")))
    return df.select(
        "total_conversations",
        r6(F.col("average_importance")).alias("average_importance"),
        F.array_join(topics, ",").alias("top_topics"),
        F.array_join("recent_summaries", "|").alias("recent_summaries"),
    )


def _with_found(found, order):
    from engram.plans.sql_views import with_views

    base = with_views(["convs"], "")
    return f"{base.rstrip()}, found AS ({found}){_SUMMARY_SQL.format(order=order)}"


@query(
    "a5_summarize_month",
    _with_found(
        f"SELECT * FROM convs WHERE created_at BETWEEN {AS_OF_SQL} - INTERVAL 30 DAY AND {AS_OF_SQL}",
        "created_at DESC NULLS FIRST",
    ),
)
def a5_month(spark, d):
    return _summary(A.summarize_conversations(V.conversations(spark, d), V.AS_OF, "month"))


@query(
    "a5_summarize_topics",
    _with_found(
        """SELECT * FROM (SELECT * FROM convs WHERE list_has_any(topics, ['t1', 't2'])
        ORDER BY importance_score DESC NULLS FIRST, conversation_id LIMIT 100) WHERE user_id = 'u3'""",
        "importance_score DESC NULLS FIRST",
    ),
)
def a5_topics(spark, d):
    found = A.summarize_conversations(V.conversations(spark, d), V.AS_OF, "week", ["t1", "t2"], "u3", strict=True)
    return _summary(found)


@query(
    "a5_summarize_topics_all",
    _with_found(
        f"""SELECT * FROM convs WHERE list_has_any(topics, ['t1', 't2']) AND user_id = 'u3'
        AND created_at BETWEEN {AS_OF_SQL} - INTERVAL 30 DAY AND {AS_OF_SQL}""",
        "created_at DESC NULLS FIRST",
    ),
)
def a5_topics_all(spark, d):
    return _summary(A.summarize_conversations(V.conversations(spark, d), V.AS_OF, "month", ["t1", "t2"], "u3"))


@query(
    "a6_token_usage",
    """SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
        round(sum(input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output), 9) AS total_cost
    FROM token_log JOIN models USING (model) GROUP BY session_id""",
    ["token_log", "models"],
)
def a6(spark, d):
    usage = A.token_usage(V.token_log(V.raw(spark, d, "events")))
    return usage.withColumn("total_cost", F.round("total_cost", 9))


@query(
    "a7_performance_metrics",
    """SELECT session_id, '{"cache_hits":' || count(*) FILTER (WHERE NOT decompress) || ',"compressions":0,"decompressions":'
        || count(*) FILTER (WHERE decompress) || '}' AS performance_metrics
    FROM access_log GROUP BY session_id""",
    ["access_log"],
)
def a7(spark, d):
    return A.performance_metrics(A.access_metrics(V.access_log(V.raw(spark, d, "events"))))


@query(
    "a8_recent_entry_stats",
    f"""SELECT (SELECT count(*) FROM (SELECT 1 FROM convs LIMIT 10)) AS num_conversations, 10 AS max_size,
        (SELECT count(DISTINCT c_custkey) FROM customer) AS num_users,
        {sql_stamp('max(created_at)')} AS last_updated FROM convs""",
    ["convs"],
)
def a8(spark, d):
    ring = R.last_n(V.conversations(spark, d)).select(F.col("created_at").alias("timestamp"))
    contexts = V.user_preferences(spark, d).select("user_id", F.col("updated_at").alias("last_updated"))
    return A.recent_entry_stats(ring, contexts).withColumn("last_updated", stamp(F.col("last_updated")))


@query(
    "a9_training_needed",
    f"""SELECT n_important, hours_since, n_important >= 25 OR hours_since >= 24 AS should_train FROM (SELECT
        (SELECT count(*) FROM (SELECT 1 FROM convs WHERE NOT is_archived AND importance_score >= 0.7)) AS n_important,
        coalesce((SELECT date_diff('second', max(completed_at), {AS_OF_SQL}) / 3600 FROM training_history
            WHERE status = 'completed'), 'inf'::DOUBLE) AS hours_since)""",
    ["convs", "training_history"],
)
def a9(spark, d):
    return A.training_needed(V.conversations(spark, d), V.training_history(spark, d), V.AS_OF)


@query(
    "a10_compression_report",
    """SELECT session_id, content_type, CAST(sum(token_count) AS BIGINT) AS total_tokens,
        CAST(sum(compressed_token_count) AS BIGINT) AS compressed_tokens,
        round(sum(token_count) / nullif(sum(compressed_token_count), 0), 6) AS ratio
    FROM memory_items GROUP BY session_id, content_type""",
    ["memory_items"],
)
def a10(spark, d):
    return A.compression_report(V.memory_items(spark, d)).withColumn("ratio", r6(F.col("ratio")))
