"""DuckDB SQL of the views in ``views``, as named WITH entries."""

from engram.policy import MODELS, STRATEGIES
from engram.plans.views import MODEL_NAMES

AS_OF_SQL = "TIMESTAMP '2024-02-02 00:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"

_models = ", ".join(
    f"('{r[0]}', {r[1]}, {r[2]}::DOUBLE, {r[3]}::DOUBLE, {r[4]}, {r[5]}::DOUBLE, {r[6]}::DOUBLE)" for r in MODELS
)
_strategies = ", ".join(f"('{r[0]}', {r[1]}::DOUBLE, '{r[2]}')" for r in STRATEGIES)
_names = "[" + ", ".join(f"'{n}'" for n in MODEL_NAMES) + "]"

# name -> (names it reads, query)
VIEWS = {
    "models": (
        [],
        "SELECT * FROM (VALUES " + _models + ") AS t(model, context_length, safe_threshold, "
        "compression_trigger, max_tokens, cost_per_1k_input, cost_per_1k_output)",
    ),
    "strategies": (
        [],
        "SELECT * FROM (VALUES " + _strategies + ") AS t(strategy, summary_ratio, detail_retention)",
    ),
    "memory_items": (
        [],
        f"""SELECT CAST(doc_id AS VARCHAR) AS id, 's' || (doc_id % 8) AS session_id, source AS content_type,
            text AS full_content,
            CASE WHEN n_chars // 4 > 2000 THEN substring(text, 1, CAST(floor((n_chars // 4) * 0.25::DOUBLE) AS BIGINT) * 4)
                 WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS compressed_summary,
            CAST(n_chars // 4 AS INTEGER) AS token_count,
            CAST(CASE WHEN n_chars // 4 > 2000 THEN floor((n_chars // 4) * 0.25::DOUBLE)
                 WHEN n_chars > 500 THEN 125 ELSE n_chars // 4 END AS INTEGER) AS compressed_token_count,
            CAST(CASE WHEN doc_id % 97 = 0 THEN NULL ELSE doc_id % 11 END AS INTEGER) AS priority,
            doc_id % 13 <> 0 AS is_active, 0 AS access_count,
            {START} + to_minutes(doc_id) AS created_at,
            {START} + to_minutes((doc_id * 7919) % 43200) AS last_accessed,
            embedding
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    ),
    "turn_rows": (
        [],
        "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id, turn, role, text FROM conversations",
    ),
    "convs": (
        [],
        f"""SELECT CAST(c.conv_id AS VARCHAR) AS conversation_id, {START} + to_hours(c.conv_id * 7) AS created_at,
            CASE WHEN c.conv_id % 10 = 0 THEN NULL ELSE 'u' || (c.conv_id % 7) END AS user_id,
            CASE WHEN c.conv_id % 17 = 0 THEN NULL ELSE ['t' || (c.conv_id % 5), 't' || (c.conv_id % 3)] END AS topics,
            least(1.0::DOUBLE, 0.5::DOUBLE + (CASE WHEN has_system THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
                + CASE WHEN n > 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS importance_score,
            CASE WHEN has_user THEN 'User asked: ' || substring(coalesce(first_text, ''), 1, 100) || '...'
                 ELSE 'Conversation' END AS summary,
            c.conv_id % 9 = 0 AS is_archived, FALSE AS is_compressed, n AS n_messages, embedding
        FROM (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS has_system,
                  bool_or(role = 'user') AS has_user,
                  arg_min(text, turn) FILTER (WHERE role = 'user') AS first_text
              FROM conversations GROUP BY conv_id) c
        LEFT JOIN embeddings ON c.conv_id = vec_id""",
    ),
    "memory_facts": (
        [],
        f"""SELECT CAST(d.doc_id AS VARCHAR) AS fact_id, CAST(d.doc_id % 120 AS VARCHAR) AS conversation_id,
            split_part(text, chr(10), 1) AS fact,
            CASE WHEN quality = 1 AND toxic = 0 THEN 0.9::DOUBLE WHEN quality = 1 THEN 0.6::DOUBLE
                 ELSE 0.4::DOUBLE END AS confidence,
            [lang, source] AS tags, {START} + to_minutes(d.doc_id) AS created_at, embedding
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings ON d.doc_id = vec_id""",
    ),
    "vector_queries": (
        [],
        """SELECT CAST(vec_id AS VARCHAR) AS query_id, 's' || (vec_id % 8) AS session_id,
            CAST(embedding AS DOUBLE[]) AS v, ['t' || (vec_id % 5), 't' || ((vec_id + 1) % 5)] AS topics
        FROM embeddings""",
    ),
    "access_log": (
        [],
        """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS item_id,
            's' || (user_id % 8) AS session_id, event_type = 'click' AS decompress, ts
        FROM events WHERE event_type IN ('view', 'click')""",
    ),
    "token_log": (
        [],
        f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 's' || (user_id % 8) AS session_id,
            {_names}[CAST(user_id % {len(MODEL_NAMES)} + 1 AS INTEGER)] AS model,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS input_tokens,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS output_tokens, ts
        FROM events""",
    ),
    "tasks": (
        [],
        """SELECT CAST(o_orderkey AS VARCHAR) AS id, 's' || (o_custkey % 8) AS session_id,
            'order ' || o_orderkey AS title,
            CASE o_orderstatus WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'completed' ELSE 'pending' END AS status,
            6 - CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority,
            CAST(o_custkey AS VARCHAR) AS assigned_agent, 0 AS progress, '{}' AS metadata,
            o_orderdate AS created_at, o_orderdate AS updated_at, CAST(NULL AS TIMESTAMP) AS completed_at
        FROM orders""",
    ),
    "task_updates": (
        [],
        """SELECT CAST(l_orderkey AS VARCHAR) AS id,
            CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber * 10 END AS progress,
            CASE WHEN l_linestatus = 'F' THEN 'completed' END AS status, l_shipdate AS ts, l_partkey,
            row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
        FROM lineitem""",
    ),
    "agents": (
        [],
        """SELECT CAST(s_suppkey AS VARCHAR) AS id, 's' || (s_suppkey % 8) AS session_id, s_name AS agent_name,
            'type' || (s_nationkey % 4) AS agent_type, s_acctbal > 0 AS is_active
        FROM supplier""",
    ),
    "context_quarantine": (
        [],
        f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, 's' || (d.doc_id % 8) AS session_id,
            'thread_' || substring(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS thread_id, source AS context_type,
            text AS isolated_content, 'toxic label' AS reason_for_isolation,
            CAST(length(text) // 4 AS INTEGER) AS token_count, TRUE AS is_active,
            {START} + to_minutes(d.doc_id) AS created_at
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1""",
    ),
    "hil": (
        [],
        """SELECT CAST(event_id AS VARCHAR) AS id, 's' || (user_id % 8) AS session_id,
            'event ' || event_id AS question, CAST(NULL AS VARCHAR) AS response,
            CASE WHEN value > 50 THEN 'answered' ELSE 'pending' END AS status,
            CAST(user_id % 5 AS INTEGER) AS priority, ts AS created_at
        FROM events WHERE event_type = 'error'""",
    ),
    "hil_responses": (
        [],
        """SELECT CAST(event_id - 10 AS VARCHAR) AS id,
            's' || ((user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % 8) AS session_id,
            'answer ' || event_id AS response, ts
        FROM events WHERE event_type = 'purchase'""",
    ),
    "training_history": (
        [],
        f"""SELECT 'train_' || n_nationkey AS training_id, {START} + to_days(n_nationkey) AS started_at,
            CASE WHEN n_regionkey IN (0, 4) THEN {START} + to_days(n_nationkey) + INTERVAL 1 HOUR END AS completed_at,
            CAST(n_nationkey + 25 AS INTEGER) AS num_conversations,
            CASE n_regionkey WHEN 0 THEN 'completed' WHEN 4 THEN 'completed' WHEN 1 THEN 'failed'
                WHEN 2 THEN 'running' ELSE 'pending' END AS status
        FROM nation""",
    ),
    "session_models": (
        ["memory_items"],
        f"""SELECT session_id,
            {_names}[CAST(CAST(substring(session_id, 2) AS INTEGER) % {len(MODEL_NAMES)} + 1 AS INTEGER)] AS model
        FROM (SELECT DISTINCT session_id FROM memory_items)""",
    ),
    "ranked_items": (
        ["memory_items"],
        """SELECT *, row_number() OVER (PARTITION BY session_id
            ORDER BY priority DESC NULLS FIRST, last_accessed DESC NULLS FIRST, id) AS position
        FROM memory_items WHERE is_active""",
    ),
    # Packing step by step in rank order: what is left after each item decides the next.
    "packed_6963": (
        ["ranked_items"],
        """SELECT session_id, id, position, token_count AS f, compressed_token_count AS c,
            CASE WHEN token_count <= 6963 THEN 'full' WHEN compressed_token_count <= 6963 THEN 'compressed' END AS form,
            CASE WHEN token_count <= 6963 THEN 6963 - token_count
                 WHEN compressed_token_count <= 6963 THEN 6963 - compressed_token_count ELSE 6963 END AS remaining
        FROM ranked_items WHERE position = 1
        UNION ALL
        SELECT r.session_id, r.id, r.position, r.token_count, r.compressed_token_count,
            CASE WHEN r.token_count <= p.remaining THEN 'full'
                 WHEN r.compressed_token_count <= p.remaining THEN 'compressed' END,
            CASE WHEN r.token_count <= p.remaining THEN p.remaining - r.token_count
                 WHEN r.compressed_token_count <= p.remaining THEN p.remaining - r.compressed_token_count
                 ELSE p.remaining END
        FROM packed_6963 p JOIN ranked_items r ON r.session_id = p.session_id AND r.position = p.position + 1""",
    ),
    # The same with the budget of each session's own model.
    "packed_models": (
        ["ranked_items", "session_models", "models"],
        """SELECT session_id, id, position, token_count AS f, compressed_token_count AS c,
            CASE WHEN token_count <= b THEN 'full' WHEN compressed_token_count <= b THEN 'compressed' END AS form,
            CASE WHEN token_count <= b THEN b - token_count WHEN compressed_token_count <= b THEN b - compressed_token_count
                 ELSE b END AS remaining
        FROM (SELECT r.*, CAST(floor(context_length * safe_threshold) AS BIGINT) AS b
            FROM ranked_items r JOIN session_models USING (session_id) JOIN models USING (model)) WHERE position = 1
        UNION ALL
        SELECT r.session_id, r.id, r.position, r.token_count, r.compressed_token_count,
            CASE WHEN r.token_count <= p.remaining THEN 'full'
                 WHEN r.compressed_token_count <= p.remaining THEN 'compressed' END,
            CASE WHEN r.token_count <= p.remaining THEN p.remaining - r.token_count
                 WHEN r.compressed_token_count <= p.remaining THEN p.remaining - r.compressed_token_count
                 ELSE p.remaining END
        FROM packed_models p JOIN ranked_items r ON r.session_id = p.session_id AND r.position = p.position + 1""",
    ),
    "arrivals": (
        ["memory_items"],
        """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS seq,
            CAST(floor(token_count * 0.25::DOUBLE) AS BIGINT) AS squeezed,
            CASE WHEN length(full_content) > 500 THEN 125 ELSE length(full_content) // 4 END AS cut
        FROM memory_items""",
    ),
    # Ingest step by step in arrival order on a model of 8192 tokens.
    "ingested": (
        ["arrivals"],
        """SELECT session_id, id, seq, FALSE AS over_trigger,
            CAST(CASE WHEN token_count > 2000 THEN squeezed ELSE cut END AS BIGINT) AS stored,
            CAST(CASE WHEN token_count > 2000 THEN squeezed ELSE cut END AS BIGINT) AS used
        FROM arrivals WHERE seq = 1
        UNION ALL
        SELECT a.session_id, a.id, a.seq, (i.used / 8192::DOUBLE) * 100 > 75,
            CASE WHEN a.token_count > 2000 OR (i.used / 8192::DOUBLE) * 100 > 75 THEN a.squeezed ELSE a.cut END,
            i.used + CASE WHEN a.token_count > 2000 OR (i.used / 8192::DOUBLE) * 100 > 75
                THEN a.squeezed ELSE a.cut END
        FROM ingested i JOIN arrivals a ON a.session_id = i.session_id AND a.seq = i.seq + 1""",
    ),
}


def with_views(names: list[str], query: str) -> str:
    """The query behind the WITH entries it needs, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for needed in VIEWS[name][0]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return query
    entries = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    return f"WITH RECURSIVE {entries}\n{query}"
