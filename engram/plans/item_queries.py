"""Registered queries over search, packing, ingest, folds and maintenance jobs."""

from pyspark.sql import functions as F

from engram.functions import hooks as H
from engram.functions import text as X
from engram.functions import values as N
from engram.functions import vectors as VEC
from engram.operators import aggregates as A
from engram.operators import folds as FO
from engram.operators import ingest as I
from engram.operators import list_index as LI
from engram.operators import maintenance as M
from engram.operators import packing as P
from engram.operators import search as SE
from engram.operators.conversations import conversation_headers
from engram.plans import views as V
from engram.plans.registry import query, r6, sql_stamp, stamp
from engram.plans.sql_views import AS_OF_SQL
from engram.policy import model_limits
from engram.sources.shared import shared_folder

PACKING_MODEL = "gpt-4"
BUDGET = model_limits(PACKING_MODEL).packing_budget
QUERY_TEXT = "the history of the earth and its people"
LISTS, PROBES, INDEX_PROBES = 16, 6, 14
_QUERY_SQL = f"SELECT '{QUERY_TEXT}' AS asked"


# ---- scalar functions ----


@query("x1_estimate_tokens", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def x1(spark, d):
    return V.raw(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "x3_compress_target",
    """SELECT id, strategy, CAST(floor(token_count * summary_ratio) AS INTEGER) AS target
    FROM memory_items, strategies""",
    ["memory_items", "strategies"],
)
def x3(spark, d):
    from engram.policy import STRATEGIES

    ratios = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(r).alias("ratio")) for s, r, _ in STRATEGIES])
    items = V.memory_items(spark, d).select("id", "token_count", F.explode(ratios).alias("s"))
    return items.select(
        "id", "s.strategy", X.compress_target(F.col("token_count"), F.col("s.ratio")).alias("target")
    )


@query(
    "x4_truncate_summary",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS summary
    FROM documents""",
)
def x4(spark, d):
    return V.raw(spark, d, "documents").select("doc_id", X.truncate_summary(F.col("text")).alias("summary"))


@query(
    "x5_compress_text",
    """SELECT doc_id, substring(text, 1, CAST(floor((length(text) // 4) * 0.25::DOUBLE) AS BIGINT) * 4) AS balanced,
        CAST(length(substring(text, 1, CAST(floor((length(text) // 4) * 0.1::DOUBLE) AS BIGINT) * 4)) AS INTEGER) AS n_aggressive
    FROM documents""",
)
def x5(spark, d):
    body = F.col("text")
    return V.raw(spark, d, "documents").select(
        "doc_id",
        X.compress_text(body).alias("balanced"),
        F.length(X.compress_text(body, "aggressive")).alias("n_aggressive"),
    )


@query(
    "x6_compression_ratio",
    """SELECT id, round(CASE WHEN token_count > 0 THEN compressed_token_count / token_count ELSE 1.0 END, 6) AS ratio
    FROM memory_items""",
    ["memory_items"],
)
def x6(spark, d):
    ratio = X.compression_ratio(F.col("compressed_token_count"), F.col("token_count"))
    return V.memory_items(spark, d).select("id", r6(ratio).alias("ratio"))


_CHUNKS_SQL = """SELECT doc_id, CAST(i AS INTEGER) AS position, substring(text, CAST(i * 3584 + 1 AS BIGINT), 4096) AS chunk
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 3584) AS BIGINT))) AS i FROM documents)"""


@query("x7_chunk_text", _CHUNKS_SQL)
def x7(spark, d):
    return V.raw(spark, d, "documents").select(
        "doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("position", "chunk")
    )


@query(
    "x8_importance_score",
    "SELECT conversation_id, importance_score FROM convs",
    ["convs"],
)
def x8(spark, d):
    heads = conversation_headers(V.turns(spark, d), F.col("role") == "system")
    return heads.select("conversation_id", "importance_score")


@query("x9_first_user_summary", "SELECT conversation_id, summary FROM convs", ["convs"])
def x9(spark, d):
    return conversation_headers(V.turns(spark, d), F.lit(False)).select("conversation_id", "summary")


@query(
    "x10_retrieval_hint",
    """SELECT id, 'Use retrieve_memory_item(''' || id || ''') to get full content' AS hint FROM memory_items""",
    ["memory_items"],
)
def x10(spark, d):
    return V.memory_items(spark, d).select("id", X.retrieval_hint(F.col("id")).alias("hint"))


@query(
    "x11_token_cost",
    """SELECT event_id, round(input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output, 9) AS cost
    FROM token_log JOIN models USING (model)""",
    ["token_log", "models"],
)
def x11(spark, d):
    priced, _ = A.with_model_limits(V.token_log(V.raw(spark, d, "events")))
    cost = N.token_cost(
        F.col("input_tokens"), F.col("output_tokens"), F.col("cost_per_1k_input"), F.col("cost_per_1k_output")
    )
    return priced.select("event_id", F.round(cost, 9).alias("cost"))


@query(
    "x12_counters_json",
    """SELECT session_id, '{' || string_agg('"' || model || '":' || n, ',' ORDER BY model) || '}' AS counters
    FROM (SELECT session_id, model, sum(input_tokens) AS n FROM token_log GROUP BY ALL) GROUP BY session_id""",
    ["token_log"],
)
def x12(spark, d):
    increments = V.token_log(V.raw(spark, d, "events")).select(
        "session_id", F.col("model").alias("metric"), F.col("input_tokens").alias("increment")
    )
    counts = A.metric_counts(increments).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("metric", "n"))).alias("pairs")
    )
    return counts.select(
        "session_id", N.counters_json(F.col("pairs.metric"), F.col("pairs.n")).alias("counters")
    )


@query(
    "x13_set_preferences",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS user_id,
        CASE WHEN n > 0 THEN 'orders=' || n ELSE c_mktsegment END AS segment,
        CASE WHEN n > 0 THEN 'n' || (n % 3) ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
        {sql_stamp(f"CASE WHEN n > 0 THEN {AS_OF_SQL} END")} AS updated_at
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders=' || count(*), 'n' || (count(*) % 3), {sql_stamp(AS_OF_SQL)}
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
)
def x13(spark, d):
    changes = (
        V.raw(spark, d, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "user_id",
            F.explode(
                F.create_map(
                    F.lit("segment"),
                    F.concat(F.lit("orders="), F.col("n").cast("string")),
                    F.lit("nation"),
                    F.concat(F.lit("n"), (F.col("n") % 3).cast("string")),
                )
            ).alias("key", "value"),
        )
    )
    after = M.set_preferences(V.user_preferences(spark, d), changes, V.AS_OF)
    return after.select(
        "user_id",
        F.col("preferences")["segment"].alias("segment"),
        F.col("preferences")["nation"].alias("nation"),
        stamp(F.col("updated_at")).alias("updated_at"),
    )


@query(
    "x14_thread_id",
    "SELECT doc_id, 'thread_' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS thread_id FROM documents",
)
def x14(spark, d):
    return V.raw(spark, d, "documents").select("doc_id", X.thread_id(F.col("doc_id")).alias("thread_id"))


@query(
    "x15_range_counts",
    f"""SELECT r.time_range, count(c.created_at) AS n FROM (VALUES ('day', {AS_OF_SQL} - INTERVAL 1 DAY),
        ('week', {AS_OF_SQL} - INTERVAL 7 DAY), ('month', {AS_OF_SQL} - INTERVAL 30 DAY),
        ('all', TIMESTAMP '2000-01-01 00:00:00')) AS r(time_range, start)
    LEFT JOIN convs c ON c.created_at BETWEEN r.start AND {AS_OF_SQL} GROUP BY r.time_range""",
    ["convs"],
)
def x15(spark, d):
    convs = V.conversations(spark, d)
    counts = [
        F.count_if(F.col("created_at").between(N.ntz(N.range_start(name, V.AS_OF)), N.ntz(V.AS_OF))).alias(name)
        for name in ("day", "week", "month", "all")
    ]
    wide = convs.agg(*counts)
    return wide.unpivot([], ["day", "week", "month", "all"], "time_range", "n")


@query(
    "x16_iso_timestamp",
    """SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS iso FROM events""",
)
def x16(spark, d):
    return V.raw(spark, d, "events").select("event_id", N.iso_timestamp(F.col("ts")).alias("iso"))


# ---- hooks ----


@query("x2_u1_count_tokens", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def u1(spark, d):
    count = H.tokenizer_hook(lambda texts: texts.str.len() // 4)
    return V.raw(spark, d, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


def hashed_sql(source, text, keep):
    """A query giving the ``keep`` columns and ``counts``, the hashed bag of words of ``text``."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r]+'), lambda w: length(w) > 0)"
    places = f"list_transform({words}, lambda w: CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64)"
    counts = "list_transform(range(64), lambda i: CAST(len(list_filter(places, lambda p: p = i)) AS DOUBLE))"
    return f"SELECT {keep}, {counts} AS counts FROM (SELECT *, {places} AS places FROM ({source}))"


def _unit_sql(counts):
    """Single-precision unit vector of a list of counts, given as DOUBLE values."""
    length = f"sqrt(list_sum(list_transform({counts}, lambda c: c * c)))"
    return f"list_transform({counts}, lambda c: CAST(CAST(c / {length} AS FLOAT) AS DOUBLE))"


@query(
    "u2_embed_new_texts",
    f"""SELECT text_hash, round(list_sum(list_transform(range(64), lambda i: v[i + 1] * (i + 1))), 4) AS checksum
    FROM (SELECT text_hash, {_unit_sql('counts')} AS v FROM ({hashed_sql(
        "SELECT DISTINCT text, sha256(text) AS text_hash FROM "
        "(SELECT text FROM documents UNION ALL SELECT text FROM conversations)", "text", "text_hash")})
        WHERE list_sum(counts) > 0)""",
)
def u2(spark, d):
    texts = V.raw(spark, d, "documents").select("text").unionByName(V.raw(spark, d, "conversations").select("text"))
    vectors = H.embed_new_texts(texts, "text")
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    checksum = F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)
    return vectors.where(VEC.norm(F.col("embedding")) > 0).select("text_hash", F.round(checksum, 4).alias("checksum"))


@query("u3_summarize", "SELECT doc_id, split_part(text, chr(10), 1) AS summary FROM documents")
def u3(spark, d):
    first_line = H.summarizer_hook(lambda: lambda texts: texts.str.split("\n").str[0])
    return V.raw(spark, d, "documents").select("doc_id", first_line(F.col("text")).alias("summary"))


# ---- vector retrieval ----

_DISTANCE = "list_cosine_distance(v, CAST(embedding AS DOUBLE[]))"


@query(
    "v0_cosine_distance",
    """SELECT fact_id, conversation_id, round(list_cosine_distance(CAST(f.embedding AS DOUBLE[]),
        CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS distance
    FROM memory_facts f JOIN convs c USING (conversation_id)""",
    ["memory_facts", "convs"],
)
def v0(spark, d):
    facts = V.memory_facts(spark, d, vectors=True).select(
        "fact_id", "conversation_id", F.col("embedding").alias("a")
    )
    convs = V.conversations(spark, d, vectors=True).select("conversation_id", F.col("embedding").alias("b"))
    distance = VEC.cosine_distance(F.col("a"), F.col("b"))
    return facts.join(convs, "conversation_id").select(
        "fact_id", "conversation_id", r6(distance).alias("distance")
    )


_NEAREST_ITEMS = f"""SELECT query_id, id, content_type, {_DISTANCE} AS distance,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_DISTANCE} ASC NULLS LAST, id) AS INTEGER) AS position
    FROM vector_queries JOIN memory_items USING (session_id) WHERE is_active"""


@query(
    "v1_search_items",
    f"""SELECT query_id, id, content_type, round(distance, 6) + 0.0 AS distance, position FROM ({_NEAREST_ITEMS})
    WHERE position <= 5""",
    ["vector_queries", "memory_items"],
)
def v1(spark, d):
    found = SE.search_items(V.vector_queries(spark, d), V.memory_items(spark, d, vectors=True))
    return found.select("query_id", "id", "content_type", r6(F.col("distance")).alias("distance"), "position")


@query(
    "v1_search_items_by_type",
    f"""SELECT query_id, id, content_type, round(distance, 6) + 0.0 AS distance, position
    FROM ({_NEAREST_ITEMS} AND content_type IN ('src3', 'src4')) WHERE position <= 5""",
    ["vector_queries", "memory_items"],
)
def v1_types(spark, d):
    items = V.memory_items(spark, d, vectors=True)
    found = SE.search_items(V.vector_queries(spark, d), items, content_types=["src3", "src4"])
    return found.select("query_id", "id", "content_type", r6(F.col("distance")).alias("distance"), "position")


def _ranked_sql(table, key, where):
    return f"""SELECT query_id, {key}, round(1 - distance, 6) + 0.0 AS similarity, position FROM (
        SELECT query_id, {key}, {_DISTANCE} AS distance,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_DISTANCE} ASC NULLS LAST, {key}) AS INTEGER) AS position
        FROM vector_queries, {table} WHERE embedding IS NOT NULL AND {where}) WHERE position <= 5"""


@query(
    "v2_search_conversations",
    _ranked_sql("convs", "conversation_id", "NOT is_archived"),
    ["vector_queries", "convs"],
)
def v2(spark, d):
    found = SE.search_conversations(V.vector_queries(spark, d), V.conversations(spark, d, vectors=True))
    return found.select("query_id", "conversation_id", r6(F.col("similarity")).alias("similarity"), "position")


@query(
    "v3_search_facts",
    _ranked_sql("memory_facts", "fact_id", "confidence >= 0.5"),
    ["vector_queries", "memory_facts"],
)
def v3(spark, d):
    found = SE.search_facts(V.vector_queries(spark, d), V.memory_facts(spark, d, vectors=True))
    return found.select("query_id", "fact_id", r6(F.col("similarity")).alias("similarity"), "position")


_IVF = f"""WITH RECURSIVE q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, 's' || (vec_id % 8) AS session_id,
        CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    items AS (SELECT CAST(doc_id AS VARCHAR) AS id, 's' || (doc_id % 8) AS session_id,
        CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 13 <> 0),
    pivots AS (SELECT e AS p, row_number() OVER (ORDER BY md5(id), id) AS list FROM items
        QUALIFY list <= {LISTS}),
    placed AS (SELECT id, session_id, e, arg_min(list, struct_pack(a := round(list_cosine_distance(e, p), 12), b := list)) AS list
        FROM items, pivots GROUP BY ALL),
    probed AS (SELECT query_id, session_id, v, list FROM q, pivots
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_distance(v, p), 12), list) <= {PROBES}),
    found AS (SELECT query_id, id, list_cosine_distance(v, e) AS distance,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(v, e), id) AS INTEGER) AS position
        FROM probed JOIN placed USING (session_id, list) QUALIFY position <= 5)
    """


def _approx(spark, d):
    items = V.memory_items(spark, d, vectors=True)
    centres = SE.pick_pivots(items.where("is_active"), LISTS, "id")
    return SE.search_items_approx(V.vector_queries(spark, d), items, centres, probes=PROBES)


@query("v4_search_items_approx", _IVF + "SELECT query_id, id, round(distance, 6) + 0.0 AS distance, position FROM found")
def v4(spark, d):
    return _approx(spark, d).select("query_id", "id", r6(F.col("distance")).alias("distance"), "position")


@query(
    "v4_recall",
    _IVF
    + """, exact AS (SELECT query_id, id FROM q JOIN items USING (session_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(v, e), id) <= 5)
    SELECT count(*) AS n_exact, count(found.id) AS n_found, round(count(found.id) / count(*), 6) AS recall
    FROM exact LEFT JOIN found USING (query_id, id)""",
)
def v4_recall(spark, d):
    items = V.memory_items(spark, d, vectors=True).where(F.col("embedding").isNotNull())
    exact = SE.search_items(V.vector_queries(spark, d), items, whole_rows=False)
    return SE.recall(_approx(spark, d), exact).withColumn("recall", r6(F.col("recall")))


def _index(spark, d, path):
    items = V.memory_items(spark, d, vectors=True).where("is_active AND embedding IS NOT NULL")
    return LI.build_list_index(items, path, scope="session_id", lists=LISTS)


@query(
    "v1_search_items_pruned",
    f"""SELECT query_id, id, round(distance, 6) + 0.0 AS distance, position
    FROM ({_NEAREST_ITEMS} AND embedding IS NOT NULL) WHERE position <= 5""",
    ["vector_queries", "memory_items"],
)
def v1_pruned(spark, d):
    index = _index(spark, d, shared_folder(spark, "list-index"))
    found = LI.search_index_exact(V.vector_queries(spark, d), index, 5, scope="session_id").found
    return found.withColumn("distance", r6(F.col("distance")))


@query(
    "v4_index_recall",
    f"""SELECT count(*) AS n_exact, TRUE AS reached FROM ({_NEAREST_ITEMS} AND embedding IS NOT NULL) WHERE position <= 5""",
    ["vector_queries", "memory_items"],
)
def v4_index_recall(spark, d):
    """Compressed codes against exact search over the same stored rows: nine of ten exact hits at least."""
    index = _index(spark, d, shared_folder(spark, "list-index"))
    asked = V.vector_queries(spark, d)
    approx = LI.search_index_approx(asked, index, 5, probes=INDEX_PROBES, scope="session_id")
    exact = SE.nearest(asked, index.rows().withColumnRenamed("scope", "session_id"), 5, "id", scope="session_id")
    return SE.recall(approx, exact).select("n_exact", (F.col("recall") >= 0.9).alias("reached"))


@query(
    "v5_score_chunks",
    f"""SELECT doc_id, position, round(s, 6) + 0.0 AS score,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, position) AS INTEGER) AS rank
    FROM (SELECT doc_id, position, list_cosine_similarity({_unit_sql('c.counts')}, {_unit_sql('q.counts')})
            * CASE WHEN position < 2 THEN 1.0 / (1 + position) ELSE 1 END AS s
        FROM ({hashed_sql(_CHUNKS_SQL, 'chunk', 'doc_id, position')}) c,
            ({hashed_sql(_QUERY_SQL, 'asked', 'asked')}) q)""",
)
def v5(spark, d):
    chunks = V.raw(spark, d, "documents").select(
        "doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("position", "chunk")
    )
    known = F.col("position") < 2
    scored = SE.score_chunks(
        chunks.withColumn("embedding", VEC.hashed_embedding(F.col("chunk"))).withColumn(
            "importance", F.when(known, F.lit(1.0) / (F.lit(1) + F.col("position")))
        ),
        H.embed_text(spark, QUERY_TEXT),
        ["doc_id"],
    )
    return scored.select("doc_id", "position", r6(F.col("score")).alias("score"), "rank")


_ISO_CREATED = "regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
_SERVED_SQL = {
    "conversation": f"""conversation_id, importance_score, array_to_string(topics, ',') AS topics, {_ISO_CREATED} AS created_at,
        CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS tags""",
    "fact": """conversation_id, CAST(NULL AS DOUBLE) AS importance_score, CAST(NULL AS VARCHAR) AS topics,
        CAST(NULL AS VARCHAR) AS created_at, confidence, array_to_string(tags, ',') AS tags""",
}


def _kind_sql(kind, table, key, text, where):
    return f"""SELECT query_id, '{kind}' AS kind, position, id, text, round(1 - distance, 6) + 0.0 AS score,
        {_SERVED_SQL[kind]} FROM (
        SELECT query_id, {key} AS id, {text} AS text, {_DISTANCE} AS distance, {table}.*,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_DISTANCE}, {key}) AS INTEGER) AS position
        FROM vector_queries, {table} WHERE embedding IS NOT NULL AND {where}) WHERE position <= 5"""


_FACT_KIND = _kind_sql("fact", "memory_facts", "fact_id", "fact", "confidence >= 0.5")


def _search(spark, d, query_type):
    found = SE.stored_search(
        V.vector_queries(spark, d),
        V.conversations(spark, d, vectors=True),
        V.memory_facts(spark, d, vectors=True),
        query_type,
    )
    texts = {c: F.array_join(c, ",") for c in ("topics", "tags")}
    return found.withColumns({"score": r6(F.col("score")), **texts})


@query(
    "v6_stored_search_semantic",
    _kind_sql("conversation", "convs", "conversation_id", "summary", "NOT is_archived") + " UNION ALL " + _FACT_KIND,
    ["vector_queries", "convs", "memory_facts"],
)
def v6_semantic(spark, d):
    return _search(spark, d, "semantic")


@query("v6_stored_search_factual", _FACT_KIND, ["vector_queries", "memory_facts"])
def v6_factual(spark, d):
    return _search(spark, d, "factual")


@query(
    "v6_stored_search_temporal",
    f"""SELECT query_id, 'conversation' AS kind, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY importance_score DESC NULLS FIRST, conversation_id) AS INTEGER) AS position,
        conversation_id AS id, summary AS text, CAST(NULL AS DOUBLE) AS score, conversation_id, importance_score,
        array_to_string(c.topics, ',') AS topics, {_ISO_CREATED} AS created_at, CAST(NULL AS DOUBLE) AS confidence,
        CAST(NULL AS VARCHAR) AS tags
    FROM vector_queries q JOIN convs c ON list_has_any(q.topics, c.topics) QUALIFY position <= 5""",
    ["vector_queries", "convs"],
)
def v6_temporal(spark, d):
    return _search(spark, d, "temporal")


@query(
    "v7_answer_lookup",
    """SELECT query_id, id, round(distance, 6) + 0.0 AS distance,
        CASE WHEN len(hits) > 0 THEN regexp_replace(CASE WHEN contains(hits[1], ':')
            THEN substring(hits[1], strpos(hits[1], ':') + 1) ELSE hits[1] END, '^\\s+|\\s+$', '', 'g')
            ELSE substring(full_content, 1, 200) END AS answer
    FROM (SELECT query_id, id, full_content, """
    + _DISTANCE
    + """ AS distance, list_filter(string_split(full_content, chr(10)), lambda x: contains(x, 'the')) AS hits
        FROM vector_queries JOIN memory_items USING (session_id) WHERE is_active
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY """
    + _DISTANCE
    + """ ASC NULLS LAST, id) = 1)""",
    ["vector_queries", "memory_items"],
)
def v7(spark, d):
    """The marker of the tests does not occur in these texts, so a common word stands for it."""
    found = SE.answer_lookup(V.vector_queries(spark, d), V.memory_items(spark, d, vectors=True), marker="the")
    return found.withColumn("distance", r6(F.col("distance")))


# ---- packing, ingest, folds ----


@query(
    "w1_working_context",
    """SELECT session_id, id, form, CASE form WHEN 'full' THEN f ELSE c END AS tokens FROM packed_6963
    WHERE form IS NOT NULL""",
    ["packed_6963"],
)
def w1(spark, d):
    return P.working_context(V.memory_items(spark, d), BUDGET)


@query(
    "w1_session_budgets",
    """SELECT session_id, id, form, CASE form WHEN 'full' THEN f ELSE c END AS tokens FROM packed_models
    WHERE form IS NOT NULL""",
    ["packed_models"],
)
def w1_session_budgets(spark, d):
    known, _ = A.with_model_limits(V.session_models(spark, d))
    limit = F.floor(F.col("context_length") * F.col("safe_threshold")).cast("int")
    return P.working_context(V.memory_items(spark, d), known.select("session_id", limit.alias("max_tokens")))


@query(
    "w1_context_totals",
    """SELECT session_id, count(*) FILTER (WHERE form = 'full') AS full_items,
        count(*) FILTER (WHERE form = 'compressed') AS compressed_items, 6963 - min(remaining) AS total_tokens,
        min(remaining) AS available_tokens FROM packed_6963 GROUP BY session_id""",
    ["packed_6963"],
)
def w1_totals(spark, d):
    items = V.memory_items(spark, d)
    return P.context_totals(P.working_context(items, BUDGET), items, BUDGET)


@query(
    "w1_context_content",
    """SELECT p.session_id, p.id, content_type AS type, form, CASE form WHEN 'full' THEN f ELSE c END AS tokens,
        CASE form WHEN 'full' THEN full_content ELSE compressed_summary END AS content,
        CASE WHEN form = 'compressed' THEN 'Use retrieve_memory_item(''' || p.id || ''') to get full content' END
            AS retrieval_hint
    FROM packed_6963 p JOIN memory_items m ON m.id = p.id WHERE form IS NOT NULL""",
    ["packed_6963", "memory_items"],
)
def w1_content(spark, d):
    items = V.memory_items(spark, d)
    return P.context_content(P.working_context(items, BUDGET), items)


_FITTED = """SELECT doc_id, text AS fitted FROM documents WHERE length(text) // 4 <= 1548
    UNION ALL SELECT doc_id, coalesce(string_agg(chunk, ' [...] ' ORDER BY rank) FILTER (WHERE running <= 1548), '')
    FROM (SELECT doc_id, chunk, rank, sum(length(chunk) // 4) OVER (PARTITION BY doc_id ORDER BY rank) AS running
        FROM ({ranked}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) // 4 > 1548))
    GROUP BY doc_id"""


@query("w2_fit_to_window", _FITTED.format(ranked=f"SELECT *, position AS rank FROM ({_CHUNKS_SQL})"))
def w2(spark, d):
    return P.fit_to_window(V.raw(spark, d, "documents"), "doc_id", "text")


@query(
    "w2_fit_to_window_query",
    _FITTED.format(
        ranked=f"""SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY
            list_cosine_similarity({_unit_sql('c.counts')}, {_unit_sql('q.counts')}) DESC, position) AS rank
        FROM ({hashed_sql(_CHUNKS_SQL, 'chunk', 'doc_id, position, chunk')}) c,
            ({hashed_sql(_QUERY_SQL, 'asked', 'asked')}) q"""
    ),
)
def w2_query(spark, d):
    return P.fit_to_window(V.raw(spark, d, "documents"), "doc_id", "text", QUERY_TEXT)


def arrivals(items):
    return items.select(
        "id", "session_id", F.col("created_at").alias("arrived_at"), "content_type", "full_content", "priority"
    )


@query(
    "w3_ingest_items",
    """SELECT i.session_id, i.id, over_trigger, over_trigger OR token_count > 2000 AS was_compressed,
        token_count, CAST(stored AS INTEGER) AS compressed_token_count,
        round(CASE WHEN token_count > 0 THEN stored / token_count ELSE 1.0 END, 6) AS compression_ratio,
        CASE WHEN over_trigger OR token_count > 2000 THEN substring(full_content, 1, squeezed * 4)
             WHEN length(full_content) > 500 THEN substring(full_content, 1, 500) || '...'
             ELSE full_content END AS compressed_summary
    FROM ingested i JOIN arrivals a ON a.id = i.id""",
    ["ingested", "arrivals"],
)
def w3(spark, d):
    done = I.ingest_items(arrivals(V.memory_items(spark, d)), PACKING_MODEL)
    return done.select(
        "session_id",
        "id",
        "over_trigger",
        "was_compressed",
        "token_count",
        "compressed_token_count",
        r6(F.col("compression_ratio")).alias("compression_ratio"),
        "compressed_summary",
    )


# Updates name their task's session, but every eleventh part a wrong one; those of no task name session s0.
_NAMED = """SELECT u.*, CASE WHEN u.l_partkey % 11 = 0 THEN 'other' ELSE coalesce(t.session_id, 's0') END AS session_id
    FROM task_updates u LEFT JOIN (SELECT id, session_id FROM tasks) t ON u.id = t.id"""


def named_updates(spark, d):
    own = V.tasks(spark, d).select("id", F.col("session_id").alias("own"))
    named = F.when(F.col("l_partkey") % 11 == 0, "other").otherwise(F.coalesce("own", F.lit("s0")))
    return V.task_updates(spark, d).join(own, "id", "left").withColumn("session_id", named).drop("own")


@query(
    "w4_task_current",
    f"""SELECT t.id, t.session_id, coalesce(u.status, t.status) AS status, coalesce(u.progress, t.progress) AS progress,
        {sql_stamp('u.completed_at')} AS completed_at
    FROM tasks t LEFT JOIN (SELECT id, session_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
        arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress,
        arg_max(ts, seq) FILTER (WHERE status = 'completed') AS completed_at
        FROM ({_NAMED}) GROUP BY id, session_id) u ON u.id = t.id AND u.session_id = t.session_id""",
    ["tasks", "task_updates"],
)
def w4(spark, d):
    current, _ = FO.task_current(V.tasks(spark, d), named_updates(spark, d), V.UPDATE_ORDER)
    return current.select("id", "session_id", "status", "progress", stamp(F.col("completed_at")).alias("completed_at"))


@query(
    "w4_unmatched_updates",
    f"""SELECT id, session_id, max(progress) IS NOT NULL AS has_progress FROM ({_NAMED}) u
    WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = u.id AND t.session_id = u.session_id) GROUP BY id, session_id""",
    ["tasks", "task_updates"],
)
def w4_unmatched(spark, d):
    _, unknown = FO.task_current(V.tasks(spark, d), named_updates(spark, d), V.UPDATE_ORDER)
    return unknown.select("id", "session_id", F.col("new_progress").isNotNull().alias("has_progress"))


_FOLDED = f"""SELECT id, session_id, CAST(access_count + coalesce(n, 0) AS BIGINT) AS access_count,
        {sql_stamp('greatest(last_accessed, last)')} AS last_accessed
    FROM memory_items LEFT JOIN (SELECT item_id, session_id AS s, count(*) AS n, max(ts) AS last
        FROM access_log GROUP BY ALL) ON item_id = id AND s = session_id"""


@query("w5_access_fold", _FOLDED, ["memory_items", "access_log"])
def w5(spark, d):
    folded = FO.access_fold(V.memory_items(spark, d), V.access_log(V.raw(spark, d, "events")))
    return folded.select(
        "id", "session_id", "access_count", stamp(F.col("last_accessed")).alias("last_accessed")
    )


# ---- maintenance jobs ----


@query(
    "m1_hygiene_candidates",
    f"""SELECT id, session_id FROM memory_items WHERE is_active AND last_accessed < {AS_OF_SQL} - INTERVAL 7 DAY
    AND token_count > 2 * compressed_token_count""",
    ["memory_items"],
)
def m1_candidates(spark, d):
    return M.hygiene_candidates(V.memory_items(spark, d), V.AS_OF).select("id", "session_id")


_PRUNED = f"""CASE WHEN last_accessed < {AS_OF_SQL} - INTERVAL 30 DAY AND priority < 5 THEN FALSE ELSE is_active END"""


@query("m1_prune", f"SELECT id, {_PRUNED} AS is_active FROM memory_items", ["memory_items"])
def m1_prune(spark, d):
    return M.prune(V.memory_items(spark, d), V.AS_OF).select("id", "is_active")


@query(
    "m1_state_after",
    f"""SELECT session_id, CAST(sum(CASE WHEN {_PRUNED} THEN compressed_token_count ELSE 0 END) AS BIGINT)
        AS used_context_length, count(*) FILTER (WHERE {_PRUNED}) AS active_count
    FROM memory_items GROUP BY session_id""",
    ["memory_items"],
)
def m1_state(spark, d):
    _, _, state = M.hygiene(V.memory_items(spark, d), V.session_models(spark, d), V.AS_OF)
    return state.select("session_id", "used_context_length", "active_count")


@query(
    "m1_hygiene_metrics",
    f"""SELECT session_id, '{{"cache_hits":0,"compressions":' || count(*) || ',"decompressions":0}}' AS performance_metrics
    FROM memory_items WHERE is_active AND last_accessed < {AS_OF_SQL} - INTERVAL 7 DAY
    AND token_count > 2 * compressed_token_count GROUP BY session_id""",
    ["memory_items"],
)
def m1_metrics(spark, d):
    _, counted, _ = M.hygiene(V.memory_items(spark, d), V.session_models(spark, d), V.AS_OF)
    return A.performance_metrics(counted)


@query(
    "m2_compress_old",
    f"""SELECT conversation_id, created_at <= {AS_OF_SQL} - INTERVAL 30 DAY AS is_compressed,
        CAST(CASE WHEN created_at <= {AS_OF_SQL} - INTERVAL 30 DAY THEN 0 ELSE n_messages END AS INTEGER) AS n_messages
    FROM convs""",
    ["convs"],
)
def m2(spark, d):
    after = M.compress_old(V.conversations(spark, d, messages=True), V.AS_OF)
    return after.select("conversation_id", "is_compressed", F.size("messages").alias("n_messages"))


@query(
    "m3_retention_tiers",
    f"""SELECT conversation_id, CASE WHEN age >= 365 * f THEN 'delete' WHEN age >= 90 * f THEN 'archive'
        WHEN age >= 30 * f THEN 'compress' ELSE 'keep' END AS tier
    FROM (SELECT conversation_id, date_diff('second', created_at, {AS_OF_SQL} + INTERVAL 60 DAY) / 86400 AS age,
        CASE WHEN importance_score >= 0.5 THEN 2.0 ELSE 1.0 END AS f FROM convs)""",
    ["convs"],
)
def m3(spark, d):
    from datetime import timedelta

    tiers = M.retention_tiers(V.conversations(spark, d), V.AS_OF + timedelta(days=60))
    return tiers.select("conversation_id", "tier")


def _quarantined_conversations(spark, d):
    facts = V.memory_facts(spark, d)
    return facts.join(V.context_quarantine(spark, d).select(F.col("id").alias("fact_id")), "fact_id", "left_semi")


_QUARANTINED = "SELECT conversation_id FROM memory_facts WHERE fact_id IN (SELECT id FROM context_quarantine)"


@query(
    "m4_mark_compressed",
    f"SELECT conversation_id, conversation_id IN ({_QUARANTINED}) AS is_compressed FROM convs",
    ["convs", "memory_facts", "context_quarantine"],
)
def m4(spark, d):
    marked, _ = M.mark_compressed(V.conversations(spark, d), _quarantined_conversations(spark, d))
    return marked.select("conversation_id", "is_compressed")


@query(
    "m4_mark_archived_found",
    f"""SELECT DISTINCT conversation_id, conversation_id IN (SELECT conversation_id FROM convs) AS found
    FROM ({_QUARANTINED})""",
    ["convs", "memory_facts", "context_quarantine"],
)
def m4_found(spark, d):
    _, found = M.mark_archived(V.conversations(spark, d), _quarantined_conversations(spark, d))
    return found


@query(
    "m5_delete_conversations",
    f"""SELECT 'conversation' AS kind, conversation_id AS id FROM convs WHERE conversation_id NOT IN ({_QUARANTINED})
    UNION ALL SELECT 'fact', fact_id FROM memory_facts WHERE conversation_id NOT IN ({_QUARANTINED})""",
    ["convs", "memory_facts", "context_quarantine"],
)
def m5(spark, d):
    convs, facts = M.delete_conversations(
        V.conversations(spark, d), V.memory_facts(spark, d), _quarantined_conversations(spark, d)
    )
    kinds = convs.select(F.lit("conversation").alias("kind"), F.col("conversation_id").alias("id"))
    return kinds.unionByName(facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id")))


@query(
    "m5_delete_facts",
    "SELECT fact_id FROM memory_facts WHERE fact_id NOT IN (SELECT id FROM context_quarantine)",
    ["memory_facts", "context_quarantine"],
)
def m5_facts(spark, d):
    keys = V.context_quarantine(spark, d).select(F.col("id").alias("fact_id"))
    return M.delete_facts(V.memory_facts(spark, d), keys).select("fact_id")


@query(
    "m6_quarantine",
    """SELECT session_id, 'thread_' || substring(md5(id), 1, 8) AS thread_id, content_type AS context_type,
        full_content AS isolated_content, 'too long' AS reason_for_isolation, token_count
    FROM memory_items WHERE token_count > 2000""",
    ["memory_items"],
)
def m6(spark, d):
    isolated = M.quarantine(V.memory_items(spark, d), F.col("token_count") > 2000, "too long", V.AS_OF)
    return isolated.select(
        "session_id", "thread_id", "context_type", "isolated_content", "reason_for_isolation", "token_count"
    )


@query(
    "m6_thread_collisions",
    """SELECT thread_id, count(*) AS n_rows FROM (SELECT 'thread_' || substring(md5(id), 1, 8) AS thread_id
        FROM memory_items) GROUP BY 1 HAVING count(*) > 1""",
    ["memory_items"],
)
def m6_collisions(spark, d):
    everything = M.quarantine(V.memory_items(spark, d), F.lit(True), "check", V.AS_OF)
    return M.thread_collisions(everything)


@query(
    "m7_answer_hil",
    f"""SELECT h.id, coalesce(r.response, h.response) AS response,
        CASE WHEN r.id IS NOT NULL THEN 'answered' ELSE h.status END AS status, {sql_stamp('r.ts')} AS answered_at
    FROM hil h LEFT JOIN hil_responses r ON r.id = h.id AND r.session_id = h.session_id""",
    ["hil", "hil_responses"],
)
def m7(spark, d):
    after, _ = M.answer_hil(V.hil_interactions(spark, d), V.hil_responses(spark, d))
    return after.select("id", "response", "status", stamp(F.col("answered_at")).alias("answered_at"))


@query(
    "m7_unmatched_responses",
    """SELECT r.id, r.session_id, r.response FROM hil_responses r LEFT JOIN hil h ON r.id = h.id AND r.session_id = h.session_id
    WHERE h.id IS NULL""",
    ["hil", "hil_responses"],
)
def m7_unmatched(spark, d):
    _, unmatched = M.answer_hil(V.hil_interactions(spark, d), V.hil_responses(spark, d))
    return unmatched.select("id", "session_id", "response")


@query(
    "m8_create_tasks",
    """SELECT id, session_id, status, priority, progress, '[]' AS dependencies FROM tasks
    UNION ALL SELECT 'hil_' || id, session_id, 'pending', priority, 0, '[]' FROM hil""",
    ["tasks", "hil"],
)
def m8_tasks(spark, d):
    base = V.tasks(spark, d).withColumn("dependencies", F.lit("[]"))
    new = V.hil_interactions(spark, d).select(
        F.concat(F.lit("hil_"), "id").alias("id"), "session_id", F.col("question").alias("title"), "priority"
    )
    after, _ = M.create_tasks(base, new, V.AS_OF)
    return after.select("id", "session_id", "status", "priority", "progress", "dependencies")


@query(
    "m8_create_agents",
    """SELECT id, agent_name, agent_type, is_active, '[]' AS assigned_tools FROM agents
    UNION ALL SELECT 'c' || c_custkey, c_name, c_mktsegment, TRUE, '[]' FROM customer""",
    ["agents"],
)
def m8_agents(spark, d):
    base = V.agents(spark, d).withColumn("assigned_tools", F.lit("[]"))
    new = V.raw(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.lit("s0").alias("session_id"),
        F.col("c_name").alias("agent_name"),
        F.col("c_mktsegment").alias("agent_type"),
    )
    after, _ = M.create_agents(base, new, V.AS_OF)
    return after.select("id", "agent_name", "agent_type", "is_active", "assigned_tools")


_STATUS_UPDATES = """SELECT 'train_' || (user_id % 30) AS training_id,
        CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
        CASE WHEN event_type = 'error' THEN 'event ' || event_id ELSE '' END AS error_message, ts FROM events"""


@query(
    "m9_training_status",
    f"""SELECT training_id, coalesce(u.status, h.status) AS status,
        {sql_stamp('coalesce(u.completed_at, h.completed_at)')} AS completed_at, u.error_message
    FROM training_history h LEFT JOIN (SELECT training_id, arg_max(status, ts) AS status,
        max(ts) FILTER (WHERE status = 'completed') AS completed_at,
        arg_max(error_message, ts) FILTER (WHERE error_message <> '') AS error_message
        FROM ({_STATUS_UPDATES}) GROUP BY 1) u USING (training_id)""",
    ["training_history"],
)
def m9(spark, d):
    kind = F.col("event_type")
    updates = V.raw(spark, d, "events").select(
        F.concat(F.lit("train_"), (F.col("user_id") % 30).cast("string")).alias("training_id"),
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running").alias("status"),
        F.when(kind == "error", F.concat(F.lit("event "), F.col("event_id").cast("string")))
        .otherwise("")
        .alias("error_message"),
        "ts",
    )
    after, _ = M.training_status(V.training_history(spark, d), updates)
    return after.select("training_id", "status", stamp(F.col("completed_at")).alias("completed_at"), "error_message")


_STORED_KEY = "md5(length(source) || '|' || source || '|' || text || '#' || doc_id)"


@query(
    "m10_store_facts",
    f"""SELECT 'conversation' AS kind, 'conv_' || {_STORED_KEY} AS id, 'conv_' || {_STORED_KEY} AS conversation_id,
        'system: ' || text || '#' || doc_id AS body, 0.3::DOUBLE AS score, '' AS tags FROM documents
    UNION ALL SELECT 'fact', 'fact_' || {_STORED_KEY}, 'conv_' || {_STORED_KEY}, text || '#' || doc_id,
        0.9::DOUBLE, lang FROM documents""",
)
def m10(spark, d):
    contents = V.raw(spark, d, "documents").select(
        F.concat("text", F.lit("#"), F.col("doc_id").cast("string")).alias("content"),
        F.lit(0.9).alias("importance"),
        F.array("lang").alias("tags"),
        F.col("source").alias("user_id"),
    )
    convs, facts = M.store_facts(contents, V.AS_OF)
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return convs.select(
        F.lit("conversation").alias("kind"),
        F.col("conversation_id").alias("id"),
        "conversation_id",
        F.array_join(said, "|").alias("body"),
        F.col("importance_score").alias("score"),
        F.lit("").alias("tags"),
    ).unionByName(
        facts.select(
            F.lit("fact").alias("kind"),
            F.col("fact_id").alias("id"),
            "conversation_id",
            F.col("fact").alias("body"),
            F.col("confidence").alias("score"),
            F.array_join("tags", ",").alias("tags"),
        )
    )


@query(
    "m10_store_conversations",
    """SELECT 'conv_' || md5(length(conv_id::VARCHAR) || '|' || conv_id || '|' || text || '#' || turn) AS conversation_id, 0.5::DOUBLE AS importance_score,
        'user: ' || text || '#' || turn AS body, role AS topics, CAST(conv_id AS VARCHAR) AS user_id FROM conversations""",
)
def m10_conversations(spark, d):
    contents = V.turns(spark, d).select(
        F.concat("text", F.lit("#"), F.col("turn").cast("string")).alias("content"),
        F.lit(None).cast("double").alias("importance"),
        F.array("role").alias("tags"),
        F.col("conversation_id").alias("user_id"),
    )
    stored = M.store_conversations(contents, V.AS_OF)
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return stored.select(
        "conversation_id",
        "importance_score",
        F.array_join(said, "|").alias("body"),
        F.array_join("topics", ",").alias("topics"),
        "user_id",
    )


@query(
    "m11_user_context",
    f"""SELECT CAST(user_id AS VARCHAR) AS user_id, props AS context, {sql_stamp('ts')} AS last_updated FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) = 1""",
)
def m11(spark, d):
    updates = V.raw(spark, d, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("context"), "ts"
    )
    return M.user_context(updates).withColumn("last_updated", stamp(F.col("last_updated")))
