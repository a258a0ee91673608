"""Explicit schemas of the engine's tables, with column defaults.

A column that may not be null is declared non-nullable here; ``apply_defaults``
uses that flag to split off rows that break it.
"""

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
)
TS = T.TimestampNTZType()
STRINGS = T.ArrayType(STR)
VECTOR = T.ArrayType(T.FloatType())
MESSAGE = T.StructType([T.StructField("role", STR), T.StructField("content", STR)])
MESSAGES = T.ArrayType(MESSAGE)


def _schema(columns, required):
    return T.StructType([T.StructField(name, kind, name not in required) for name, kind in columns])


SCHEMAS = {
    "conversations": _schema(
        [
            ("conversation_id", STR),
            ("created_at", TS),
            ("updated_at", TS),
            ("messages", MESSAGES),
            ("summary", STR),
            ("importance_score", DBL),
            ("topics", STRINGS),
            ("embedding", VECTOR),
            ("user_id", STR),
            ("extra_metadata", STR),
            ("is_compressed", BOOL),
            ("is_archived", BOOL),
        ],
        {"conversation_id", "created_at", "messages"},
    ),
    "memory_facts": _schema(
        [
            ("fact_id", STR),
            ("conversation_id", STR),
            ("fact", STR),
            ("confidence", DBL),
            ("created_at", TS),
            ("embedding", VECTOR),
            ("tags", STRINGS),
            ("source_type", STR),
        ],
        {"fact_id", "fact", "created_at"},
    ),
    "user_preferences": _schema(
        [
            ("user_id", STR),
            ("preferences", T.MapType(STR, STR)),
            ("created_at", TS),
            ("updated_at", TS),
        ],
        {"user_id", "preferences", "created_at"},
    ),
    "training_history": _schema(
        [
            ("training_id", STR),
            ("started_at", TS),
            ("completed_at", TS),
            ("num_conversations", INT),
            ("adapter_path", STR),
            ("status", STR),
            ("metrics", STR),
            ("error_message", STR),
        ],
        {"training_id"},
    ),
    "memory_items": _schema(
        [
            ("id", STR),
            ("session_id", STR),
            ("content_type", STR),
            ("full_content", STR),
            ("compressed_summary", STR),
            ("embedding", VECTOR),
            ("token_count", INT),
            ("compressed_token_count", INT),
            ("compression_ratio", DBL),
            ("is_active", BOOL),
            ("priority", INT),
            ("access_count", INT),
            ("last_accessed", TS),
            ("created_at", TS),
            ("updated_at", TS),
            ("metadata", STR),
        ],
        {
            "id",
            "session_id",
            "content_type",
            "full_content",
            "compressed_summary",
            "token_count",
            "compressed_token_count",
        },
    ),
    "session_state": _schema(
        [
            ("session_id", STR),
            ("model_name", STR),
            ("total_context_length", INT),
            ("used_context_length", LONG),
            ("available_context_length", LONG),
            ("context_utilization_percentage", DBL),
            ("active_count", LONG),
            ("token_usage_stats", STR),
            ("performance_metrics", STR),
            ("updated_at", TS),
        ],
        {"session_id", "model_name", "total_context_length"},
    ),
    "tasks": _schema(
        [
            ("id", STR),
            ("session_id", STR),
            ("title", STR),
            ("description", STR),
            ("status", STR),
            ("priority", INT),
            ("assigned_agent", STR),
            ("dependencies", STR),
            ("progress", INT),
            ("created_at", TS),
            ("updated_at", TS),
            ("completed_at", TS),
            ("metadata", STR),
        ],
        {"id", "session_id", "title"},
    ),
    "agents": _schema(
        [
            ("id", STR),
            ("session_id", STR),
            ("agent_name", STR),
            ("agent_type", STR),
            ("capabilities", STR),
            ("assigned_tools", STR),
            ("performance_stats", STR),
            ("is_active", BOOL),
            ("created_at", TS),
            ("updated_at", TS),
            ("metadata", STR),
        ],
        {"id", "session_id", "agent_name", "agent_type"},
    ),
    "context_quarantine": _schema(
        [
            ("id", STR),
            ("session_id", STR),
            ("thread_id", STR),
            ("context_type", STR),
            ("isolated_content", STR),
            ("reason_for_isolation", STR),
            ("token_count", INT),
            ("is_active", BOOL),
            ("created_at", TS),
            ("updated_at", TS),
            ("metadata", STR),
        ],
        {"id", "session_id", "thread_id", "context_type", "isolated_content"},
    ),
    "hil_interactions": _schema(
        [
            ("id", STR),
            ("session_id", STR),
            ("question", STR),
            ("response", STR),
            ("status", STR),
            ("priority", INT),
            ("created_at", TS),
            ("answered_at", TS),
            ("metadata", STR),
        ],
        {"id", "session_id", "question"},
    ),
    # Append-only logs and raw inputs the operators read.
    "access_log": _schema(
        [("event_id", STR), ("item_id", STR), ("session_id", STR), ("decompress", BOOL), ("ts", TS)],
        {"event_id", "item_id", "session_id", "ts"},
    ),
    "token_log": _schema(
        [
            ("event_id", STR),
            ("session_id", STR),
            ("model", STR),
            ("input_tokens", LONG),
            ("output_tokens", LONG),
            ("ts", TS),
        ],
        {"event_id", "session_id", "model", "ts"},
    ),
    "events": _schema(
        [
            ("event_id", LONG),
            ("ts", TS),
            ("user_id", LONG),
            ("event_type", STR),
            ("value", DBL),
            ("props", STR),
        ],
        set(),
    ),
}

# Column defaults. "now" stands for the caller's as_of time.
DEFAULTS = {
    "conversations": {
        "created_at": "now",
        "updated_at": "now",
        "importance_score": 0.5,
        "is_compressed": False,
        "is_archived": False,
    },
    "memory_facts": {"confidence": 0.8, "created_at": "now", "source_type": "extraction"},
    "user_preferences": {"preferences": {}, "created_at": "now", "updated_at": "now"},
    "training_history": {"started_at": "now", "status": "pending"},
    "memory_items": {
        "is_active": True,
        "priority": 0,
        "access_count": 0,
        "last_accessed": "now",
        "created_at": "now",
        "updated_at": "now",
        "metadata": "{}",
    },
    "tasks": {
        "status": "pending",
        "priority": 0,
        "dependencies": "[]",
        "progress": 0,
        "created_at": "now",
        "updated_at": "now",
        "metadata": "{}",
    },
    "agents": {
        "capabilities": "[]",
        "assigned_tools": "[]",
        "performance_stats": "{}",
        "is_active": True,
        "created_at": "now",
        "updated_at": "now",
        "metadata": "{}",
    },
    "context_quarantine": {
        "is_active": True,
        "created_at": "now",
        "updated_at": "now",
        "metadata": "{}",
    },
    "hil_interactions": {"status": "pending", "priority": 0, "created_at": "now", "metadata": "{}"},
}
