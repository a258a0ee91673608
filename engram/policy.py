"""Model limits, compression strategies and policy numbers."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Name, context_length, safe_threshold, compression_trigger,
# max_tokens, cost_per_1k_input, cost_per_1k_output.
MODELS = [
    ("gpt-4", 8192, 0.85, 0.75, 4096, 0.03, 0.06),
    ("gpt-4-32k", 32768, 0.85, 0.75, 8192, 0.06, 0.12),
    ("gpt-4-turbo", 128000, 0.85, 0.75, 4096, 0.01, 0.03),
    ("gpt-4o", 128000, 0.85, 0.75, 16384, 0.0025, 0.01),
    ("gpt-4o-mini", 128000, 0.85, 0.75, 16384, 0.00015, 0.0006),
    ("gpt-3.5-turbo", 16385, 0.85, 0.75, 4096, 0.0005, 0.0015),
    ("gpt-3.5-turbo-16k", 16385, 0.85, 0.75, 4096, 0.001, 0.002),
    ("gpt-5", 200000, 0.85, 0.75, 16384, 0.005, 0.015),
    ("claude-3-opus", 200000, 0.85, 0.75, 4096, 0.015, 0.075),
    ("claude-3-sonnet", 200000, 0.85, 0.75, 4096, 0.003, 0.015),
    ("claude-3-haiku", 200000, 0.85, 0.75, 4096, 0.00025, 0.00125),
    ("gemma-3-4b", 8192, 0.85, 0.75, 2048, 0.0, 0.0),
]
MODEL_COLUMNS = (
    "model string, context_length int, safe_threshold double, compression_trigger double, "
    "max_tokens int, cost_per_1k_input double, cost_per_1k_output double"
)

# Strategy, summary_ratio, detail_retention.
STRATEGIES = [
    ("aggressive", 0.1, "minimal"),
    ("balanced", 0.25, "moderate"),
    ("conservative", 0.5, "high"),
]

# Text formats.
RETRIEVAL_HINT = "Use retrieve_memory_item('%s') to get full content"
ASKED_PREFIX = "User asked: "
ASKED_CHARS = 100
NO_USER_SUMMARY = "Conversation"
ELLIPSIS = "..."
CHUNK_SEPARATOR = " [...] "
THREAD_PREFIX = "thread_"
ANSWER_MARKER = "ANSWER_KEY"
ANSWER_PREVIEW_CHARS = 200


@dataclass(frozen=True)
class ModelLimits:
    model: str
    context_length: int
    safe_threshold: float
    compression_trigger: float
    max_tokens: int
    cost_per_1k_input: float
    cost_per_1k_output: float

    @property
    def packing_budget(self) -> int:
        return int(self.context_length * self.safe_threshold)


# Names in the export, and what a session is set to unless it says otherwise.
ITEMS_SECTION = "active_memory_items"
STATE_FIELD = "memory_state"
DEFAULT_SETTINGS = {"memory_approach": "external_llm", "use_slm": False, "use_lora_finetuning": False}


@dataclass(frozen=True)
class Policy:
    """Numbers the operators default to; operators take most of them as arguments."""

    # Fixed values.

    always_compress_above: int = 2000
    summary_chars: int = 500
    chars_per_token: int = 4
    idle_days: int = 7
    prune_days: int = 30
    prune_below_priority: int = 5
    chunk_tokens: int = 1024
    chunk_overlap: int = 128
    window_tokens: int = 2048
    reserve_tokens: int = 500
    ring_size: int = 10
    compress_after_days: int = 30
    archive_after_days: int = 90
    delete_after_days: int = 365
    retention_importance: float = 0.5
    retrain_conversations: int = 25
    retrain_hours: float = 24.0
    retrain_importance: float = 0.7
    # Not fixed: the rule is named without a number, and the factor is our choice.
    important_multiplier: float = 2.0


POLICY = Policy()


def model_limits(model: str) -> ModelLimits:
    for row in MODELS:
        if row[0] == model:
            return ModelLimits(*row)
    raise ValueError(f"unknown model: {model}")


def strategy_ratio(strategy: str) -> float:
    for name, ratio, _ in STRATEGIES:
        if name == strategy:
            return ratio
    raise ValueError(f"unknown compression strategy: {strategy}")


def models_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, MODEL_COLUMNS)


def strategies_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "strategy string, summary_ratio double, detail_retention string")
