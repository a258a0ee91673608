"""Session state as JSON documents, in pages of bounded size."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.values import iso_timestamp
from engram.operators.filters import newest
from engram.operators.ranking import item_order, positions, task_order
from engram.policy import DEFAULT_SETTINGS, ITEMS_SECTION, STATE_FIELD
from engram.sources.shared import settled

PAGE_ROWS = 1000

# The columns of exported items.
ITEM_FIELDS = [
    "id",
    "content_type",
    "compressed_summary",
    "token_count",
    "compressed_token_count",
    "priority",
    "access_count",
    "last_accessed",
]


def paged(
    df: DataFrame,
    section: str,
    fields: Sequence[str],
    ordered_by: Sequence[str],
    order: Sequence[Column],
    page_rows: int = PAGE_ROWS,
    key: str = "id",
) -> DataFrame:
    """(session_id, section, page, n_rows, body): the rows of a section as JSON arrays.

    A page holds at most ``page_rows`` rows, so a session of any size is
    exported whole without one task holding it. Keys are numbered first, each
    row is then joined to its place once.
    """
    kinds = dict(df.dtypes)
    shown = [iso_timestamp(F.col(c)).alias(c) if kinds[c] == "timestamp_ntz" else F.col(c) for c in fields]
    keys = df.select("session_id", key, *[c for c in ordered_by if c not in ("session_id", key)])
    placed = positions(keys, ["session_id"], order).select(F.col(key).alias("_key"), "position")
    rows = df.select("session_id", F.col(key).alias("_key"), F.struct(*shown).alias("_row")).join(placed, "_key")
    page = F.floor((F.col("position") - 1) / page_rows).cast("int")
    listed = F.array_sort(F.collect_list(F.struct("position", "_row")))
    return (
        rows.groupBy("session_id", page.alias("page"))
        .agg(listed.alias("_rows"))
        .select(
            "session_id",
            F.lit(section).alias("section"),
            "page",
            F.size("_rows").alias("n_rows"),
            F.to_json(F.col("_rows._row"), {"ignoreNullFields": "false"}).alias("body"),
        )
    )


def item_pages(items: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Active items, without their full content."""
    active = items.where(F.col("is_active"))
    return paged(active, ITEMS_SECTION, ITEM_FIELDS, ["priority", "last_accessed"], item_order(), page_rows)


def state_sections(
    states: DataFrame, usage: DataFrame, metrics: DataFrame, as_of: datetime, settings: DataFrame | None = None
) -> DataFrame:
    """session_id, head: all that the export says of a session itself.

    ``states`` is ``aggregates.session_state``, ``usage`` is ``token_usage``,
    ``metrics`` has performance_metrics as JSON, ``settings`` may have
    (session_id and the names of ``DEFAULT_SETTINGS``). What a session
    does not have is an empty object, a setting without a row its default.
    """
    used = usage.select(
        "session_id", F.to_json(F.struct("input_tokens", "output_tokens", "total_cost")).alias("usage")
    )
    found = states.join(used, "session_id", "left").join(metrics, "session_id", "left")
    if settings is not None:
        found = found.join(settings, "session_id", "left")
    chosen = [
        (F.coalesce(F.col(name), F.lit(default)) if settings is not None else F.lit(default)).alias(name)
        for name, default in DEFAULT_SETTINGS.items()
    ]
    head = F.to_json(
        F.struct(
            F.col("model_name").alias("model"),
            *chosen,
            iso_timestamp(F.lit(as_of).cast("timestamp_ntz")).alias("timestamp"),
        ),
        {"ignoreNullFields": "false"},
    )
    sizes = F.to_json(
        F.struct(
            F.col("total_context_length").alias("total_context"),
            F.col("used_context_length").alias("used_context"),
            F.col("available_context_length").alias("available_context"),
            F.col("context_utilization_percentage").alias("utilization_percentage"),
        ),
        {"ignoreNullFields": "false"},
    )
    # The counters are JSON already and are put in as they are.
    inner = F.concat(
        F.expr("substr(_sizes, 1, length(_sizes) - 1)"),
        F.lit(',"token_usage":'),
        F.coalesce(F.col("usage"), F.lit("{}")),
        F.lit(',"performance_metrics":'),
        F.coalesce(F.col("performance_metrics"), F.lit("{}")),
        F.lit("}"),
    )
    return (
        found.withColumn("_sizes", sizes)
        .withColumn("_head", head)
        .select(
            "session_id",
            F.concat(F.expr("substr(_head, 1, length(_head) - 1)"), F.lit(f',"{STATE_FIELD}":'), inner, F.lit("}")).alias("head"),
        )
    )


def export_state(
    states: DataFrame,
    items: DataFrame,
    tasks: DataFrame,
    agents: DataFrame,
    quarantined: DataFrame,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """(session_id, section, page, document) for every session in ``states``.

    Section ``session_state`` is one document per session; the other sections
    are present where the session has rows for them. Each child table is paged
    on its own, so no two of them are ever joined. ``states`` has (session_id,
    head), as ``state_sections`` gives it; it is written out first, as every
    section is matched with it.
    """
    states = settled(states, "export-states")
    state = states.select(
        "session_id",
        F.lit("session_state").alias("section"),
        F.lit(0).alias("page"),
        F.lit(1).alias("n_rows"),
        F.col("head").alias("body"),
    )
    newest_first = [newest("created_at"), F.asc("id")]
    children = [
        item_pages(items, page_rows),
        paged(
            tasks,
            "tasks",
            [c for c in tasks.columns if c != "session_id"],
            ["priority", "created_at"],
            task_order(),
            page_rows,
        ),
        paged(
            agents.where(F.col("is_active")),
            "agents",
            [c for c in agents.columns if c != "session_id"],
            [],
            [F.asc("id")],
            page_rows,
        ),
        paged(
            quarantined.where(F.col("is_active")),
            "quarantined_contexts",
            [c for c in quarantined.columns if c != "session_id"],
            ["created_at"],
            newest_first,
            page_rows,
        ),
    ]
    pages = state
    for child in children:
        known = child.join(states.select("session_id"), "session_id", "left_semi")
        pages = pages.unionByName(known)
    document = F.concat(
        F.lit('{"session_id":'),
        _json_text(F.col("session_id")),
        F.lit(',"section":"'),
        F.col("section"),
        F.lit('","page":'),
        F.col("page").cast("string"),
        F.lit(',"body":'),
        F.col("body"),
        F.lit("}"),
    )
    return pages.select("session_id", "section", "page", "n_rows", document.alias("document"))


def _json_text(value: Column) -> Column:
    """A string as JSON, quoted and escaped."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def write_export(pages: DataFrame, path: str) -> None:
    """One line per document, in folders by section."""
    pages.select("section", F.col("document").alias("value")).write.partitionBy("section").mode(
        "errorifexists"
    ).text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(value, section): the exported lines with the folder they came from."""
    return spark.read.text(path)
