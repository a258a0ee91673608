"""Table to table jobs: hygiene, retention, flags, deletes, quarantine, inserts."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.hooks import Hook, default_tokenizer
from engram.functions.text import parse_messages, thread_id
from engram.functions.values import ntz, set_keys
from engram.operators.aggregates import session_state
from engram.operators.joins import cascade_delete
from engram.policy import POLICY
from engram.schemas import MESSAGES
from engram.sources.tables import apply_defaults


def hygiene_candidates(items: DataFrame, as_of: datetime) -> DataFrame:
    """Active items unread for a week whose summary is less than half their size.

    They are only counted, as compressions of their session; nothing is rewritten.
    """
    return items.where(
        F.col("is_active")
        & (F.col("last_accessed") < ntz(as_of - timedelta(days=POLICY.idle_days)))
        & (F.col("token_count") > F.col("compressed_token_count") * 2)
    )


def hygiene_metrics(items: DataFrame, as_of: datetime) -> DataFrame:
    return hygiene_candidates(items, as_of).select(
        "session_id", F.lit("compressions").alias("metric"), F.lit(1).alias("increment")
    )


def prune(items: DataFrame, as_of: datetime, days: int = POLICY.prune_days) -> DataFrame:
    """Long unread items of low priority become inactive; a null priority is kept."""
    stale = (F.col("last_accessed") < ntz(as_of - timedelta(days=days))) & (
        F.col("priority") < POLICY.prune_below_priority
    )
    return items.withColumn("is_active", F.when(stale, False).otherwise(F.col("is_active")))


def hygiene(
    items: DataFrame, sessions: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after pruning, counted compressions, session state after pruning).

    Compressions are counted on the items as they were; ``sessions`` is
    (session_id, model).
    """
    pruned = prune(items, as_of)
    return pruned, hygiene_metrics(items, as_of), session_state(pruned, sessions)


def compress_old(
    conversations: DataFrame, as_of: datetime, days: int = POLICY.compress_after_days
) -> DataFrame:
    """Old conversations lose their messages and keep their summary."""
    old = (F.col("created_at") <= ntz(as_of - timedelta(days=days))) & ~F.col("is_compressed")
    return conversations.withColumn(
        "messages", F.when(old, F.array().cast(MESSAGES)).otherwise(F.col("messages"))
    ).withColumn("is_compressed", F.when(old, True).otherwise(F.col("is_compressed")))


def retention_tiers(
    conversations: DataFrame, as_of: datetime, important_multiplier: float = POLICY.important_multiplier
) -> DataFrame:
    """Conversations with the tier their age puts them in: keep, compress, archive or delete.

    For important ones every age limit is multiplied by ``important_multiplier``.
    """
    important = F.col("importance_score") >= POLICY.retention_importance
    factor = F.when(important, float(important_multiplier)).otherwise(1.0)
    micros = F.unix_micros(ntz(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    age = micros / F.lit(86_400_000_000.0)

    def beyond(days: int) -> Column:
        return age >= days * factor

    tier = (
        F.when(beyond(POLICY.delete_after_days), "delete")
        .when(beyond(POLICY.archive_after_days), "archive")
        .when(beyond(POLICY.compress_after_days), "compress")
        .otherwise("keep")
    )
    return conversations.withColumn("tier", tier)


def mark(conversations: DataFrame, keys: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(conversations with the flag set on the keys, keys with whether they were found)."""
    wanted = keys.select("conversation_id").distinct()
    hit = wanted.withColumn("_hit", F.lit(True))
    marked = conversations.join(hit, "conversation_id", "left").select(
        *[
            F.when(F.col("_hit"), True).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
            for c in conversations.columns
        ]
    )
    there = conversations.select("conversation_id").withColumn("_there", F.lit(True))
    found = wanted.join(there, "conversation_id", "left").select(
        "conversation_id", F.coalesce("_there", F.lit(False)).alias("found")
    )
    return marked, found


def mark_compressed(conversations: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mark(conversations, keys, "is_compressed")


def mark_archived(conversations: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mark(conversations, keys, "is_archived")


def delete_conversations(
    conversations: DataFrame, facts: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(conversations, facts) without the deleted conversations and their facts."""
    return cascade_delete(conversations, keys), cascade_delete(facts, keys)


def delete_facts(facts: DataFrame, keys: DataFrame) -> DataFrame:
    return cascade_delete(facts, keys, "fact_id")


def quarantine_id(item: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit("quarantine"), item))


def quarantine(
    items: DataFrame, predicate: Column, reason: str, as_of: datetime, tokenizer: Hook = default_tokenizer
) -> DataFrame:
    """Quarantine rows for the matching items, which stay as they are."""
    return items.where(predicate).select(
        quarantine_id(F.col("id")).alias("id"),
        "session_id",
        thread_id(F.col("id")).alias("thread_id"),
        F.col("content_type").alias("context_type"),
        F.col("full_content").alias("isolated_content"),
        F.lit(reason).alias("reason_for_isolation"),
        tokenizer(F.col("full_content")).alias("token_count"),
        F.lit(True).alias("is_active"),
        ntz(as_of).alias("created_at"),
    )


def thread_collisions(quarantined: DataFrame) -> DataFrame:
    """Thread ids held by more than one row; the id is 32 bits of a hash and must be unique."""
    return (
        quarantined.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    )


def without_quarantined(items: DataFrame, quarantined: DataFrame, item_key: str = "id") -> DataFrame:
    """Items that are not in active quarantine, for callers that want them out of a search.

    They are found by the row id that ``quarantine`` gives an item, 128 bits of
    a hash; the 32 bits of a thread id are for display and clash.
    """
    isolated = quarantined.where(F.col("is_active")).select(F.col("id").alias("_isolated")).distinct()
    return items.join(isolated, quarantine_id(items[item_key]) == isolated["_isolated"], "left_anti")


def answer_hil(interactions: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions after their last response, responses to unknown requests).

    ``responses`` has (id, session_id, response, ts); a later answer replaces an
    earlier one. A response that names another session than the request's is
    one to an unknown request.
    """
    key = ["id", "session_id"]
    last = responses.groupBy(*key).agg(
        F.max_by("response", F.struct("ts", "response")).alias("_response"), F.max("ts").alias("_at")
    )
    answered = F.col("_at").isNotNull()
    new = {
        "response": F.when(answered, F.col("_response")).otherwise(F.col("response")),
        "status": F.when(answered, "answered").otherwise(F.col("status")),
        "answered_at": F.when(answered, F.col("_at")).otherwise(F.col("answered_at")),
    }
    after = interactions.join(last, key, "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in interactions.columns]
    )
    unmatched = last.join(interactions.select(*key).distinct(), key, "left_anti").select(
        *key, F.col("_response").alias("response"), F.col("_at").alias("ts")
    )
    return after, unmatched


def insert_rows(
    base: DataFrame, new_rows: DataFrame, table: str, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """(base plus the new rows with defaults filled, rejected rows)."""
    accepted, rejected = apply_defaults(new_rows, table, as_of)
    return base.unionByName(accepted.select(*base.columns)), rejected


def create_tasks(base: DataFrame, new_tasks: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return insert_rows(base, new_tasks, "tasks", as_of)


def create_agents(base: DataFrame, new_agents: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return insert_rows(base, new_agents, "agents", as_of)


def training_status(history: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history after its last status updates, found flag per updated id).

    ``updates`` has (training_id, status, error_message, ts). Completing stamps
    completed_at; an empty error message leaves the old one.
    """
    at = F.struct("ts", "status")
    error = F.col("error_message")
    last = updates.groupBy("training_id").agg(
        F.max_by("status", at).alias("_status"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("_completed"),
        F.max_by(error, F.when(F.length(error) > 0, at)).alias("_error"),
    )
    new = {
        "status": F.coalesce("_status", "status"),
        "completed_at": F.coalesce("_completed", "completed_at"),
        "error_message": F.coalesce("_error", "error_message"),
    }
    after = history.join(last, "training_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in history.columns]
    )
    there = history.select("training_id", F.lit(True).alias("_there"))
    found = last.select("training_id").join(there, "training_id", "left").select(
        "training_id", F.coalesce("_there", F.lit(False)).alias("found")
    )
    return after, found


def content_key() -> Column:
    """A hash of user and content; the user's length keeps the two apart."""
    user = F.coalesce("user_id", F.lit(""))
    return F.md5(F.concat_ws("|", F.length(user), user, "content"))


def stored_once(contents: DataFrame) -> DataFrame:
    """One row per user and content, with its key; of repeated ones the greatest importance and its tags."""
    held = F.max(F.struct("importance", "tags"))
    return (
        contents.groupBy(content_key().alias("_key"))
        .agg(F.first("user_id").alias("user_id"), F.first("content").alias("content"), held.alias("_held"))
        .select("_key", "user_id", "content", F.col("_held.importance").alias("importance"), F.col("_held.tags").alias("tags"))
    )


def store_conversations(contents: DataFrame, as_of: datetime) -> DataFrame:
    """Conversations for stored contents, keyed by a hash of user and content, one for each.

    ``contents`` has (content, importance, tags, user_id). JSON content is read
    as messages, any other content is one user message; tags become the topics.
    """
    return stored_once(contents).select(
        F.concat(F.lit("conv_"), "_key").alias("conversation_id"),
        ntz(as_of).alias("created_at"),
        parse_messages(F.col("content")).alias("messages"),
        F.coalesce(F.col("importance"), F.lit(0.5)).alias("importance_score"),
        F.col("tags").alias("topics"),
        "user_id",
    )


def store_facts(contents: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(conversations, facts) for stored facts, both keyed by a hash of the fact.

    ``contents`` has (content, importance, tags, user_id). The conversation is
    one system message of importance 0.3; the fact's confidence is the given
    importance, 0.5 where none is given. A fact that comes twice is stored once.
    """
    keyed = stored_once(contents)
    conversation_id = F.concat(F.lit("conv_"), "_key").alias("conversation_id")
    message = F.struct(F.lit("system").alias("role"), F.col("content"))
    conversations = keyed.select(
        conversation_id,
        ntz(as_of).alias("created_at"),
        F.array(message).alias("messages"),
        F.lit(0.3).alias("importance_score"),
        "user_id",
    )
    facts = keyed.select(
        F.concat(F.lit("fact_"), "_key").alias("fact_id"),
        conversation_id,
        F.col("content").alias("fact"),
        F.coalesce(F.col("importance"), F.lit(0.5)).alias("confidence"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        ntz(as_of).alias("created_at"),
    )
    return conversations, facts


def user_context(updates: DataFrame) -> DataFrame:
    """The last context of each user, stamped with its time; (user_id, context, ts) in."""
    return updates.groupBy("user_id").agg(
        F.max_by("context", F.struct("ts", "context")).alias("context"), F.max("ts").alias("last_updated")
    )


def set_preferences(preferences: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """All keys set that the changes (user_id, key, value) name; users without a row get one.

    A user may set several keys; of several values for one key the last by
    ``ts``, if there is such a column, and then the greatest counts.
    ``replace_preferences`` swaps the whole map.
    """
    order = [c for c in ("ts", "value") if c in changes.columns]
    latest = changes.where(F.col("key").isNotNull()).groupBy("user_id", "key").agg(F.max_by("value", F.struct(*order)).alias("value"))
    folded = latest.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_changes")
    )
    joined = preferences.join(folded, "user_id", "full_outer")
    changed = F.col("_changes").isNotNull()
    return joined.select(
        "user_id",
        F.when(changed, set_keys(F.col("preferences"), F.col("_changes")))
        .otherwise(F.col("preferences"))
        .alias("preferences"),
        F.when(changed, ntz(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def replace_preferences(preferences: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Whole maps replaced for the users named in ``changes``; unknown users are ignored."""
    new = changes.select("user_id", F.col("preferences").alias("_new"))
    changed = F.col("_new").isNotNull()
    return preferences.join(new, "user_id", "left").select(
        "user_id",
        F.coalesce("_new", "preferences").alias("preferences"),
        F.when(changed, ntz(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
