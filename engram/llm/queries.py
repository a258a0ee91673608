"""The queries of this folder over the supplied tables, with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import chat
from engram.llm.alignment import align_tokens
from engram.llm.bpe import encode_and_decode
from engram.llm.common import documents
from engram.llm.fingerprints import edited_fingerprints
from engram.llm.line_dedup import dedup_lines
from engram.llm.ngram_join import near_duplicates
from engram.llm.packing import pack
from engram.llm.quality_model import quality_scores
from engram.llm.rules import quality_verdicts
from engram.llm.sharding import place
from engram.llm.token_counts import count_tokens
from engram.llm.toxicity import toxicity_scores
from engram.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(job):
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def hex_digest(text):
    return F.sha2(text.cast("binary"), 256)


PROBE = "</s>[INST] ok [/INST]"


@query(
    "op1_chat_formatting",
    f"""WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
    escaped AS (SELECT *, length(text) + length(text) - length(replace(replace(text, '<', ''), '[', '')) AS n,
        CASE role WHEN 'system' THEN 7 + 9 WHEN 'user' THEN 9 + 7 WHEN 'assistant' THEN 8 + 5
            ELSE 6 + 6 + 7 + 5 + length(role) + length(role) - length(replace(replace(role, '<', ''), '[', '')) END AS marks,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS former,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS later FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(n + marks)::BIGINT AS formatted_chars,
        bool_and(coalesce((former IS NULL AND role IN ('system', 'user')) OR (former IN ('system', 'assistant') AND role = 'user')
            OR (former = 'user' AND role = 'assistant'), false) AND (later IS NOT NULL OR role = 'assistant')) AS valid
    FROM escaped GROUP BY conv_id""",
)
def op1(spark, d):
    table = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], table.schema)
    out = chat.format_chats(table.unionByName(probe))
    read = out.select(
        "conv_id",
        "valid",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_digest(F.array_join(said, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


@query("op2_quality_classifier")
def op2(spark, d):
    scored = quality_scores(documents(spark, d).select("doc_id", "text"), labels(spark, d))
    return scored.select("row.doc_id", "held_out", "score", "predicted")


@query("op3_bpe_encoding")
def op3(spark, d):
    coded = encode_and_decode(documents(spark, d), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join("ids", " ")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_packing")
def op4(spark, d):
    return pack(documents(spark, d), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_quality_rules")
def op5(spark, d):
    return quality_verdicts(documents(spark, d)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("posterior", 6).alias("posterior"),
    )


SHARDS = [f"shard-{i:03d}" for i in range(96)]
SLOTS = 4099


@query(
    "op6_sharding",
    f"""WITH RECURSIVE shards AS (
        SELECT i, ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 3, '0') || '/offset'), 1, 15))::BIGINT % {SLOTS} AS first,
            ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 3, '0') || '/skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
        FROM range({len(SHARDS)}) t(i)),
    filled(step, owners, slot) AS (
        SELECT -1, list_transform(range({SLOTS}), lambda x: -1), -1::BIGINT
        UNION ALL
        SELECT step + 1, list_transform(owners, lambda x, k: CASE WHEN k - 1 = free THEN i::INTEGER ELSE x END), free
        FROM (SELECT step, owners, i, list_filter(list_transform(range({SLOTS}), lambda j: (first + j * skip) % {SLOTS}), lambda s: owners[s + 1] = -1)[1] AS free
            FROM filled JOIN shards ON i = (step + 1) % {len(SHARDS)} WHERE step + 1 < {SLOTS})),
    owned AS (SELECT slot, step % {len(SHARDS)} AS i FROM filled WHERE step >= 0)
    SELECT doc_id, slot, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard
    FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) JOIN owned USING (slot)""",
)
def op6(spark, d):
    return place(documents(spark, d).select("doc_id"), F.col("doc_id"), SHARDS, SLOTS)


@query("op7_document_fingerprints")
def op7(spark, d):
    marked = edited_fingerprints(documents(spark, d))
    return marked.select(
        "doc_id",
        "n_chars",
        hex_digest(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op8_token_counts")
def op8(spark, d):
    table = documents(spark, d).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = count_tokens(
        table.select(F.struct("doc_id", "n_bytes").alias("row"), "text"),
        public_tokenizers.path("byte_bpe_50k.json"),
        key="row",
    )
    return counted.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op9_toxicity")
def op9(spark, d):
    scored = toxicity_scores(documents(spark, d), labels(spark, d))
    return scored.select(
        "doc_id", *(F.round(c, 6).alias(c) for c in ("p_marked", "p_repeated", "p_toxic")), F.col("is_toxic").cast("int").alias("predicted")
    )


@query("op10_ngram_join")
def op10(spark, d):
    return near_duplicates(documents(spark, d))


@query("op11_token_alignment")
def op11(spark, d):
    return align_tokens(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op12_line_dedup",
    """WITH lines AS (
        SELECT doc_id, pos, list[pos] AS line,
            translate(trim(list[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(range(1, len(list) + 1)) AS pos, list
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents))),
    owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
    marked AS (SELECT doc_id, pos, line, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN owners USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op12(spark, d):
    kept = dedup_lines(documents(spark, d))
    return kept.select("doc_id", "n_lines", "n_dropped", hex_digest(F.col("kept_text")).alias("kept_sha256"))


@query("op13_embedding_whitening")
def op13(spark, d):
    return whiten(spark.read.parquet(f"{d}/embeddings.parquet"))
