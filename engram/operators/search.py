"""Exact and approximate vector top-k for many queries at once.

Vectors are scored inside the tasks that read them, block against block; a task
passes on at most k rows per query, never the pairs. Distances compare as
numbers < NaN (zero vector) < null (no vector), and ties go to the lower id.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from engram.functions.text import answer_after_marker
from engram.functions.values import iso_timestamp
from engram.functions.vectors import cosine_similarity, norm
from engram.operators.filters import newest, searchable_items, trusted_facts
from engram.operators.ranking import top_per_group
from engram.policy import ANSWER_MARKER
from engram.sources.shared import settled

MAX_QUERIES = 4096
MAX_QUERY_BYTES = 64 << 20
MAX_FOUND_ROWS = 100_000
GROUP_ROWS = 50_000
QUERY_BLOCK = 256
SLACK = 1e-9
ALL = "*"


class _Best:
    """The k nearest rows per query of one scope, updated block by block."""

    def __init__(self, query_ids: Sequence[str], vectors: np.ndarray, k: int):
        self.query_ids = list(query_ids)
        self.vectors = vectors
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.k = k
        m = len(self.query_ids)
        self.distances = [np.empty(0) for _ in range(m)]
        self.ids = [np.empty(0, dtype=object) for _ in range(m)]
        self.bound = np.where(self.lengths > 0, np.inf, -np.inf)
        self.zero_ids: list[str] = []
        self.null_ids: list[str] = []
        self.some_ids: list[str] = []

    def _lowest(self, kept: list[str], ids: np.ndarray) -> list[str]:
        return sorted(kept + sorted(ids.tolist())[: self.k])[: self.k]

    def add(self, ids: np.ndarray, vectors: np.ndarray, missing: np.ndarray) -> None:
        """``vectors`` holds one row per id that is not ``missing``."""
        self.null_ids = self._lowest(self.null_ids, ids[missing])
        ids = ids[~missing]
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        if (self.lengths == 0).any():
            self.some_ids = self._lowest(self.some_ids, ids)
        real = np.isfinite(lengths) & (lengths > 0)
        # Zero vectors and those with an element that is no number have no distance: NaN, after all numbers.
        self.zero_ids = self._lowest(self.zero_ids, ids[~real])
        ids, vectors, lengths = ids[real], vectors[real], lengths[real]
        if not len(ids):
            return
        unit = (vectors / lengths[:, None]).T
        for start in range(0, len(self.query_ids), QUERY_BLOCK):
            rough = 1.0 - self.unit[start : start + QUERY_BLOCK] @ unit
            if len(ids) > self.k:
                kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            else:
                kth = np.full(len(rough), np.inf)
            reach = np.minimum(kth, self.bound[start : start + QUERY_BLOCK]) + SLACK
            near = rough <= reach[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                self._merge(start + i, ids, vectors, lengths, np.flatnonzero(near[i]))

    def _merge(self, q, ids, vectors, lengths, rows) -> None:
        exact = 1.0 - (vectors[rows] * self.vectors[q]).sum(axis=1) / (lengths[rows] * self.lengths[q])
        distances = np.concatenate([self.distances[q], exact])
        names = np.concatenate([self.ids[q], ids[rows]])
        order = np.lexsort((names.astype(str), distances))[: self.k]
        self.distances[q], self.ids[q] = distances[order], names[order]
        if len(order) == self.k:
            self.bound[q] = self.distances[q][-1]

    def rows(self) -> Iterator[tuple[str, str, float | None]]:
        for q, query_id in enumerate(self.query_ids):
            for name, distance in zip(self.ids[q], self.distances[q]):
                yield query_id, name, float(distance)
            lacking = len(self.ids[q]) < self.k
            if lacking:
                for name in self.zero_ids if self.lengths[q] > 0 else self.some_ids:
                    yield query_id, name, float("nan")
                for name in self.null_ids:
                    yield query_id, name, None


def _matrix(vectors: pa.ListArray, dimension: int) -> np.ndarray:
    flat = vectors.flatten()
    if len(flat) != len(vectors) * dimension or (
        len(vectors) and not np.all(np.diff(vectors.offsets.to_numpy()) == dimension)
    ):
        raise ValueError("vector dimensions differ")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _take(best: _Best, ids: pa.Array, vectors: pa.Array) -> None:
    missing = vectors.is_null().to_numpy(zero_copy_only=False)
    given = vectors.filter(pa.array(~missing))
    best.add(
        ids.to_numpy(zero_copy_only=False).astype(object),
        _matrix(given, best.vectors.shape[1]),
        missing,
    )


def _batch(rows: list[tuple], scope: str) -> pa.RecordBatch:
    query_ids, ids, distances = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids, pa.string()),
            pa.array(ids, pa.string()),
            pa.array(distances, pa.float64(), from_pandas=False),
            pa.array([scope] * len(ids), pa.string()),
        ],
        names=["query_id", "id", "distance", "scope"],
    )


_FOUND = "query_id string, id string, distance double, scope string"


def _query_matrix(vectors: Sequence) -> np.ndarray:
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vector dimensions differ")
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _search_small(queries: pd.DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Queries travel with the task; the items are scored where they are read."""
    by_scope = {
        scope: (part["query_id"].tolist(), _query_matrix(part["embedding"].tolist()))
        for scope, part in queries.groupby("scope")
    }

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, _Best] = {}
        for batch in batches:
            scopes = batch.column("scope").dictionary_encode()
            codes = scopes.indices.to_numpy(zero_copy_only=False)
            by_code = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(scopes.dictionary)))
            for scope, rows in zip(scopes.dictionary.to_pylist(), np.split(by_code, ends[:-1])):
                if scope not in by_scope:
                    continue
                if scope not in best:
                    best[scope] = _Best(*by_scope[scope], k)
                rows = pa.array(rows)
                _take(best[scope], batch.column("id").take(rows), batch.column("embedding").take(rows))
        for scope, found in best.items():
            yield _batch(list(found.rows()), scope)

    asked = items.where(F.col("scope").isin(list(by_scope)))
    return asked.mapInArrow(score, _FOUND)


def _search_grouped(
    queries: DataFrame, items: DataFrame, k: int, group_rows: int, block_queries: int
) -> DataFrame:
    """For query sets too large to hand out: groups of bounded size, joined by scope.

    A scope's items are cut into salts of about ``group_rows`` rows and its
    queries into blocks; each block meets each salt once.
    """
    parts = (
        items.groupBy("scope")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("scope", F.ceil(F.col("n") / group_rows).cast("int").alias("salts"))
    )
    blocks = (
        queries.groupBy("scope")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("scope", F.ceil(F.col("n") / block_queries).cast("int").alias("blocks"))
    )
    # One row per scope that has queries, written out so that the items meet it by its size.
    shape = settled(parts.join(blocks, "scope"), "search-shape")

    def cut(df, key, own, other):
        return df.join(shape, "scope").select(
            "*",
            F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other),
        )

    keys = ["scope", "salt", "block"]
    left = cut(queries, "query_id", "block", "salt").select(*keys, "query_id", "embedding")
    right = cut(items, "id", "salt", "block").select(*keys, "id", "embedding")

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        scope = asked.column("scope")[0].as_py() if asked.num_rows else ""
        if asked.num_rows and held.num_rows:
            best = _Best(
                asked.column("query_id").to_pylist(), _query_matrix(asked.column("embedding").to_pylist()), k
            )
            for batch in held.to_batches():
                _take(best, batch.column("id"), batch.column("embedding"))
            rows = list(best.rows())
        return pa.Table.from_batches([_batch(rows, scope)])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _FOUND)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    item_id: str,
    scope: str | None = None,
    max_queries: int = MAX_QUERIES,
    group_rows: int = GROUP_ROWS,
    keep_scope: bool = False,
) -> DataFrame:
    """(query_id, id, distance, position) of the k nearest items of each query, with ``keep_scope`` the scope too.

    ``queries`` has (query_id, embedding) and the scope column if one is given;
    a query then sees only items of its own scope. At most ``max_queries``
    queries (and 64 MB) are handed to the tasks; a larger set is shuffled. A
    result of a known small size is marked for broadcast, so that fetching the
    rows of the found ids does not move the items.
    """
    scope_of = F.lit(ALL) if scope is None else F.col(scope)
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"), scope_of.alias("scope"), "embedding"
    )
    held = items.select(F.col(item_id).cast("string").alias("id"), scope_of.alias("scope"), "embedding")
    size = asked.limit(max_queries + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")
    )
    n, width = size.first()
    small = n <= max_queries and n * width * 8 <= MAX_QUERY_BYTES
    if small:
        found = _search_small(asked.toPandas(), held, k)
    else:
        found = _search_grouped(asked, held, k, group_rows, max_queries)
    found = found.withColumnRenamed("scope", scope) if keep_scope and scope else found.drop("scope")
    ranked = top_per_group(found, ["query_id"], [F.asc_nulls_last("distance"), F.asc("id")], k)
    return F.broadcast(ranked) if small and n * k <= MAX_FOUND_ROWS else ranked


def hydrate(found: DataFrame, table: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    """Found ids with their rows; ids without a row are dropped.

    With a scope the rows are met by scope and id: of a table partitioned by the
    scope (sessions, say) only the partitions of found rows are then read, as
    Spark prunes them by the broadcast side at run time.
    """
    return found.withColumnRenamed("id", key).join(table, key if scope is None else [scope, key])


def search_items(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    content_types: Sequence[str] | None = None,
    whole_rows: bool = True,
    **bounds,
) -> DataFrame:
    """Nearest active items in each query's session; items without a vector come last."""
    held = searchable_items(items, content_types=content_types)
    found = nearest(queries, held, k, "id", scope="session_id", keep_scope=whole_rows, **bounds)
    return hydrate(found, items, "id", "session_id") if whole_rows else found


def search_conversations(queries: DataFrame, conversations: DataFrame, k: int = 5, **bounds) -> DataFrame:
    held = conversations.where(F.col("embedding").isNotNull() & ~F.col("is_archived"))
    found = nearest(queries, held, k, "conversation_id", **bounds)
    return hydrate(_similarity(found), conversations, "conversation_id")


def search_facts(
    queries: DataFrame, facts: DataFrame, k: int = 5, min_confidence: float = 0.5, **bounds
) -> DataFrame:
    found = nearest(queries, trusted_facts(facts, min_confidence), k, "fact_id", **bounds)
    return hydrate(_similarity(found), facts, "fact_id")


def _similarity(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", (F.lit(1.0) - F.col("distance")).alias("similarity"), "position")


def topic_matches(queries: DataFrame, conversations: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, conversation_id, position): best k conversations sharing a topic with each query.

    The order does not depend on the query, so the best k of each topic are
    enough to answer every query exactly, and popular topics stay small.
    """
    order = [newest("importance_score"), F.asc("conversation_id")]
    by_topic = conversations.select(
        "conversation_id", "importance_score", F.explode(F.array_distinct("topics")).alias("topic")
    )
    best = top_per_group(by_topic, ["topic"], order, k).drop("position")
    wanted = queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.explode(F.array_distinct("topics")).alias("topic")
    )
    matched = wanted.join(best, "topic").select("query_id", "conversation_id", "importance_score").distinct()
    return top_per_group(matched, ["query_id"], order, k).drop("importance_score")


def stored_search(
    queries: DataFrame,
    conversations: DataFrame,
    facts: DataFrame,
    query_type: str = "semantic",
    k: int = 5,
    user_id: str | None = None,
) -> DataFrame:
    """(query_id, kind, position, id, text, score) and the serving fields of the kinds a query type asks for.

    Conversations come with importance_score, topics and created_at (ISO text),
    facts with confidence, tags and their conversation_id; the others, and
    columns the tables do not have, are null.

    semantic: conversations and facts by vector; factual: facts only; temporal:
    conversations by shared topic (``queries`` then has a topics column).
    """
    if query_type not in ("semantic", "factual", "temporal"):
        raise ValueError(f"unknown query type: {query_type}")
    mine = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    kinds = []
    if query_type == "semantic":
        kinds.append(search_conversations(queries, mine, k))
    if query_type == "temporal":
        found = topic_matches(queries, mine, k).withColumn("similarity", F.lit(None).cast("double"))
        kinds.append(found.join(mine, "conversation_id"))
    results = [_result(df, "conversation", "conversation_id", "summary") for df in kinds]
    if query_type in ("semantic", "factual"):
        results.append(_result(search_facts(queries, facts, k), "fact", "fact_id", "fact"))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])


# What a caller is served besides text and score: the column of each kind that has it.
SERVED = {
    "conversation_id": ("string", {"conversation", "fact"}),
    "importance_score": ("double", {"conversation"}),
    "topics": ("array<string>", {"conversation"}),
    "created_at": ("string", {"conversation"}),
    "confidence": ("double", {"fact"}),
    "tags": ("array<string>", {"fact"}),
}


def _result(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    def served(name: str, type_name: str, kinds: set[str]) -> Column:
        if kind not in kinds or name not in df.columns:
            return F.lit(None).cast(type_name).alias(name)
        return (iso_timestamp(F.col(name)) if name == "created_at" else F.col(name)).alias(name)

    return df.select(
        "query_id",
        F.lit(kind).alias("kind"),
        "position",
        F.col(key).alias("id"),
        F.col(text).alias("text"),
        F.col("similarity").alias("score"),
        *[served(name, *of) for name, of in SERVED.items()],
    )


def score_chunks(
    chunks: DataFrame, query_vector: Sequence[float], key: Sequence[str], position: str = "position"
) -> DataFrame:
    """Chunks with ``score``, relevance times importance, and ``rank`` in their text.

    ``chunks`` has an embedding and may have an importance; none counts as 1.
    ``key`` names the text a chunk is of, whose chunks are ranked together.
    """
    vector = F.array(*[F.lit(float(x)) for x in query_vector])
    length = F.lit(float(np.sqrt(np.square(np.asarray(query_vector, dtype=np.float64)).sum())))
    importance = F.coalesce(F.col("importance"), F.lit(1.0)) if "importance" in chunks.columns else F.lit(1.0)
    similarity = cosine_similarity(F.col("embedding"), vector, norm_b=length)
    order = W.partitionBy(*key).orderBy(F.desc_nulls_last("score"), F.asc(position))
    return chunks.withColumn("score", similarity * importance).withColumn("rank", F.row_number().over(order))


def answer_lookup(
    queries: DataFrame, items: DataFrame, k: int = 2, marker: str = ANSWER_MARKER, **bounds
) -> DataFrame:
    """The answer line, or a preview, of the best item of each query."""
    best = search_items(queries, items, k, whole_rows=False, **bounds).where(F.col("position") == 1)
    return hydrate(best, items.select("id", "full_content"), "id").select(
        "query_id", "id", "distance", answer_after_marker(F.col("full_content"), marker).alias("answer")
    )


def pick_pivots(items: DataFrame, lists: int, item_id: str) -> list[list[float]]:
    """List centres for the approximate search: item vectors in the order of a hash of the id."""
    rows = (
        items.where(F.col("embedding").isNotNull())
        .withColumn("_length", norm(F.col("embedding")))
        .where(F.col("_length") > 0)
        .orderBy(F.md5(F.col(item_id).cast("string")), F.col(item_id).cast("string"))
        .select("embedding")
        .limit(lists)
        .collect()
    )
    return [list(r["embedding"]) for r in rows]


def train_centres(items: DataFrame, lists: int, seed: int = 7, iterations: int = 10) -> list[list[float]]:
    """List centres by k-means under cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = items.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))
    model = KMeans(k=lists, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="v").fit(
        rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    )
    return [c.tolist() for c in model.clusterCenters()]


def assign_lists(df: DataFrame, centres: Sequence[Sequence[float]], nearest_lists: int = 1) -> DataFrame:
    """Each row with the number(s) of its nearest lists, one row per list.

    Centres are at most a few thousand vectors. Rows without a usable vector
    are left out, as an index leaves them out.
    """
    matrix = _query_matrix(centres)
    unit = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
    if unit.nbytes > MAX_QUERY_BYTES:
        raise ValueError("too many centres")

    def assign(vectors: pd.Series) -> pd.Series:
        given = np.flatnonzero(vectors.notna())
        out: list = [None] * len(vectors)
        if len(given):
            rows = _query_matrix(vectors.iloc[given].tolist())
            if rows.shape[1] != unit.shape[1]:
                raise ValueError("vector dimensions differ")
            lengths = np.sqrt((rows * rows).sum(axis=1))
            distances = np.round(1.0 - (rows / np.where(lengths > 0, lengths, 1.0)[:, None]) @ unit.T, 12)
            closest = np.argsort(distances, axis=1, kind="stable")[:, :nearest_lists]
            for place, lists, length in zip(given, closest.tolist(), lengths):
                out[place] = lists if length > 0 else None
        return pd.Series(out, index=vectors.index, dtype=object)

    lists = F.pandas_udf(assign, T.ArrayType(T.IntegerType()))
    return df.withColumn("list", F.explode(lists(F.col("embedding"))))


def nearest_approx(
    queries: DataFrame,
    indexed: DataFrame,
    centres: Sequence[Sequence[float]],
    k: int,
    item_id: str,
    probes: int = 4,
    scope: str | None = None,
    **bounds,
) -> DataFrame:
    """Top-k among the items of each query's ``probes`` nearest lists.

    ``indexed`` is the result of ``assign_lists`` on the items, usually a table
    partitioned by ``list``: only the lists that some query probes are read.
    Found items carry their exact distance.
    """
    cell = F.col("list").cast("string")
    key = cell if scope is None else F.concat_ws("\u0001", cell, F.col(scope))
    placed = assign_lists(queries, centres, probes)
    # At most one row per centre.
    lists = [row["list"] for row in placed.select("list").distinct().collect()]
    probed = placed.select(
        F.concat_ws("\u0001", "query_id", "list").alias("query_id"), "embedding", key.alias("_cell")
    )
    bounds.setdefault("max_queries", MAX_QUERIES * probes)
    held = indexed.where(F.col("list").isin(lists)).withColumn("_cell", key)
    found = nearest(probed, held, k, item_id, scope="_cell", **bounds)
    merged = found.select(F.substring_index("query_id", "\u0001", 1).alias("query_id"), "id", "distance")
    return top_per_group(merged, ["query_id"], [F.asc_nulls_last("distance"), F.asc("id")], k)


def search_items_approx(
    queries: DataFrame,
    items: DataFrame,
    centres: Sequence[Sequence[float]],
    k: int = 5,
    probes: int = 4,
    content_types: Sequence[str] | None = None,
) -> DataFrame:
    indexed = assign_lists(searchable_items(items, content_types=content_types), centres)
    return nearest_approx(queries, indexed, centres, k, "id", probes, scope="session_id")


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search found."""
    hits = exact.select("query_id", "id").join(
        approx.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("n_exact"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"),
        F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")).alias("recall"),
    )
