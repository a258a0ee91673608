"""A stored index of vectors: rows in lists, with compressed codes for approximate and bounds for exact search.

``build_list_index`` writes it once, partitioned by list. The approximate search
reads the codes of the probed lists only and re-ranks exactly; the exact search
for query sets of any size skips every block that cannot hold a hit. Rows
without a usable vector (null, zero, not finite) are not in an index.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.vectors import cosine_distance
from engram.operators.ranking import top_per_group
from engram.operators.search import MAX_FOUND_ROWS, MAX_QUERIES, SLACK
from engram.sources.shared import settled

LISTS = 64
PARTS = 8
CODES = 256
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 20_000
ROUNDS = 8
MAX_LISTS = 4096
PAIR_QUERIES = 256
PAIR_ROWS = 4096
BLOCK_QUERIES = 64


@dataclass
class ListIndex:
    """Where the rows lie, and the small tables: unit centres (lists x dimension), codebooks (part -> codes x width)."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    codebooks: list[np.ndarray]

    def rows(self) -> DataFrame:
        """id, scope, angle to the list's centre, code, embedding, list."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def blocks(self) -> DataFrame:
        """scope, list, rows, radius: the largest angle of a row to the centre."""
        return self.spark.read.parquet(f"{self.path}/blocks")


def unit_rows(flat: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of unit length and which rows have one."""
    rows = flat.astype(np.float64).reshape(-1, dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(lengths) & (lengths > 0)
    return rows[good] / lengths[good][:, None], good


def means_of(rows: np.ndarray, k: int, seed: int, on_sphere: bool) -> np.ndarray:
    """k-means by Lloyd's rounds; a mean that loses all rows keeps its place."""
    draw = np.random.default_rng(seed)
    means = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        distances = (means * means).sum(axis=1)[None, :] - 2 * rows @ means.T
        nearest = distances.argmin(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(means))
        held = counts > 0
        means[held] = sums[held] / counts[held][:, None]
        if on_sphere:
            lengths = np.sqrt((means * means).sum(axis=1, keepdims=True))
            means = np.where(lengths > 0, means / np.where(lengths > 0, lengths, 1), means)
    return means


def learn(items: DataFrame, item_id: str, lists: int, parts: int, sample_rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres and codebooks from at most ``sample_rows`` rows, chosen by a hash of the id."""
    chosen = (
        items.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .select(F.xxhash64(F.col(item_id).cast("string")).alias("h"), F.col(item_id).cast("string").alias("i"), "embedding")
        .orderBy("h", "i")
        .limit(sample_rows)
        .collect()
    )
    if not chosen:
        return np.zeros((0, 0)), []
    dimension = len(chosen[0]["embedding"])
    if any(len(r["embedding"]) != dimension for r in chosen):
        raise ValueError("vector dimensions differ")
    unit, _ = unit_rows(np.array([r["embedding"] for r in chosen]), dimension)
    if not len(unit):
        return np.zeros((0, dimension)), []
    centres = means_of(unit, min(lists, MAX_LISTS), 7, on_sphere=True)
    rest = unit - centres[(unit @ centres.T).argmax(axis=1)]
    pieces = np.array_split(rest, min(parts, dimension), axis=1)
    return centres, [means_of(piece, CODES, 11 + i, on_sphere=False) for i, piece in enumerate(pieces)]


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def build_list_index(
    items: DataFrame,
    path: str,
    item_id: str = "id",
    scope: str | None = None,
    lists: int = LISTS,
    parts: int = PARTS,
    sample_rows: int = SAMPLE_ROWS,
) -> ListIndex:
    """Writes an index of all items with a usable vector under ``path``.

    Centres and codebooks are learnt from a bounded sample; every row is put
    into the list of its nearest centre and stored with the code of what is
    left of it, ``parts`` bytes. Files are cut by size and not by list
    (``rebalance``), so a list of very many rows is written by many tasks.
    """
    spark = items.sparkSession
    centres, books = learn(items, item_id, lists, parts, sample_rows)
    scope_of = F.lit("") if scope is None else F.col(scope).cast("string")
    given = items.where(F.col("embedding").isNotNull()).select(
        F.col(item_id).cast("string").alias("id"), scope_of.alias("scope"), "embedding"
    )
    cuts = np.cumsum([b.shape[1] for b in books])[:-1] if books else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(centres):
                continue
            vectors = batch.column(2)
            if (np.diff(vectors.offsets.to_numpy()) != centres.shape[1]).any():
                raise ValueError("vector dimensions differ")
            unit, good = unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), centres.shape[1])
            cosines = unit @ centres.T
            nearest = cosines.argmax(axis=1)
            rest = np.split(unit - centres[nearest], cuts, axis=1)
            codes = np.stack(
                [((b * b).sum(axis=1)[None, :] - 2 * r @ b.T).argmin(axis=1).astype(np.uint8) for r, b in zip(rest, books, strict=True)],
                axis=1,
            )
            kept = batch.filter(pa.array(good))
            columns = [
                kept.column(0),
                kept.column(1),
                pa.array(angles(cosines[np.arange(len(unit)), nearest])),
                pa.array([c.tobytes() for c in codes], pa.binary()),
                kept.column(2),
                pa.array(nearest.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "scope", "angle", "code", "embedding", "list"])

    shape = "id string, scope string, angle double, code binary, embedding array<float>, list int"
    placed = given.withColumn("embedding", F.col("embedding").cast("array<float>")).mapInArrow(place, shape)
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    rows = spark.read.schema(shape).parquet(f"{path}/rows")
    blocks = rows.groupBy("scope", "list").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    coded = [(p, c, code.tolist()) for p, book in enumerate(books) for c, code in enumerate(book)]
    spark.createDataFrame(coded, "part int, code int, vector array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
    return open_list_index(spark, path)


def open_list_index(spark: SparkSession, path: str) -> ListIndex:
    """A written index; its centres and codebooks have a few thousand rows at most."""
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]
    books: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect():
        books.setdefault(row["part"], []).append(row["vector"])
    return ListIndex(spark, path, np.array(centres), [np.array(books[p]) for p in sorted(books)])


def asked_of(queries: DataFrame, scope: str | None) -> DataFrame:
    """query_id, scope and embedding of the queries that have a vector."""
    scope_of = F.lit("") if scope is None else F.col(scope).cast("string")
    return queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"), scope_of.alias("scope"), F.col("embedding").cast("array<float>").alias("embedding")
    )


def search_index_approx(
    queries: DataFrame,
    index: ListIndex,
    k: int,
    probes: int = 8,
    rerank: int = 8,
    scope: str | None = None,
    max_queries: int = MAX_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, distance, position) of about the k nearest rows of each query, distances exact.

    The scan is cut to the lists some query probes; there the codes are scored
    by lookup tables, and the best ``rerank * k`` rows of each query meet their
    vectors. More than ``max_queries`` queries are not handed to the tasks but
    dealt to the blocks of the lists they probe, as in ``search_index_exact``;
    there the best ``rerank * k`` rows of each block meet their vectors.
    """
    asked = asked_of(queries, scope)
    listed = asked.limit(max_queries + 1).toPandas()
    if len(listed) > max_queries and len(index.centres):
        found = meet(probes_of(asked, index, probes, block_rows), index, k, block_rows, rerank * k)
        best = top_per_group(found, ["query_id"], [F.asc("distance"), F.asc("id")], k)
        return best.select("query_id", "id", "distance", "position")
    dimension = index.centres.shape[1] if index.centres.ndim == 2 else 0
    if listed.empty or not len(index.centres):
        return index.spark.createDataFrame([], "query_id string, id string, distance double, position int")
    unit, good = unit_rows(np.concatenate(listed["embedding"].to_list()), dimension)
    listed = listed[good].reset_index(drop=True)
    cosines = unit @ index.centres.T
    probed = np.argsort(-cosines, axis=1, kind="stable")[:, :probes]
    by_cell: dict[tuple[str, int], list[int]] = {}
    for q, (scope_name, lists) in enumerate(zip(listed["scope"], probed.tolist(), strict=True)):
        for number in lists:
            by_cell.setdefault((scope_name, number), []).append(q)
    widths = [b.shape[1] for b in index.codebooks]
    pieces = np.split(unit, np.cumsum(widths)[:-1], axis=1)
    # query x part x code
    tables = np.stack([np.pad(p @ b.T, ((0, 0), (0, CODES - len(b)))) for p, b in zip(pieces, index.codebooks, strict=True)], axis=1)
    names, wanted, parts = listed["query_id"].to_numpy(object), rerank * k, len(index.codebooks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes = batch.column(1).dictionary_encode()
            lists = batch.column(3).to_numpy(zero_copy_only=False)
            cell = scopes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * MAX_LISTS + lists
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for value, rows in zip(cells, np.split(order, starts[1:]), strict=True):
                own = by_cell.get((scopes.dictionary[int(value // MAX_LISTS)].as_py(), int(value % MAX_LISTS)))
                if own is None:
                    continue
                near = np.repeat(cosines[own, value % MAX_LISTS][:, None], len(rows), axis=1)
                for part in range(parts):
                    near += tables[own, part][:, codes[rows, part]]
                if len(rows) > wanted:
                    best = np.argpartition(-near, wanted - 1, axis=1)[:, :wanted]
                else:
                    best = np.broadcast_to(np.arange(len(rows)), (len(own), len(rows)))
                found.append((np.repeat(own, best.shape[1]), rows[best].ravel(), np.take_along_axis(near, best, axis=1).ravel()))
            if found:
                q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [pa.array(names[q], pa.string()), batch.column(0).take(pa.array(r)), pa.array(s), batch.column(3).take(pa.array(r))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "near", "list"])

    probed_lists = sorted({int(n) for n in probed.ravel()})
    held = index.rows().where(F.col("list").isin(probed_lists))
    rough = held.select("id", "scope", "code", "list").mapInArrow(score, "query_id string, id string, near double, list int")
    best = top_per_group(rough, ["query_id"], [F.desc("near"), F.asc("id")], wanted).select("query_id", "id", "list")
    few = len(listed) * wanted <= MAX_FOUND_ROWS
    vectors = index.spark.createDataFrame(
        [(n, [float(x) for x in v]) for n, v in zip(names, listed["embedding"], strict=True)], "query_id string, asked array<float>"
    )
    best = best.join(F.broadcast(vectors), "query_id")
    met = held.select("id", "list", "embedding").join(F.broadcast(best) if few else best, ["list", "id"])
    exact = met.select("query_id", "id", cosine_distance(F.col("embedding"), F.col("asked")).alias("distance"))
    return top_per_group(exact, ["query_id"], [F.asc("distance"), F.asc("id")], k)


def probes_of(asked: DataFrame, index: ListIndex, probes: int, block_rows: int) -> DataFrame:
    """Each query with the blocks of the ``probes`` lists of the nearest centres, as far as they have rows in its scope."""
    centres = index.centres

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAIR_QUERIES):
                part = batch.slice(start, PAIR_QUERIES)
                unit, good = unit_rows(part.column(2).flatten().to_numpy(zero_copy_only=False), centres.shape[1])
                lists = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]
                source = pa.array(np.repeat(np.flatnonzero(good), lists.shape[1]))
                columns = [part.column(c).take(source) for c in range(3)] + [pa.array(lists.ravel(), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "scope", "embedding", "list"])

    probed = asked.mapInArrow(choose, "query_id string, scope string, embedding array<float>, list int")
    sizes = index.blocks().select("scope", "list", F.ceil(F.col("rows") / block_rows).cast("int").alias("salts"))
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    return probed.join(sizes, ["scope", "list"]).select("query_id", "embedding", "scope", "list", salt)


_PAIR = "query_id string, embedding array<float>, scope string, list int, salt int, pruned long, met long"


def paired(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    """Rows of a batch by number, each with a list, a salt and the two counts."""
    source = pa.array([o[0] for o in out], pa.int64())
    columns = [batch.column(c).take(source) for c in (0, 2, 1)]
    columns += [pa.array([o[c] for o in out], pa.int32()) for c in (1, 2)]
    columns += [pa.array([o[c] for o in out], pa.int64()) for c in (3, 4)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "scope", "list", "salt", "pruned", "met"])


def pairs_of(asked: DataFrame, index: ListIndex, block_rows: int, first: bool) -> DataFrame:
    """Each query with the blocks it has to meet.

    ``first``: the block of the list whose centre is nearest among those with
    rows in the query's scope. Else ``asked`` has that list as ``done`` and the
    similarity of the k-th hit there as ``reach`` (null: too few hits), and all
    other lists are met but those whose nearest possible row is farther:
    a row at most ``radius`` from a centre at angle a is at least a - radius
    from the query. ``met`` and ``pruned`` count a query's lists.
    """
    centres = index.centres
    shapes = index.blocks().groupBy("scope").agg(F.collect_list(F.struct("list", "rows", "radius")).alias("lists"))
    extra = ["done", "reach"] if not first else []
    given = asked.join(shapes, "scope").select("query_id", "scope", "embedding", "lists", *extra)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, PAIR_QUERIES) for b in batches for start in range(0, b.num_rows, PAIR_QUERIES)):
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            unit, good = unit_rows(vectors, centres.shape[1])
            out: list[tuple] = []
            for u, row in zip(unit, np.flatnonzero(good).tolist(), strict=True):
                cells = batch.column(3)[row].as_py()
                lists = np.array([c["list"] for c in cells])
                radius = np.array([c["radius"] for c in cells])
                angle = angles(centres[lists] @ u)
                if first:
                    chosen = [int(angle.argmin())]
                else:
                    done, reach = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                    nearest = np.cos(np.maximum(angle - radius, 0.0))
                    others = lists != done
                    open_ = others if reach is None else others & (nearest >= reach - SLACK)
                    chosen = np.flatnonzero(open_).tolist()
                for at in chosen:
                    for salt in range(-(-cells[at]["rows"] // block_rows)):
                        out.append((row, cells[at]["list"], salt, len(cells) - len(chosen), len(chosen)))
                        if len(out) == PAIR_ROWS:
                            yield paired(batch, out)
                            out = []
            yield paired(batch, out)

    return given.mapInArrow(choose, _PAIR)


def meet(pairs: DataFrame, index: ListIndex, k: int, block_rows: int, rerank: int | None = None) -> DataFrame:
    """(query_id, id, distance, list): the k nearest rows of each block a query meets.

    With ``rerank`` they are looked for among so many rows of the best codes.

    Rows and queries of a block are dealt to one task and sorted, the rows
    first: the task holds one block of about ``block_rows`` rows and lets the
    queries pass in batches. No row is copied, and no number of queries has to
    fit anywhere.
    """
    sizes = index.blocks().select("scope", "list", F.ceil(F.col("rows") / block_rows).cast("int").alias("salts"))
    asked = pairs.select("scope", "list").distinct()
    held = index.rows().join(asked.join(sizes, ["scope", "list"]), ["scope", "list"])
    block = ["scope", "list", "salt"]
    none = F.lit(None).cast("binary").alias("code")
    rows = held.select(
        "scope", "list", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("kind"), F.col("id").alias("name"), "embedding",
        none if rerank is None else "code",
    )
    queries = pairs.select(*block, F.lit(1).alias("kind"), F.col("query_id").alias("name"), "embedding", none)
    dealt = rows.unionByName(queries).repartition(*block).sortWithinPartitions(*block, "kind")
    centres, books = index.centres, index.codebooks
    dimension = centres.shape[1]

    def exact(unit: np.ndarray, vectors: np.ndarray, codes: np.ndarray, number: int) -> np.ndarray:
        return 1.0 - unit @ vectors.T

    def coded(unit: np.ndarray, vectors: np.ndarray, codes: np.ndarray, number: int) -> np.ndarray:
        near = np.repeat((1.0 - unit @ centres[number])[:, None], len(codes), axis=1)
        pieces = np.split(unit, np.cumsum([b.shape[1] for b in books])[:-1], axis=1)
        for part, (piece, book) in enumerate(zip(pieces, books, strict=True)):
            near -= (piece @ book.T)[:, codes[:, part]]
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, codes, whole = None, [], [], [], None
        for batch in batches:
            scopes, lists, salts, kinds = (batch.column(c).to_pylist() for c in range(4))
            start = 0
            while start < batch.num_rows:
                key = scopes[start], lists[start], salts[start]
                stop = start
                while stop < batch.num_rows and (scopes[stop], lists[stop], salts[stop], kinds[stop]) == (*key, kinds[start]):
                    stop += 1
                part = batch.slice(start, stop - start)
                unit, good = unit_rows(part.column(5).flatten().to_numpy(zero_copy_only=False), dimension)
                names = part.column(4).to_numpy(zero_copy_only=False)[good]
                if key != current:
                    current, ids, vectors, codes, whole = key, [], [], [], None
                if kinds[start] == 0:
                    ids.append(names)
                    vectors.append(unit)
                    if rerank is not None:
                        codes.append(np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(-1, len(books))[good])
                elif ids:
                    if whole is None:
                        whole = np.concatenate(ids), np.concatenate(vectors), np.concatenate(codes) if codes else np.empty((0, 0), np.uint8)
                        ids, vectors, codes = [None], [], []
                    yield from nearest_of(names, unit, *whole, key[1], k, exact if rerank is None else coded, rerank)
                start = stop

    return dealt.mapInArrow(run, "query_id string, id string, distance double, list int")


def nearest_of(names, unit, ids, vectors, codes, list_number: int, k: int, score, rerank: int | None) -> Iterator[pa.RecordBatch]:
    """The k nearest of the held rows for each query, equal distances by id; with ``rerank`` of the rows of so many best scores."""
    wanted = k if rerank is None else rerank
    for start in range(0, len(names), BLOCK_QUERIES):
        asked = unit[start : start + BLOCK_QUERIES]
        out: list[tuple] = []
        for name, own, line in zip(names[start : start + BLOCK_QUERIES], asked, score(asked, vectors, codes, list_number), strict=True):
            near = np.flatnonzero(line <= np.partition(line, wanted - 1)[wanted - 1] + SLACK) if len(line) > wanted else np.arange(len(line))
            # Summed row by row, so that equal vectors are equally far whatever block they are in.
            exact = 1.0 - (vectors[near] * own).sum(axis=1)
            best = np.lexsort((ids[near].astype(str), exact))[:k]
            out += [(name, ids[near[i]], float(exact[i])) for i in best]
        columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))]
        columns.append(pa.array([list_number] * len(out), pa.int32()))
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "distance", "list"])


@dataclass
class PrunedSearch:
    found: DataFrame
    pairs: list[DataFrame]

    def report(self) -> DataFrame:
        """One row: n_met, n_pruned (query, list) pairs and the share that was skipped."""
        second = self.pairs[1].select("query_id", "pruned", "met").distinct()
        met = second.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("a")).join(self.pairs[0].agg(F.countDistinct("query_id").alias("b")))
        all_ = self.pairs[0].select("query_id", "pruned", "met").distinct().agg(F.coalesce(F.sum(F.col("pruned") + F.col("met")), F.lit(0)).alias("n"))
        both = met.select((F.col("a") + F.col("b")).alias("n_met")).join(all_)
        return both.select("n_met", (F.col("n") - F.col("n_met")).alias("n_pruned"), (1 - F.col("n_met") / F.col("n")).alias("skipped"))


def search_index_exact(
    queries: DataFrame, index: ListIndex, k: int, scope: str | None = None, block_rows: int = BLOCK_ROWS
) -> PrunedSearch:
    """``found``: (query_id, id, distance, position) of the k nearest rows of each query, for query sets of any size.

    Each query meets the list of the nearest centre first; the k-th hit there
    bounds what other lists have to offer, and those out of reach are skipped.
    Query ids are unique. A query without a usable vector finds nothing.
    """
    asked = asked_of(queries, scope)
    if not len(index.centres):
        none = index.spark.createDataFrame([], "query_id string, id string, distance double, position int")
        empty = index.spark.createDataFrame([], _PAIR)
        return PrunedSearch(none, [empty, empty])
    one = settled(pairs_of(asked, index, block_rows, first=True), "search-first-pairs")
    hits = settled(meet(one, index, k, block_rows), "search-first-hits")
    kth = top_per_group(hits, ["query_id"], [F.asc("distance"), F.asc("id")], k).where(F.col("position") == k)
    known = one.select("query_id", F.col("list").alias("done")).distinct().join(
        kth.select("query_id", (F.lit(1.0) - F.col("distance")).alias("reach")), "query_id", "left"
    )
    two = settled(pairs_of(asked.join(known, "query_id"), index, block_rows, first=False), "search-other-pairs")
    both = hits.unionByName(meet(two, index, k, block_rows))
    found = top_per_group(both, ["query_id"], [F.asc("distance"), F.asc("id")], k)
    return PrunedSearch(found.select("query_id", "id", "distance", "position"), [one, two])
