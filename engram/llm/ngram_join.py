"""Jaccard join of shingle sets by token-combination prefixes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import lowered_words, settled, small_batches
from engram.llm.components import connected
from engram.llm.shingles import WORDS

SHARE = 80  # per cent of the union
COMMON = 64  # a token in more texts is of a frequent class
COMMON_TOKENS = 1 << 18  # so many at most are; which are never changes results
SLICE_TOKENS = 1 << 20
KNOWN_PAIRS = 1 << 17
HOT_SHARE, HOT_SEEN, HOT_KEYS = 64, 64, 1 << 16
SHORT_LIST = 8
BLOCK = 2048
SEEN_KEYS = 8
ROWS = 1024
FILTER_BITS = 23
BITMAP_WORDS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number: the golden ratio's fraction


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's begin, and the end."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (np.asarray(b).astype(np.uint64) * MIX)) * MIX
        return (h ^ (h >> np.uint64(32))) * MIX


def run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of ``words`` word hashes."""
    if len(h) < words:
        return h[:0]
    total = np.full(len(h) - words + 1, words, np.uint64)
    factor = MIX
    with np.errstate(over="ignore"):
        for k in range(words):
            total += h[k : len(h) - words + 1 + k] * factor
            factor = factor * MIX + np.uint64(2)
    return mixed(total, 7)


class Sets:
    """The shingle sets of a batch: tokens in ascending order, where each row's begin, and a hash of each row's set."""

    def __init__(self, batch: pa.RecordBatch, words: int):
        h, ends = flat(batch.column(1))
        h = h.view(np.uint64)
        runs = run_hashes(h, words)
        parts = []
        for i, k in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if k - i >= words:
                parts.append(np.unique(runs[i : k - words + 1]))
            else:
                parts.append(run_hashes(h[i:k], k - i) if k > i else h[:0])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.at = np.r_[0, np.cumsum(self.sizes)]
        self.tokens = np.concatenate([*parts, h[:0]])
        sums = np.r_[np.uint64(0), np.cumsum(mixed(self.tokens, 11), dtype=np.uint64)]
        with np.errstate(over="ignore"):
            own = sums[self.at[1:]] - sums[self.at[:-1]]
        self.nodes = mixed(own, self.sizes).view(np.int64)
        self.usable = (self.sizes > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.at[i] : self.at[i + 1]]

    def fresh(self, seen: set) -> list[int]:
        """The rows with a key and a set that this task has not had before."""
        rows = []
        for i, (node, usable) in enumerate(zip(self.nodes.tolist(), self.usable.tolist(), strict=True)):
            if usable and node not in seen:
                seen.add(node)
                rows.append(i)
        return rows


def parities(places: np.ndarray, owner: np.ndarray, rows: int, words: int) -> np.ndarray:
    """A row of ``words`` words for each set: bit k is the parity of the number of its tokens at place k."""
    counts = np.bincount(owner * (64 * words) + places % (64 * words), minlength=rows * 64 * words)
    return np.packbits((counts & 1).astype(np.uint8).reshape(rows, 64 * words), axis=1, bitorder="little").view(np.int64)


def bitmaps(sets: Sets) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each set a bitmap of 1,024 bits, and one of a power of two of bits, two for a token at least.

    Two bitmaps of one size differ in at most as many bits as the sets differ in
    tokens; a bitmap's two halves, taken exclusively or, are that of half the size.
    """
    places = (mixed(sets.tokens, 5) >> np.uint64(40)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    brief = parities(places, owner, len(sets.sizes), BITMAP_WORDS)
    wide = []
    for i, n in enumerate(sets.sizes.tolist()):
        words = max(BITMAP_WORDS, 1 << max(0, (n - 1).bit_length() - 5))
        own = places[sets.at[i] : sets.at[i + 1]]
        wide.append(brief[i] if words == BITMAP_WORDS else parities(own, np.zeros(len(own), np.int64), 1, words)[0])
    return brief, wide


def hashed_words(texts: DataFrame) -> DataFrame:
    """key and the hashes of the lower-cased words of each row's whole text."""
    return texts.select("key", F.transform(lowered_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def fixed_lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def outlined(hashed: DataFrame, words: int) -> DataFrame:
    """kind 0: a = key, b = node, c = n and the two bitmaps of each row; kind 1: a = token, b = texts with it, by slices of a task.

    Tokens that a slice has once are not counted: this only decides which
    tokens are taken for frequent, and those are frequent in many slices.
    """
    names = ["kind", "a", "b", "c", "bitmap", "wide"]
    listed = pa.list_(pa.int64())

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held).view(np.int64), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        kind = pa.array(np.ones(len(token), np.int32))
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([kind, pa.array(token), pa.array(count.astype(np.int64)), none, *[pa.nulls(len(token), listed)] * 2], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                sets = Sets(part, words)
                kind = pa.array(np.zeros(part.num_rows, np.int32))
                node = pa.array(sets.nodes, mask=~sets.usable)
                brief, wide = bitmaps(sets)
                columns = [kind, part.column(0), node, pa.array(sets.sizes), fixed_lists(brief), pa.array(wide, listed)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                for i in sets.fresh(seen):
                    held.append(sets.of(i))
                    size += len(held[-1])
                    if size >= SLICE_TOKENS:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)

    return hashed.mapInArrow(run, "kind int, a long, b long, c long, bitmap array<bigint>, wide array<bigint>")


def levels_of(n: int) -> list[tuple[int, int]]:
    """(level, classes): the schemes a set of this size takes part in.

    Level k is for sizes from 32 * 4 ** (k - 1), level 0 for those below 32, and
    each also for sizes up to a quarter above, so that two sets that may be alike
    have a level in common. Frequent tokens fall into 4 ** k classes.
    """
    found, low, high, k = [], 0, 32, 0
    while low <= n:
        if 4 * n <= 5 * high:
            found.append((k, 4**k))
        low, high, k = high, high * 4, k + 1
    return found


def signature_keys(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The index keys of one set, from its tokens in ascending order and which of them are common.

    The order of all tokens is rare before common, then by value. A set of n
    can lack d = n - ceil(0.8 n) of its tokens in a set that is alike. With d + 1
    rare tokens these are its prefix, and each is a key. Otherwise its prefix is
    all rare tokens and, at each of its levels, as many common ones as are needed
    for d + 1 after one token of each class is taken off: two sets that are alike
    then share a rare token or two tokens of a class, and the keys are the rare
    tokens and all pairs within a class.
    """
    n = len(tokens)
    need = n - (SHARE * n + 99) // 100 + 1
    rare = tokens[~common]
    if len(rare) >= need:
        return mixed(rare[:need], 1)
    keys = [mixed(rare, 1)]
    often = tokens[common]
    for level, classes in levels_of(n):
        of = (mixed(often, 2) >> np.uint64(20)) % np.uint64(classes)
        _, first = np.unique(of, return_index=True)
        gain = np.ones(len(often), np.int64)
        gain[first] = 0
        end = int(np.searchsorted(np.cumsum(gain), need - len(rare))) + 1
        order = np.argsort(of[:end], kind="stable")
        members, sizes = often[:end][order], np.bincount(of[:end].astype(np.int64), minlength=classes)
        begin = 0
        for size in sizes[sizes > 0].tolist():
            if size > 1:
                a, b = np.triu_indices(size, 1)
                group = members[begin : begin + size]
                keys.append(mixed(mixed(group[a], level + 3), group[b]))
            begin += size
    return np.concatenate(keys)


def indexed(hashed: DataFrame, frequent: np.ndarray, words: int, hot: np.ndarray | None = None) -> DataFrame:
    """key, node, salt: the index entries of all sets of two tokens or more; a task writes those of a node once.

    Entries of ``hot`` keys, given in ascending order, carry one of ``HOT_SHARE`` salts from 1 by
    their node, all others the salt 0.
    """
    hot = np.empty(0, np.int64) if hot is None else hot
    mask = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[frequent & mask] = True

    def is_common(values: np.ndarray) -> np.ndarray:
        result = maybe[values & mask]
        at = np.flatnonzero(result)
        place = np.minimum(np.searchsorted(frequent, values[at]), max(len(frequent) - 1, 0))
        result[at] = frequent[place] == values[at] if len(frequent) else False
        return result

    def entries(keys: list[np.ndarray], owners: list) -> pa.RecordBatch:
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys).view(np.int64)
        salt = np.zeros(len(key), np.int32)
        if len(hot):
            at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key)
            salt[at] = 1 + owner[at] % HOT_SHARE
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(salt)], names=["key", "node", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                sets = Sets(batch.slice(begin, ROWS), words)
                common = is_common(sets.tokens)
                keys, owners, size = [], [], 0
                for i in sets.fresh(seen):
                    if sets.sizes[i] < 2:
                        continue
                    keys.append(signature_keys(sets.of(i), common[sets.at[i] : sets.at[i + 1]]))
                    owners.append(sets.nodes[i])
                    size += len(keys[-1])
                    if size > 1 << 18:
                        yield entries(keys, owners)
                        keys, owners, size = [], [], 0
                if keys:
                    yield entries(keys, owners)

    return hashed.mapInArrow(run, "key long, node long, salt int")


def hot_keys(hashed: DataFrame, frequent: np.ndarray, words: int) -> np.ndarray:
    """Keys of very long lists, in ascending order, as a fixed share of the rows shows them.

    Their entries are dealt out by node too. Which keys are taken for hot never
    changes results: every list is worked through, whatever its length.
    """
    some = indexed(hashed.where(F.pmod(F.xxhash64("key", F.lit("hot")), F.lit(HOT_SHARE)) == 0), frequent, words)
    seen = some.groupBy("key").count().where(F.col("count") >= HOT_SEEN)
    return np.sort(np.array([r["key"] for r in seen.orderBy(F.desc("count"), "key").limit(HOT_KEYS).collect()], np.int64))


def shared_lists(index: DataFrame) -> DataFrame:
    """Entries of keys that two nodes or more have: kind 0 with a, b as a pair from a short list, kind 1 with a = key, b = node.

    Entries come sorted, so a task holds only the short beginning of a list.
    Entries of hot keys, dealt out by salts, are passed on as those of long lists.
    """
    names = ["kind", "a", "b"]

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        last_key = np.empty(0, np.int64)
        last_node = np.empty(0, np.int64)
        long_key = None  # the list that goes on is long: its entries have been passed on

        def pairs(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal known
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            for length in range(2, SHORT_LIST + 1):
                begin = start[size == length]
                if not len(begin):
                    continue
                a, b = np.triu_indices(length, 1)
                left, right = node[begin[:, None] + a].ravel(), node[begin[:, None] + b].ravel()
                new = [p for p in zip(left.tolist(), right.tolist(), strict=True) if p not in known]
                if len(known) > KNOWN_PAIRS:
                    known = set()
                new = list(dict.fromkeys(new))
                known.update(new)
                if new:
                    yield rows(0, *np.array(new, np.int64).T.copy())
            many = np.repeat(size > SHORT_LIST, size)
            if many.any():
                yield rows(1, key[many], node[many])

        for batch in batches:
            hot = batch.column(2).to_numpy() > 0
            if hot.any():
                key, node = (batch.column(c).to_numpy()[hot] for c in range(2))
                single = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
                yield rows(1, key[single], node[single])
                batch = batch.filter(pa.array(~hot))
            if not batch.num_rows:
                continue
            key = np.concatenate([last_key, batch.column(0).to_numpy()])
            node = np.concatenate([last_node, batch.column(1).to_numpy()])
            single = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[single], node[single]
            if long_key is not None and len(key):
                ends = int(np.searchsorted(key != long_key, True)) if (key != long_key).any() else len(key)
                if ends:
                    yield rows(1, key[:ends], node[:ends])
                key, node = key[ends:], node[ends:]
                if not len(key):
                    last_key, last_node = key, node
                    continue
                long_key = None
            tail = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            if tail:
                yield from pairs(key[:tail], node[:tail])
            last_key, last_node = key[tail:], node[tail:]
            if len(last_key) > SHORT_LIST:
                yield rows(1, last_key, last_node)
                long_key, last_key, last_node = last_key[-1], last_key[:0], last_node[:0]
        if len(last_key):
            yield from pairs(last_key, last_node)

    return index.repartition("key", "salt").sortWithinPartitions("key", "node").mapInArrow(run, "kind int, a long, b long")


def with_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with the given keys, and few others: those whose bit is set in a table of 2 ** 23 bits.

    Every task gets the table, 2 ** 17 words of it at most, so that a text is neither moved nor
    hashed to find out whether it is asked for.
    """
    word = F.shiftright("key", 6).bitwiseAND(F.lit((1 << (FILTER_BITS - 6)) - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63L as int))")
    table = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    return texts.withColumn("w", word).join(F.broadcast(table), "w").where(F.col("bits").bitwiseAND(bit) != 0).select(*texts.columns)


def needed_sets(texts: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """node and tokens of the rows with the given keys, and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                sets = Sets(batch.slice(begin, ROWS), words)
                if rows := sets.fresh(seen):
                    tokens = [sets.of(i).view(np.int64) for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(sets.nodes[rows]), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])

    return hashed_words(with_keys(texts, keys)).mapInArrow(run, "node long, tokens array<bigint>")


def alike(most: Column, total: Column) -> Column:
    """Whether an intersection of ``most`` tokens is enough for sets of ``total`` tokens together."""
    return most * (100 + SHARE) >= total * SHARE


def may_link(x: str, y: str) -> Column:
    """False only for pairs whose sizes or bitmaps show that they cannot be alike."""
    a, b = F.col(f"{x}.wide"), F.col(f"{y}.wide")

    def halved(m: Column) -> Column:
        half = (F.size(m) / 2).cast("int")
        return F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def differing(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)

    # Sets whose sizes allow a link have bitmaps of the same size or of twice the size.
    differ = F.when(F.size(a) == F.size(b), differing(a, b)).when(F.size(a) > F.size(b), differing(halved(a), b)).otherwise(differing(a, halved(b)))
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    least = F.least(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return F.when(alike(least, total), alike(F.least(F.floor((total - differ) / 2), least), total)).otherwise(F.lit(False))


def likely(pairs: DataFrame, briefs: DataFrame) -> DataFrame:
    """The pairs a, b that sizes and bitmaps allow."""
    brief = briefs.select("node", F.struct("n", "wide").alias("brief"))
    left, right = (brief.select(F.col("node").alias(c), F.col("brief").alias(f"{c}_brief")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(may_link("a_brief", "b_brief")).select(*pairs.columns)


def verified(pairs: DataFrame, briefs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b, linked: the verdict on the whole sets of each pair.

    A set is fetched from the text with its node's smallest key, written to the
    shared folder, as both sides of the pairs read it, and moved once to all its pairs.
    """
    reps = briefs.select("node", F.col("rep").alias("key"))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node").select("key")
    whole = settled(needed_sets(texts, keys, words), "sets")
    left, right = (whole.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    total = F.size("a_tokens") + F.size("b_tokens")
    verdicts = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", alike(both, total).alias("linked"))
    return settled(verdicts, "links")


def first_lists(entries: DataFrame) -> DataFrame:
    """Of each node its entries in the lists of its least and its greatest key: texts that are alike often share them."""
    ends = entries.groupBy("node").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    return ends.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("key"), "node")


def open_lists(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root: the entries of the lists that hold nodes of different components, whose root is given."""
    rooted = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settled(rooted.select("key", "node", "root"), "rooted")
    still = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    return settled(rooted.join(settled(still.select("key"), "open"), "key", "left_semi"), "entries")


def size_class(n: Column) -> Column:
    """Sets that may be alike differ by a quarter in size, so their classes are the same or next to each other."""
    return F.floor(F.log(n) / F.log(F.lit(1.26))).cast("int")


def dealt(rows: DataFrame, turn: int, every: bool) -> DataFrame:
    """The entries with the part they are compared in and their side there.

    A list of up to ``BLOCK`` entries is one part. A longer one is cut into size
    classes and these into blocks, drawn anew each turn. Each block is a part,
    and with ``every`` so are all two blocks of the same or of neighbouring
    classes, where only entries of different sides meet. Without it each entry
    is dealt once.
    """
    rows = rows.withColumn("class", size_class(F.col("n")))
    sizes = settled(rows.groupBy("key", "class").agg(F.count("*").alias("entries")), "sizes")
    large = sizes.groupBy("key").agg(F.sum("entries").alias("entries")).where(F.col("entries") > BLOCK).select("key")
    cut = sizes.join(large, "key", "left_semi").select("key", "class", F.ceil(F.col("entries") / BLOCK).cast("int").alias("blocks"))
    cut = settled(cut, "blocks")
    around = cut
    for step in (-1, 1):
        other = cut.select("key", (F.col("class") - step).alias("class"), F.col("blocks").alias(f"blocks{step}"))
        around = around.join(other, ["key", "class"], "left")
    around = settled(around, "around")
    own = F.pmod(F.xxhash64("key", "node", F.lit(turn)), F.col("blocks")).cast("int")
    placed = rows.join(around, ["key", "class"], "left").withColumn("own", F.struct(F.col("class").alias("c"), own.alias("b")))
    met = F.array("own")
    if every:

        def blocks_of(step: int, count: Column) -> Column:
            numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(numbers, lambda b: F.struct((F.col("class") + step).alias("c"), b.alias("b")))

        met = F.concat(*(blocks_of(step, F.col(name)) for step, name in ((-1, "blocks-1"), (0, "blocks"), (1, "blocks1"))))
    placed = placed.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array("own")).otherwise(met)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    part = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair)
    side = F.when(F.col("blocks").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select(part.alias("part"), "n", "node", "root", "bitmap", side.alias("side"), *(c for c in ("key", "keys") if c in rows.columns and every))


def with_first_keys(entries: DataFrame) -> DataFrame:
    """The entries with ``keys``: the least ``SEEN_KEYS`` keys of their node, in ascending order.

    Texts that are alike share many lists. A pair need be given only in the
    first list that both are in; where these few keys show an earlier one, it
    is not given again.
    """
    first = entries.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, SEEN_KEYS).alias("keys"))
    return entries.join(first, "node")


def list_pairs(entries: DataFrame, briefs: DataFrame, turn: int, forest: bool) -> DataFrame:
    """The pairs of ``pairs_by_list``, each once."""
    return pairs_by_list(entries, briefs, turn, forest).distinct()


def pairs_by_list(entries: DataFrame, briefs: DataFrame, turn: int, forest: bool) -> DataFrame:
    """Pairs of long lists that sizes and bitmaps allow, between nodes of different components; ``entries`` have their roots.

    With ``forest`` a part of a list gives only pairs that would join its
    components, one less than its entries at most, and every entry is in one
    part; else all pairs, each in one of the lists that hold both as a rule.
    """
    entries = entries if forest else with_first_keys(entries)
    rows = dealt(entries.join(briefs.select("node", "n", "bitmap"), "node"), turn, every=not forest)

    def compared(n: np.ndarray, node: np.ndarray, root: np.ndarray, bitmap: np.ndarray, side: np.ndarray, earlier: list[frozenset]) -> tuple[list[int], list[int]]:
        label = np.unique(root, return_inverse=True)[1]
        a, b = [], []
        if label.max(initial=0) == 0:
            return a, b
        ends = np.searchsorted(n, n * 100 // SHARE, "right")
        for i in range(len(n)):
            j = slice(i + 1, int(ends[i]))
            total = n[i] + n[j]
            differ = np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(axis=1, dtype=np.int64)
            most = np.minimum((total - differ) // 2, n[i])
            near = np.flatnonzero((most * (100 + SHARE) >= total * SHARE) & (label[j] != label[i]) & ((side[j] != side[i]) | (side[i] == 0)))
            if not len(near):
                continue
            if forest:
                near = near[np.argsort(differ[near], kind="stable")]
                near = near[np.unique(label[j][near], return_index=True)[1]]
                joined = np.isin(label, label[j][near])
                a += [int(node[i])] * len(near)
                b += node[j][near].tolist()
                label[joined] = label[i]
            else:
                new = [k for k in (near + i + 1).tolist() if earlier[i].isdisjoint(earlier[k])]
                a += [int(node[i])] * len(new)
                b += node[new].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        known: set = set()

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            part, n, node, root = (table.column(c).to_numpy() for c in range(4))
            bitmap = flat(table.column(4).combine_chunks())[0].view(np.uint64).reshape(-1, BITMAP_WORDS)  # bits are counted of unsigned numbers
            side = table.column(5).to_numpy()
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for i, k in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True):
                earlier = [] if forest else [frozenset(x for x in own if x < key) for key, own in zip(*(table.column(c).slice(i, k - i).to_pylist() for c in (6, 7)), strict=True)]
                a, b = compared(n[i:k], node[i:k], root[i:k], bitmap[i:k], side[i:k], earlier)
                new = [p for p in {(min(p), max(p)) for p in zip(a, b, strict=True)} if p not in known]
                if len(known) > KNOWN_PAIRS:
                    known.clear()
                known.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1].as_py()
            if held[0].column(0)[0].as_py() != last:
                table = pa.Table.from_batches(held)
                part = table.column(0).to_numpy()
                tail = int(np.searchsorted(part == last, True))
                yield from finished(table.slice(0, tail))
                held = table.slice(tail).combine_chunks().to_batches()
        if held:
            yield from finished(pa.Table.from_batches(held))

    ordered = rows.repartition("part").sortWithinPartitions("part", "n", "node")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row.

    A set has the distinct runs of five lower-cased words, of a shorter text its
    whole sequence. Two sets link when their intersection has at least 80 per cent of
    their union; equal sets are one node, told apart by 64 bits. Null and empty
    texts have no set, link with nothing and are their own component. Repeated
    rows are rows of the same component; a row with a null key links with
    nothing and has a null component. Other columns are not looked at; no rows give no rows.

    Texts are read to outline the sets and find frequent tokens, to index
    prefixes, and in each round to fetch the sets of pairs that sizes and bitmaps
    allow; only the texts asked for are hashed again. Two rounds take from long lists only pairs that would join components:
    first from two lists of each node, then from all lists that still hold
    different components. A last round, where anything is left for it, takes all
    pairs that are then left between components.
    """
    with small_batches(df.sparkSession):
        texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        hashed = hashed_words(texts)
        outline = settled(outlined(hashed, words), "outline")
        rows = outline.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("c").alias("n"), "bitmap", "wide")
        often = outline.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") > COMMON)
        frequent = np.array([r["a"] for r in often.orderBy(F.desc("n"), "a").limit(COMMON_TOKENS).collect()], np.int64).view(np.uint64)
        frequent = np.sort(frequent)

        shared = settled(shared_lists(indexed(hashed, frequent, words, hot_keys(hashed, frequent, words))), "lists")
        entries = shared.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"))
        nodes = shared.select(F.explode(F.when(F.col("kind") == 0, F.array("a", "b")).otherwise(F.array("b"))).alias("node")).distinct()
        described = [F.min("key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bitmap", "wide"))]
        briefs = settled(rows.where("n > 1").join(nodes, "node", "left_semi").groupBy("node").agg(*described), "briefs")

        first = settled(first_lists(entries), "first").withColumn("root", F.col("node"))
        found = shared.where("kind = 0").select("a", "b").unionByName(list_pairs(first, briefs, 0, forest=True)).distinct()
        links = verified(settled(likely(found, briefs), "pairs"), briefs, texts, words)
        roots = connected(links.where("linked"))
        for turn, forest in ((1, True), (2, False)):
            entries = open_lists(entries, roots).select("key", "node", "root")
            found = list_pairs(entries, briefs, turn, forest).join(links.select("a", "b"), ["a", "b"], "left_anti")
            pairs = settled(likely(found, briefs), "pairs")
            if not pairs.isEmpty():
                links = links.unionByName(verified(pairs, briefs, texts, words))
                roots = connected(links.where("linked"))
            entries = entries.select("key", "node")

        rows = rows.select("key", "node", "n").join(roots, "node", "left").select("key", "n", F.coalesce("root", "node").alias("root"))
        grouped = settled(rows, "roots")
    least = grouped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("key").alias("component_id"))
    found = grouped.join(least, "root", "left")
    return found.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
