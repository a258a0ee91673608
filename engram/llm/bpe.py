"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from engram.llm.vocab import NOT_SPACE, SPACE, byte_characters, composed, lowered, read_vocabulary, special_pattern

NONE = 1 << 62
PLACES = 32
KNOWN = 400_000
ROWS = 256
# Words of up to so many symbols are merged side by side, so many at a time.
SHORT, BLOCK = 64, 8192
ABSENT = np.int64(NONE)


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges, the leftmost pair of the lowest rank always first.

    The leaves of the tree hold rank and place of the pair that begins at each
    symbol, an inner node the least of its two children, so the root is the next
    merge. A merge changes three leaves: O(log n) each, O(n log n) for the text.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    half = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * half)
    get = merges.get
    for i in range(n - 1):
        pair = get((symbols[i], symbols[i + 1]))
        if pair is not None:
            tree[half + i] = pair[0] << PLACES | i
    for node in range(half - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        node = half + i
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def leaf(i: int, j: int) -> None:
        pair = get((symbols[i], symbols[j]))
        put(i, NONE if pair is None else pair[0] << PLACES | i)

    alive = [True] * n
    while tree[1] != NONE:
        i = tree[1] & ((1 << PLACES) - 1)
        j = following[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        alive[j] = False
        k = following[i] = following[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            leaf(i, k)
        else:
            put(i, NONE)
        if before[i] >= 0:
            leaf(before[i], i)
    return [s for s, kept in zip(symbols, alive, strict=True) if kept]


class PairRanks:
    """The merges as arrays, for many pairs at a time: a merge is named by its rank."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        pairs = np.array([a << 32 | b for a, b in merges] + [NONE], np.int64)
        ranks = np.array([r for r, _ in merges.values()] + [0], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], ranks[order]
        self.symbol = np.zeros(int(ranks.max()) + 1, np.int64)
        self.symbol[ranks[:-1]] = [s for _, s in merges.values()]

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of each pair; what no merge joins comes after all ranks, and so do symbols below 0."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs[:-1], pair)
        known = (self.pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] << PLACES | place, ABSENT)


def merged_together(flat: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> list[tuple[int, ...]]:
    """``merged`` of many short words, given one after the other.

    Each has a segment tree of its own, a row of one array, and each step merges one pair in every tree.
    """
    rows, half = len(lengths), 1 << (int(lengths.max()) - 1).bit_length()
    symbols = np.full((rows, half + 1), -1, np.int64)
    symbols[np.arange(half + 1) < lengths[:, None]] = flat
    tree = np.full((rows, 2 * half), ABSENT)
    tree[:, half:] = pairs.leaves(symbols[:, :-1], symbols[:, 1:], np.arange(half))
    level = half
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    following = np.tile(np.arange(1, half + 2), (rows, 1))
    before = np.tile(np.arange(-1, half), (rows, 1))
    ending = half  # the place of no symbol
    following[following >= np.minimum(lengths, half)[:, None]] = ending
    symbols, tree, following, before = (a.ravel() for a in (symbols, tree, following, before))
    wide = half + 1
    row = np.flatnonzero(tree[1 :: 2 * half] != ABSENT)
    while len(row):
        root = tree[row * (2 * half) + 1]
        i, at = root & ((1 << PLACES) - 1), row * wide
        j = following[at + i]
        k = following[at + j]
        new = pairs.symbol[root >> PLACES]
        symbols[at + i], symbols[at + j] = new, -1
        following[at + i], before[at + k] = k, i
        p = before[at + i]
        changed = [(j, np.full(len(row), ABSENT)), (i, pairs.leaves(new, symbols[at + k], i))]
        held = p >= 0
        changed.append((np.where(held, p, i), np.where(held, pairs.leaves(symbols[at + np.maximum(p, 0)], new, p), changed[1][1])))
        base = row * (2 * half)
        for place, value in changed:
            tree[base + half + place] = value
        for place, _ in changed:
            node = (half + place) >> 1
            while node[0]:
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                node >>= 1
        row = row[tree[base + 1] != ABSENT]
    kept = symbols.reshape(rows, wide) >= 0
    ids, ends = symbols[kept.ravel()].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class WordEncoder:
    """Encodes texts with a vocabulary whose pattern drops white space, so that each word stands alone.

    Words met before are looked up; the lookup holds ``known`` words at most and
    starts anew beyond that, which changes no result.
    """

    def __init__(self, path: str, known: int = KNOWN):
        v = read_vocabulary(path)
        if not v.suffix or [n for n in v.normalizers if n not in ("NFC", "Replace", "Lowercase")]:
            raise ValueError(f"{path}: not a vocabulary of words with ends")
        self.vocabulary, self.known = v, known
        self.lower, self.compose = "Lowercase" in v.normalizers, "NFC" in v.normalizers
        self.special = special_pattern(v.special)
        self.lines = regex.compile(f"{v.pattern}|\n")
        self.pairs = PairRanks(v.merges)
        self.spaces = regex.compile(f"[^{SPACE}]+")
        self.symbols = np.array([v.ids[c] for c in byte_characters()], np.int64)
        self.last_symbols = np.array([v.ids[c + v.suffix] for c in byte_characters()], np.int64)
        self.token_of = v.tokens()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def learn_pieces(self, pieces: list[str]) -> None:
        """The ids of pieces not met before; short ones of about one length are merged side by side."""
        coded = sorted((piece.encode() for piece in pieces), key=len)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.symbols[raw]
        symbols[ends - 1] = self.last_symbols[raw[ends - 1]]
        begin, short = 0, int(np.searchsorted(lengths, SHORT, "right"))
        while begin < short:
            size = 1 << (int(lengths[begin]) - 1).bit_length()
            end = min(int(np.searchsorted(lengths[:short], size, "right")), begin + BLOCK)
            found = merged_together(symbols[ends[begin] - lengths[begin] : ends[end - 1]], lengths[begin:end], self.pairs)
            self.pieces.update(zip([c.decode() for c in coded[begin:end]], found, strict=True))
            begin = end
        for i in range(short, len(coded)):
            self.pieces[coded[i].decode()] = tuple(merged(symbols[ends[i] - lengths[i] : ends[i]].tolist(), self.vocabulary.merges))

    def missing(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words not met before, each a line of one text that the vocabulary's pattern splits."""
        listed = list(words)
        text = "\n".join([*listed, ""])
        text = composed(text) if self.compose else text
        text = lowered(text) if self.lower else text
        pieces = self.lines.findall(text)
        distinct = set(pieces)
        distinct.discard("\n")
        new = distinct.difference(self.pieces)
        if len(self.pieces) + len(new) > self.known:
            self.pieces.clear()
            new = distinct
        self.learn_pieces(list(new))
        coded, found, ids = self.pieces, {}, ()
        words_left = iter(listed)
        for piece in pieces:
            if piece == "\n":
                found[next(words_left)] = ids
                ids = ()
            else:
                ids = ids + coded[piece] if ids else coded[piece]
        return found

    def split(self, text: str) -> list[str]:
        return self.spaces.findall(text) if any(c in text for c in NOT_SPACE) else text.split()

    def lists(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null is empty. A special string in a text is one id."""
        split = []
        for text in texts:
            parts = self.special.split(text) if text and "<" in text else [text or ""]
            split.append([[p] if p in self.vocabulary.special else self.split(p) for p in parts])
        distinct = set().union(*(words for parts in split for words in parts))
        new = distinct.difference(self.words, self.vocabulary.special)
        if len(self.words) + len(new) > self.known:
            self.words = {}
            new = distinct.difference(self.vocabulary.special)
        self.words.update(self.missing(new))
        for s, i in self.vocabulary.special.items():
            self.words[s] = (i,)
        known = self.words.__getitem__
        return [list(chain.from_iterable(map(known, chain.from_iterable(parts)))) for parts in split]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids with one blank between; these files name no decoder."""
        return " ".join([self.token_of[i] for i in ids])


def encode_and_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``ids`` (array of int) and ``decoded`` text of each row's whole text.

    A null text is encoded as the empty one: no ids, an empty decoded text.
    Repeated rows give a row each, a null key stays null, an empty table gives no
    rows, and other columns are not looked at. Rows are worked off in slices of
    ``ROWS``, so a task holds one Arrow batch of texts and one slice of ids.
    """
    keys = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = encoder.lists(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array([encoder.decode(x) for x in lists], pa.string()),
                    ],
                    names=[key, "ids", "decoded"],
                )

    schema = f"`{key}` {keys.dataType.simpleString()}, ids array<int>, decoded string"
    return df.select(key, text).mapInArrow(run, schema)
