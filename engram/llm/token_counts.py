"""Token counts by merging whole batches of pre-tokens at once, rank by rank."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from engram.llm.vocab import SPACE, byte_characters, read_vocabulary, special_pattern

NO_RANK = np.int32(np.iinfo(np.int32).max)
KNOWN = 400_000
ROWS = 512
BATCH_BYTES = 4 << 20


class BatchMerger:
    """Merges many byte strings at the same time: a flat array of symbols and the sequence of each."""

    def __init__(self, vocabulary):
        marks = byte_characters()
        self.first = np.array([vocabulary.ids[c] for c in marks], np.int64)
        self.base = max(vocabulary.ids.values()) + 1
        pairs = np.array([a * self.base + b for a, b in vocabulary.merges], np.int64)
        order = np.argsort(pairs)
        ranks = np.array([r for r, _ in vocabulary.merges.values()], np.int32)
        self.pairs, self.ranks = pairs[order], ranks[order]
        self.result = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        for rank, to in vocabulary.merges.values():
            self.result[rank] = to

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece once nothing can be merged.

        Every round applies, in each sequence, all pairs of that sequence's
        lowest rank; of overlapping ones (aaa) every other from the left.
        Sequences without a pair leave the arrays.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        result = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = self.ranks_in(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(rank, starts)
            result[owner[starts]] = sizes
            live = np.repeat(least != NO_RANK, sizes)
            if not live.all():
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                least, sizes = least[least != NO_RANK], sizes[least != NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            beside = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1])
            if beside.any():
                hit = self.every_other(hit, np.r_[False, beside])
            at = np.flatnonzero(hit)
            symbols[at] = self.result[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            changed = hit[stays]
            symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
            again = np.flatnonzero(changed | np.r_[changed[1:], False])
            after = np.minimum(again + 1, len(symbols) - 1)
            fresh = self.rank_of(symbols[again], symbols[after])
            fresh[(after == again) | (owner[again] != owner[after])] = NO_RANK
            rank[again] = fresh
        return result

    def ranks_in(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank_of(symbols[:-1], symbols[1:]), NO_RANK)
        return rank

    @staticmethod
    def every_other(hit: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Of each run of neighbouring hits the first, third, ..."""
        places = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(hit & ~goes_on, places, 0))
        return hit & ((places - run_start) % 2 == 0)


class TokenCounter:
    """Counts the tokens of texts; pieces met before are looked up, at most ``known`` of them."""

    def __init__(self, path: str, known: int = KNOWN):
        v = read_vocabulary(path)
        if v.suffix or v.normalizers:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.special, self.special_at = v.special, special_pattern(v.special)
        self.pattern = regex.compile(v.pattern)
        # White space goes with the characters after it; no pre-token reaches beyond such a unit.
        self.unit = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.merger = BatchMerger(v)
        self.known = known
        self.units: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def learn(self, units: set[str]) -> None:
        split = {u: self.pattern.findall(u) for u in units}
        new = list({p for pieces in split.values() for p in pieces}.difference(self.pieces))
        if len(self.pieces) + len(new) > self.known:
            self.pieces = {}
            new = list({p for pieces in split.values() for p in pieces})
        coded = [p.encode() for p in new]
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(coded[end]) <= BATCH_BYTES):
                size += len(coded[end])
                end += 1
            self.pieces.update(zip(new[at:end], self.merger.counts(coded[at:end]).tolist(), strict=True))
            at = end
        for u, pieces in split.items():
            self.units[u] = sum([self.pieces[p] for p in pieces])

    def counts(self, texts: list[str | None]) -> list[int]:
        specials, split = [], []
        for text in texts:
            text = text or ""
            parts = self.special_at.split(text) if "<" in text else [text]
            specials.append(len(parts) // 2)
            units: list[str] = []
            for part in parts[::2]:
                units += self.unit.findall(part)
            split.append(units)
        new = {u for units in split for u in units}.difference(self.units)
        if len(self.units) + len(new) > self.known:
            self.units = {}
            new = {u for units in split for u in units}
        self.learn(new)
        known = self.units
        return [n + sum([known[u] for u in units]) for n, units in zip(specials, split, strict=True)]


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``n_tokens`` of each row's whole text; a special string inside a text is one token.

    A null or empty text has 0 tokens. Repeated rows give a row each, a null key
    stays null, an empty table gives no rows; other columns are not looked at.
    A task holds one Arrow batch of texts and the pieces of ``ROWS`` of them.
    """
    keys = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {keys.dataType.simpleString()}, n_tokens long")
