"""Packing token pieces into windows: repeat counts of length combinations by non-negative least squares."""

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from engram.llm.common import WORD, settled, small_batches
from engram.llm.vocab import composed, lowered, read_vocabulary, special_pattern
from engram.operators.spread import salts_for

WINDOW = 4096
END_ID = 2
DEPTH = 6
TRIES = 4
ROUNDS = 200
ROWS = 4096
BYTES = 1 << 20
# Units whose ids a task keeps, about 200 bytes each.
KNOWN = 400_000
# The pieces encoded in one text, the units learnt at a time.
JOINED, LEARNT = 1000, 1 << 14
# ASCII punctuation but the apostrophe, with which a piece may begin and go on with letters; letters and digits for certain.
MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
LETTER = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]"
SPACED = regex.compile(WORD)


class LibraryEncoder:
    """The ids of many texts as one row of numbers, units not met before coming from the tokenizers library.

    Words are told apart by Arrow and cut into units; a text is a ragged take from the
    ids of its distinct words, and these one from the ids of their units. A new unit is
    normalized and cut into pieces by the vocabulary's pattern; pieces are encoded many in
    one text, with blanks between: a blank ends a piece, and only the last token of a
    piece has the word end. What is stored is bounded by ``known`` units and starts
    anew beyond, which changes no result.
    """

    def __init__(self, path: str, end_id: int, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        v = read_vocabulary(path)
        if not v.suffix or [n for n in v.normalizers if n not in ("NFC", "Replace", "Lowercase")]:
            raise ValueError(f"{path}: not a vocabulary of words with ends")
        self.library, self.end_id, self.known = Tokenizer.from_file(path), end_id, known
        # It gets pieces, which are normalized and split.
        self.library.normalizer = normalizers.Sequence([])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        self.lower, self.compose = "Lowercase" in v.normalizers, "NFC" in v.normalizers
        tokens = v.tokens()
        self.ending = np.array([tokens.get(i, "").endswith(v.suffix) for i in range(max(tokens) + 1)])
        self.lines = regex.compile(f"{v.pattern}|\n")
        self.special, self.apart = v.special, special_pattern(v.special)
        self.forget()

    def forget(self) -> None:
        known = ["", *self.special]
        self.units = Stored(known, np.array([*self.special.values()], "<u4"), np.array([0] + [1] * len(self.special), np.int64))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        all_ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for block in (pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)):
            (found,) = self.library.encode_batch_fast([" ".join(block)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.ending[ids])
            if len(ends) != len(block):
                raise ValueError("the vocabulary does not end each piece with one token")
            all_ids.append(ids)
            lengths.append(np.diff(ends, prepend=-1))
        return np.concatenate(all_ids), np.concatenate(lengths)

    def learn(self, units: list[str]) -> None:
        """The ids of units from those of their pieces; every unit is a line of one text."""
        text = "\n".join([*units, ""])
        text = composed(text) if self.compose else text
        text = lowered(text) if self.lower else text
        coded = pa.array(self.lines.findall(text), pa.string()).dictionary_encode()
        at = coded.indices.to_numpy()
        distinct = strings(coded.dictionary)
        line = distinct.index("\n")
        ids, lengths = self.encode_pieces(distinct[:line] + distinct[line + 1 :])
        ids, lengths = ragged(ids, np.insert(lengths, line, 0), at)
        stops = np.cumsum(lengths)[at == line]
        self.units.add(units, ids, np.diff(stops, prepend=0))

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text; other than ASCII white space, which stays inside, is left to the pattern."""
        small = pc.ascii_lower(texts)
        if not any(pc.any(pc.match_substring(small, s.lower())).as_py() for s in self.special):
            return pc.ascii_split_whitespace(small if self.lower else texts)
        rows = []
        for text in texts.to_pylist():
            parts = self.apart.split(text)
            rows.append([w for p in parts for w in ([p] if p in self.special else SPACED.findall(p))])
        return pa.array(rows, pa.list_(pa.string()))

    def parts(self, words: pa.Array) -> pa.Array:
        """Three units of each word: marks before, what is between, marks behind.

        The pattern's pieces never hold a mark and a letter next to each other, so
        that the units have the pieces of the word. Where another character is next
        to the marks they are left in the middle, and special strings are left whole.
        """
        n = len(words)
        words = pa.concat_arrays([words])
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1)
        before = pc.ascii_rtrim(words, MARKS)
        inner = pc.ascii_ltrim(before, MARKS)
        whole = pc.is_in(words, pa.array(list(self.special), pa.string())).to_numpy(zero_copy_only=False)

        def where(pattern: str, column: pa.Array) -> np.ndarray:
            return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False) & ~whole

        length = pc.binary_length(before).to_numpy()
        stop = np.where(where(f"{LETTER}$", before), offsets[:-1] + length, offsets[1:])
        start = np.where(where(f"^{LETTER}", inner), offsets[:-1] + length - pc.binary_length(inner).to_numpy(), offsets[:-1])
        cuts = np.append(np.stack([offsets[:-1], start, stop], axis=1).ravel(), offsets[-1:]).astype(np.int32)
        return pa.StringArray.from_buffers(3 * n, pa.py_buffer(cuts), words.buffers()[2])

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text ends; null is empty."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = self.split(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        parts = self.parts(coded.dictionary).dictionary_encode()
        distinct = strings(parts.dictionary)
        new = [u for u in distinct if u not in self.units.place]
        if len(self.units.place) + len(new) > self.known:
            self.forget()
            new = [u for u in distinct if u not in self.units.place]
        for i in range(0, len(new), LEARNT):
            self.learn(new[i : i + LEARNT])
        ids, lengths = self.units.take(distinct, parts.indices.to_numpy())
        ids, lengths = ragged(ids, lengths.reshape(-1, 3).sum(axis=1), coded.indices.to_numpy())
        stops = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        sizes = np.diff(stops)
        ends = np.cumsum(sizes + 1)
        out = np.empty(len(ids) + len(sizes), "<u4")
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = ids
        out[ends - 1] = self.end_id
        return out, ends


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def ragged(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows ``at``, one after the other, and how many each has; rows lie side by side unless ``starts`` are given."""
    starts = np.cumsum(lengths) - lengths if starts is None else starts
    lengths = lengths[at]
    ends = np.cumsum(lengths)
    place = np.repeat((starts[at] - (ends - lengths)).astype(np.int32), lengths)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place], lengths


class Stored:
    """The ids of strings, in one array."""

    def __init__(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray):
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.add(strings, ids, lengths)

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.place), len(self.place) + len(strings)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, distinct: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all coded strings, one after the other, and how many each has."""
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int32, len(distinct))[codes]
        return ragged(self.ids, self.lengths, at, self.starts)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and bytes; one longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(max(int(np.searchsorted(ends, before + BYTES, "right")), start + 1), start + ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def cut_documents(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of each row's ids and the end id: full windows, then what is left.

    key, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and
    doc_tokens; with ``with_ids`` also the ids themselves. A null text is empty
    and has the end id alone. Every row gives a piece at least, repeated rows
    too; a null key stays null; other columns are not looked at.
    """
    names = [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder(path, end_id)
        for batch in batches:
            for part in slices(batch, 1):
                owner, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
                coded, ends = encoder.rows(part.column(1))
                first = 0
                for row, end in enumerate(ends.tolist()):
                    for start in range(first, end, window):
                        piece = coded[start : min(start + window, end)]
                        owner.append(row)
                        starts.append(start - first)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece))
                        totals.append(end - first)
                        pieces.append(piece)
                    first = end
                columns = [part.column(0).take(pa.array(owner, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return df.select(key, text).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


@dataclass
class Plan:
    """Runs of equal sequences. Pieces of one length are numbered from 0; a slot of a run takes ``repeats`` of them in turn."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def combinations(counts: np.ndarray, window: int, depth: int, tries: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill the window exactly, ``tries`` for each length at most.

    For a length, the others are taken at even steps of the cumulated tokens, so
    that common lengths stand in many combinations; the last one closes the
    window exactly if there are pieces of that length.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    mass = np.cumsum(counts[present])
    found: set[tuple[int, ...]] = set()
    for length in present.tolist():
        if length == window:
            found.add((window,))
        for t in range(tries):
            parts, space = [length], window - length
            for d in range(depth - 1):
                if space <= 0:
                    break
                if counts[space]:
                    found.add(tuple(sorted([*parts, space])))
                fitting = int(np.searchsorted(present, space, "right"))
                if not fitting:
                    break
                share = ((t + 1) * 0.618033988749895 + d * 0.414213562373095 + length * 0.7320508075688772) % 1.0
                pick = int(np.searchsorted(mass[:fitting], share * mass[fitting - 1], "right"))
                parts.append(int(present[min(pick, fitting - 1)]))
                space -= parts[-1]
            if space == 0:
                found.add(tuple(sorted(parts)))
    return sorted(found)


def repeat_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, where A has how often each pattern uses each length.

    Accelerated projected gradient; A is kept as its non-zero entries.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    size = len(counts)

    def up(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[column], size)

    def down(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, r[row], len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(30):
        probe = down(up(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - down(up(y) - counts) / (norm * 1.01))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_windows(histogram: dict[int, int], window: int = WINDOW, depth: int = DEPTH, tries: int = TRIES, rounds: int = ROUNDS) -> Plan:
    """Where the pieces of each length go. The work depends on the window, not on the number of pieces.

    Least squares over exactly filling combinations gives repeat counts, which
    are rounded down to what is there; the pieces left are packed greedily, the
    largest that fits first, whole runs of equal sequences at a time.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(window + 1, np.int64)
    runs: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], repeats: int) -> None:
        runs.append((pattern, repeats))
        for length in pattern:
            left[length] -= repeats

    if left[window]:
        take((window,), int(left[window]))
    for _ in range(3):
        patterns = combinations(left, window, depth, tries)
        if not patterns:
            break
        x = np.floor(repeat_counts(patterns, left.astype(float), rounds) + 0.5).astype(np.int64)
        for p in np.argsort(-x, kind="stable").tolist():
            if x[p] <= 0:
                break
            need = np.bincount(patterns[p], minlength=1)
            lengths = np.flatnonzero(need)
            repeats = min(int(x[p]), int((left[lengths] // need[lengths]).min()))
            if repeats > 0:
                take(patterns[p], repeats)
    present = np.flatnonzero(left).tolist()
    while present:
        pattern, need, space, at = [], {}, window, len(present)
        while space > 0:
            at = min(at, bisect_right(present, space)) - 1
            if at < 0:
                break
            length = present[at]
            fits = min(space // length, int(left[length]))
            pattern += [length] * fits
            need[length] = fits
            space -= fits * length
        repeats = min(int(left[length]) // fits for length, fits in need.items())
        take(tuple(pattern), repeats)
        present = [length for length in present if left[length]]

    rows, sequence = [], 0
    for pattern, repeats in runs:
        offset = 0
        for length in pattern:
            rows.append((length, int(used[length]), sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence)


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``rank``: the number of each piece among those of its length, from 0.

    Numbers are given inside salts, and the counts of a length's earlier salts
    are added, so that a length which a third of all pieces have is not one task.
    """
    salts = salts_for(pieces)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "salt").orderBy(*order)
    joined = salted.withColumn("place", F.row_number().over(inside)).join(offsets, ["length", "salt"])
    return joined.withColumn("rank", F.col("earlier") + F.col("place") - 1).drop("salt", "earlier", "place")


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """sequence_id and offset of each numbered piece, from the plan that every task gets."""
    keys = (plan.length << 40) | plan.first
    first, sequence, offset = plan.first, plan.sequence, plan.offset
    at = pieces.columns.index("length"), pieces.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            slot = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            columns = [pa.array(sequence[slot] + rank - first[slot]), pa.array(offset[slot])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "sequence_id", "offset"])

    new = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    schema = StructType([*pieces.schema.fields, *new])
    return pieces.mapInArrow(run, schema).drop("rank")


def pack(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """The pieces of ``cut_documents``, each with its sequence_id and offset.

    Sequences are numbered from 0, hold at most ``window`` tokens and are
    gapless. The pieces are written once to the shared folder; the driver sees
    the histogram of their lengths, at most ``window`` rows, and makes the plan.
    Repeated rows are packed each, an empty table gives no rows.
    """
    with small_batches(df.sparkSession):
        pieces = settled(cut_documents(df, path, key, text, window, end_id, with_ids), "packing")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    return placed(numbered(pieces, [key, "start", "ids_crc32"]), plan_windows(histogram, window))
