"""Encoding, token counts and packing against the tokenizers library and plain programs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_texts import texts_of
from tokenizers import Tokenizer

from engram.llm import bpe, packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"aaab  \n\t\r\x0b\x1c\x85\xa0'streÉΣσ日１!?.-_#", "　", "​", "̊", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE"]


def random_texts(n=800):
    pick = random.Random(5)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 60))) for _ in range(n)] + ["a" * 3000, "ab" * 999, ""]


@pytest.mark.parametrize("known", [50, 10_000])
def test_encoder_equals_the_library(known):
    library, own = Tokenizer.from_file(WORDS), bpe.WordEncoder(WORDS, known)
    texts = random_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [ids for at in range(0, len(texts), 100) for ids in own.lists(texts[at : at + 100])]
    assert got == want
    assert [own.decode(i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_merges_leftmost_of_the_lowest_rank():
    merges = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert bpe.merged([1, 1, 1], merges) == [3]
    assert bpe.merged([1, 1, 1, 1], merges) == [4]
    assert bpe.merged([5], merges) == [5]
    assert bpe.merged([], merges) == []


def test_words_merged_side_by_side_equal_words_merged_alone():
    """One tree per word in one array gives what a tree per word gives, in one step per merge of the longest word."""
    merges = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4), (3, 1): (3, 5), (6, 1): (4, 7), (4, 4): (5, 8)}
    pick = random.Random(11)
    words = [[pick.choice([1, 1, 1, 6]) for _ in range(n)] for n in range(1, 65) for _ in range(9)]
    flat, lengths = np.array([s for w in words for s in w]), np.array([len(w) for w in words])
    got = bpe.merged_together(flat, lengths, bpe.PairRanks(merges))
    assert got == [tuple(bpe.merged(list(w), merges)) for w in words]


@pytest.mark.parametrize("known", [50, 10_000])
def test_counter_equals_the_library(known):
    library, own = Tokenizer.from_file(BYTES), token_counts.TokenCounter(BYTES, known)
    texts = random_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [n for at in range(0, len(texts), 100) for n in own.counts(texts[at : at + 100])] == want


def test_encoding_of_odd_rows(odd, empty):
    library = Tokenizer.from_file(WORDS)
    want = sorted((str(k), library.encode(t or "", add_special_tokens=False).ids) for k, t in texts_of(odd))
    got = bpe.encode_and_decode(odd, WORDS).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert bpe.encode_and_decode(empty, WORDS).collect() == []


def test_counts_of_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTES)
    want = sorted((str(k), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in texts_of(odd))
    got = token_counts.count_tokens(odd, BYTES).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(empty, BYTES).collect() == []


def test_pieces_lie_gapless_in_sequences(odd, empty):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(odd, WORDS, with_ids=True).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert max(at.values()) <= 4096 and sorted(at) == list(range(len(at)))
    for k, t in texts_of(odd):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = [r for r in rows if r["doc_id"] == k]
        assert all(r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]] for r in own)
        assert sum(r["length"] for r in own) == len(ids) * [x for x, _ in texts_of(odd)].count(k)
    assert packing.pack(empty, WORDS).collect() == []


@pytest.mark.parametrize("n", [0, 1, 30, 2000, 60_000])
def test_plan_holds_every_piece_once(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(6, 1, n).astype(int), 1, 4096)
    lengths[: n // 3] = 300
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan_windows(histogram)
    for length, count in histogram.items():
        own = plan.length == length
        assert plan.first[own][0] == 0 and (np.diff(plan.first[own]) > 0).all() and plan.first[own][-1] < count
    if n >= 2000:
        assert lengths.sum() / (plan.sequences * 4096) > 0.99


MARKED = ["İ\u0316b", "(the,", "THE!", "it's", "'s", "('s", "x='s", "a,'ll,b", "é.", "É\u0301,", "5%", "a\u0301*", "*\u0338a", "<|ENDOFTEXT|>", "|>", "_a_", "日,", "’s,"]


@pytest.mark.parametrize("known", [50, 10_000])
def test_packed_ids_equal_the_library(known):
    """Also where marks stand next to letters, apostrophes or signs that combine, in any slice and with special strings or without."""
    library, own, pick = Tokenizer.from_file(WORDS), packing.LibraryEncoder(WORDS, 2, known), random.Random(7)
    pool = [*ALPHABET, *MARKED, *MARKED]
    plain = [c for c in pool if "<|" not in c]
    texts = ["".join(pick.choice(plain if i % 3 else pool) for _ in range(pick.randint(0, 60))) for i in range(900)] + [" ".join(MARKED), ""]
    for at in range(0, len(texts), 50):
        for some in (texts[at : at + 50], [t for t in texts[at : at + 50] if "<|" not in t]):
            ids, ends = own.rows(pa.array(some))
            got = [x.tolist() for x in np.split(ids, ends[:-1])]
            assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]


def test_words_with_marks_or_capitals_are_encoded_once():
    """What is handed to the library does not grow with the marks around a word and the capitals in it."""
    own, given = packing.LibraryEncoder(WORDS, 2), []
    encode = own.library.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given.extend(p for t in texts for p in t.split(" "))
            return encode(texts, **how)

    own.library = Counted()
    for text in ("word", "Word, (word) WORD! «word» word", 'the "Word".'):
        own.rows(pa.array([text]))
    assert sorted(given) == sorted(["word", ",", "(", ")", "!", "«", "word", "»", "the", '"', '".'])


def test_the_library_gets_few_pieces_at_a_time():
    """What a slice of new words takes does not grow with their number: the library's result is read block by block."""
    own, given = packing.LibraryEncoder(WORDS, 2), []
    encode = own.library.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given.append(sum(t.count(" ") + 1 for t in texts))
            return encode(texts, **how)

    own.library = Counted()
    letters = "abcdefghij"
    texts = [" ".join("w" + "".join(letters[int(c)] for c in str(i)) for i in range(at, at + 500)) for at in range(0, 20_000, 500)]
    ids, ends = own.rows(pa.array(texts))
    assert max(given) <= packing.JOINED and sum(given) == 20_000 and len(own.units.place) >= 20_000
    library = Tokenizer.from_file(WORDS)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_slices_hold_few_bytes():
    """A slice is bounded in bytes well below an Arrow batch, and every row is in one slice."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["word " * 1000] * 3000)], names=["doc_id", "text"])
    parts = list(packing.slices(batch, 1))
    assert max(p.column(1).nbytes for p in parts) <= 5 << 20
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(3000))
