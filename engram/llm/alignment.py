"""Cross-tokenizer alignment: each distinct text is tokenised and aligned once, pairs are counted with its multiplicity."""

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import settled
from engram.llm.vocab import BYTE_PATTERN, byte_characters, read_vocabulary

ROWS = 256
CHARACTERS = 1_000_000
# A text of more than one in so many rows, or a pair of more than one in so many links' rows, is hot: there are fewer than this.
HOT_TEXTS = 1024
HOT_PAIRS = 1 << 17
# Characters beyond the Latin blocks, whose classes have not changed since the first editions.
LATE = re.compile("[^\x00-\u024f]")
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """Byte-level BPE (A) against pieces with byte fallback (B), whose model puts a blank before the text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.tokens_a()
        self.bytes_b = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a = np.array([len(t) for t in self.bytes_a])
        self.lengths_b = np.array([len(t) for t in self.bytes_b])
        self.size_b = len(self.bytes_b)
        self.ranked = self.ranks_of_a(path_a)
        # Ids as they stand in the digest's string, with what follows them.
        self.within_a, self.last_a = self.written(len(self.bytes_a), ",|")
        self.within_b, self.last_b = self.written(self.size_b, ",;")

    @staticmethod
    def written(n: int, ends: str) -> list[np.ndarray]:
        return [np.array([f"{i}{end}" for i in range(n)], object) for end in ends]

    def tokens_a(self) -> list[bytes]:
        byte = {c: b for b, c in enumerate(byte_characters())}
        ids = self.a.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(ids.values(), default=-1) + 1)
        for token, i in ids.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return tokens

    def ranks_of_a(self, path: str):
        """The same vocabulary for tiktoken, which is several times as fast; None where its merges are not in the order of ids."""
        import tiktoken

        vocabulary = read_vocabulary(path)
        by_rank = [i for _, i in sorted(vocabulary.merges.values())]
        if by_rank != sorted(by_rank) or len(set(self.bytes_a)) < len(self.bytes_a) or vocabulary.normalizers or vocabulary.suffix:
            return None
        ranks = {t: i for i, t in enumerate(self.bytes_a)}
        return tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encoded_a(self, texts: list[str]) -> list[list[int]]:
        """The ids of A. Where classes of characters may differ with a library's edition of Unicode, the file's own library decides."""
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        late = [k for k, t in enumerate(texts) if LATE.search(t)]
        own = dict(zip(late, self.a.encode_batch_fast([texts[k] for k in late], add_special_tokens=False), strict=True))
        return [own[k].ids if k in own else self.ranked.encode_ordinary(t) for k, t in enumerate(texts)]

    def piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokenised(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of A and B for each text; None where either's bytes are not a blank and the text."""
        out: list[tuple[list[int], list[int]] | None] = [None] * len(texts)
        whole = [b" " + t.encode() for t in texts]
        coded_b = self.b.encode(texts, num_threads=1)
        fits = [k for k, ids in enumerate(coded_b) if texts[k] and b"".join([self.bytes_b[i] for i in ids]) == whole[k]]
        coded_a = self.encoded_a([" " + texts[k] for k in fits])
        for k, ids in zip(fits, coded_a, strict=True):
            if b"".join([self.bytes_a[i] for i in ids]) == whole[k]:
                out[k] = ids, coded_b[k]
        return out

    def align(self, texts: list[str]) -> dict[str, list]:
        """Measures, digest and distinct id pairs (a * size of B + b) with their numbers of links, of each text.

        Texts stand one after the other in one row of bytes; both tokenizers
        end a token at each text's end. Every stretch between two neighbouring
        ends of either is one link, so all links come from one sort of ends.
        """
        coded = self.tokenised(texts)
        kept = [k for k, c in enumerate(coded) if c is not None]
        out = {name: [0] * len(texts) for name in MEASURES} | {"groups_sha256": [""] * len(texts), "links": [[]] * len(texts)}
        if not kept:
            return out
        a, b = (np.concatenate([np.array(coded[k][side], np.int64) for k in kept]) for side in (0, 1))
        n_a, n_b = (np.array([len(coded[k][side]) for k in kept]) for side in (0, 1))
        end_a, end_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        text_end = end_a[np.cumsum(n_a) - 1]
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        again = np.r_[False, ends[1:] == ends[:-1]]
        cuts, shared = ends[~again], ends[again]

        pair = a[np.searchsorted(end_a, cuts)] * self.size_b + b[np.searchsorted(end_b, cuts)]
        owner = np.searchsorted(text_end, cuts)
        space = len(self.bytes_a) * self.size_b
        distinct, counts = np.unique(owner * space + pair, return_counts=True)
        of_text = np.searchsorted(distinct, np.arange(len(kept) + 1) * space)
        distinct %= space
        n_links = np.bincount(owner, minlength=len(kept))
        n_groups = np.bincount(np.searchsorted(text_end, shared), minlength=len(kept))

        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        spelt = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        spelt[at_a] = np.where(shared[group_a] == end_a, self.last_a[a], self.within_a[a])
        spelt[at_b] = np.where(shared[group_b] == end_b, self.last_b[b], self.within_b[b])
        stops = np.cumsum(n_a + n_b)
        for i, k in enumerate(kept):
            out["n_a"][k], out["n_b"][k] = int(n_a[i]), int(n_b[i])
            out["n_groups"][k], out["n_links"][k] = int(n_groups[i]), int(n_links[i])
            string = "".join(spelt[stops[i] - n_a[i] - n_b[i] : stops[i]].tolist())[:-1]
            out["groups_sha256"][k] = sha256(string.encode()).hexdigest()
            out["links"][k] = distinct[of_text[i] : of_text[i + 1]], counts[of_text[i] : of_text[i + 1]]
        return out


PAIR = pa.struct([("pair", pa.int64()), ("links", pa.int64())])


def pair_lists(lists: list) -> pa.Array:
    """Lists of (pair, links) from each row's two arrays."""
    rows = [(x[0], x[1]) if len(x) else (np.zeros(0, np.int64),) * 2 for x in lists]
    offsets = np.cumsum([0, *(len(p) for p, _ in rows)])
    flat = [np.concatenate([r[side] for r in rows]) if rows else np.zeros(0, np.int64) for side in (0, 1)]
    values = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in flat], fields=list(PAIR))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and characters; one longer text is a part of its own."""
    sizes = [len(t or "") for t in batch.column(column).to_pylist()]
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= ROWS or held + size > CHARACTERS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def aligned_texts(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Each distinct text once: digest, times, the measures of its alignment and its pairs.

    Rows are folded per task before texts are shuffled, so copies do not meet
    in one task. Null and empty texts are not among them.
    """
    shape = "digest binary, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    shape += "links array<struct<pair:long,links:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, 2):
                found = aligner.align(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), *(pa.array(found[m], pa.int64()) for m in MEASURES)]
                columns += [pa.array(found["groups_sha256"]), pair_lists(found["links"])]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "times", *MEASURES, "groups_sha256", "links"])

    once = df.select(F.col(text).alias("body")).where("body != ''").groupBy("body").agg(F.count("*").alias("times"))
    return once.select(F.unhex(F.md5(F.col("body").cast("binary"))).alias("digest"), "times", "body").mapInArrow(run, shape)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, total (links in the corpus), texts (rows of ``aligned`` that have it), best (its B id has no higher total).

    The totals' maxima are one row for each id of B: their broadcast is bounded by the vocabulary.
    """
    each = aligned.select("times", F.inline("links"))
    totals = each.groupBy("pair").agg(F.sum(F.col("links") * F.col("times")).alias("total"), F.count("*").alias("texts"))
    totals = settled(totals.withColumn("b", F.col("pair") % size_b), "pair-totals")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), "b").select("pair", "total", "texts", (F.col("total") == F.col("most")).alias("best"))


def weighed(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of each distinct text, by digest.

    Pairs of many texts are looked up in a broadcast table of fewer than
    HOT_PAIRS rows, where the links lie; all others, each in few texts, are
    joined by pair and summed.
    """
    spark = aligned.sparkSession
    rows = counts.agg(F.sum("texts")).first()[0] or 0
    hot = counts.where(F.col("texts") * HOT_PAIRS > rows).select("pair", "total", "best").orderBy("pair").toArrow()
    arrays = [hot.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
    table = spark.sparkContext.broadcast((arrays[0].astype(np.int64), arrays[1].astype(np.int64), arrays[2].astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, totals, best = table.value
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            pair, links = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row[known], links[known] * best[at[known]])
            np.add.at(count_sum, row[known], links[known] * totals[at[known]])
            stops = np.cumsum([0, *np.bincount(row[~known], minlength=batch.num_rows)])
            others = pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(links[~known])], fields=list(PAIR))
            columns = [batch.column(0), pa.array(n_best), pa.array(count_sum)]
            columns.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), others))
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_best", "count_sum", "others"])

    shape = "digest binary, n_best long, count_sum long, others array<struct<pair:long,links:long>>"
    looked_up = settled(aligned.select("digest", "links").mapInArrow(run, shape), "pairs-looked-up")
    met = looked_up.select("digest", F.inline("others")).join(counts.select("pair", "total", "best"), "pair")
    rest = met.groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("total")).alias("count_sum"),
    )
    both = looked_up.select("digest", "n_best", "count_sum").unionByName(rest)
    return both.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokens(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A's text is a blank and the text, B's model adds the blank itself. Texts
    that are null, empty or not given back byte for byte by both have zeros
    and an empty string. Repeated rows count and come out as often, a null key
    stays null, other columns are not looked at, an empty table gives no rows.

    Texts are shuffled whole once; ids meet the measures by a 128-bit digest
    of the text. Measures of texts that many rows share (fewer than HOT_TEXTS)
    are broadcast, so that no task gets all their ids.
    """
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = settled(aligned_texts(df, path_a, path_b, text), "aligned-texts")
    counts = settled(pair_counts(aligned, size_b), "pair-counts")
    measures = aligned.drop("links").join(weighed(aligned, counts), "digest")
    measures = settled(measures.select("digest", "times", *MEASURES, "n_best", "count_sum", "groups_sha256"), "text-measures")

    body = F.when(F.col(text) != "", F.col(text))
    ids = settled(df.select(F.col(key), F.unhex(F.md5(body.cast("binary"))).alias("digest")), "text-ids")
    rows = measures.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(measures.where(F.col("times") * HOT_TEXTS > rows))
    columns = [F.col(c) for c in (*MEASURES, "n_best", "count_sum", "groups_sha256")]
    without = ids.where("digest IS NULL").select(
        key, *(F.lit(0).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")), F.lit("").alias("groups_sha256")
    )
    some = ids.where("digest IS NOT NULL")
    shared = some.join(hot, "digest").select(key, *columns)
    single = some.join(hot.select("digest"), "digest", "left_anti").join(measures, "digest").select(key, *columns)
    return without.unionByName(shared).unionByName(single)
