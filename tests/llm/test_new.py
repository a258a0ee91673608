"""Token alignment, line dedup and whitening against plain programs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_texts import texts_of
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from engram.llm import alignment, line_dedup, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_links(text, a, b, byte):
    """Tokens of both, their byte ranges, groups as a string and all overlapping pairs."""
    whole = b" " + text.encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return None
    links, groups, i, j, end_a, end_b = [], [([], [])], 0, 0, len(parts_a[0]), len(parts_b[0])
    groups[0][0].append(ids_a[0])
    groups[0][1].append(ids_b[0])
    while True:
        links.append((ids_a[i], ids_b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            if i + 1 == len(ids_a):
                break
            groups.append(([], []))
        if step_a:
            i += 1
            end_a += len(parts_a[i])
            groups[-1][0].append(ids_a[i])
        if step_b:
            j += 1
            end_b += len(parts_b[j])
            groups[-1][1].append(ids_b[j])
    return ids_a, ids_b, links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), len(groups)


def plain_alignment(rows):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(alignment.byte_characters())}
    found = [(k, plain_links(t or "", a, b, byte)) for k, t in rows]
    counts = Counter(p for _, f in found if f for p in f[2])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for k, f in found:
        if f is None:
            out.append((str(k), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(counts[p] == best[p[1]] for p in f[2])
        digest = hashlib.sha256(f[3].encode()).hexdigest()
        out.append((str(k), len(f[0]), len(f[1]), f[4], len(f[2]), n_best, sum(counts[p] for p in f[2]), digest))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 3, 1 << 17])
def test_alignment_equals_a_plain_program(spark, odd, empty, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "HOT_TEXTS", min(hot, 1024))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (odd, documents):
        got = sorted((str(r["doc_id"]), *(r[m] for m in MEASURES)) for r in alignment.align_tokens(table, A, B).collect())
        assert got == plain_alignment(texts_of(table))
        assert any(r[1] for r in got)
    assert alignment.align_tokens(empty, A, B).collect() == []


def test_alignment_of_special_strings_and_bytes():
    texts = ["<s> <|endoftext|> </s>", "日本 🙂 naïve", "a\x00b", "x", "ab" * 3000, "▁ low", "two  blanks"]
    rows = list(enumerate(texts))
    found = alignment.Aligner(A, B).align(texts)
    want = plain_alignment(rows)
    got = [(str(k), *(found[m][k] for m in MEASURES[:4]), found["groups_sha256"][k]) for k, _ in rows]
    assert got == [(*w[:5], w[7]) for w in want]


def plain_dedup(rows):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    owners = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(space).translate(low)
            if len(key) >= 10:
                place = (k is None, k)
                owners[key] = min(owners.get(key, place), place, key=lambda p: (p[0], p[1] or 0))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owners.get(x.strip(space).translate(low), (k is None, k)) == (k is None, k)]
        out.append((str(k), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


LINES = [
    (5, "A shared line of text\nown line number five\n\n"),
    (2, "  a SHARED line of text \r\nshort\nshort\na shared line of text"),
    (9, "short\nA Shared Line Of Text\x0b\n\nÄ SHARED LINE"),
    (9, "twin rows of nine\nown line number five"),
    (9, "twin rows of nine\nown line number five"),
    (7, "ä shared line"),
    (None, "a shared line of text\nonly without an id"),
    (None, "only without an id\nlast"),
    (None, None),
    (11, None),
    (12, ""),
    (13, "\n\n\n"),
    (14, "own line number five\n" * 500),
    (15, "all of it is gone\n"),
    (3, "all of it is gone"),
]


@pytest.mark.parametrize("batches", [1, 5])
def test_dedup_equals_a_plain_program(spark, odd, empty, batches):
    clash = spark.createDataFrame(LINES, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS pos", "2 AS h1", "0 AS owner", "1 AS n")
    for table in (clash, odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted((str(r["doc_id"]), *r[1:]) for r in line_dedup.dedup_lines(table, batches=batches).collect())
        assert got == plain_dedup(texts_of(table))
    assert line_dedup.dedup_lines(empty, batches=batches).collect() == []


def test_hot_lines_and_runs(spark, monkeypatch):
    """A line of every document is settled by broadcast; runs of equal level are merged and joined without exchange or sort."""
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 4)
    rows = [(k, f"the line of all documents\nthe line of group {k % 7}\nthe line of {k} alone") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), *r[1:]) for r in line_dedup.dedup_lines(table, batches=6).collect())
    assert got == plain_dedup(rows)

    runs = line_dedup.LineRuns(spark)
    with line_dedup.sorted_scans(spark):
        for k in range(5):
            part = spark.range(k * 50, k * 50 + 100).selectExpr("id AS h1", "-id AS h2", "id AS owner", "1L AS n")
            own = spark.table(runs.add(runs.write(part)))
            assert own.count() == (100 if k == 0 else 50)
        assert [level is not None for level in runs.levels] == [True, False, True]
        assert sum(r.count() for r in runs.runs()) == 300
        last = runs.runs()[-1].select("h1", "h2")
        plan = last.join(runs.runs()[0].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text and "Sort [" not in text
    runs.close()


def plain_whitening(rows, dimensions, components=8):
    kept = [(k, v) for k, v in rows if v is not None and len(v) == dimensions and None not in v and np.isfinite(v).all()]
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(float) if n else x
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return [k for k, _ in kept], n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_whitening_equals_a_plain_program(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    bad = [(None, rows[0][1]), (7, rows[7][1]), (-1, None), (-2, [float("nan")] * 64), (-3, [1.0]), (-4, []), (-5, [None] + [0.5] * 63)]
    bad += [(-6, [float("inf")] + [0.5] * 63), (-7, [1e38] + [0.5] * 63)]
    odd = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    rows += bad[:-1]
    ids, n, deviation, white, explained = plain_whitening(rows, 64)
    both = table.select("vec_id", "embedding").unionByName(odd).selectExpr("*", "0 AS n", "1 AS component", "'x' AS i")
    got = whitening.whiten(both).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    signs = {}
    by_key = defaultdict(list)
    for r in got:
        by_key[r["vec_id"]].append(r)
    for at, key in enumerate(ids):
        for r in by_key[key]:
            c = r["component"] - 1
            assert r["deviation"] == deviation[at] and abs(r["explained"] / explained[c] - 1) < 1e-9
            if abs(white[at, c]) > 1e-3:
                sign = signs.setdefault(c, np.sign(white[at, c] * r["whitened"]))
                assert abs(r["whitened"] - sign * white[at, c]) < 1e-7


def test_whitening_of_few_rows(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert of([]) == [] and of([(1, [1.0, 2.0])]) == [] and of([(1, None), (2, [])]) == []
    two = of([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])])
    assert [(r["component"], abs(r["whitened"]), r["explained"]) for r in two] == [(1, 1.0, 1.0)] * 2


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_spectrum_by_counts(size):
    draw = np.random.default_rng(size)
    q = np.linalg.qr(draw.standard_normal((size, size)))[0]
    for values in (np.arange(1.0, size + 1), np.ones(size), np.r_[np.full(size // 2, 3.0), np.linspace(0, 1, size - size // 2)],
                   1 + 1e-9 * np.arange(size), draw.standard_normal(size)):
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        for shift in (-0.5, 0.3, 1.5, 2.5):
            assert whitening.count_below(matrix, shift) == int((values < shift).sum())
        found, vectors = whitening.leading(matrix, 8)
        want = np.sort(values)[::-1]
        want = want[want > 1e-12 * want.sum()][:8] if want.sum() > 0 else want[want > 1e-12 * want.sum()][:8]
        assert len(found) == len(want) and np.abs(found - want).max(initial=0) < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) < 1e-6
        assert np.abs(matrix @ vectors - vectors * found).max(initial=0) < 1e-12 * size
    # Zeros on the diagonal need pivots of two rows.
    assert whitening.count_below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
