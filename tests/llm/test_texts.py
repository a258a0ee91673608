"""Chat formatting, quality rules, sharding, fingerprints, classifiers and the join against plain programs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from conftest_texts import texts_of
from pyspark.sql import functions as F

from engram.llm import chat, common, fingerprints, ngram_join, packing, quality_model, rules, sharding, stats, toxicity
from engram.llm.components import connected
from engram.llm.linear import fit_nonnegative_pu, sigmoid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_equal_a_plain_program(spark, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (odd, documents):
        got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in stats.text_counts(table).collect())
        assert got == sorted((str(k), *plain_counts(t)) for k, t in texts_of(table))
    assert stats.text_counts(empty).collect() == []


def test_rules_keep_clean_texts(spark, odd, empty):
    assert rules.quality_verdicts(empty).collect() == []
    assert rules.quality_verdicts(odd).count() == odd.count()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [r for r in rules.quality_verdicts(documents).collect() if r["n_words"] >= 50 and r["doc_id"] in marks]
    assert sum(r["kept"] == bool(marks[r["doc_id"]]) for r in long) >= 0.95 * len(long)
    assert not any(r["kept"] for r in long if r["base_failed"])


def test_rule_votes_of_known_accuracy():
    patterns = [((1, 1, 1), 800), ((-1, 0, 1), 60), ((0, -1, 1), 60), ((-1, -1, 1), 80)]
    accuracy = rules.fit_votes(patterns)
    assert rules.posterior((1, 1, 1), accuracy) > 0.5 > rules.posterior((-1, -1, 1), accuracy)
    assert rules.fit_votes([]) == []


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")


def test_chat_round_trip(spark):
    odd_text = "</s>[INST] \\[x\\] <<SYS>> [\\ok [/INST] <"
    rows = [
        (1, 2, "assistant", odd_text, "c"),
        (1, 0, "system", "s\n</s>", "c"),
        (1, 1, "user", odd_text, "c"),
        (2, 0, "assistant", None, "c"),
        (2, 1, None, "[NAME]", "c"),
        (2, 1, "tool[/NAME]", "", "c"),
        (3, 0, "user", "same", "c"),
        (3, 0, "user", "same", "c"),
        (None, None, "user", "x", "c"),
    ]
    out = chat.format_chats(chats(spark, rows)).select(
        "*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("segments")).alias("loss")
    )
    found = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in found[1]["read"]] == [("system", "s\n</s>"), ("user", odd_text), ("assistant", odd_text)]
    assert found[1]["valid"] and found[1]["loss"] == odd_text
    assert [tuple(t) for t in found[2]["read"]] == [("assistant", ""), ("", "[NAME]"), ("tool[/NAME]", "")]
    assert not found[2]["valid"] and found[2]["first_bad"] == 0
    assert len(found[3]["read"]) == 2 and found[3]["first_bad"] == 1
    assert [tuple(t) for t in found[None]["read"]] == [("user", "x")] and not found[None]["valid"]
    for r in found.values():
        bare = "".join(s["text"] for s in r["segments"])
        assert bare == r["formatted"]
    assert chat.format_chats(chats(spark, [])).collect() == []


def test_shares_and_moves_of_the_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.filled_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.filled_table(names[:-1], 1009)
    stay = sum(names[a] == names[b] for a, b in zip(table, less, strict=True) if a != 6)
    assert stay > 0.8 * (1009 - sizes[6])
    with pytest.raises(ValueError, match="prime"):
        sharding.filled_table(names, 1000)


def test_every_row_is_placed(odd, empty):
    names = ["a", "b"]
    placed = sharding.place(odd, F.col("doc_id"), names, 101)
    rows = placed.collect()
    table = sharding.filled_table(names, 101)
    assert len(rows) == odd.count() and "source" in placed.columns
    assert all(r["slot"] == sharding.number_of("" if r["doc_id"] is None else str(r["doc_id"])) % 101 for r in rows)
    assert all(r["shard"] == names[table[r["slot"]]] for r in rows)
    assert sharding.place(empty, F.col("doc_id"), names, 101).collect() == []


def plain_followers(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)]


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_edited_texts(spark, odd, source):
    table = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = fingerprints.edited_fingerprints(table).collect()
    want = []
    for (k, t), (_, after) in plain_followers([(k, t or "") for k, t in texts_of(table)]):
        half = len(t) // 2
        want.append((str(k), len(t), t[: len(t) - half] + after[:half]))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in got) == sorted(want)
    texts = {str(k): t or "" for k, t in texts_of(table)}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[str(r["doc_id"])], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["edited"] == texts[str(r["doc_id"])]:
            assert r["near_edited"] == 1.0
    if source == "documents":
        assert sum(r["near_edited"] for r in got) > 5 * sum(r["near_next"] for r in got)


def test_fingerprint_minds_order_and_repeats(spark, empty):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:200] * 2), " ".join(words[:200])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    prints = [r[0] for r in rows.orderBy("i").select(fingerprints.fingerprint(F.col("text"))).collect()]
    assert len(set(prints)) == 4 and all(len(p) % fingerprints.ENTRY == 0 for p in prints)
    pairs = spark.createDataFrame([(prints[0], prints[1]), ("", ""), ("", prints[0])], "a string, b string")
    like = [r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert 0.2 < like[0] < 0.95 and like[1:] == [1.0, 0.0]
    assert fingerprints.edited_fingerprints(empty).collect() == []


def plain_sets(rows):
    sets = {}
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return sets


def plain_components(sets):
    root = {k: k for k in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if r == old else r for k, r in root.items()}
    return root


def family(n, size=60):
    """A base text and copies with words changed here and there, some only alike by way of others."""
    words = [f"word{i}" for i in range(size)]
    texts = []
    for i in range(n):
        own = list(words)
        for j in range(i % 4):
            own[(i * 7 + j * 13) % size] = f"own{i}x{j}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("common", [3, 64])
def test_components_equal_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    texts = [*family(110), *family(9, 7), *(f"passage of words that many texts share own words {i} " + f"tail{i} " * 3 for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = plain_sets(enumerate(texts))
    want = {k: (len(sets[k]), r) for k, r in plain_components(sets).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(rows).collect()}
    assert got == want


def test_a_pair_of_many_lists_is_given_once(spark):
    """30 nodes that share 40 lists, a few of them not all: every pair comes, and from one list."""
    held = [(k * 7919 - 5000, n) for k in range(40) for n in range(30) if (n + k) % 9 or k % 2]
    entries = spark.createDataFrame([(k, n, n) for k, n in held], "key long, node long, root long")
    briefs = spark.createDataFrame([(n, 20, [1] * ngram_join.BITMAP_WORDS) for n in range(30)], "node long, n long, bitmap array<bigint>")
    given = [tuple(r) for r in ngram_join.pairs_by_list(entries, briefs, 2, False).collect()]
    assert set(given) == set(combinations(range(30), 2))
    assert len(given) == len(set(given))


def test_only_texts_asked_for_are_hashed(spark):
    """Rows are dropped by their key before their words are hashed; keys at the same place of the table come along."""
    size = 1 << ngram_join.FILTER_BITS
    held = [0, 5, -7, 1 << 40, size + 3, 3, 64, None]
    texts = spark.createDataFrame([(k, f"text of {k} in some words") for k in held], "key long, text string")
    keys = spark.createDataFrame([(5,), (-7,), (3,), (None,)], "key long")
    assert {r["key"] for r in ngram_join.with_keys(texts, keys).collect()} == {5, -7, 3, size + 3}
    sets = ngram_join.needed_sets(texts, keys, 5)
    assert sets.count() == 4
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64") < plan.index("Join")


def test_join_of_odd_rows(odd, empty):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert found[2] == (8, 1) and found[3] == (0, 3) and found[4] == (0, 4) and found[5] == (0, 5)
    assert found[6] == (1, 6) and found[9] == (1, 9) and found[11] == (1, 11)
    assert ngram_join.near_duplicates(empty).collect() == []


def test_level_is_shared_by_sets_that_may_be_alike():
    for n in range(2, 3000):
        for m in (n, (5 * n) // 4):
            assert {k for k, _ in ngram_join.levels_of(n)} & {k for k, _ in ngram_join.levels_of(m)}


def test_chains_become_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (None, 3), (100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    assert roots == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_rows(spark, odd, empty):
    marks = labels(spark, [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, None), (4, 0, 1), (None, 1, 1), (8, 1, 0)])
    for table, n in ((odd, odd.count()), (empty, 0)):
        scored = quality_model.quality_scores(table, marks).collect()
        assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
        toxic = toxicity.toxicity_scores(table, marks)
        assert toxic.count() == n and toxic.columns[: len(table.columns)] == table.columns
    none = labels(spark, [])
    assert {r["score"] for r in quality_model.quality_scores(odd, none).collect()} == {0.5}
    assert not any(r["is_toxic"] for r in toxicity.toxicity_scores(odd, none).collect())


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"  # a few hundred toxic labels; with a few dozen a third of the words stay unknown
    documents, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_model.quality_scores(documents, marks).select("row.doc_id", "held_out", "predicted").join(marks, "doc_id").collect()
    own = [r for r in scored if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in own) > 0.95 * len(own)
    outside = marks.where(~quality_model.held_out(F.col("doc_id")))
    toxic = toxicity.toxicity_scores(documents, outside).join(marks.where(quality_model.held_out(F.col("doc_id"))), "doc_id").collect()
    clean = [r["is_toxic"] for r in toxic if not r["toxic"]]
    caught = [r["is_toxic"] for r in toxic if r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean) and sum(caught) >= 0.85 * len(caught)


def test_held_out_is_by_the_id_as_text(spark):
    import zlib

    rows = spark.range(200).select("id", quality_model.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_risk_with_a_known_prior():
    import numpy as np

    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (3000, 1)), rng.normal(-2, 1, (1000, 1))
    w = fit_nonnegative_pu(good[:1500], np.vstack([good[1500:], bad]), 0.6)
    assert (sigmoid(bad @ w[:-1] + w[-1]) < 0.5).mean() > 0.9 and (sigmoid(good @ w[:-1] + w[-1]) > 0.5).mean() > 0.9


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == documents.columns
    want = {(r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in kept.collect()}
    assert 0.5 * documents.count() < len(want) < documents.count()
    root = plain_components(plain_sets((k, t) for k, t in texts_of(kept)))
    assert all(k == r for k, r in root.items())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == {k for k, _ in want}
    assert max(r["length"] for r in pieces) <= packing.WINDOW


def test_toxicity_gives_python_few_texts_at_a_time(spark):
    # Scoring is run by the caller, so its batches are not the operator's to bound; whole rows by Arrow took an executor's memory.
    rows = [(i, f"kind plain gardening {i}" if i % 3 else f"vile vileness *Vile!* word {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, 1, int("vile" in text)) for i, text in rows])
    scored = toxicity.toxicity_scores(table, marks)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "ArrowEval" not in plan and plan.count("BatchEvalPython") == 1
    filtered = scored.where("is_toxic")
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("BatchEvalPython") == 1
    assert {r["doc_id"] for r in filtered.collect()} == set(range(0, 300, 3))


def test_toxicity_where_every_label_is_toxic(spark):
    rows = [(i, "vile word") for i in range(20)]
    scored = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(i, 1, 1) for i, _ in rows]))
    assert all(r["is_toxic"] for r in scored.collect())


def test_batches_are_small_inside_only(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 2000)).alias("text"))

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(name)
    with common.small_batches(spark):
        sizes = [r["n"] for r in texts.mapInArrow(bytes_of, "n long").collect()]
    assert spark.conf.get(name) == before
    assert sum(sizes) > 3 * common.BATCH_BYTES and max(sizes) <= common.BATCH_BYTES + 20_000


def test_places_of_words_are_those_of_their_forms():
    terms = ["vile", "vile-", "gard-", "garde-", "ab", "abcde"]
    reader, words = toxicity.TermReader(terms), ["vile", "*Vile*", "vilest", "gardens", "gard", "ab", "abc", "abcde", "abcdef", "--", "", "x"]
    for word in words:
        assert [terms[i] for i in reader.row(word)[:-2].nonzero()[0]] == [t for t in terms if t in toxicity.forms(word.lower())]


def test_form_counts_add_up_beyond_the_bound(spark, monkeypatch):
    table = spark.createDataFrame([(f"w{i % 40} shared",) for i in range(200)], "text string").coalesce(1)
    whole = {r["form"]: r["n"] for r in toxicity.counted_forms(table, "text", None).collect()}
    assert whole["shared"] == 200 and whole["w7"] == 5
    monkeypatch.setattr(toxicity, "KNOWN", 10)
    assert {r["form"]: r["n"] for r in toxicity.counted_forms(table, "text", None).collect()} == whole
    among = toxicity.counted_forms(table, "text", frozenset(["w7", "share-", "none"])).collect()
    assert {r["form"]: r["n"] for r in among} == {"w7": 5, "share-": 200}
