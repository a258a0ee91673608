"""Order MinHash: sketches that are sensitive to the edit distance of texts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import once
from engram.llm.shingles import shingle_hashes
from engram.operators.spread import salts_for

SLOTS_LOG = 6  # 64 slots
PLACE_BITS = 31
ENTRY = 10  # characters of an entry: two for the slot, eight for the hash
BUCKETS_PER_TASK = 8


def numbered_kmers(hashes: Column) -> Column:
    """The k-mer hashes with their occurrence number mixed in: the second of two equal ones differs from the first.

    Only texts with a repeated k-mer pay for the sorting.
    """

    def with_numbers(h: Column) -> Column:
        sorted_places = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        # Runs of equal hashes: a place minus the place where its run begins is the occurrence number.
        def numbers(s: Column) -> Column:
            begins = F.filter(
                F.transform(s, lambda x, j: F.when(j == 0, j).when(F.get(s, j - 1)["h"] != x["h"], j)), lambda j: j.isNotNull()
            )
            runs = F.zip_with(begins, F.slice(F.concat(begins, F.array(F.size(s))), 2, F.size(begins)), lambda a, b: F.sequence(F.lit(0), b - a - 1))
            keyed = F.zip_with(s, F.flatten(runs), lambda x, n: F.struct(x["i"].alias("i"), F.when(n == 0, x["h"]).otherwise(F.xxhash64(x["h"], n)).alias("k")))
            return F.transform(F.array_sort(keyed), lambda x: x["k"])

        return once(sorted_places, numbers)

    return once(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(with_numbers(h)),
    )


def slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 63 - SLOTS_LOG)


def fingerprint(text: Column, n: int = 5) -> Column:
    """The sketch of a text: for each of 64 slots the hash of its two least numbered k-mers, in the order of the text.

    A k-mer is ``n`` words. The leading bits of a k-mer's hash name its slot (one
    permutation for all slots), the others its order there. A slot with one
    k-mer hashes that one, an empty slot has no entry; so the fingerprint is up to
    64 entries of two hexadecimal digits for the slot and eight for the hash, and
    that of a text without words is empty.
    """
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    keep = F.lit(((1 << 63) - 1) ^ ((1 << PLACE_BITS) - 1)).cast("long")

    def sketch(k: Column) -> Column:
        packed = F.transform(k, lambda x, i: F.xxhash64(x).bitwiseAND(keep).bitwiseOR(i.cast("long")))

        def least(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(slot(F.get(s, i - 2)) != slot(x), F.lit(True)))

        def entries(t: Column) -> Column:
            def entry(x: Column, i: Column) -> Column:
                after = F.get(t, i + 1)
                paired = F.coalesce(slot(after) == slot(x), F.lit(False))
                a, b = x.bitwiseAND(low).cast("int"), after.bitwiseAND(low).cast("int")
                both = F.xxhash64(F.get(k, F.least(a, b)), F.get(k, F.greatest(a, b)))
                value = F.when(paired, both).otherwise(F.xxhash64(F.get(k, a)))
                text = F.concat(F.lpad(F.hex(slot(x)), 2, "0"), F.substring(F.lpad(F.hex(value), 16, "0"), 9, 8))
                first = F.coalesce(slot(F.get(t, i - 1)) != slot(x), F.lit(True))
                return F.when(first, F.lower(text)).otherwise(F.lit(""))

            return F.array_join(F.transform(t, entry), "")

        return once(once(F.sort_array(packed), least), entries)

    return once(numbered_kmers(shingle_hashes(text, n)), sketch)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries among the slots that either fingerprint fills; two empty ones are alike (1.0)."""

    def cut(f: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest((F.length(f) / ENTRY).cast("int") - 1, F.lit(0)))
        return F.when(F.length(f) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(places, lambda i: F.substring(f, i * ENTRY + 1, F.lit(ENTRY)))
        )

    def slots(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.substring(e, 1, 2))

    def share(x: Column, y: Column) -> Column:
        filled = F.size(F.array_union(slots(x), slots(y)))
        return F.size(F.array_intersect(x, y)) / F.greatest(filled, F.lit(1))

    value = once(F.struct(cut(a).alias("a"), cut(b).alias("b")), lambda p: share(p["a"], p["b"]))
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(value)


def followed(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Each row with ``next``: the ``values`` of the row after it by descending key, after the last the first.

    Rows go to buckets of neighbouring keys, so that no task sees them all. The
    first rows of a bucket also stand, as guests, at the end of the bucket before
    it. Bounds are approximate quantiles of the key; of each bucket only the
    highest key comes to the driver, at most as many as there are bounds.
    Equal keys are ordered by the values, null keys come last.
    """
    buckets = salts_for(df) * BUCKETS_PER_TASK
    steps = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, steps, max(10_000, 10 * buckets)).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    # Bucket of a key: how many bounds are not above it, by binary search; null keys stand below all.
    halves = [1 << b for b in range(max(len(bounds), 1).bit_length() - 1, -1, -1)]
    held = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<bigint>")
    searched = F.aggregate(
        F.array(*(F.lit(h) for h in halves)),
        F.lit(0),
        lambda at, h: F.when(F.coalesce(F.get(held, at + h - 1) <= F.col(key), F.lit(False)), at + h).otherwise(at),
    )
    dealt = df.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(searched))
    highest = dealt.groupBy("bucket").agg(F.max(key).alias("top")).orderBy(F.desc("bucket")).collect()
    order = [r["bucket"] for r in highest]
    hosts = {r["bucket"]: order[i - 1] for i, r in enumerate(highest)}  # the bucket of the rows before these; the first's is the last
    is_top = F.lit(False)
    if highest:
        tops = F.map_from_arrays(F.array(*(F.lit(r["bucket"]) for r in highest)), F.array(*(F.lit(r["top"]).cast("long") for r in highest)))
        host = F.map_from_arrays(F.array(*(F.lit(b) for b in hosts)), F.array(*(F.lit(h) for h in hosts.values())))
        is_top = F.try_element_at(tops, F.col("bucket")).eqNullSafe(F.col(key))
        guest = F.struct(F.try_element_at(host, F.col("bucket")).alias("bucket"), F.lit(1).alias("guest"))
        own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
        dealt = dealt.withColumn("at", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own)))).drop("bucket")
    else:
        dealt = dealt.withColumn("at", F.struct(F.col("bucket"), F.lit(0).alias("guest"))).drop("bucket")
    line = Window.partitionBy("at.bucket").orderBy("at.guest", F.desc_nulls_last(key), *values)
    after = F.lead(F.struct(*values)).over(line).alias("next")
    return dealt.select(*df.columns, F.col("at.guest").alias("guest"), after).where("guest = 0").drop("guest")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to it and to the next text's.

    key, n_chars, edited (the text whose last floor(n_chars / 2) code points are
    replaced by the first as many of the next row's text, or all of it),
    fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; an empty text is its own edited text. Repeated rows are rows of their
    own, ordered by their text; a single row is its own next; other columns are
    not looked at; an empty table gives no rows.
    """
    body = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    made = body.withColumn("print", fingerprint(F.col("body"), n))
    lined = followed(made, "key", ["body", "print"])
    length = F.length("body")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), length - half), F.substring("next.body", F.lit(1), half))
    full = lined.select("key", length.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    full = full.withColumn("edited_print", fingerprint(F.col("edited"), n))
    return full.select(
        F.col("key").alias(key),
        "n_chars",
        "edited",
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
