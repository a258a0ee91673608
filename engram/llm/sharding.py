"""Placement by a permutation-filled lookup table: each shard claims slots in its own order."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 15  # of the hexadecimal digest: 60 bits, a positive long


def number_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def filled_table(shards: list[str], slots: int) -> list[int]:
    """The place in ``shards`` of each slot's owner.

    Each shard has a preference order offset, offset + skip, ... over the prime
    number of slots, from hashes of its name alone. Shards take turns; each
    claims its first free slot. So shares differ by at most one slot, and when
    a shard goes, nearly all slots of the others stay theirs. The work is
    bounded by the table: slots * log(slots) steps as a rule.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, not under the number of shards")
    at = [number_of(f"{name}/offset") % slots for name in shards]
    skip = [number_of(f"{name}/skip") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner = [-1] * slots
    left = slots
    while left:
        for shard in range(min(len(shards), left)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key, from 60 bits of its digest; a null key has the slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long"), F.lit(slots).cast("long"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = 4099, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``df`` with the slot and the shard name of each row's key.

    Every row is kept, repeated rows too; equal keys, null among them, go to one
    shard. A hot key can be spread by hashing more columns into ``key``. Columns
    named like the two new ones are replaced. The table has ``slots`` rows, a
    parameter and not the data's size, and is broadcast.
    """
    spark = df.sparkSession
    owners = filled_table(shards, slots)
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owners)], f"`{slot}` long, `{shard}` string")
    kept = df.drop(slot, shard).withColumn(slot, slot_of(key, slots))
    return kept.join(F.broadcast(table), slot).select(*(c for c in kept.columns if c != slot), slot, shard)
