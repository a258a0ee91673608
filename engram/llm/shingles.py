"""Word shingles of whole texts as 64-bit hashes, in DataFrame expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.llm.common import once, words

WORDS = 5


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """The hash of each run of ``n`` words in text order; with fewer words the whole sequence as one, without any none.

    64 bits: two different shingles of one text of a million have a chance of
    one in 10 ** 7 to be taken for one.
    """

    def runs(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
        whole = F.array(F.xxhash64(h, F.size(h)))
        each = F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)), F.lit(n)))
        return F.when(F.size(h) >= n, each).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return once(F.transform(words(text), lambda w: F.xxhash64(w)), runs)
