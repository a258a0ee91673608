"""Vector expressions on array<float> columns, accumulated in double."""

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
KNOWN_WORDS = 100_000
SLICE_BYTES = 1 << 20


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null for a null vector, NaN for a zero vector, an error for unequal sizes."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(NAN))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ")).cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), checked.otherwise(value))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b, norm_a, norm_b)


def has_dimension(vector: Column, dimension: int) -> Column:
    """True for a null vector or one of the given size."""
    return vector.isNull() | (F.size(vector) == dimension)


def slices_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts, each of at most ``size`` bytes and one more text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(ends // size)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(texts)], strict=True)


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """Bag-of-words vector: words hashed to a fixed number of places, unit length.

    A text without words gets the zero vector, null text a null vector. This
    runs on Arrow batches: counting into a fixed array takes one pass there,
    while array functions pass over the words once per place. The words of
    about SLICE_BYTES of text are held at a time, however long a batch is.
    """
    word = re.compile(r"[^ \t\n\r]+")

    def place(w: str) -> int:
        return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimension

    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, int] = {}
        for texts in batches:
            vectors = np.empty((len(texts), dimension), np.float32)
            for start, stop in slices_of(texts, SLICE_BYTES):
                if len(places) > KNOWN_WORDS:
                    places = {}
                split = [[] if t is None else word.findall(t.lower()) for t in texts.slice(start, stop - start).to_pylist()]
                flat = list(chain.from_iterable(split))
                places.update((w, place(w)) for w in set(flat).difference(places))
                owner = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
                at = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
                counts = np.bincount(owner * dimension + at, minlength=len(split) * dimension).reshape(-1, dimension).astype(float)
                lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                vectors[start:stop] = counts / np.where(lengths > 0, lengths, 1.0)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension)
            yield pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()), mask=texts.is_null())

    embed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(embed, "array<float>")(text)
