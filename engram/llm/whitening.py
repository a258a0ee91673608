"""Whitening of embeddings: leading eigenpairs by spectrum slicing and Rayleigh quotient iteration."""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import settled

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
MOST_DIMENSIONS = 4096
LARGEST = 2.0**62
PIVOT = (1 + 17**0.5) / 8
EPS = float(np.finfo(float).eps)


# The spectrum of one matrix of dimensions x dimensions, on the driver.


def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are smaller than the shift: the negative ones in D of P(A - sI)Pᵀ = LDLᵀ.

    Sylvester's law of inertia. The whole rest is searched for each pivot, of
    one row or two; a block of two has one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    at, negative = 0, 0
    while at < len(a):
        rest = np.abs(a[at:, at:])
        diagonal = rest.diagonal().copy()
        p = int(diagonal.argmax())
        np.fill_diagonal(rest, 0)
        r, s = divmod(int(rest.argmax()), len(rest))
        if diagonal[p] == 0 and rest[r, s] == 0:
            break
        if diagonal[p] >= PIVOT * rest[r, s]:
            swap(a, at, at + p)
            pivot = a[at, at]
            column = a[at + 1 :, at]
            a[at + 1 :, at + 1 :] -= np.outer(column, column / pivot)
            negative += pivot < 0
            at += 1
        else:
            r, s = min(r, s), max(r, s)
            swap(a, at, at + r)
            swap(a, at + 1, at + s)
            columns = a[at + 2 :, at : at + 2]
            a[at + 2 :, at + 2 :] -= columns @ np.linalg.solve(a[at : at + 2, at : at + 2], columns.T)
            negative += 1
            at += 2
    return int(negative)


def swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


class Spectrum:
    """Eigenvalues of a symmetric matrix by number, 1 the largest, between shifts whose counts are known."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.above = {-self.norm * 1.01 - 1e-300: self.size, self.norm * 1.01 + 1e-300: 0}

    def count_above(self, shift: float) -> int:
        if shift not in self.above:
            self.above[shift] = self.size - count_below(self.matrix, shift)
        return self.above[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The closest known shifts with the numbered eigenvalue between them."""
        low = max(s for s, n in self.above.items() if n >= number)
        high = min(s for s, n in self.above.items() if n < number)
        return low, high

    def halve(self, low: float, high: float) -> None:
        self.count_above((low + high) / 2)

    def group(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbered eigenvalue and its vector, or all those that no shift can tell from it."""
        while True:
            low, high = self.bracket(number)
            width = max(64 * EPS * self.norm, 4 * EPS * abs(high), 4 * EPS * abs(low), 1e-290)
            inside = self.above[low] - self.above[high]
            if inside > 1 and high - low > width:
                self.halve(low, high)
            elif inside > 1:
                return self.alike((low + high) / 2, inside)
            else:
                found = self.refined(low, high, number)
                if found is not None:
                    return found
                if high - low <= width:
                    return self.alike((low + high) / 2, 1)
                self.halve(low, high)

    def solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        for k in range(4):
            try:
                return np.linalg.solve(self.matrix - (shift + k * EPS * self.norm) * np.eye(self.size), right)
            except np.linalg.LinAlgError:
                continue
        raise np.linalg.LinAlgError("no shift near by can be solved for")

    def start(self, columns: int) -> np.ndarray:
        return np.linalg.qr(np.random.default_rng(self.size).standard_normal((self.size, columns)))[0]

    def refined(self, low: float, high: float, number: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Rayleigh quotient iteration from inside the bracket; None unless counts certify the number of what it finds."""
        v = self.start(1)[:, 0]
        for _ in range(2):
            v = unit(self.solve((low + high) / 2, v))
        best, value = np.inf, None
        for _ in range(12):
            quotient = float(v @ self.matrix @ v)
            residual = float(np.linalg.norm(self.matrix @ v - quotient * v))
            if not low < quotient < high:
                return None
            if residual >= best:
                break
            best, value, vector = residual, quotient, v
            v = unit(self.solve(quotient, v))
        if value is None:
            return None
        reach = 4 * best + 16 * EPS * self.norm
        if self.count_above(value - reach) != number or self.count_above(value + reach) != number - 1:
            return None
        return np.array([value]), vector[:, None]

    def alike(self, shift: float, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Orthonormal vectors of eigenvalues that are equal to rounding, by inverse iteration on a block."""
        block = self.start(columns)
        for _ in range(4):
            block = self.solve(shift, block)
            block = np.linalg.qr(block / np.abs(block).max(axis=0))[0]
        values = np.einsum("ij,ij->j", block, self.matrix @ block)
        order = np.argsort(-values)
        return values[order], block[:, order]


def leading(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to so many eigenvalues above rounding, falling, and their unit vectors as columns."""
    spectrum = Spectrum(matrix)
    least = 1e-12 * float(np.trace(matrix))
    values, vectors = np.zeros(0), np.zeros((len(matrix), 0))
    if not spectrum.norm:
        return values, vectors
    while len(values) < min(components, len(matrix)):
        value, vector = spectrum.group(len(values) + 1)
        if not value[0] > least:
            break
        values, vectors = np.append(values, value), np.hstack([vectors, vector])
    keep = [i for i in range(min(components, len(values))) if values[i] > least]
    return values[keep], vectors[:, keep]


# The passes over the table.


def usable(vectors: pa.Array, dimensions: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length in a batch: the rows that have a whole, finite vector of it, and their entries as x, long."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    found = {}
    for length in np.unique(lengths):
        if length == 0 or dimensions not in (None, length):
            continue
        rows = np.flatnonzero(lengths == length)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        entries = flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(SCALE * entries)
        good = (np.abs(scaled) < LARGEST).all(axis=1)
        if good.any():
            found[int(length)] = rows[good], scaled[good].astype(np.int64) + SHIFT
    return found


def exact_sums(x: np.ndarray) -> list[int]:
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)]


def merged_tasks(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as run at once four times over, so that few partial matrices are moved."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class Fit:
    """Sums over the fit list and what was found from them."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part taken off in integers."""
        whole = np.array([s // self.n for s in self.sums])
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exact; null where a long cannot hold it."""
        off = x - np.array([s // self.n for s in self.sums])
        rest = [s % self.n for s in self.sums]
        reach = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 2.0**62:
            return ((self.n * off - np.array(rest)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(o) - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off]
        return [e if e < 2**63 else None for e in exact]


def summed_products(df: DataFrame, vector: str, fit: Fit, width: int, values) -> np.ndarray:
    """The sum over all usable vectors of the products of ``values(x)`` with itself: one partial matrix a task, added by Spark."""
    dimensions = len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in usable(batch.column(0), dimensions).values():
                v = values(x)
                total += v.T @ v
        lists = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), lists], names=["i", "line"])

    parts = merged_tasks(df.select(vector)).mapInArrow(run, "i long, line array<double>")
    cells = parts.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix = np.zeros((width, width))
    for cell in cells.collect():
        matrix[cell["i"], cell["j"]] = cell["v"]
    return (matrix + matrix.T) / 2


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Sums, covariance and leading components of all usable vectors; None without any.

    Three readings of the vector column: exact sums, centred products,
    products of the whitened vectors. The driver gets one number for each
    pair of dimensions; more than MOST_DIMENSIONS are refused.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for length, (rows, x) in usable(batch.column(0)).items():
                n, before = totals.get(length, (0, [0] * length))
                totals[length] = n + len(rows), [a + b for a, b in zip(before, exact_sums(x), strict=True)]
        for length, (n, total) in totals.items():
            columns = [
                pa.array([length] * length, pa.int64()),
                pa.array(range(length), pa.int64()),
                pa.array([n] * length, pa.int64()),
                pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["length", "dimension", "n", "total"])

    shape = "length long, dimension long, n long, total decimal(38,0)"
    parts = settled(merged_tasks(df.select(vector)).mapInArrow(sums, shape), "vector-sums")
    counts = parts.where("dimension = 0").groupBy("length").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "length").first()
    if most is None:
        return None
    dimensions, n = most["length"], most["n"]
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions; {MOST_DIMENSIONS} at most")
    rows = parts.where(F.col("length") == dimensions).groupBy("dimension").agg(F.sum("total").alias("total")).collect()
    totals = [int(r["total"]) for r in sorted(rows, key=lambda r: r["dimension"])]
    fit = Fit(n, totals, np.zeros(0), np.zeros((dimensions, 0)), 0.0)
    covariance = summed_products(df, vector, fit, dimensions, fit.centred) / n
    fit.trace = float(np.trace(covariance))
    fit.values, fit.vectors = leading(covariance, components)
    found = len(fit.values)
    if found:
        again = summed_products(df, vector, fit, found + 1, lambda x: np.hstack([fit.whitened(x), np.ones((len(x), 1))])) / n
        mean = again[:found, found]
        fit.identity_error = float(np.abs(again[:found, :found] - np.outer(mean, mean) - np.eye(found)).max())
    return fit


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component up to ``components``.

    key, component (from 1), n, deviation, whitened, explained,
    identity_error. Rows whose vector is null, empty, holds null or non-finite
    entries or such as no long can hold, or has another length than most
    (the shorter of two that are as frequent) give none. Components whose
    eigenvalue is zero to rounding have no whitened form and are left out, so
    a table of equal vectors, or without any, gives no rows. Repeated rows
    count and come out as often; a null key stays null; other columns are not
    looked at. ``deviation`` is null where a long cannot hold it.
    """
    kind = df.schema[key].dataType.simpleString()
    shape = (
        f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    fit = fit_whitening(df, vector, components)
    if fit is None or not len(fit.values):
        return df.sparkSession.createDataFrame([], shape)
    found, dimensions = len(fit.values), len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in usable(batch.column(1), dimensions).values():
                total = len(rows) * found
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, found))),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(total, fit.n)),
                    pa.array([d for d in fit.deviations(x) for _ in range(found)], pa.int64()),
                    pa.array(fit.whitened(x).reshape(-1)),
                    pa.array(np.tile(fit.values / fit.trace, len(rows))),
                    pa.array(np.full(total, fit.identity_error)),
                ]
                names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(key, vector).mapInArrow(run, shape)
