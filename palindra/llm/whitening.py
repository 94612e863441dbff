"""Whitening of embeddings by an exactly centred, compensated covariance.

Values become integers, so sums and deviations are exact. Products of centred columns are summed in
pairs of doubles by error-free transformations, in every task, and the high and low parts of the tasks
are merged the same way along a tree. Only sums and one matrix of the vectors' length reach the driver, which solves
the eigenproblem by reduction to tridiagonal form and divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .memory import lean

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Integers up to here are exact in a double; a value beyond has no place in the fit.
_EXACT = 2.0**53
#: Entries of the matrix summed at once, numbers held in a temporary, rows taken at once.
_PAIRS, _CELLS, _ROWS = 1 << 18, 1 << 15, 4096
_LOW = (1 << 26) - 1


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, its rounding error), exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as the sum of two numbers of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


class Products:
    """Sums over rows of the products of all pairs of columns, high and low parts; only pairs i <= j are held."""

    def __init__(self, width: int):
        self.i, self.j = np.triu_indices(width)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, rows: np.ndarray) -> None:
        """Add rows; several are summed side by side before they are joined."""
        top, rest = halves(rows)
        for at in range(0, len(self.i), _PAIRS):
            i, j = self.i[at : at + _PAIRS], self.j[at : at + _PAIRS]
            lanes = max(1, min(len(rows), _CELLS // len(i)))
            high, low = np.zeros((lanes, len(i))), np.zeros((lanes, len(i)))
            for k in range(0, len(rows), lanes):
                m = min(lanes, len(rows) - k)
                p, e = self._times(rows[k : k + m], top[k : k + m], rest[k : k + m], i, j)
                s, t = two_sum(high[:m], p)
                high[:m], low[:m] = two_sum(s, t + (low[:m] + e))
            for lane in range(lanes):
                self._join(slice(at, at + len(i)), high[lane], low[lane])

    @staticmethod
    def _times(a: np.ndarray, top: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(product, its rounding error) of the pairs of columns, exactly."""
        p = a[:, i] * a[:, j]
        ti, tj, ri, rj = top[:, i], top[:, j], rest[:, i], rest[:, j]
        return p, ((ti * tj - p) + ti * rj + ri * tj) + ri * rj

    def _join(self, at: slice, high: np.ndarray, low: np.ndarray) -> None:
        s, t = two_sum(self.high[at], high)
        self.high[at], self.low[at] = two_sum(s, t + (self.low[at] + low))

    def merge(self, other: Products) -> Products:
        self._join(slice(None), other.high, other.low)
        return self

    def dump(self) -> bytes:
        return self.high.tobytes() + self.low.tobytes()

    @classmethod
    def load(cls, width: int, data: bytes) -> Products:
        out = cls(width)
        out.high, out.low = np.frombuffer(data, float).reshape(2, -1).copy()
        return out

    def matrix(self) -> np.ndarray:
        width = self.i.max(initial=-1) + 1
        out = np.zeros((width, width))
        out[self.i, self.j] = out[self.j, self.i] = self.high + self.low
        return out


def valid(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that can be fitted, x the scaled and shifted integers.

    Left out are null vectors, null or non-finite entries, entries whose integer a double does not hold, empty vectors, and vectors
    of another length than most of the rest have (of lengths equally common the longer counts).
    """
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < _EXACT), F.lit(False)))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(good)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    kept = kept.select(F.col(key).cast("long").alias(key), x.alias("x"))
    most = kept.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return kept.where(F.size("x") == (most.width if most else 0))


def matrices(batches, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, its vectors as a matrix), some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            some = b.slice(at, _ROWS)
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of every dimension): high and low bits are summed apart, so that no sum overflows."""

    def part(batches) -> bytes:
        total = np.zeros((2, width), np.int64)
        n = 0
        for _, x in matrices(batches):
            total += np.stack([(x >> 26).sum(0), (x & _LOW).sum(0)])
            n += len(x)
        return np.concatenate([[n], total.ravel()]).astype(np.int64).tobytes()

    total = trees.reduced(rows.select("x"), part, np.add, lambda b: np.frombuffer(b, np.int64))
    if total is None:
        return 0, [0] * width
    return int(total[0]), [(h << 26) + low for h, low in zip(total[1 : width + 1].tolist(), total[width + 1 :].tolist())]


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: 64-bit integers where they suffice, else Python's."""
    middle = [round(s / n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle)]
    near = x - np.array(middle, np.int64)
    if float(np.abs(near).max(initial=0)) * n < 2.0**62:
        return near * n - np.array(rest, np.int64)
    return near.astype(object) * n - np.array(rest, object)


def squared(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; null where a long does not hold it."""
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(1).tolist()]


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance with divisor n, from sums of products of the exact deviations n * x - total."""
    width = len(total)

    def part(batches) -> bytes:
        out = Products(width)
        for _, x in matrices(batches):
            out.add(deviations(x, n, total).astype(float))
        return out.dump()

    found = trees.reduced(rows.select("x"), part, lambda a, b: a.merge(b), lambda b: Products.load(width, b))
    return found.matrix() / float(n) / float(n) / float(n)


def components(cov: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) by falling eigenvalue, of at most ``most`` that exceed rounding.

    The solver reduces the symmetric matrix to tridiagonal form and divides and conquers that. The largest entry of
    a vector is positive, so reruns agree.
    """
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > max(values[0], 0.0) * len(values) * np.finfo(float).eps)[:most]
    values, vectors = values[keep], vectors[:, keep]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))])


def whitened(x: np.ndarray, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, whitened coordinates) of vectors."""
    d = deviations(x, n, total)
    return d, (d.astype(float) / n) @ vectors / np.sqrt(values)


def identity_error(rows: DataFrame, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; blocks are centred at their means and merged."""
    width = len(values)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of (count, mean, products around the mean), one row after another."""
        m, k = a[0, 0], b[0, 0]
        if not m or not k:
            return b if not m else a
        gap = b[1] - a[1]
        return np.vstack([np.full(width, m + k), a[1] + gap * (k / (m + k)), a[2:] + b[2:] + np.outer(gap, gap) * (m * k / (m + k))])

    def part(batches) -> bytes:
        out = np.zeros((width + 2, width))
        for _, x in matrices(batches):
            w = whitened(x, n, total, values, vectors)[1]
            mean = w.mean(0)
            out = join(out, np.vstack([np.full(width, float(len(w))), mean, (w - mean).T @ (w - mean)]))
        return out.tobytes()

    found = trees.reduced(rows.select("x"), part, join, lambda b: np.frombuffer(b).reshape(width + 2, width))
    return float(np.abs(found[2:] / n - np.eye(width)).max())


_OUT = "{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every valid row and component.

    See :func:`valid` for the rows left out. Components whose eigenvalue is rounding noise are not made, so equal vectors, a
    single one or an empty table give no rows. Null keys and repeated rows stay, other columns are not read. ``deviation`` is null where a
    long does not hold it.
    """
    out = _OUT.format(key=key)
    spark = rows.sparkSession
    fit = valid(rows, key, vector)
    first = fit.select(F.size("x").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], out)
    n, total = sums(fit, first.width)
    cov = covariance(fit, n, total)
    values, vectors = components(cov, most)
    if not len(values):
        return spark.createDataFrame([], out)
    error, explained = identity_error(fit, n, total, values, vectors), values / np.trace(cov)
    shared = spark.sparkContext.broadcast((total, values, vectors, explained))  # of the vectors' length

    def run(batches) -> Iterator[pa.RecordBatch]:
        total, values, vectors, explained = shared.value
        names = [c.split(" ")[0] for c in out.split(", ")]
        for b, x in matrices(batches):
            d, w = whitened(x, n, total, values, vectors)
            rows_, width = w.shape
            every = lambda v: pa.array(np.repeat(v, rows_ * width))
            each = pa.array(np.repeat(np.arange(rows_), width))
            columns = [b.column(key).take(each), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows_)), every(np.int64(n)), pa.array(squared(d), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), every(error)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return fit.mapInArrow(lean(run), out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
