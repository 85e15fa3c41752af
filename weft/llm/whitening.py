"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers, so that counts, sums and products can be added up exactly, in whatever
order the tasks finish: every task multiplies the vectors less a common centre in float64 blocks small
enough to be exact, and Spark adds up the entries in pieces of 40 bits. What reaches the driver is a
number per dimension, then one per pair of dimensions; the eigenvectors come from ``eigen``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, small_batches
from .eigen import WIDE, eigenvectors

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Bits of a piece of a sum: 2**23 tasks may add pieces in a long.
PIECE = 40
#: Binary digits behind the point that sums of whitened products keep.
DIGITS = 60
#: Rows multiplied at a time.
ROWS = 4096


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """((vec_id, v), width): the rows whose vector has the commonest length (of several, the longest), and only usable entries.

    Without any entry (NULL, empty) a vector is left out, as one with a NULL, an entry that isn't finite, or
    one beyond 2**55, whose whole number no long could hold.
    """
    v = F.col("v")
    rows = df.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    fit = rows.where(F.forall(v, lambda c: F.coalesce(F.abs(c) < 2.0**55, F.lit(False))) & (F.size(v) > 0))
    most = fit.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fit.where(F.size(v) == (most["d"] if most else 0)), most["d"] if most else 0


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of the vectors, a row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), whole(part.column(1), width)


def gram(y: np.ndarray) -> np.ndarray:
    """Y'Y exactly: as float64 where the sums stay below 2**53, else in Python's numbers."""
    most = int(np.abs(y).max()) if y.size else 0
    rows = (1 << 53) // max(1, most * most)
    if not rows:
        return y.T.astype(object) @ y.astype(object)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def summed(rows: DataFrame, width: int, measure: Callable[[pa.Array, np.ndarray], np.ndarray]) -> list[int]:
    """Sums over all rows of whole numbers that ``measure`` makes of a block (a flat array of Python ints).

    A task hands on each of its numbers once, cut into four pieces; Spark adds them up. The driver gets one row a number.
    """
    schema = pa.schema([("at", pa.int64()), *((f"p{k}", pa.int64()) for k in range(4))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for ids, x in blocks(batches, width):
            total = total + measure(ids, x)
        if isinstance(total, np.ndarray):
            mask = (1 << PIECE) - 1
            pieces = [pa.array([t >> (PIECE * k) & mask if k < 3 else t >> (PIECE * k) for t in total], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *pieces], schema=schema)

    partial = small_batches(rows).mapInArrow(run, "at long, p0 long, p1 long, p2 long, p3 long")
    found = partial.groupBy("at").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(4))).orderBy("at").collect()
    return [sum(r[f"p{k}"] << (PIECE * k) for k in range(4)) for r in found]


def covariance(n: int, sums: list[int], products: list[int]) -> np.ndarray:
    """(n P - s s') / n**2 in the wide type, rounded from exact fractions. ``products`` has the upper triangle by rows."""
    d = len(sums)
    out = np.zeros((d, d), WIDE)
    at = iter(products)
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(n * next(at) - sums[i] * sums[j], n * n)
            high = float(exact)
            out[i, j] = out[j, i] = WIDE(high) + WIDE(float(exact - Fraction(high)))
    return out


class Whitening:
    """What a fit knows: n, the sums of the dimensions, and the projections that whiten."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, components: int):
        self.n, self.width = n, len(sums)
        self.sums = sums
        values, vectors = eigenvectors(v)
        total = float(np.trace(v))
        # an eigenvalue within rounding of zero has no direction to scale
        rank = int((values > len(v) * 2.0**-50 * abs(total)).sum())
        k = min(components, rank)
        vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(v))][:k] < 0, -1, 1)
        self.values = values[:k].astype(np.float64)
        self.vectors = vectors.astype(np.float64)
        self.explained = self.values / total if k else self.values
        self.scaled = (vectors / np.sqrt(values[:k])).astype(np.float64)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.n * (int(np.abs(x).max()) if x.size else 0) < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, gaps: np.ndarray) -> list[int | None]:
        """The sums of squared gaps; None where a long can't hold them."""
        most = int(abs(gaps).max()) if gaps.size else 0
        if most * most * self.width < 1 << 63:
            return (gaps.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (gaps.astype(object) ** 2).sum(axis=1)
        return [t if t < 1 << 63 else None for t in exact]

    def whitened(self, gaps: np.ndarray) -> np.ndarray:
        return (gaps / self.n).astype(np.float64) @ self.scaled


def fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    """Count, sums and covariance of all rows in two passes; None where there are no rows."""
    if not width:
        return None
    first = summed(rows, width, lambda ids, x: np.array([len(x), *(x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).tolist())], object))
    n, sums = first[0], first[1:]
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the mean, to the next whole number
    upper = np.triu_indices(width)

    def products(ids: pa.Array, x: np.ndarray) -> np.ndarray:
        return gram(x - np.array(centre, np.int64))[upper]

    found = summed(rows, width, products)
    return Whitening(n, sums, covariance(n, [s - n * c for s, c in zip(sums, centre)], found), components)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def products(ids: pa.Array, x: np.ndarray) -> np.ndarray:
        w = model.whitened(model.gaps(x))
        sums = np.concatenate([w.sum(axis=0), (w.T @ w)[upper]])
        return np.array([int(v) for v in np.ldexp(sums.astype(WIDE), DIGITS)], object)

    found = [Fraction(t, model.n << DIGITS) for t in summed(rows, model.width, products)]
    mean, square = found[:k], found[k:]
    return max(abs(float(c - mean[i] * mean[j] - (i == j))) for c, i, j in zip(square, *upper))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components are numbered from 1 by falling eigenvalue; the largest entry of each is positive. Only as many are
    returned as the vectors have directions in which they vary, so that a table of one vector, or of equal ones,
    gives no rows, like an empty one. Vectors that are NULL, empty, of another length than the commonest, or that hold
    a NULL, infinite or NaN entry are left out of fit and result. NULL ids and repeated rows are kept and count as often as they
    occur. ``deviation`` is NULL where a long can't hold it. Other columns are not read. Every pass reads the table; nothing
    is shuffled but a number per pair of dimensions and task.
    """
    rows, width = vectors_of(df, id_col, vector_col)
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("vec_id", kind)] + T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields)
    model = fit(rows, width, components)
    k = len(model.values) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, width):
            gaps = model.gaps(x)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array(model.deviations(gaps), pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(gaps).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(each), error)),
            ], names=schema.names)

    return small_batches(rows).mapInArrow(run, schema)
