"""Whitening of vectors by a randomised range finder.

Entries become whole numbers first, x = floor(1024 c) + 100000, so that counts, sums and deviations are exact. A block of
random directions, some more than the components asked for, is multiplied by the covariance in passes over all centred rows;
after each pass the Rayleigh-Ritz values and vectors of the block are tested by their residuals. If the last pass leaves a residual above
``TOLERANCE``, the block grows to the full dimension, where Rayleigh-Ritz gives all components at once.

A pass is one scan: each task adds its rows' share of the d x l product, in double precision, and these sums are added by row of the product in as many tasks as
there are rows. The driver and the closures hold d x l numbers, d the length of a vector, whatever the number of vectors.

Cases. Left out: vectors that are null, hold null or non-finite entries, or are shorter than the longest one without such entries (their missing entries count as null).
Repeated rows are vectors of their own in fit and result; a null id passes through. A component whose variance is zero up to rounding cannot be whitened and is not returned, so
equal vectors, or a single one, give no rows, as an empty table does; with fewer than ``components`` dimensions there are as many as dimensions. Equal variances: any basis of their space. Other columns are ignored.
A sign is such that a component's largest entry is positive. An entry whose x exceeds 2**62 is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, partitions, tidy

#: Components, directions beyond them, and passes before the block grows to the full dimension.
COMPONENTS, OVERSAMPLING, PASSES = 8, 8, 3
#: Residual of a component, as a share of the greatest variance, up to which its block has converged.
TOLERANCE = 1e-13
SCALE, SHIFT = 1024, 100_000
SEED = 13
WHOLE = "decimal(38,0)"
#: Rows that are worked on together.
ROWS = 4096


def whole_numbers(column: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the valid vectors of each length, or of length dims alone: places in the column, a row of x for each."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    entries = np.asarray(flat.fill_null(np.nan), np.float64)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    valid = (size > 0) & (bad[start + np.maximum(size, 0)] == bad[start])
    for d in np.unique(size[valid]).tolist() if dims is None else [dims]:
        places = np.flatnonzero(valid & (size == d))
        c = np.floor(entries[start[places][:, None] + np.arange(d)] * SCALE)
        if len(c) and np.abs(c).max() >= 2.0**62:
            raise ValueError("an entry is too large to become a whole number")
        yield places, c.astype(np.int64) + SHIFT


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of columns in Python's whole numbers."""
    if len(x) and int(np.abs(x).max()) * len(x) >= 2**62:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


@tidy
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of the task's valid vectors of each length."""
    held: dict[int, list] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            for places, x in whole_numbers(batch["vec"].slice(a, ROWS)):
                if len(places):
                    one = held.setdefault(x.shape[1], [0, 0])
                    one[0] += len(x)
                    one[1] = one[1] + _total(x)
    for d, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), _decimals(s)], ["dims", "n", "pos", "total"])


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s, exactly."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, s)) >= 2**62:
        return x.astype(object) * n - s
    return x * n - s.astype(np.int64)


def deviations(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    if y.dtype != object and (not len(y) or int(np.abs(y).max()) < 2**46) and y.shape[1] < 2**15:
        high, low = y >> 23, y & (2**23 - 1)  # three sums of products below 2**47
        parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
        return [(a << 46) + (b << 24) + c for a, b, c in zip(*parts, strict=True)]
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


class Vectors(NamedTuple):
    """The valid vectors of a table: its rows, and how many there are, their length and the sums of their entries."""

    rows: DataFrame
    n: int
    dims: int
    sum: np.ndarray

    @classmethod
    def of(cls, table: DataFrame, id_col: str, vec_col: str) -> Vectors:
        rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
        found = materialise(rows.select("vec").mapInArrow(_sums, f"dims int, n long, pos int, total {WHOLE}"))
        dims = found.agg(F.max("dims")).first()[0] or 0
        sums = found.where(F.col("dims") == dims).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").cast(WHOLE).alias("total")).orderBy("pos").collect()
        return cls(rows, sums[0]["n"] if sums else 0, dims, np.array([int(r["total"]) for r in sums], object))

    def summed(self, product: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """product(centred rows, as doubles) added over all rows."""
        _, n, dims, s = self

        @tidy
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x, _ in _blocks(batches, dims):
                total += product(centred(x, n, s).astype(np.float64) / n)
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

        parts = self.rows.mapInArrow(task, "i int, part array<double>")
        added = parts.repartition(min(partitions(self.rows.sparkSession), shape[0]), "i").mapInArrow(_added, "i int, part array<double>")
        out = np.zeros(shape)
        for row in added.collect():
            out[row["i"]] = row["part"]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """x and ids of the valid vectors, ROWS or fewer at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            for places, x in whole_numbers(batch["vec"].slice(a, ROWS), dims):
                if len(places):
                    yield x, batch["vec_id"].slice(a, ROWS).take(pa.array(places))


@tidy
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of equal i, added."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch["i"].to_pylist(), batch["part"], strict=True):
            values = np.asarray(part.values)
            total[i] = total[i] + values if i in total else values
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "part"])


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, falling, vectors and residuals of the block q, whose product with the covariance is vq."""
    t = q.T @ vq
    values, u = np.linalg.eigh((t + t.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    vectors = q @ u
    return values, vectors, np.linalg.norm(vq @ u - vectors * values, axis=0)


def components(vectors: Vectors, most: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Variances, unit vectors (as columns), the trace of the covariance, and whether the block had to grow to the full dimension."""
    d, n = vectors.dims, vectors.n
    if not n:
        return np.zeros(0), np.zeros((d, 0)), 0.0, False
    trace = 0.0

    def multiplied(q: np.ndarray) -> np.ndarray:
        """Covariance times q; one more row gives the trace."""
        nonlocal trace

        def product(c: np.ndarray) -> np.ndarray:
            squares = np.zeros((1, q.shape[1]))
            squares[0, 0] = np.einsum("ij,ij->", c, c)
            return np.vstack([c.T @ (c @ q), squares])

        total = vectors.summed(product, (d + 1, q.shape[1])) / n
        trace = float(total[d, 0])
        return total[:d]

    block = min(d, most + oversampling)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, block)))[0]
    for _ in range(passes if block < d else 0):
        q = np.linalg.qr(multiplied(q))[0]
    grown = block == d
    vq = multiplied(q)
    values, found, residual = _ritz(q, vq)
    if not grown and (residual[:most] > tolerance * max(values[0], 0)).any():
        rest = np.random.default_rng(SEED + 1).standard_normal((d, d - block))
        q, grown = np.linalg.qr(np.hstack([q, rest]))[0], True
        values, found, residual = _ritz(q, multiplied(q))
    keep = values[:most] > max(values[0], 0) * d * 2.0**-50
    values, found = values[:most][keep], found[:, :most][:, keep]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return values, found * signs, trace, grown


def whitened(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """For each valid vector and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.

    deviation is the exact sum over dimensions of (n x - S)**2, whitened the centred vector's part along the component over its standard deviation,
    explained the component's share of all variance, identity_error the largest absolute entry of the whitened rows' covariance minus the identity.
    """
    vectors = Vectors.of(table, id_col, vec_col)
    values, found, trace, _ = components(vectors, most, oversampling, passes, tolerance)
    n, k = vectors.n, len(values)
    turn = found / np.sqrt(values)
    error = 0.0
    if k:
        # Centred rows have the mean zero, and so have the whitened ones; the last row holds their sums, which measure rounding.
        total = vectors.summed(lambda c: np.vstack([(w := c @ turn).T @ w, w.sum(axis=0, keepdims=True)]), (k + 1, k)) / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    share = values / trace if k else values

    _, _, dims, sums = vectors

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _blocks(batches, dims):
            y = centred(x, n, sums)
            m = len(y)
            at = np.repeat(np.arange(m), k)
            columns = [
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), _decimals(deviations(y)).take(pa.array(at)),
                pa.array(((y.astype(np.float64) / n) @ turn).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.rows.mapInArrow(rows, f"vec_id long, component int, n long, deviation {WHOLE}, whitened double, explained double, identity_error double")
