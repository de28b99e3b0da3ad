"""Op 12: whitening of embeddings by exact, bit-sliced cross-products.

Components become integers. A block of rows is shifted by its least value in each dimension, and every bit plane of every
dimension is packed across the block's rows into words: the cross-product of two dimensions is the sum over pairs of their
planes of 2^(a+b) times the ones in the AND of the two. Blocks are added up as integers, without any rounding: a task
returns one row a pair of dimensions, Spark adds them, and the scatter is centred as an integer matrix before eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
ENTRY_BITS = 40  # of an integer entry: sums of products of a trillion rows fit 38 digits
NARROW = 1e-11  # eigenvalues below this share of the trace are no more than rounding
PARTIAL = "i int, j int, value decimal(38,0), low long, high long"


@dataclass(frozen=True)
class Whitening:
    """The fit: vectors of `dim` integers, their number and sums, eigenvectors (columns) and eigenvalues, falling."""

    dim: int
    n: int
    scale: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    deviation_bound: int


def _length(df: DataFrame, vector: str) -> int | None:
    """The most common length of vectors that are not null (the longest of those equally common); None if there is none."""
    lengths = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    first = lengths.where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    return first and first["dim"]


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and floor(scale * c) of their entries, as int64: vectors of `dim` finite entries below 2^ENTRY_BITS / scale."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(rows)).flatten()
    x = entries.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # a null entry becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
        good = (np.abs(x) < 2.0**ENTRY_BITS).all(axis=1)  # false for NaN
    return rows[good], x[good].astype(np.int64)


def cross_products(y: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of rows of integers that are not negative: weights (powers of two) and count matrices that add up to y'y, upper triangle."""
    rows, dim = y.shape
    bits = int(y.max(initial=0)).bit_length()
    words = -(-rows // 64)
    planes = np.zeros((bits, dim, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits((y >> b).astype(np.uint8) & 1, axis=0)  # rows to bits
        planes[b, :, : len(packed)] = packed.T
    planes = planes.view(np.uint64)
    by_power: dict[int, np.ndarray] = {}
    for i in range(dim):
        for a in range(bits):
            ones = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(axis=2, dtype=np.int64)  # of every plane of dimensions from i on
            for b in range(bits):
                by_power.setdefault(a + b, np.zeros((dim, dim), dtype=np.int64))[i, i:] += ones[b]
    return [(1 << p, m) for p, m in by_power.items()]


class Scatter:
    """Sums and cross-products of integer rows, exact: small ones wait in 64 bits, all end in Python's integers."""

    def __init__(self, dim: int):
        self.n, self.sums, self.products = 0, np.zeros(dim, dtype=np.int64), np.zeros((dim, dim), dtype=object)
        self.small, self.waiting = np.zeros((dim, dim), dtype=np.int64), 0
        self.low, self.high = np.full(dim, 2**62), np.full(dim, -(2**62))

    def add(self, x: np.ndarray) -> None:
        shift, n = x.min(axis=0), len(x)
        y = x - shift
        narrow = max(-int(shift.min()), int(x.max())) < 2**20
        kind = np.int64 if narrow else object  # products of narrow rows, 2^22 of them, fit 64 bits
        s, at = y.sum(axis=0).astype(kind), shift.astype(kind)
        # About zero again: x = y + shift.
        products = np.outer(at, s) + np.outer(s, at) + n * np.outer(at, at)
        for weight, counts in cross_products(y):
            products += counts.astype(kind, copy=False) * weight
        if narrow:
            self.small += products
            self.waiting += n
        else:
            self.products += products
        if self.waiting >= 2**21:
            self._settle()
        self.n, self.sums = self.n + n, self.sums + x.sum(axis=0)
        self.low, self.high = np.minimum(self.low, shift), np.maximum(self.high, x.max(axis=0))

    def _settle(self) -> None:
        self.products += self.small.astype(object)
        self.small[:], self.waiting = 0, 0

    def rows(self) -> tuple[list, list, list, list, list]:
        """(i, j, value, low, high): (-1, -1, n), then each dimension's sum and range under j = -1, then the upper triangle."""
        self._settle()
        dim = len(self.sums)
        i, j = np.triu_indices(dim)
        empty = [None] * len(i)
        return ([-1, *range(dim), *i.tolist()], [-1] * (dim + 1) + j.tolist(), [self.n, *self.sums.tolist(), *self.products[i, j]], [None, *self.low.tolist(), *empty], [None, *self.high.tolist(), *empty])


def _scatter(df: DataFrame, vector: str, dim: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(dim)
        for batch in batches:
            _, x = _integers(batch.column(0), dim, scale)
            for at in range(0, len(x), BLOCK_ROWS):
                total.add(x[at : at + BLOCK_ROWS])
        if total.n:
            i, j, value, low, high = total.rows()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in value], pa.decimal128(38, 0)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["i", "j", "value", "low", "high"])

    parts = df.select(vector).mapInArrow(run, PARTIAL)
    return parts.groupBy("i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"), F.min("low").alias("low"), F.max("high").alias("high"))


def fit(df: DataFrame, vector: str, components: int = 32, scale: int = 64) -> Whitening | None:
    """The whitening of all usable vectors; None where there is none. What reaches the driver is one row a pair of dimensions."""
    dim = _length(df, vector)
    if dim is None:
        return None
    n, sums = 0, [0] * dim
    products = np.zeros((dim, dim), dtype=object)
    low, high = [0] * dim, [0] * dim
    for r in _scatter(df, vector, dim, scale).collect():
        i, j, value = r["i"], r["j"], int(r["value"])
        if i < 0:
            n = value
        elif j < 0:
            sums[i], low[i], high[i] = value, r["low"], r["high"]
        else:
            products[i, j] = products[j, i] = value
    if not n:
        return None
    centred = n * products - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))  # n^2 times the covariance, an integer
    covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], dtype=np.float64)  # one rounding an entry
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = sum(centred[k, k] for k in range(dim)) / (n * n)
    spread = [max(abs(n * high[k] - sums[k]), abs(n * low[k] - sums[k])) for k in range(dim)]
    return Whitening(dim, n, scale, tuple(sums), vectors * signs, values, trace, sum(s * s for s in spread))


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of integer rows; NaN for components without variance."""
    mean = np.array([s / model.n for s in model.sums])
    with np.errstate(invalid="ignore", divide="ignore"):
        deviation = np.where(model.values > NARROW * model.trace, np.sqrt(np.abs(model.values)), np.nan)
        return (y - mean) @ model.vectors / deviation


def identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest entry of (covariance of the whitened vectors - identity), over components with variance, measured on all of them."""
    there = np.flatnonzero(model.values > NARROW * model.trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Means and scatter about them, blocks merged: nothing is multiplied before it is centred.
        n, mean, scatter = 0, np.zeros(len(there)), np.zeros((len(there), len(there)))
        for batch in batches:
            _, y = _integers(batch.column(0), model.dim, model.scale)
            for at in range(0, len(y), BLOCK_ROWS):
                w = _projected(y[at : at + BLOCK_ROWS], model)[:, there]
                m = w.mean(axis=0)
                c, d = w - m, m - mean
                scatter += c.T @ c + np.outer(d, d) * (n * len(w) / (n + len(w)))
                mean, n = mean + d * len(w) / (n + len(w)), n + len(w)
        if n:
            i, j = np.triu_indices(len(there))
            # A whitened mean is next to zero, so what parts add by their own means is small beside the scatter.
            value = (scatter + n * np.outer(mean, mean))[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value), pa.array(n * mean[i] * (i == j))], names=["i", "j", "value", "total"])

    if not len(there):
        return 0.0
    parts = df.select(vector).mapInArrow(run, "i int, j int, value double, total double").groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("total").alias("total"))
    rows = parts.collect()  # one a pair of components
    mean = {r["i"]: r["total"] / model.n for r in rows if r["i"] == r["j"]}
    return max(abs(r["value"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows)


def transform(df: DataFrame, id_column: str, vector: str, model: Whitening, error: float) -> DataFrame:
    """A row for each usable row and component; deviation is decimal where a long could not hold it, and null beyond 38 digits."""
    wide = model.deviation_bound >= 2**63
    kind = df.schema[id_column].dataType.simpleString()
    explained = model.values / model.trace if model.trace else np.full(len(model.values), np.nan)
    k = len(model.values)
    narrow = max(model.deviation_bound, *map(abs, model.sums)) < 2**62  # n * x may pass 64 bits, but comes back when the sum is taken off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows, y = _integers(batch.column(1), model.dim, model.scale)
            for at in range(0, len(rows), BLOCK_ROWS):
                some, part = rows[at : at + BLOCK_ROWS], y[at : at + BLOCK_ROWS]
                if narrow:
                    apart = model.n * part - np.array(model.sums, dtype=np.int64)
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    apart = model.n * part.astype(object) - np.array(model.sums, dtype=object)
                    exact = (apart * apart).sum(axis=1).tolist()
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)) if wide else pa.array(exact, pa.int64())
                each = pa.array(np.repeat(np.arange(len(some)), k))
                w = _projected(part, model).ravel()
                arrays = [ids.take(pa.array(some)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(len(some) * k, model.n)), deviation.take(each), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(some)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained"])

    shape = f"id {kind}, component int, n long, deviation {'decimal(38,0)' if wide else 'long'}, whitened double, explained double"
    out = df.select(id_column, vector).mapInArrow(run, shape)
    return out.select(F.col("id").alias(id_column), "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: every usable row along the leading components.

    An entry c is the integer floor(scale * c); a constant added to all would change nothing here. Unusable are rows whose
    vector is null, has a null or non-finite entry, an entry beyond 2^40 after scaling, or another length than most vectors. Rows may repeat and ids may be null: each row is fitted and returned. A component without variance (rows
    too few or all alike) has a null `whitened`; with no variance at all `explained` is NaN. Fewer dimensions than components give one
    component a dimension. An empty table, or one without a usable row, gives an empty result. Other columns are not returned.
    """
    model = fit(df, vector, components, scale)
    if model is None:
        kind = df.schema[id_column].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return transform(df, id_column, vector, model, identity_error(df, vector, model))
