"""Embedding whitening from an exact integer scatter.

Vectors become integers. Their scatter is accumulated without rounding: a fixed integer vector is subtracted, each task
multiplies blocks of rows in limbs small enough for exact products in floating point, and sums go into Python's integers.
n X'X - SS' is formed from the totals, still exact, so a mean that is huge beside the spread costs no digit; only then is
it divided, and decomposed by eigh. Of the data, the driver sees d^2 numbers for each of a few groups of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, finite, matrix

#: A product of two limbs of LIMB bits, summed over BLOCK rows, is below 2^53.
LIMB, BLOCK = 21, 1024
_BIG = 1 << 61


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x of integers, as Python's integers."""
    dim = x.shape[1]
    out = np.zeros((dim, dim), object)
    if not len(x):
        return out
    if x.dtype == object:
        return out + x.T.dot(x)
    top = int(np.abs(x).max())
    limbs = []
    while top >> LIMB:
        limbs.append(x & ((1 << LIMB) - 1))
        x, top = x >> LIMB, (top >> LIMB) + 1
    limbs = [part.astype(float) for part in [*limbs, x]]
    for i, p in enumerate(limbs):
        for j, q in enumerate(limbs):
            products = np.zeros((dim, dim), np.int64)  # each block adds less than 2^53, an Arrow batch has far fewer than 2^9 blocks
            for at in range(0, len(p), BLOCK):
                products += (p[at : at + BLOCK].T @ q[at : at + BLOCK]).astype(np.int64)
                if at % (256 * BLOCK) == 255 * BLOCK:
                    out += products.astype(object) << (LIMB * (i + j))
                    products[:] = 0
            out += products.astype(object) << (LIMB * (i + j))
    return out


def shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, in Python's integers where a long could overflow."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(shift.astype(float)).max(initial=0)) >= _BIG:
        return x.astype(object) - shift.astype(object)
    return x - shift


def _scatter(shift: np.ndarray):
    """Rows (x) as one row: their number, sums and cross-products of x - shift, as decimal text."""
    dim = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            if batch.num_rows:
                x = shifted(matrix(batch.column(0)), shift)
                n += len(x)
                sums += (x.sum(0) if x.dtype == object or np.abs(x).max() < 1 << 40 else x.astype(object).sum(0)).astype(object)
                cross += exact_gram(x)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([list(map(str, sums))]), pa.array([list(map(str, cross[np.triu_indices(dim)]))])], names=["n", "sums", "cross"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, totals = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            n += row["n"]
            new = [np.array(list(map(int, row[c])), object) for c in ("sums", "cross")]
            totals = new if totals is None else [a + b for a, b in zip(totals, new, strict=True)]
    if n:
        yield pa.record_batch([pa.array([n]), *(pa.array([list(map(str, t))]) for t in totals)], names=["n", "sums", "cross"])


@dataclass(frozen=True)
class Axes:
    """n vectors less `shift` sum to `sums`; unit axes (dim, k), their eigenvalues, and the trace of the covariance."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as longs where the squares of a row add up within a long, else as Python's integers."""
        x = shifted(x, self.shift)
        most = max(map(abs, map(int, (x.min(), x.max())))) * self.n + max(map(abs, self.sums))
        if most**2 * x.shape[1] < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whiten(self, away: np.ndarray) -> np.ndarray:
        return (away / self.n).astype(float) @ self.axes / np.sqrt(self.values)


def decompose(n: int, shift: np.ndarray, sums: np.ndarray, cross: np.ndarray, components: int) -> Axes:
    """Eigenvectors of (n X'X - SS') / n^2, largest first; an axis' largest entry (the first of equals) is positive.

    Eigenvalues that are rounding beside the largest (d eps of it) belong to directions without spread and are left out.
    """
    scatter = cross * n - np.outer(sums, sums)
    cov = np.array([[v / (n * n) for v in row] for row in scatter.tolist()])  # quotients of integers, rounded once
    trace = sum(scatter.diagonal().tolist()) / (n * n)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > len(cov) * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    sign = np.sign(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0))
    return Axes(n, shift, sums, axes * sign, values, trace)


def _projected(a: Axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = a.whiten(a.away(matrix(batch.column(0))))
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.record_batch([pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], names=["w"])

    return run


def _rows(a: Axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = a.away(matrix(batch.column(1)))
            w = a.whiten(away)
            if away.dtype == object:
                deviation = pa.array([str(d) for d in (away**2).sum(1)])
            else:
                deviation = pa.array(np.einsum("ij,ij->i", away, away)).cast(pa.string())
            k = w.shape[1]
            each = pa.array(np.repeat(np.arange(len(w)), k))
            number = np.tile(np.arange(k, dtype=np.int32), len(w))
            columns = [batch.column(0).take(each), pa.array(number + 1), deviation.take(each), pa.array(w.reshape(-1)), pa.array((a.values / a.trace)[number])]
            yield pa.record_batch(columns, names=["_key", "component", "deviation", "whitened", "explained"])

    return run


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """Each vector on each of the first components: key, component (from 1), n, deviation, whitened, explained and
    identity_error.

    Entries become floor(scale * c), which saturates at the range of a long. Null and empty vectors, those with null or
    non-finite entries, and those of another length than the commonest (ties: the longer) are dropped. The covariance is
    that of the distinct integer vectors, n in number; deviation is the sum of (n x - S)^2 in decimal text, exact at any
    size; identity_error is measured on the whitened values of the distinct vectors. Directions without spread are no
    components, so fewer than asked for may come, and none, hence no rows, if all vectors are equal. Repeated and null
    keys are rows of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(key)).dtypes[0][1]
    held = cut(finite(vectors, key=key, vector=vector).select("_key", F.transform("v", lambda c: F.floor(c * scale)).alias("x")))
    length = held.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    held = held.where(F.size("x") == (length["dim"] if length else 0))
    fit = cut(held.select("x").distinct())
    result = f"{key} {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    if not length:
        return spark.createDataFrame([], result)
    shift = np.array(fit.agg(F.min("x")).first()[0], np.int64)  # any fixed vector near the others will do
    dim, totals = len(shift), "n long, sums array<string>, cross array<string>"
    few = max(1, isqrt(fit.rdd.getNumPartitions()))
    parts = fit.mapInArrow(_scatter(shift), totals).repartition(few).mapInArrow(_merge, totals).collect()
    n = sum(r["n"] for r in parts)
    sums = sum(np.array(list(map(int, r["sums"])), object) for r in parts)
    cross = np.zeros((dim, dim), object)
    upper = np.triu_indices(dim)
    cross[upper] = sum(np.array(list(map(int, r["cross"])), object) for r in parts)
    cross.T[upper] = cross[upper]
    a = decompose(n, shift, sums, cross, components)
    k = len(a.values)
    if not k:
        return spark.createDataFrame([], result)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    measured = fit.mapInArrow(_projected(a), "w array<double>").agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    out = held.mapInArrow(_rows(a), f"_key {kind}, component int, deviation string, whitened double, explained double")
    return out.select(F.col("_key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
