"""Axes through a vector cloud: moments are summed on the cluster, small matrices are solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import centroids, gram


def moments(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) from one partial matrix per partition, added up by position."""
    one = vectors.select(F.concat(F.array(F.lit(1.0)), F.col(vector).cast("array<double>")).alias("_v"))
    parts = gram(one, "_v").select("rows", F.posexplode("gram").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
    flat = [r["x"] for r in sorted(parts.collect(), key=lambda r: r["p"])]  # (dim + 1)^2 numbers
    m = np.array(flat).reshape(int(len(flat) ** 0.5), -1)
    n = m[0, 0]
    mean = m[0, 1:] / n
    return int(n), mean, m[1:, 1:] / n - np.outer(mean, mean)


def fixed_sign(v: np.ndarray) -> np.ndarray:
    """The sign that makes the entry of largest size positive."""
    return v * np.sign(v[np.abs(v).argmax()] or 1)


def principal(vectors: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, (k, dim) axes) in order of variance."""
    _, mean, cov = moments(vectors, vector)
    _, axes = np.linalg.eigh(cov)
    return mean, np.array([fixed_sign(axes[:, -1 - i]) for i in range(k)])


def contrastive(own: DataFrame, background: DataFrame, vector: str, k: int, shrink: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of largest variance against a background covariance shrunk towards its mean variance."""
    _, mean, a = moments(own, vector)
    _, _, b = moments(background, vector)
    w = np.linalg.inv(np.linalg.cholesky(_shrunk(b, shrink)))
    _, axes = np.linalg.eigh(w @ a @ w.T)
    out = (w.T @ axes)[:, ::-1][:, :k].T
    return mean, np.array([fixed_sign(v / np.linalg.norm(v)) for v in out])


def _unit(v: np.ndarray) -> np.ndarray:
    return fixed_sign(v / (np.linalg.norm(v) or 1.0))


def _shrunk(m: np.ndarray, shrink: float) -> np.ndarray:
    return (1 - shrink) * m + shrink * np.trace(m) / len(m) * np.eye(len(m))


def varimax(axes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """(k, dim) axes of the same space, turned so that each loads on few dimensions."""
    turn = np.eye(len(axes))
    for _ in range(rounds):
        load = axes.T @ turn
        u, _, v = np.linalg.svd(axes @ (load**3 - load * (load**2).mean(0)))
        turn = u @ v
    return np.array([_unit(x) for x in (axes.T @ turn).T])


def independent(vectors: DataFrame, vector: str, k: int, rounds: int = 8) -> np.ndarray:
    """(k, dim) axes of the k principal dimensions along which the rows are least normal: a fixed-point search with tanh, all axes at once.

    Each round is one pass that adds up k x k numbers in each partition.
    """
    _, mean, cov = moments(vectors, vector)
    values, all_ = np.linalg.eigh(cov)
    white = all_[:, -k:] / np.sqrt(np.maximum(values[-k:], 1e-12))
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(k, k)))[0]
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((k, k)), 0
            for b in batches:
                if b.num_rows:
                    z = (b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) - mean) @ white
                    g = np.tanh(z @ turn.T)
                    total += g.T @ z - (1 - g**2).sum(0)[:, None] * turn
                    n += b.num_rows
            if n:
                yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

        sums = vectors.select(vector).mapInArrow(step, "m array<double>").select(F.posexplode("m").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).collect()  # k x k numbers
        u, _, v = np.linalg.svd(np.array([r["x"] for r in sorted(sums, key=lambda r: r["p"])]).reshape(k, k))
        turn = u @ v
    return np.array([_unit(x) for x in turn @ white.T])


def discriminant(vectors: DataFrame, vector: str, label: str, k: int, shrink: float = 0.2) -> np.ndarray:
    """(k, dim) axes along which the labels' means lie farthest apart against the spread within labels; of two labels one such axis is Fisher's."""
    n, mean, cov = moments(vectors, vector)
    sizes = {r[label]: r["n"] for r in vectors.groupBy(label).agg(F.count("*").alias("n")).collect()}
    means = {r[label]: np.array(r["centroid"]) for r in centroids(vectors, label, vector).collect()}  # a row per label
    between = sum(sizes[x] / n * np.outer(m - mean, m - mean) for x, m in means.items())
    w = np.linalg.inv(np.linalg.cholesky(_shrunk(cov - between, shrink)))
    _, axes = np.linalg.eigh(w @ between @ w.T)
    return np.array([_unit(v) for v in (w.T @ axes)[:, ::-1][:, :k].T])


def ridge(vectors: DataFrame, vector: str, target: Column, penalty: float = 0.1) -> np.ndarray:
    """(1, dim): the direction that best predicts the target, such as a time, under a penalty on its length."""
    both = vectors.select(F.concat(F.col(vector).cast("array<double>"), F.array(target.cast("double"))).alias("_b"))
    _, _, cov = moments(both, "_b")
    own = cov[:-1, :-1]
    return _unit(np.linalg.solve(own + penalty * np.trace(own) / len(own) * np.eye(len(own)), cov[:-1, -1]))[None]


def contrast(one: DataFrame, other: DataFrame, vector: str) -> np.ndarray:
    """(1, dim): from the mean of one set of rows to the mean of the other."""
    return _unit(moments(other, vector)[1] - moments(one, vector)[1])[None]


def project(vectors: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, names: list[str]) -> DataFrame:
    """Adds each axis' coordinate. Means and axes are a few rows of the vectors' width."""
    cols = {}
    for name, axis in zip(names, axes, strict=True):
        lit = F.array(*[F.lit(float(x)) for x in axis])
        cols[name] = F.aggregate(F.zip_with(vector, lit, lambda a, b: a.cast("double") * b), F.lit(-float(mean @ axis)), lambda s, x: s + x)
    return vectors.withColumns(cols)
