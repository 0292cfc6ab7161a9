"""Approximate nearest neighbours: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking.

Vectors are cut into two-dimensional parts, each coded by one of 16 centres. Codes and centres minimise
|r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r, so the residual along the vector, which is what moves large inner
products, costs eta times as much. Codes are stored two to a byte, with the length of the residual. A block of queries meets a block
of codes in one task: each query scores the block by look-ups in its tables and compares the best few exactly. Their k-th
distance is a bound: a row cannot be nearer than its code less its residual, so rows beyond the bound are left out and the
others are compared too. Nothing is lost, however the vectors lie; where codes tell little, more is compared. Vectors and
queries stay in DataFrames; only the sample that the centres are fitted on is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

CENTRES, PART = 16, 2
#: Queries and rows that meet in one task, about; both bound its memory.
QUERY_BLOCK, CODE_BLOCK = 1024, 1 << 16


@dataclass(frozen=True)
class Book:
    dim: int
    centres: np.ndarray  # (parts, CENTRES, PART)
    eta: float


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros((len(x), parts * PART))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, PART)


def encode(book: Book, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """(n, parts) codes: coordinate descent on the anisotropic loss, from the nearest centres."""
    parts = len(book.centres)
    p = _parts(x, parts)
    u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    codes = np.zeros((len(x), parts), np.uint8)
    along = np.zeros((len(x), parts))
    for m in range(parts):
        codes[:, m] = ((p[:, m, None, :] - book.centres[m]) ** 2).sum(2).argmin(1)
        along[:, m] = ((p[:, m] - book.centres[m][codes[:, m]]) * u[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(parts):
            r = p[:, m, None, :] - book.centres[m]
            a = (r * u[:, m, None, :]).sum(2)
            loss = (r**2).sum(2) + (book.eta - 1) * ((total - along[:, m])[:, None] + a) ** 2
            codes[:, m] = loss.argmin(1)
            new = np.take_along_axis(a, codes[:, m, None].astype(int), 1)[:, 0]
            total += new - along[:, m]
            along[:, m] = new
    return codes


def train(sample: np.ndarray, *, threshold: float = 0.2, rounds: int = 8, seed: int = 5) -> Book:
    """Centres from a sample (n, dim); threshold is the T of eta = (d - 1) T^2 / (1 - T^2)."""
    dim = sample.shape[1]
    parts = -(-dim // PART)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    p = _parts(sample, parts)
    rng = np.random.default_rng(seed)
    centres = np.stack([p[rng.choice(len(p), CENTRES, replace=len(p) < CENTRES), m] for m in range(parts)])
    u = p / np.maximum(np.linalg.norm(sample, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        book = Book(dim, centres.copy(), eta)
        codes = encode(book, sample, 1)
        along = ((p - np.stack([centres[m][codes[:, m]] for m in range(parts)], 1)) * u).sum(2)
        total = along.sum(1)
        for m in range(parts):
            other = total - along[:, m]
            outer = u[:, m, :, None] * u[:, m, None, :]
            # sum over members of (I + (eta-1) uu') c = sum of x + (eta-1) u (u.x + residual of the other parts)
            right = p[:, m] + (eta - 1) * u[:, m] * ((u[:, m] * p[:, m]).sum(1) + other)[:, None]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if n := int(own.sum()):
                    centres[m, c] = np.linalg.solve(n * np.eye(PART) + (eta - 1) * outer[own].sum(0), right[own].sum(0))
    return Book(dim, centres, eta)


def usable(vectors: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: finite, not null or zero, of the commonest length (ties: the longer)."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores of a row; among equals the earlier ones."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, k - 1)[k - 1]
    under = np.flatnonzero(scores < edge)
    return np.concatenate([under, np.flatnonzero(scores == edge)[: k - len(under)]])


def _encoded(book: Book):
    """Rows (id, v) as (id, norm, off, code, v): norm and residual of the coded vector, two parts' codes to a byte, the first in the low half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            codes = encode(book, x)
            held = book.centres[np.arange(codes.shape[1]), codes]
            off = np.sqrt(((_parts(x, codes.shape[1]) - held) ** 2).sum((1, 2)))
            if codes.shape[1] % 2:
                codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
            yield pa.record_batch([batch.column(0), pa.array((held**2).sum((1, 2))), pa.array(off), code, batch.column(1)], names=["id", "norm", "off", "code", "v"])

    return run


def _distances(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - query
    return np.sqrt(np.einsum("nd,nd->n", d, d))


def _scan(book: Book, k: int, rerank: int):
    """A block of queries (id, v) and a block of rows (id, norm, off, code, v): each query's k nearest, and what is as near but for rounding."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("approx", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        queries, ids = matrix(asked.column("v")), asked.column("id").to_numpy()
        own = held.column("id").to_numpy()
        order = np.argsort(own, kind="stable")
        own, norms, off, x = own[order], held.column("norm").to_numpy()[order], held.column("off").to_numpy()[order], matrix(held.column("v"))[order]
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(own), -1)[order].T.copy()
        tables = -2 * np.einsum("qmd,mcd->qmc", _parts(queries, len(book.centres)), book.centres)
        if tables.shape[1] % 2:
            tables = np.concatenate([tables, np.zeros((len(tables), 1, CENTRES))], 1)
        pairs = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(tables), -1, CENTRES * CENTRES)
        out = []
        for q in range(len(ids)):
            square = (queries[q] ** 2).sum()
            approx = norms + square
            for m in range(len(codes)):
                approx += pairs[q, m].take(codes[m])
            approx[own == ids[q]] = np.inf
            near = _top(approx, max(k, rerank))
            near = near[own[near] != ids[q]]
            far = _distances(queries[q], x[near])
            if len(far) >= k:
                bound = np.partition(far, k - 1)[k - 1]
                # squares of sums are off by rounding; whatever is not surely beyond the bound is compared (NaN is not)
                slack = 1e-12 * (norms + square)
                rest = ~(approx - slack > (bound * (1 + 1e-9) + off) ** 2)
                rest[near] = False
                rest = np.flatnonzero(rest & (own != ids[q]))
                near, far = np.concatenate([near, rest]), np.concatenate([far, _distances(queries[q], x[rest])])
                keep = ~(far > np.partition(far, k - 1)[k - 1] * (1 + 1e-9))
                near, far = near[keep], far[keep]
            out.append((np.full(len(near), ids[q]), own[near], far))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, rerank: int = 512,
    sample_rows: int = 10_000, threshold: float = 0.2,
) -> DataFrame:
    """Each query's k nearest other rows by Euclidean distance: query_id, rank (from 1), the key and score.

    is_query: a condition on the column `id`. Centres are fitted on about sample_rows rows (by a hash of key and
    vector); every row is coded and scanned. In each block a query's best `rerank` rows are compared exactly, and then those
    that the codes' error does not rule out, so the k are the true ones. Nulls,
    zero vectors, null or non-finite components and vectors of another length than the commonest take no part; equal
    distances go to the smaller key; rows with the query's key are never its neighbours; a repeated query key is one
    query (its smallest vector), and a repeated neighbour is one neighbour for each vector it has; without usable rows
    the result is empty.
    """
    rows = usable(vectors, key=key, vector=vector)
    n = rows.count()
    draw = F.shiftrightunsigned(F.xxhash64("id", "v"), 2)
    share = min(1.0, sample_rows / max(1, n))
    sample = sorted((r["id"], r["v"]) for r in rows.where(draw < int(share * 2.0**62)).dropDuplicates().collect()) if n else []
    if not sample:
        sample = [(r["id"], r["v"]) for r in rows.orderBy("id").limit(CENTRES).collect()]
    schema = f"query_id long, rank int, {key} long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    book = train(np.array([v for _, v in sample]), threshold=threshold)
    asked = cut(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    # of equal vectors only the k + 1 smallest keys can be answers, so copies do not crowd the rest out
    rows = cut(rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r"))
    codes = cut(rows.mapInArrow(_encoded(book), "id long, norm double, off double, code binary, v array<double>"))
    # tiles: every block of queries with every block of codes, at least two for each shuffle partition
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-asked.count() // QUERY_BLOCK))
    down = max(-(-n // CODE_BLOCK), min(-(-n // 1024), -(-2 * parts // across)))
    number = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(across))).withColumn("_d", number(down))
    right = codes.withColumn("_d", F.pmod(F.xxhash64("code", "id"), F.lit(down))).withColumn("_a", number(across))
    tile = [F.col("_a").cast("long"), F.col("_d").cast("long")]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_scan(book, k, rerank), "query_id long, id long, approx double")
    first = Window.partitionBy("query_id").orderBy("approx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = found.withColumn("edge", F.coalesce(F.nth_value("approx", k).over(first), F.lit(float("inf"))) * (1 + 1e-9))
    best = cut(best.where("approx <= edge OR isnan(edge)").select("query_id", "id").distinct())
    exact = best.join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = exact.select("query_id", "id", F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
