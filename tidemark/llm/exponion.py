"""Centroid clustering: Lloyd's rounds over integer vectors, exact, with exponion search.

A vector keeps an upper bound on the distance to its centroid and a lower bound on the distance to every other one. While
the upper bound is below the lower one, or below half the way to the next centroid, nothing is computed. Otherwise the
distance is taken exactly, and if that does not settle it, only centroids in the ball of radius 2 u + s around the
vector's centroid are scanned, in the order of its list of distances to the others (u: the vector's distance, s: the way
to the nearest other centroid). The nearest and the second nearest lie in that ball; its edge belongs to it and bounds
are widened by more than their rounding, so ties are always compared. Distances are compared as integers.

A round is one pass: each task reads its vectors with their bounds, and writes both, and the counts and sums of its
clusters, to the shared folder, where a lost executor costs nothing; the pass before is then deleted. Only counts and sums
of clusters reach the driver, whose number is that of clusters times dimensions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import delete, ensure_checkpoint_dir, finite, matrix

#: Factors that widen a bound by more than the rounding of the few operations behind it.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Components up to here have squared distances that fit a long in up to 256 dimensions; beyond, Python's integers are used.
SMALL = 1 << 26


def _wide(x: np.ndarray) -> bool:
    """Whether squared distances need Python's integers."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0))) > SMALL or x.shape[-1] > 256


def _squared(x: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    """Exact squared distances of the rows of x from c."""
    if wide:
        x, c = x.astype(object), c.astype(object)
        return ((x - c) ** 2).sum(1) if len(x) else np.zeros(0, object)
    away = x - c
    return np.einsum("ij,ij->i", away, away)


@dataclass(frozen=True)
class Centroids:
    """Centroids (k, dim), their mutual distances in rising order, and how far each has moved in the last round."""

    at: np.ndarray
    order: np.ndarray
    away: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        wide = _wide(at) or before is not None and _wide(before)
        apart = np.stack([np.sqrt(_squared(at, c, wide).astype(float)) for c in at])
        order = np.argsort(apart, axis=1, kind="stable")
        moved = np.zeros(len(at)) if before is None else np.sqrt([float(_squared(a[None], b, wide)[0]) for a, b in zip(at, before, strict=True)])
        return Centroids(at, order, np.take_along_axis(apart, order, 1), moved)


def assign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (the smaller number in a tie), new bounds, and how many distances it took."""
    k, wide = len(c.at), _wide(x) or _wide(c.at)
    a, scans = a.copy(), np.zeros(len(x), np.int64)
    others = np.array([np.delete(c.moved, j).max(initial=0.0) for j in range(k)])
    u = (u + c.moved[a]) * UP
    low = (low - others[a]) * DOWN
    next_to = c.away[:, 1] if k > 1 else np.full(1, np.inf)
    settled = lambda i: u[i] < np.maximum(low[i], next_to[a[i]] / 2 * DOWN)
    live = np.flatnonzero(~settled(slice(None)))
    for j in np.unique(a[live]):
        i = live[a[live] == j]
        u[i] = np.sqrt(_squared(x[i], c.at[j], wide).astype(float)) * UP
        scans[i] += 1
    live = live[~settled(live)]
    for j in np.unique(a[live]):
        i = live[a[live] == j]
        reach = np.searchsorted(c.away[j] * DOWN, (2 * u[i] + (next_to[j] if k > 1 else 0.0)) * UP, "right")
        best, second, near = np.empty(len(i), object if wide else np.int64), np.full(len(i), np.inf), np.full(len(i), -1)
        for place, m in enumerate(c.order[j]):
            inside = np.flatnonzero(reach > place)
            if not len(inside):
                break
            d = _squared(x[i[inside]], c.at[m], wide)
            scans[i[inside]] += 1
            if not place:
                best[inside], near[inside] = d, m
                continue
            held = best[inside]
            wins = ((d < held) | ((d == held) & (m < near[inside]))).astype(bool)
            second[inside] = np.minimum(second[inside], np.sqrt(np.where(wins, held, d).astype(float)))
            best[inside[wins]], near[inside[wins]] = d[wins], m
        a[i], u[i], low[i] = near, np.sqrt(best.astype(float)) * UP, second * DOWN
    return a, u, low, scans


def _passed(c: Centroids, last: bool, schema: pa.Schema):
    """One pass: rows (_key, x, a, u, low, scans) as they were, and after them one row of counts and sums for each cluster met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = c.at.shape
        n, sums, far = np.zeros(k, np.int64), np.zeros((k, dim), object), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (a, u, low, scans) = matrix(batch.column(1)), (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            a, u, low, took = assign(x, a.astype(np.int64), u, low, c)
            n += np.bincount(a, minlength=k)
            wide = _wide(x) or _wide(c.at)
            away = np.zeros(len(x), object)
            for j in np.unique(a):
                sums[j] += (x[a == j].astype(object) if wide else x[a == j]).sum(0).astype(object)
                if last:
                    away[a == j] = d = _squared(x[a == j], c.at[j], wide)
                    far[j] += int(d.sum())
            distance = pa.array([int(d) if d < 1 << 63 else None for d in away] if last else [None] * len(x), pa.int64())
            none = pa.nulls(len(x))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(a.astype(np.int32)), pa.array(u), pa.array(low), pa.array(scans + took), distance, *(none.cast(f.type) for f in list(schema)[7:])], schema=schema)
        met = np.flatnonzero(n)
        if len(met):
            blank = lambda i: pa.nulls(len(met), schema.field(i).type)
            totals = [pa.array([list(map(str, sums[j])) for j in met]), pa.array([str(far[j]) for j in met])]
            yield pa.record_batch([blank(0), blank(1), pa.array(met.astype(np.int32)), *map(blank, range(3, 7)), pa.array(n[met]), *totals], schema=schema)

    return run


def _key_type(name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(name))


def cluster(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dim: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """Each vector's cluster after `rounds` rounds: key, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 and scans, the number of distances it took in all rounds.

    Vectors of another length than dim, null ones and those with null or non-finite components take no part; components
    become floor(scale * x), which saturates at the range of a long. The first centroids are the vectors with the
    smallest SHA-256 of `seed:key` (a null key comes last, ties go to the smaller vector); of fewer vectors than clusters
    each is one. A centroid becomes the floor of its vectors' mean; one without vectors stays. Distances and sums that
    exceed a long are null. Repeated keys are rows of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    kind = vectors.select(F.col(key)).dtypes[0][1]
    kept = finite(vectors, key=key, vector=vector).where(F.size("v") == dim).select("_key", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256).asc_nulls_last(), "x").limit(clusters).select("x").collect()
    result = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans long"
    if not first:
        return spark.createDataFrame([], result)
    at = np.array([r["x"] for r in first], np.int64)
    fields = f"_key {kind}, x array<long>, a int, u double, low double, scans long, distance long, n long, sums array<string>, far string"
    types = [_key_type(kind), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
    schema = pa.schema(list(zip((f.split()[0] for f in fields.split(", ")), types, strict=True)))
    state = kept.select("_key", "x", F.lit(0).alias("a"), F.lit(float("inf")).alias("u"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("scans"))
    folder, before = f"{spark.sparkContext.getCheckpointDir()}/exponion-{uuid.uuid4().hex}", None
    for r in range(rounds + 1):
        state.mapInArrow(_passed(Centroids.of(at, before), r == rounds, schema), fields).write.parquet(f"{folder}/{r}")
        if r:
            delete(spark, f"{folder}/{r - 1}")
        written = spark.read.schema(fields).parquet(f"{folder}/{r}")
        state = written.where("n IS NULL").select("_key", "x", "a", "u", "low", "scans")
        totals = written.where("n IS NOT NULL")
        if r < rounds:
            sums = totals.select("a", "n", F.posexplode("sums").alias("place", "s")).groupBy("a", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
            before, at = at, at.copy()
            for row in sums.collect():
                at[row["a"], row["place"]] = int(row["s"]) // row["n"]
    inertia = {row["a"]: int(row["far"]) for row in totals.groupBy("a").agg(F.sum(F.col("far").cast("decimal(38,0)")).alias("far")).collect()}
    fits = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    of = lambda values: F.array(*values)[F.col("a")]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    return written.where("n IS NULL").select(
        F.col("_key").alias(key), F.col("a").alias("cluster"), "distance", of([fits(inertia.get(j, 0)) for j in range(len(at))]).alias("cluster_inertia"),
        fits(sum(inertia.values())).alias("inertia"), of([F.lit(x) for x in names]).alias("centroid_sha256"), "scans",
    )


def oracle_sql(clusters: int = 8, rounds: int = 10) -> str:
    """The same clustering in DuckDB, a common table for each round."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    nearest = f"SELECT v.vec_id, v.x, arg_min(struct_pack(j := c.j, d := {apart}), struct_pack(d := {apart}, j := c.j)) AS a FROM kept v CROSS JOIN c{{r}} c GROUP BY v.vec_id, v.x"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT a.j AS j, place, sum(x[place])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS place) GROUP BY ALL),
m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::BIGINT AS j, x FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {clusters}),
{",\n".join(steps)}
SELECT a.vec_id, a.a.j::BIGINT AS cluster, a.a.d::BIGINT AS distance, (sum(a.a.d) OVER (PARTITION BY a.a.j))::BIGINT AS cluster_inertia, (sum(a.a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.a.j"""
