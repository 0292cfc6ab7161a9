"""Ties by rounded distances, exact hundredths from shards, draws that are not broadcast, and closures that leave leaves out of their rounds."""

import duckdb
import numpy as np
import pytest

from tidemark.operators import closure, stats
from tidemark.plans import registry


def against_sql(spark, path, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracles()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_nearest_core_point_by_rounded_distance(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(40, 2)), 2).tolist()
    # core points so near that squares round alike, the smaller key not the nearest
    rows = [(i, i % 4, [a + d, b]) for i, (a, b, d) in enumerate((a, b, d) for a, b in x for d in (3e-5, 2e-5, 1e-5))] + [(1000 + i, 9, [a, b + (i > 30) * 1e-3]) for i, (a, b) in enumerate(x)]
    got, want = against_sql(spark, tmp_path, "mp4_outlier_absorb", embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert got == want


def test_gathered_vectors_are_whole(spark, tmp_path):
    e = spark.createDataFrame([(i, [i / 1000 + 0.00499]) for i in range(0, 400, 2)], "vec_id long, embedding array<float>")
    got, want = against_sql(spark, tmp_path, "src16_vector_gather", embeddings=e, documents=spark.range(400).withColumnRenamed("id", "doc_id"))
    assert [(d, ok, x and round(x, 6)) for d, ok, x in got] == [(d, ok, x and round(x, 6)) for d, ok, x in want]


def test_draws_are_not_broadcast(spark):
    rows = spark.range(500).selectExpr("id % 40 AS user_id", "CAST(id AS DOUBLE) AS value")
    plan = stats.cluster_bootstrap(rows, 10, "user_id", "value")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [i#" not in plan and "Generate" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_any_edges(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 30, (30, 2)).tolist()} | {("l1", "n1"), ("l2", "l3"), ("n2", "l4"), ("l5", "n1"), ("l5", "n2")}
    reach = {e for e in edges if e[0] != e[1]}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c and a != d} - reach:
        reach |= more
    got = [tuple(r) for r in closure.transitive(spark.createDataFrame(list(edges), "child string, parent string")).collect()]
    assert len(got) == len(set(got)) and set(got) == reach


def test_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    seen = []
    cut = closure.cut

    def counted(df):
        df = cut(df)
        seen.append(df.count())
        return df

    monkeypatch.setattr(closure, "_doubled", lambda paths, rounds, of=getattr(closure, "_doubled"): of(counted(paths), rounds))
    closure.transitive(spark.createDataFrame([(f"l{i}", f"n{i % 3}") for i in range(200)] + [("n0", "n1"), ("n1", "n2"), ("n2", "w")], "child string, parent string")).collect()
    assert seen == [2]
