"""Registered queries against DuckDB or brute force on the test tables, and the signatures against exact similarity."""

from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anisotropic_ann, dart_minhash, queries, secret_scan


def near_classes(docs, threshold=0.8):
    sets, index = {}, defaultdict(list)
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
        for g in sets[i]:
            index[g].append(i)
    shared = defaultdict(int)
    for own in index.values():
        for a, b in combinations(sorted(own), 2):
            shared[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracles(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.ORACLES[name]).fetch_df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, got[order].astype(object).values.tolist())) == sorted(map(repr, want[order].astype(object).values.tolist()))


def test_near_duplicates_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op1_dart_minhash(spark, sf).collect()}
    assert got == near_classes(docs)


def test_large_near_copy_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(300):
        words = list(base)
        for j in rng.choice(200, 3, replace=False):
            words[j] = f"x{i}{j}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(base[:60] + [f"own{i}n{j}" for j in range(140)])) for i in range(100)]  # share a passage only
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_classes(docs)


def test_repeated_ids_with_other_texts(spark):
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = dart_minhash.near_duplicates(frame([(1, x), (1, y), (2, y), (3, y), (4, x)])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1} and all(r["n_shingles"] == 26 for r in got)
    got = dart_minhash.near_duplicates(frame([(5, x), (5, y), (2, y), (3, y), (4, x), (6, None), (6, x), (6, x)]), carry=("text",)).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["class_id"]) for r in got) == sorted([(5, x, 4), (5, y, 2), (2, y, 2), (3, y, 2), (4, x, 4), (6, "", 6), (6, x, 4), (6, x, 4)])


def test_repeated_ids_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(8):
            words = list(base)
            for j in rng.choice(80, int(rng.integers(0, 5)), replace=False):
                words[j] = f"n{rng.integers(10**6)}"
            rows.append((int(rng.integers(0, 25)), " ".join(words)))
    rows = list(dict.fromkeys(rows))
    want = near_classes([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, 99), rows[i][0])
    got = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), carry=("text",)).collect()
    assert {(r["doc_id"], r["text"]): r["class_id"] for r in got} == {rows[i]: least[c] for i, c in want.items()}


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_agreement_is_weighted_jaccard(weighted):
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 120).astype(np.uint64)
    w = rng.gamma(2.0, 1.0, (2, 120)) if weighted else np.ones((2, 120))
    a, b = slice(0, 90), slice(30, 120)
    sig = dart_minhash.signatures(np.repeat([0, 1], 90), np.concatenate([h[a], h[b]]), np.concatenate([w[0][a], w[1][b]]), 2, 2048)
    x, y = np.zeros(120), np.zeros(120)
    x[a], y[b] = w[0][a], w[1][b]
    assert (sig > 0).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 203), (201, 203), (202, 203)]
    got = {r["node"]: r["label"] for r in dart_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 204)}}
    assert dart_minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_kept_ledger_gives_what_a_whole_scan_gives(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {(r["path"]["doc_id"], r["path"]["version"]): r["text"] for r in queries.two_versions(docs).collect()}
    got = {(r["doc_id"], r["version"]): r["spans"] for r in queries.secret_ledger_rescan(spark, sf).collect()}
    assert {v for _, v in got} == {1, 2} and set(got) == set(text)
    for k, t in text.items():
        assert sorted(filter(None, got[k].split(","))) == sorted(f"{kind}:{a}:{b}" for a, _, b, kind in secret_scan.find(t or "", secret_scan.RULES))
    base = secret_scan.RULES[:3]
    known = secret_scan.scan_new(docs, rules=base).cache()
    again = secret_scan.scan_new(docs, known).collect()
    assert again and all(set(r["rules"]) == {x.name for x in secret_scan.RULES[3:]} for r in again)


def test_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    hits = 0
    got = queries.op7_anisotropic_ann(spark, sf).toPandas()
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(own.vec_id))
    assert hits >= 0.9 * len(got)


def test_recall_on_many_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50_000, 32)).astype(np.float32)
    x[1000:1400] = x[1000]  # copies
    v = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}))
    got = anisotropic_ann.nearest(v, F.col("id") % 1000 == 0).toPandas()
    assert len(got) == 500
    hits, x = 0, x.astype(float)
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(own.vec_id))
    assert hits >= 0.95 * len(got)


def test_anisotropic_codes_lower_their_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16))
    book = anisotropic_ann.train(x)
    book = anisotropic_ann.Book(16, book.centres, 5.0)
    codes = anisotropic_ann.encode(book, x)
    r = x - book.centres[np.arange(8), codes].reshape(500, 16)
    along = (r * x).sum(1) / np.linalg.norm(x, axis=1)
    plain = anisotropic_ann.encode(anisotropic_ann.Book(16, book.centres, 1.0), x)
    r0 = x - book.centres[np.arange(8), plain].reshape(500, 16)
    along0 = (r0 * x).sum(1) / np.linalg.norm(x, axis=1)
    loss = lambda r, a: ((r**2).sum(1) + (book.eta - 1) * a**2).mean()
    assert loss(r, along) < loss(r0, along0)
