"""Exponion clusters, the shingle join and exact whitening against plain Python, and on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import exponion, ngram_join, queries, whitening

VECTORS = "vec_id long, embedding array<double>, x long, a int, n long, u double, w double, _key string"
NAN, INF = float("nan"), float("inf")


def table(spark, items):
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5, 0.5, "k") for i, v in items], VECTORS)


def lloyd(items, dim, k, rounds, scale, seed):
    """{(key, vector): (cluster, distance)} and centroids, in Python's integers."""
    rows = [(i, tuple(min(max(int(np.floor(scale * c)), -(1 << 63)), (1 << 63) - 1) for c in v)) for i, v in items if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c, strict=True))
    for r in range(rounds + 1):
        a = [min(range(len(at)), key=lambda j: (far(v, at[j]), j)) for _, v in rows]
        if r < rounds:
            for j in range(len(at)):
                own = [v for (_, v), m in zip(rows, a, strict=True) if m == j]
                if own:
                    at[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i, m, far(v, at[m])) for (i, v), m in zip(rows, a, strict=True)), key=str), at


def check_clusters(spark, items, *, dim, k, rounds=4, scale=4, seed=3):
    got = exponion.cluster(table(spark, items), dim=dim, clusters=k, rounds=rounds, scale=scale, seed=seed).collect()
    want, at = lloyd(items, dim, k, rounds, scale, seed)
    fits = lambda d: d if d < 1 << 63 else None
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(((i, m, fits(d)) for i, m, d in want), key=str)
    for r in got:
        assert r["inertia"] == fits(sum(d for _, _, d in want)) and r["cluster_inertia"] == fits(sum(d for _, m, d in want if m == r["cluster"]))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()
    return got


def test_clusters_with_ties_and_repeats(spark):
    rng = random.Random(5)
    grid = [(i, [rng.randint(-3, 3) / 4 for _ in range(2)]) for i in range(300)]  # many equal vectors and equal distances
    check_clusters(spark, grid + [(7, [0.0, 0.0])] * 40 + [(None, [0.25, -0.5]), (8, None), (9, [1.0]), (10, [1.0, None]), (11, [NAN, 1.0]), (12, [INF, 1.0]), (13, [])], dim=2, k=6)


def test_clusters_far_apart_are_not_scanned(spark):
    rng = np.random.default_rng(2)
    items = [(i, (rng.normal(size=4) + 400 * (i % 5) * (np.arange(4) == i % 4)).tolist()) for i in range(400)]
    got = check_clusters(spark, items, dim=4, k=8, rounds=6, scale=64)
    assert sum(r["scans"] for r in got) < 0.6 * len(got) * 8 * 7  # of rows x centroids x passes


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, [1.0, 2.0])], [(2, [1.0, 1.0])] * 5, [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)], [(i, [2.0**33 + i, -(2.0**40) * i]) for i in range(9)]])
def test_few_equal_and_huge_vectors(spark, items):
    check_clusters(spark, items, dim=2, k=3)


def test_small_clustering_by_bounds_alone():
    """Passes with kept bounds against full scans, as centroids move."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (500, 3))
    at = x[:12].copy()
    a, u, low, before = np.zeros(500, int), np.full(500, np.inf), np.zeros(500), None
    for _ in range(12):
        a, u, low, _ = exponion.assign(x, a, u, low, exponion.Centroids.of(at, before))
        d = ((x[:, None] - at) ** 2).sum(2)
        assert (a == d.argmin(1)).all() and (u >= np.sqrt(d.min(1)) - 1e-9).all()
        before, at = at, np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else at[j] for j in range(12)])


def shingles(text, n=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(items, percent=80):
    sets = [(i, shingles(t)) for i, t in items]
    label = list(range(len(sets)))
    for p, (i, s) in enumerate(sets):
        for q in range(p):
            j, r = sets[q]
            if s and r and i is not None and j is not None and 100 * len(s & r) >= percent * len(s | r) and label[p] != label[q]:
                old, new = label[p], label[q]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(sets, label, strict=True):
        least[x] = i if least.get(x) is None else min(i, least[x]) if i is not None else least[x]
    return sorted(((i, len(s), least[x]) for (i, s), x in zip(sets, label, strict=True)), key=str)


def check_join(spark, items):
    docs = spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in items], "doc_id long, text string, _key string, node long, size int, f1 long")
    assert sorted((tuple(r) for r in ngram_join.link_documents(docs).collect()), key=str) == components(items)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in words)


def test_join_of_chains_groups_and_hot_passages(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 4000)}"
    items, base = [], [word() for _ in range(120)]
    items += [(i, edited(rng, base, 0.012)) for i in range(40)]  # near copies, not all of which link
    chain = [word() for _ in range(80)]
    for i in range(40, 60):  # each differs from the one before by a word or two
        chain = chain[:]
        chain[rng.randrange(80)] = word()
        items.append((i, " ".join(chain)))
    hot = [word() for _ in range(60)]
    items += [(i, " ".join([*hot, *[word() for _ in range(rng.randint(3, 30))]])) for i in range(60, 110)]  # one passage in all
    items += [(i, " ".join(word() for _ in range(rng.randint(1, 7)))) for i in range(110, 140)]
    items += [(200, items[3][1]), (201, items[3][1].upper()), (201, items[50][1]), (202, "the same four words"), (203, "The  same\tfour\nwords")]
    rng.shuffle(items)
    check_join(spark, items)


def test_join_at_the_threshold(spark):
    """Sets of 4 in 5 and of 39 in 49 shingles: the first pair links, the second does not."""
    words = [f"a{i}" for i in range(60)]
    check_join(spark, [(1, " ".join(words[:8])), (2, " ".join(words[:9])), (3, " ".join(words[20:24] + words[24:59])), (4, " ".join(words[20:24] + words[24:50] + ["q"] * 3))])
    check_join(spark, [(i, " ".join(words[:n])) for i, n in enumerate((9, 11, 14, 16, 19, 23, 28, 34, 41))])


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, ""), (2, " \t\n"), (3, "x"), (3, "x"), (None, "x"), (4, "X"), (None, None)], [(7, "one long text " * 9000), (8, "one long text " * 9000 + "more")]])
def test_join_of_nulls_empties_and_long_texts(spark, items):
    check_join(spark, items)


def test_prefix_takes_the_cheapest_number_of_matches():
    held = np.sort(np.random.default_rng(1).integers(2, 900, 90))
    match, length = ngram_join.prefix(100, held, 80)
    cost = lambda n: (held[: 90 - 80 + n] - 1).sum() * (1 + ngram_join.VERIFY * 100 / n)
    assert cost(match) == min(map(cost, range(1, 81))) and length == 90 - 80 + match and match > 1


def exact_axes(items, scale):
    """n, S, V and the distinct integer vectors, in fractions."""
    rows = [(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v in items if v and all(c is not None and np.isfinite(c) for c in v)]
    most = max({len(v) for _, v in rows}, key=lambda n: (sum(len(v) == n for _, v in rows), n))
    rows = [r for r in rows if len(r[1]) == most]
    fit = sorted({v for _, v in rows})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[Fraction(sum(v[p] * v[q] for v in fit) * n - s[p] * s[q], n * n) for q in range(most)] for p in range(most)]
    return rows, fit, n, s, cov


def check_whitening(spark, items, scale=256):
    got = whitening.whiten(table(spark, items), scale=scale).collect()
    rows, fit, n, s, cov = exact_axes(items, scale)
    v = np.array([[float(c) for c in r] for r in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, int((values > 1e-13 * values[0]).sum()))
    assert sorted({r["component"] for r in got}) == list(range(1, k + 1)) and len(got) == k * len(rows)
    trace = float(sum(cov[i][i] for i in range(len(s))))
    away = {}
    for i, x in rows:
        centred = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)])
        away.setdefault((i, str(sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)))), []).append(centred @ axes[:, :k] / np.sqrt(values[:k]))
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-6
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-6)
        assert any(abs(abs(r["whitened"]) - abs(w[r["component"] - 1])) < 1e-6 * max(1, abs(w[r["component"] - 1])) for w in away[r["vec_id"], r["deviation"]])
    return got


def test_whitening_of_clouds_far_from_zero(spark):
    rng = np.random.default_rng(4)
    spread = np.array([9.0, 5.0, 3.0, 2.0, 1.0])
    near = [(i, (rng.normal(size=5) * spread).tolist()) for i in range(200)]
    check_whitening(spark, near + near[:30] + [(5, None), (6, []), (7, [1.0, 2.0]), (8, [NAN] * 5), (9, [1.0, 2.0, 3.0, 4.0, None]), (None, [1.0, 2.0, 3.0, 4.0, 5.0])])
    check_whitening(spark, [(i, [c + 3e12 for c in v]) for i, v in near])  # a mean that rounding would not survive
    check_whitening(spark, [(i, [c * 1e9 for c in v]) for i, v in near])  # deviations beyond a long


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    flat = check_whitening(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)])  # one direction only
    assert len(flat) == 20


def test_exact_products():
    rng = np.random.default_rng(6)
    for top in (10, 1 << 20, 1 << 30, 1 << 45, 1 << 60):
        x = rng.integers(-top, top, (3000, 3))
        assert (whitening.exact_gram(x) == x.astype(object).T.dot(x.astype(object))).all()


def test_queries_on_the_test_tables(spark, sf):
    items = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_exact_whitening(spark, sf).collect()
    rows, _, n, s, _ = exact_axes(items, 256)
    want = {i: sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)) for i, x in rows}
    assert len(got) == 4 * len(want) and all(r["deviation"] == want[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9 for r in got)
