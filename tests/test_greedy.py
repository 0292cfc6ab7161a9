"""Greedy selections in rounds and ranges against the loops they stand for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import greedy
from tidemark.plans import datasets, registry

NEEDS = {"near": 2, "wide": 1}


def loop(cands, limit, pick):
    """cands: (id, marks, gold, guard, {pool: docs}) in order; accepted ids with what they take."""
    marks, roles, forbidden, out = set(), {}, set(), {}
    for i, own, gold, guard, pools in cands:
        if len(out) == limit:
            break
        if marks & set(own) or gold in roles or gold in forbidden or guard & roles.keys():
            continue
        took, seen = [(gold, "gold")], {gold}
        for pool in sorted(pools):
            free = sorted((d for d in pools[pool] - guard - forbidden - roles.keys() - seen), key=lambda d: (pick(i, d), d))
            seen |= pools[pool]  # a document of several pools serves the first
            took += [(d, pool) for d in free[: NEEDS_OF(pools)[pool]]]
        if len(took) < 1 + sum(NEEDS_OF(pools).values()):
            continue
        marks |= set(own)
        roles.update(took)
        forbidden |= guard
        out[i] = sorted(took)
    return out


def NEEDS_OF(pools):
    return datasets.DB8_NEEDS if "same_key" in pools else NEEDS


@pytest.mark.parametrize("seed", range(4))
def test_rounds_against_the_loop(spark, seed):
    rng = random.Random(seed)
    docs = range(40 if seed % 2 else 150)
    cands = [(i, [f"k{rng.randrange(60)}", f"v{rng.randrange(60)}"], rng.choice(docs), set(rng.sample(docs, rng.randrange(4))), {"near": set(rng.sample(docs, 5)), "wide": set(rng.sample(docs, 4))}) for i in range(120)]
    cands = [(i, m, g, f - {g}, {k: p - {g} for k, p in pools.items()}) for i, m, g, f, pools in cands]
    rows = spark.createDataFrame([(i, f"{i:04d}", m) for i, m, *_ in cands], "id long, place string, marks array<string>")
    touch = [(i, d, r) for i, _, g, f, pools in cands for r, ds in [("gold", {g}), ("guard", f), *pools.items()] for d in ds]
    touches = spark.createDataFrame(touch, "id long, doc long, role string")
    rules = greedy.Rules(NEEDS, F.md5(F.concat_ws("|", "id", "doc")))
    for limit in (3, 50):
        got = {}
        for r in greedy.accept(rows, rows, rules, limit, lambda some: touches.join(some.select("id"), "id")).collect():
            got.setdefault(r["id"], []).append((r["doc"], r["role"]))
        want = loop(cands, limit, lambda i, d: hashlib.md5(f"{i}|{d}".encode()).hexdigest())
        assert {i: sorted(x) for i, x in got.items()} == want


def lines(spark, sf):
    brand = {r["p_partkey"]: r["p_brand"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    return sorted({(r["l_suppkey"], r["l_partkey"], brand[r["l_partkey"]], r["l_orderkey"]) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()})


def check_db8(got, held):
    by_key, by_value, pairs = {}, {}, {}
    for k, v, b, d in held:
        by_key.setdefault(k, []).append((b, d))
        by_value.setdefault(v, set()).add(d)
        pairs.setdefault((k, v, b), set()).add(d)
    used, want = set(), {}
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    for seed in datasets.DB8_SEEDS:
        cands = []
        for (k, v, b), ds in pairs.items():
            if len(ds) == 1 and k not in used:
                gold = next(iter(ds))
                guard = {d for x, d in by_key[k] if x == b} - {gold}
                cands.append(((k, v), [f"k{k}", f"v{v}"], gold, guard, {"same_key": {d for x, d in by_key[k] if x != b} - {gold}, "same_value": by_value[v] - {gold}}))
        cands.sort(key=lambda c: (md5(seed, *c[0]), c[0]))
        took = loop(cands, datasets.DB8_QUERIES, lambda i, d: md5(seed, *i, d))
        used |= {k for k, _ in took}
        want |= {(seed, *i): x for i, x in took.items()}
    rows = {}
    for r in got:
        rows.setdefault((r["instance"], r["key"], r["value"]), []).append((r["doc"], r["role"]))
    assert {i: sorted(x) for i, x in rows.items()} == want and len(want) > 2
    return want


def test_db8_against_the_loop(spark, sf):
    check_db8(registry.queries()["db8_greedy_accept"](spark, sf).collect(), lines(spark, sf))


def test_db9_against_the_loop(spark, sf):
    sets = {}
    for _, part, _, order in lines(spark, sf):
        sets.setdefault(order, set()).add(part)
    union, want = set(), []
    for key in sorted((k for k, s in sets.items() if 2 <= len(s) <= 6), key=lambda k: (hashlib.md5(f"pace|{k}".encode()).hexdigest(), k)):
        if len(want) == datasets.DB9_TARGET:
            break
        if len(union | sets[key]) <= datasets.DB9_BUDGET * (len(want) + 1) / datasets.DB9_TARGET:
            union |= sets[key]
            want.append((key, len(want) + 1, len(union)))
    assert sorted(tuple(r) for r in registry.queries()["db9_paced_budget"](spark, sf).collect()) == sorted(want) and len(want) > 20


def test_pace_on_nulls_and_little(spark):
    rows = spark.createDataFrame([(1, None), (2, [7, None, 7]), (None, [8]), (3, [1, 2, 3, 4, 5]), (4, [7, 8])], "key long, docs array<long>")
    got = greedy.pace(rows, [F.col("key")], 4, 4, parts=3)
    assert [tuple(r) for r in got.orderBy("accepts").collect()] == [(None, 1, 1), (1, 2, 1), (2, 3, 2), (4, 4, 2)]
    assert greedy.pace(rows.limit(0), [F.col("key")], 4, 4).collect() == []


def test_ranges_of_the_order_against_the_loop(spark):
    """All pairs were written with their places, twice, whatever the limit (F5, db8_greedy_accept)."""
    rng = random.Random(7)
    cands = [(i, [f"k{rng.randrange(60)}"], rng.randrange(90), set(), {"near": set(rng.sample(range(90), 5)), "wide": set(rng.sample(range(90), 4))}) for i in range(36)]
    cands = [(i, m, g, f, {k: p - {g} for k, p in pools.items()}) for i, m, g, f, pools in cands]
    touches = spark.createDataFrame([(i, d, r) for i, _, g, f, pools in cands for r, ds in [("gold", {g}), *pools.items()] for d in ds], "id long, doc long, role string")
    asked = []

    def ranges():
        for a in range(0, 36, 12):
            asked.append(a)
            rows = spark.createDataFrame([(i, f"{i:04d}", m) for i, m, *_ in cands[a : a + 12]], "id long, place string, marks array<string>")
            yield rows, rows, lambda some: touches.join(some.select("id"), "id")

    rules = greedy.Rules(NEEDS, F.md5(F.concat_ws("|", "id", "doc")))
    for limit, last in ((1, 0), (50, 24)):
        asked.clear()
        got = {}
        for r in greedy.accept_ranges(ranges(), rules, limit).collect():
            got.setdefault(r["id"], []).append((r["doc"], r["role"]))
        assert {i: sorted(x) for i, x in got.items()} == loop(cands, limit, lambda i, d: hashlib.md5(f"{i}|{d}".encode()).hexdigest()) and asked[-1] == last
