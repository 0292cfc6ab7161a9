"""Hand-computed answers, invariants and properties."""

import itertools
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import config, text
from tidemark.operators import automaton, batches, closure, labels, measures, ranking, running, stats


def run_of(spark, docs, system="s", qid=1):
    return spark.createDataFrame([(system, qid, d, float(-i), i + 1) for i, d in enumerate(docs)], "system string, qid long, doc_id string, score double, rank long")


def graded(spark, docs, grades, **kw):
    g = spark.createDataFrame([(1, d, v) for d, v in grades.items()], "qid long, doc_id string, grade long")
    return measures.graded(run_of(spark, docs), g, **kw).first()


def test_graded_ndcg(spark):
    r = graded(spark, ["d3", "d1", "x", "d2", "d4"], {"d1": 2, "d2": 1, "d3": 0, "d4": 2, "d5": 1})
    assert round(r["ndcg"], 6) == 0.588246 and r["p_ge1"] == pytest.approx(0.3) and r["p_ge2"] == pytest.approx(0.2) and r["judged"] == pytest.approx(0.8)


def test_unjudged_never_relevant(spark):
    r = graded(spark, [f"x{i}" for i in range(12)] + ["d1"], {"d1": 1})
    assert r["ndcg"] == 0 and r["p_ge1"] == 0 and r["judged"] == 0 and r["bpref"] == 1.0
    assert graded(spark, ["a"], {"a": 0})["ndcg"] is None


@pytest.mark.parametrize("docs, grades, want", [
    ("rnrnr", {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}, (1 + 0.5 + 0) / 3),
    ("nr", {0: 0, 1: 1}, 0.0),
    ("rn", {0: 1, 1: 0}, 1.0),
    ("n", {0: 0}, None),
])
def test_bpref(spark, docs, grades, want):
    got = graded(spark, [f"d{i}" for i in range(len(docs))], {f"d{i}": v for i, v in grades.items()})["bpref"]
    assert got == (None if want is None else pytest.approx(want))


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "pair string, p double")
    got = {r["pair"]: round(r["p_holm"], 6) for r in stats.holm(p).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02}


def test_exact_sign_flip(spark):
    d = spark.createDataFrame([("x", i, 0.1) for i in range(10)], "pair string, unit long, diff double")
    assert stats.sign_flip_exact(d).first()["p"] == pytest.approx(2 / 1024)


def test_sampled_sign_flip_is_near_exact(spark):
    values = [0.3, -0.1, 0.2, 0.25, -0.05, 0.1, 0.15, -0.2, 0.05, 0.12]
    d = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "pair string, unit long, diff double")
    exact, sampled = stats.sign_flip_exact(d).first()["p"], stats.sign_flip_sampled(d, 2000).first()["p"]
    assert abs(exact - sampled) < 4 * math.sqrt(exact * (1 - exact) / 2000) + 0.001


def test_mcnemar(spark):
    cases = [(12, 4), (4, 12), (7, 7), (1, 0), (30, 9), (0, 0)]
    got = {(r["b"], r["c"]): r["p"] for r in stats.mcnemar(spark.createDataFrame(cases, "b long, c long")).collect()}
    for b, c in cases:
        n, k = b + c, min(b, c)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert got[b, c] == pytest.approx(want)


def test_rank_fusion(spark):
    a, b = run_of(spark, "xyz", "a"), run_of(spark, "zw", "b")
    got = [(r["doc_id"], r["score"]) for r in ranking.rrf(a.unionByName(b), 3).orderBy("rank").collect()]
    assert [d for d, _ in got] == ["z", "x", "w"]
    assert [s for _, s in got] == [pytest.approx(1 / 63 + 1 / 61, abs=1e-8), pytest.approx(1 / 61, abs=1e-8), pytest.approx(1 / 62, abs=1e-8)]


def test_rerank_merge(spark):
    r = run_of(spark, [f"a{i}" for i in range(1, 7)])
    s = spark.createDataFrame([(1, "a1", 0.1), (1, "a2", 0.9), (1, "a3", 0.9)], "qid long, doc_id string, score double")
    got = ranking.rerank_merge(r, s, 3).orderBy("rank").collect()
    assert [x["doc_id"] for x in got] == ["a2", "a3", "a1", "a4", "a5", "a6"] and [x["score"] for x in got[3:]] == [None] * 3


def test_condensed_is_a_subset_in_order(spark):
    r = run_of(spark, "abcdef")
    drop = spark.createDataFrame([(1, "b"), (1, "e")], "qid long, doc_id string")
    assert [x["doc_id"] for x in measures.condense(r, drop).orderBy("rank").collect()] == list("acdf")


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "child string, parent string")
    got = {(r["child"], r["ancestor"]) for r in closure.transitive(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd" if x != y}


def test_pareto_points_do_not_dominate_each_other(spark):
    pts = spark.createDataFrame([(i, float(i % 7), float((i * 5) % 11)) for i in range(40)], "id long, cost double, score double")
    got = [(r["cost"], r["score"]) for r in stats.pareto(pts, "cost", "score", "id").collect()]
    assert all(not (a[0] <= b[0] and a[1] >= b[1]) for a, b in itertools.permutations(got, 2))


def test_latest_label(spark):
    log = spark.createDataFrame([(1, 1, 10, 1, 0, 2.0), (1, 1, 20, 2, 1, 1.0), (1, 1, 15, 3, 1, 4.0), (1, 2, 5, 4, 2, 1.0)], "who long, item long, at long, id long, grade long, sec double")
    got = {(r["who"], r["item"]): r for r in labels.latest(log, ["who", "item"], "at", "id", "grade", "sec").collect()}
    r = got[1, 1]
    assert (r["grade"], r["n_changes"], r["sec"], r["first_at"], r["updated_at"]) == (1, 1, 7.0, 10, 20)


@given(st.lists(st.tuples(st.sets(st.integers(0, 30), max_size=4), st.sets(st.integers(0, 30), max_size=3)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_guarded_batches(rows):
    got = batches.fit(rows, [(0, (), ())] * 12, 5)
    assert len(got) == len(rows) and all(-1 <= j < 12 for j in got)
    for (j, a), (k, b) in itertools.combinations(zip(got, rows), 2):
        if j == k >= 0:
            assert a[0].isdisjoint(b[0]) and a[0].isdisjoint(b[1]) and b[0].isdisjoint(a[1])
    assert all(got.count(j) <= 5 for j in range(12))


@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
@settings(max_examples=80, deadline=None)
def test_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 200.0 * table[-1][-1] / (len(a) + len(b)) if a and b else (100.0 if a == b else 0.0)
    assert text.indel_ratio(a, b) == pytest.approx(want)


def test_listed_places(spark):
    cases = [("```json\n[3, 1, 2]\n```", [3, 1, 2]), ('{"ranking": [2, 2, 9]}', [2]), ("first 3 then 1", [3, 1]), ("", []), (None, []), ("[]", []), ('{"best": 4}', []), ('["4", 2.5, "x", 1]', [4, 1]), ("5", [5])]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, reply string").select("i", text.listed_places(F.col("reply"), 5).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: want for i, (_, want) in enumerate(cases)}


def test_letters_and_spans_and_config():
    assert stats.letters(["a", "b", "c"], {("a", "c")}) == {"a": "a", "b": "ab", "c": "b"}
    assert stats.letters(["a", "b"], set()) == {"a": "a", "b": "a"}
    assert automaton.Marker([automaton.Phrase(p, "k") for p in ("the", "of the", "of")], ("k",)).spans("one of the few") == [(4, 10, "k", "of the")]
    assert config.errors({"n": 0, "x": 1}, {"n": int, "seed": int}) == [("n", "is not positive"), ("seed", "is missing"), ("x", "is unknown")]


def test_recall_grows_with_k(spark):
    gold = spark.createDataFrame([(1, "b"), (1, "e"), (2, "z")], "qid long, doc_id string")
    r = measures.binary(run_of(spark, "abcdef"), gold, ks=(1, 2, 5, 6)).where(F.col("qid") == 1).first()
    assert [r[f"recall{k}"] for k in (1, 2, 5, 6)] == [0, 0.5, 1, 1]
    assert measures.binary(run_of(spark, "abcdef"), gold).where(F.col("qid") == 2).first()["ndcg10"] == 0  # a query without a ranking counts


def test_running_operators(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101, float((i * 7) % 10)) for i in range(101)], "id long, o long, v double")
    total, want = 0.0, {}
    for i, o, v in sorted(((i, (i * 37) % 101, float((i * 7) % 10)) for i in range(101)), key=lambda r: r[1]):
        total += v
        want[i] = total
    assert {r["id"]: r["t"] for r in running.totals(rows, [F.col("o")], {"t": F.col("v")}).collect()} == want
    values = sorted(float((i * 7) % 10) for i in range(101))
    got = {r["v"]: r["r"] for r in running.average_rank(rows, "v", "r").collect()}
    assert got == {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    params = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, 4.0), (4, 50.0), (5, 8.0)], "k long, p double")
    near = {r["id"]: r["nearest"] for r in running.nearest(rows, "v", params, "p", "k").collect()}
    table = [(0.0, 1), (4.0, 2), (50.0, 4), (8.0, 5)]
    assert near == {i: min((abs(p - (i * 7) % 10), k) for p, k in table)[1] for i in range(101)}


def test_no_nearest_value_reads_the_rest_of_its_range(spark):
    """Each row of a range read all after it (F4, jn20_nearest_parameter); answers against all pairs, nulls and ties included."""
    at = [None, *[x / 4 for x in range(-10, 60)], 3.25, 1e9]
    rows = spark.createDataFrame(list(enumerate(at)), "id long, v double")
    held = [(7, 3.0), (2, 3.0), (5, 3.5), (9, 8.0), (1, -1.0)]
    got = running.nearest(rows, "v", spark.createDataFrame(held, "k long, p double"), "p", "k")
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
    near = {r["id"]: r["nearest"] for r in got.collect()}
    assert len(near) == len(at) and all(near[i] == min((abs(p - v), k) for k, p in held)[1] for i, v in enumerate(at) if v is not None)
