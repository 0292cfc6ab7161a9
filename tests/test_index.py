"""The stored index: top-k search against full scores, what it leaves unread, and when it is built anew."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import english
from tidemark.operators import inverted, ranking


def corpus(spark, path, n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "cell", "cells", "gene", "rat"]) for _ in range(rng.randint(0, 30))] + [f"w{int(rng.paretovariate(0.4)) % 400}" for _ in range(rng.randint(0, 12))]
        rows.append((i % 850, " ".join(words)))  # some keys have two rows
    spark.createDataFrame([*rows, (None, "cell gene"), (5000, None), (5001, "")], "doc_id long, text string").write.parquet(path)


def full(index, queries, k1=1.5, b=0.75):
    scored = ranking.bm25(index.matches(queries), k1, b)
    return {(r["qid"], r["doc_id"]): r["score"] for r in scored.collect()}


def ask(spark):
    texts = {1: "w1 w2 cell", 2: "gene cell rat w7 w300", 3: "cell", 4: "w399 gene", 5: "unknown", 6: "w11 w12 w13 w14 gene cells"}
    return spark.createDataFrame([(q, t) for q, x in texts.items() for t in x.split()], "qid long, term string")


@pytest.mark.parametrize("k", [1, 7, 40, 2000])
def test_search_gives_the_best_of_all(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(inverted, "AREA", 16)
    monkeypatch.setattr(inverted, "AHEAD", 1)
    corpus(spark, f"{tmp_path}/docs")
    index = inverted.stored(spark, f"{tmp_path}/docs", folder=str(tmp_path))
    found = inverted.search(index, ask(spark), k)
    got = {}
    for r in found.top.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
    want = {}
    for (q, d), s in full(index, ask(spark)).items():
        want.setdefault(q, []).append((-s, d))
    assert {q: [(d, s) for _, d, s in sorted(x)] for q, x in got.items()} == {q: [(d, -s) for s, d in sorted(x)[:k]] for q, x in want.items()}
    read = {r["qid"]: (r["postings"], r["read"]) for r in found.read.collect()}
    assert all(n <= all_ for all_, n in read.values())
    if k == 1:
        assert sum(n for _, n in read.values()) < 0.7 * sum(all_ for all_, _ in read.values())  # blocks stay unread


def test_search_among_candidates(spark, tmp_path):
    corpus(spark, f"{tmp_path}/docs")
    index = inverted.stored(spark, f"{tmp_path}/docs", folder=str(tmp_path))
    wanted = [(q, d) for q in (1, 2, 5) for d in range(q, 200, 3)] + [(1, 10**6), (1, 1)]
    candidates = spark.createDataFrame(wanted, "qid long, doc_id long")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in inverted.search(index, ask(spark), 1000, candidates=candidates).top.collect()}
    scores = full(index, ask(spark))
    assert got == {p: scores.get(p, 0.0) for p in wanted}


def test_an_index_is_used_again_until_the_documents_change(spark, tmp_path):
    path = f"{tmp_path}/docs"
    corpus(spark, path, 60)
    first = inverted.stored(spark, path, folder=f"{tmp_path}/i")
    made = set(os.listdir(f"{tmp_path}/i"))
    assert inverted.stored(spark, path, folder=f"{tmp_path}/i").n == first.n and set(os.listdir(f"{tmp_path}/i")) == made
    home = f"{tmp_path}/i/{next(iter(made))}"
    os.remove(f"{home}/blocks/_SUCCESS")  # an attempt that failed
    assert inverted.stored(spark, path, folder=f"{tmp_path}/i").n == first.n and os.path.exists(f"{home}/blocks/_SUCCESS")
    time.sleep(1.1)
    shutil.rmtree(path)
    corpus(spark, path, 90, seed=2)
    again = inverted.stored(spark, path, folder=f"{tmp_path}/i")
    assert again.n > first.n and len(os.listdir(f"{tmp_path}/i")) == 2
    assert inverted.stored(spark, path, analyzer="stemmed", folder=f"{tmp_path}/i").terms.where("term = 'cells'").count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    index = inverted.stored(spark, f"{tmp_path}/docs", folder=str(tmp_path))
    assert index.n == 0 and inverted.search(index, ask(spark), 5).top.collect() == []


def test_published_sample_of_stems():
    # fixed values: part of the vocabulary that the algorithm's authors publish with it
    sample = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
    consolation consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson consorted consort conspicuously conspicu
    conspiracy conspiraci conspirator conspir conspire conspir constable constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knave knave
    knavish knavish kneaded knead kneel kneel kneeling kneel knell knell knelt knelt knightly knight knights knight knitted knit knitting knit knives knive knobs knob knocked knock
    knocker knocker knockers knocker knopp knopp knots knot generate generat generously generous skies sky dying die news news proceed proceed ties tie cries cri this this""".split()
    assert {w: english.stem(w) for w in sample[::2]} == dict(zip(sample[::2], sample[1::2]))
    assert [english.stem(w) for w in ("", "a", "as", "'s", "yes's", "by", "say", "cry", "hopping", "hoping", "relational", "gas")] == ["", "a", "as", "'s", "yes", "by", "say", "cri", "hop", "hope", "relat", "gas"]
