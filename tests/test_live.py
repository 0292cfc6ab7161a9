"""Postings and passages from one pass over the documents, against the stored index and plain Python."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_index import ask, corpus, full
from tidemark.operators import inverted, live, ranking, running, tiles
from tidemark.plans import fixtures, registry, retrieval

ODD = ["", "a", "b1-c", "É", "abc", "", "def", "x" * 300, "K2 K3 İz", "été2ß9", "  ", "A\nB\x00c", "7"]


def test_tokens_are_those_of_the_regular_expression(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", F.lower("t").alias("t"), ranking.tokens(F.col("t")).alias("w")).orderBy("i").collect()
    low = pa.array(["cut off", *[r["t"] for r in rows], "cut off"]).slice(1, len(rows))
    tokens, each = live.split(low)
    assert tokens.to_pylist() == [w for r in rows for w in r["w"]] and each.tolist() == [len(r["w"]) for r in rows]
    assert live.split(pa.array(["", "-"]))[1].tolist() == [0, 0] and live.split(pa.array([], pa.string()))[1].tolist() == []


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_an_index_of_the_terms_asked_for(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(live, "DOCS", 100)
    monkeypatch.setattr(live, "ASKED", block)
    corpus(spark, f"{tmp_path}/docs")
    stored, got = inverted.stored(spark, f"{tmp_path}/docs", folder=str(tmp_path)), live.index(spark.read.parquet(f"{tmp_path}/docs"), ask(spark))
    assert (got.n, got.avgdl) == (stored.n, pytest.approx(stored.avgdl))
    plain = lambda d: sorted(map(tuple, d.collect()))
    assert plain(got.docs.select("doc_id", "dl")) == plain(stored.docs.select("doc_id", "dl"))
    assert plain(got.terms) == plain(stored.terms.join(ask(spark).select("term").distinct(), "term", "left_semi"))
    assert plain(got.postings(ask(spark))) == plain(stored.postings(ask(spark)))
    scores = full(stored, ask(spark))
    assert {(r["qid"], r["doc_id"]): r["score"] for r in tiles.every(got, ask(spark)).collect()} == scores
    best = {(r["qid"], r["doc_id"]) for r in tiles.top(got, ask(spark), 7, ((1.5, 0.75),)).collect()}
    assert best == {(q, d) for q in {q for q, _ in scores} for _, d in sorted((-s, d) for (p, d), s in scores.items() if p == q)[:7]}


def test_no_documents_or_terms(spark):
    none = spark.createDataFrame([(1, None), (None, "w1")], "doc_id long, text string")
    assert tiles.every(live.index(none, ask(spark)), ask(spark)).count() == 0
    some = spark.createDataFrame([(1, "w1 cell")], "doc_id long, text string")
    assert tiles.every(live.index(some, ask(spark).limit(0)), ask(spark).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_passages_that_texts_hold(spark, monkeypatch, block):
    monkeypatch.setattr(live, "DOCS", 100)
    monkeypatch.setattr(live, "ASKED", block)
    rng = random.Random(3)
    docs = [(i % 380, " ".join(rng.choice(["Ab", "b-c", "dé", "e1", "f", "İ9"]) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(900, None), (901, "")]
    cut = []
    for q in range(60):
        text = docs[rng.randrange(400)][1]
        a = rng.randrange(len(text) + 1)
        cut.append((q, text[a : a + rng.randint(1, 40)] if q % 5 else text[a : a + 30].upper()))
    asked = spark.createDataFrame(cut, "qid long, passage string").where("passage <> ''").withColumn("words", ranking.tokens(F.col("passage")))
    asked = asked.withColumn("words", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))).where(F.size("words") > 0)
    passages = [(r["qid"], r["passage"]) for r in asked.collect()]
    assert len(passages) > 30
    got = {tuple(r) for r in live.holding(spark.createDataFrame(docs, "doc_id long, text string"), asked).collect()}
    assert got == {(q, i) for q, p in passages for i, t in docs if t is not None and p in t}


def test_runs_keep_less_than_the_texts(spark, tmp_path):
    """Tokens, counts of terms that nobody asks for and blocks were all written, several times what is read."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    os.mkdir(f"{tmp_path}/sf")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    before, sc = running.shared_folder(spark), spark.sparkContext
    try:
        sc.setCheckpointDir(f"{tmp_path}/kept")
        assert fixtures.runs(spark, f"{tmp_path}/sf").count() > 0
        kept = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{tmp_path}/kept") for f in files)
    finally:
        sc._jsc.sc().setCheckpointDir(before)
    assert kept < docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_the_leaders_of_all_tiles_together(spark):
    rng = random.Random(5)
    found = [(q, d, round(rng.random(), 2) + rng.choice([0, 0, 1e-6])) for q in (1, 2) for d in range(500)] + [(3, 1, 0.5)]
    frame = spark.createDataFrame(found, "qid long, doc_id long, near double")
    got = {tuple(r) for r in tiles.leaders(frame, 20, "near").collect()}
    for q in (1, 2, 3):
        best = sorted((-round(s, 5), d) for p, d, s in found if p == q)[:20]
        assert {(q, d) for _, d in best} <= got
    assert len(got) < 120


def _nodes(plan):
    below = plan.children()
    return [plan, *(x for i in range(below.size()) for x in _nodes(below.apply(i)))]


def test_texts_and_postings_stay_out_of_joins(spark, sf):
    """Lost documents brought their texts through a join, and the set baseline all postings of the terms asked for."""
    plan = lambda df: _nodes(df._jdf.queryExecution().optimizedPlan())
    lost = [x.output().mkString(",") for x in plan(retrieval.mt13(spark, sf)) if x.nodeName() == "Join"]
    assert lost and not any("text#" in x for x in lost)
    assert not any("inline(" in x.simpleString(1000) for x in plan(retrieval.mt4(spark, sf)))


#: Their time went into an index of all words, which they wrote before they searched (F12 to F18, F22).
SEARCHES = ["mt10_map", "mt3_condensed", "rt12_listwise_merge", "mt12_seed_mean", "rt1_bm25_live", "rt15_shown_order", "mt11_ungraded_top", "mt9_hit_mrr"]


@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_writes_less_than_the_texts(spark, tmp_path, name):
    sf = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    before, sc = running.shared_folder(spark), spark.sparkContext
    try:
        sc.setCheckpointDir(f"{tmp_path}/kept")
        assert registry.queries()[name](spark, sf).count() > 0
        kept = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{tmp_path}/kept") for f in files)
    finally:
        sc._jsc.sc().setCheckpointDir(before)
    assert 0 < kept < texts


def test_stems_asked_for_are_those_of_the_stored_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "DOCS", 100)
    corpus(spark, f"{tmp_path}/docs")
    stored, words = (inverted.stored(spark, f"{tmp_path}/docs", analyzer=a, folder=str(tmp_path)) for a in ("stemmed", "words"))
    got = live.indexes(spark.read.parquet(f"{tmp_path}/docs"), {"stemmed": ask(spark), "words": ask(spark).where("term <> 'cell'")})
    plain = lambda d: sorted(map(tuple, d.collect()))
    for new, old in ((got["stemmed"], stored), (got["words"], words)):
        assert (new.n, new.avgdl) == (old.n, pytest.approx(old.avgdl))
        assert plain(new.docs.select("doc_id", "dl")) == plain(old.docs.select("doc_id", "dl"))
    assert plain(got["stemmed"].postings(ask(spark))) == plain(stored.postings(ask(spark)))
    assert plain(got["words"].postings(ask(spark))) == plain(words.postings(ask(spark).where("term <> 'cell'")))


def _kept_by(spark, tmp_path, name):
    sf = "/root/testdata/sf0.01"
    before, sc = running.shared_folder(spark), spark.sparkContext
    try:
        sc.setCheckpointDir(f"{tmp_path}/kept")
        assert registry.queries()[name](spark, sf).count() > 0
        return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{tmp_path}/kept") for f in files)
    finally:
        sc._jsc.sc().setCheckpointDir(before)


def test_block_search_writes_less_than_the_texts(spark, tmp_path):
    """It wrote an index of all stems, several times the texts (F1)."""
    assert 0 < _kept_by(spark, tmp_path, "rt2b_block_search") < spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]


def test_the_grid_writes_less_than_the_texts(spark, tmp_path):
    """It wrote two indexes, of all words and of all stems (F2)."""
    assert 0 < _kept_by(spark, tmp_path, "rt2_bm25_grid") < spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
