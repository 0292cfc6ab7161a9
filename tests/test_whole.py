"""Queries that must take all of their input, against the whole job in plain Python or DuckDB."""

import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import english, text
from tidemark.operators import axes, batches, ranking, running, stats, vectors
from tidemark.plans import fixtures, registry, search
from tests.test_contract import TABLES, rows as compared


def by_hash(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def test_section_after_marker_is_whole(spark, sf):
    got = {r["page_id"]: r["section"] for r in registry.queries()["prj2_section_after_marker"](spark, sf).collect()}
    want = duckdb.sql(f"SELECT page_id, CASE WHEN position('<p>' IN html) > 0 THEN trim(substr(html, position('<p>' IN html) + 3)) ELSE '' END FROM '{sf}/pages.parquet'").fetchall()
    assert got == dict(want) and max(map(len, got.values())) > 40


def test_guarded_batches_place_every_order(spark, sf):
    got = registry.queries()["db24_guarded_batches"](spark, sf).collect()
    orders = duckdb.sql(f"SELECT DISTINCT l_orderkey FROM '{sf}/lineitem.parquet'").fetchall()
    assert sorted(r["row"] for r in got) == sorted(k for k, in orders) and len(got) > 600
    assert max(r["batch"] for r in got) < -(-len(orders) // 16)


@pytest.mark.parametrize("hot", [0, 0.3])
def test_batches_over_several_runs(spark, hot):
    rng = random.Random(3)
    rows = {i: ({rng.randrange(60), 99 if rng.random() < hot else rng.randrange(60)}, {rng.randrange(60)}) for i in range(400)}
    frame = spark.createDataFrame([(i, list(d), list(g)) for i, (d, g) in rows.items()], "row long, docs array<long>, guard array<long>")
    got = {r["row"]: r["batch"] for r in batches.plan(frame, [F.col("row")], 8, 16).collect()}
    assert set(got) == set(rows) and set(got.values()) <= {-1, *range(50)}
    held = {b: [rows[i] for i in got if got[i] == b] for b in range(50)}
    clash = lambda x, y: x[0] & y[0] or x[0] & y[1] or x[1] & y[0]
    assert all(len(v) <= 8 and not any(clash(v[i], v[j]) for i in range(len(v)) for j in range(i)) for v in held.values())
    left = [rows[i] for i in got if got[i] < 0]
    assert all(len(v) == 8 or any(clash(r, x) for x in v) for r in left for v in held.values())  # only true conflicts
    assert bool(left) == bool(hot)


def test_balanced_rounds_fill_a_rare_stratum(spark, tmp_path):
    common, rare = by_hash("round", range(1000))[:980], by_hash("round", range(1000))[980:]
    spark.createDataFrame([(i, 1, 0) for i in common] + [(i, 0, 1) for i in rare], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["db30_balanced_rounds"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["doc_id"] for r in got if r["stratum"] == "(0, 1)"] == rare and [r["doc_id"] for r in got if r["stratum"] == "(1, 0)"] == common[:40]


def test_repeat_order_takes_every_label(spark, sf):
    got = registry.queries()["db32_repeat_order"](spark, sf).orderBy("place").collect()
    first = by_hash("once", [k for k, in duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet'").fetchall()])
    assert len(first) > 60
    assert [tuple(r) for r in got] == [(i, x, 1) for i, x in enumerate(first)] + [(len(first) + i, x, 2) for i, x in enumerate(first[::4])]


def test_query_terms_are_all_but_stop_words(spark):
    queries = spark.createDataFrame([(1, "The gene of a rat, and the cat BRCA1")], "item_id long, text string")
    assert {r["term"] for r in ranking.query_terms(queries).collect()} == {"gene", "rat", "cat", "brca1"}


@pytest.mark.parametrize("name", ["rt1_bm25_live", "rt5_match_modes"])
def test_bm25_scores_short_terms(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = registry.oracles()[name]
    assert "length(term)" not in sql
    assert compared(registry.queries()[name](spark, sf).toPandas()) == compared(con.execute(sql).fetch_df())


def test_split_text_back_returns_every_document(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["title"], r["body"]) for r in registry.queries()["prj4_split_text_back"](spark, sf).collect()}
    assert got == {i: (source if i % 3 else None, hashlib.md5(text.encode()).hexdigest()) for i, source, text in docs}


def test_gold_of_short_passages(spark, tmp_path):
    texts = ["to be or not to be", "x", "a-b", "naïve 日本 text", "no such thing", "ab", "the end. Of it"]
    passages = ["be or", "to be or not", "x", "", None, "日本", "a-b", "o", "d. O", "absent words here now", "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["qid"], r["doc_id"]) for r in fixtures.gold(spark, str(tmp_path)).collect()}
    assert got == {(q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if p and p in t}


def test_exact_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    x[100:140] = x[100]  # copies
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    for cosine in (True, False):
        got = vectors.knn(rows, rows.where("id % 50 = 0"), 5, key="id", vector="v", cosine=cosine, block=16, rows=512).collect()
        near = {}
        for r in got:
            near.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
        assert set(near) == set(range(0, 3000, 50))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q, own in near.items():
            s = np.round(unit @ unit[q], 9) if cosine else -np.sqrt(((x - x[q]) ** 2).sum(1))
            s[q] = -np.inf
            assert [n for _, n in sorted(own)] == np.lexsort((np.arange(3000), -s))[:5].tolist()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ranks_and_quantiles_over_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(None if i % 11 == 0 else ["a", "b", "c"][min(2, int(rng.integers(0, 9)))], i, float(rng.integers(0, 40))) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(rows, "g string, id long, v double")
        got = running.ranks(frame, ["g"], [F.col("v"), F.col("id")], "r", "n").collect()
        quart = running.quantiles(frame, ["g"], F.col("v"), {"q": 0.25, "m": 0.5}).collect()
        whole = running.quantiles(frame, [], F.col("v"), {"m": 0.5}).first()["m"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((v, i))
    want = {(g, i): (k + 1, len(own)) for g, own in groups.items() for k, (_, i) in enumerate(sorted(own))}
    assert {(r["g"], r["id"]): (r["r"], r["n"]) for r in got} == want
    assert {r["g"]: (r["q"], r["m"]) for r in quart} == {g: tuple(np.quantile([v for v, _ in own], [0.25, 0.5])) for g, own in groups.items()}
    assert whole == np.quantile([v for *_, v in rows], 0.5)


def test_stems_and_accents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in docs.items()}
    for r in registry.queries()["fn11_stems"](spark, sf).collect():
        assert (r["n_words"], r["n_stems"]) == (len(tokens[r["doc_id"]]), len({english.stem(w) for w in tokens[r["doc_id"]]}))
    for r in registry.queries()["fn7_accent_fold"](spark, sf).collect():
        plain = unicodedata.normalize("NFKD", docs[r["doc_id"]]).encode("ascii", "ignore").decode().lower()
        assert r["h"] == hashlib.md5(plain.encode()).hexdigest()


def test_letters_are_the_largest_sets_alike():
    rng = random.Random(5)
    for n in (1, 2, 5, 8, 30):
        names = [f"s{i:02}" for i in range(n)]
        far = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.4}
        shown = stats.letters(names, far)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if n < 26:
                    assert bool(set(shown[a]) & set(shown[b])) == ((a, b) not in far)
        assert all(shown[x] for x in names)


def test_a_large_group_is_refused_exact_sign_flips(spark):
    with pytest.raises(ValueError, match="sign_flip_sampled"):
        stats.sign_flip_exact(spark.createDataFrame([("x", i, 1.0) for i in range(17)], "pair string, unit long, diff double"))


def test_axes(spark):
    rng = np.random.default_rng(8)
    n, mix = 4000, np.linalg.qr(rng.normal(size=(6, 6)))[0]
    hidden = np.stack([rng.uniform(-1, 1, n) * 3, rng.laplace(size=n) * 2, rng.normal(size=n) * 0.3, *rng.normal(size=(3, n)) * 0.1], 1)
    label = (rng.random(n) < 0.4).astype(int)
    x = hidden @ mix + label[:, None] * mix[2] * 1.5
    rows = spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(label, x.tolist()))], "vec_id long, label long, v array<double>").repartition(5)
    cos = lambda a, b: float(abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b))
    mean, cov = x.mean(0), np.cov(x.T, bias=True)
    values, vectors_ = np.linalg.eigh(cov)
    got_mean, got = axes.principal(rows, "v", 3)
    assert np.allclose(got_mean, mean) and all(cos(got[i], vectors_[:, -1 - i]) > 0.9999 for i in range(3))
    turned = axes.varimax(got)
    assert np.allclose(turned @ turned.T, np.eye(3), atol=1e-6)
    peaked = lambda a: ((a**2 - (a**2).mean(1, keepdims=True)) ** 2).sum()
    assert peaked(turned) >= peaked(got) - 1e-9 and np.allclose(got.T @ got, turned.T @ turned, atol=1e-6)
    found = axes.independent(rows, "v", 2)
    assert all(max(cos(f, m) for f in found) > 0.95 for m in mix[:2])
    fisher = axes.discriminant(rows, "v", "label", 1, shrink=0.0)[0]
    within = sum(np.cov(x[label == c].T, bias=True) * (label == c).mean() for c in (0, 1))
    assert cos(fisher, np.linalg.solve(within, x[label == 1].mean(0) - x[label == 0].mean(0))) > 0.9999
    t = np.arange(n)
    want = np.linalg.solve(cov + 0.1 * np.trace(cov) / 6 * np.eye(6), ((x - mean) * (t - t.mean())[:, None]).mean(0))
    assert cos(axes.ridge(rows, "v", F.col("vec_id"))[0], want) > 0.9999
    assert cos(axes.contrast(rows.where("label = 0"), rows.where("label = 1"), "v")[0], x[label == 1].mean(0) - x[label == 0].mean(0)) > 0.9999


def test_topics_of_separate_clouds(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, (rng.normal(size=4) * 0.05 + np.eye(4)[i % 3] * 9).tolist()) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["mp3b_kmeans_topics"](spark, str(tmp_path)).collect()
    owners = {}
    for r in got:
        owners.setdefault(r["cluster"], set()).add(r["vec_id"] % 3)
    assert len(got) == 90 and all(len(x) == 1 for c, x in owners.items() if c >= 0)  # no topic mixes clouds
    assert sum(r["cluster"] < 0 for r in got) <= 9


def test_even_clusterings_score_higher(spark):
    rows = [(1, i % 4) for i in range(80)] + [(2, 0 if i < 77 else i) for i in range(80)] + [(3, i % 4 if i < 40 else None) for i in range(80)]
    got = {r["g"]: r["score"] for r in search.evenness(spark.createDataFrame(rows, "g int, cluster int")).collect()}
    assert got[1] == pytest.approx(4) and got[3] == pytest.approx(2) and got[2] < 1.3


def test_topic_terms_say_something_of_their_own(spark, sf):
    listed = ["protein", "proteins", "cystic", "fibrosis", "cystic fibrosis", "lung cancer", "cell lung", "gene"]
    ranked = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(listed)], "class string, rank int, term string")
    assert [r["term"] for r in search.apart(ranked).orderBy("place").collect()] == ["protein", "cystic fibrosis", "lung cancer", "gene"]
    got = {}
    for r in registry.queries()["mp1c_topic_terms"](spark, sf).collect():
        got.setdefault(r["class"], []).append(r["term"])
    for own in got.values():
        stems = [{english.stem(w) for w in t.split()} for t in own]
        assert len(own) <= 6 and all(not (a & b) for i, a in enumerate(stems) for b in stems[i + 1 :])
