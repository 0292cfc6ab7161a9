"""Queries: axes, exact neighbours, intrinsic dimension, cluster scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import axes, ranking, running, sampling
from tidemark.operators.vectors import knn
from tidemark.plans.registry import query
from tidemark.sources import sinks
from tidemark.sources.tables import table

_DOT = "list_sum(list_transform(list_zip({}, {}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
#: kn: the 10 nearest (cosine) of each vector whose id is divisible by 50.
_KNN = f"""kn AS (SELECT q, vec_id AS n, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM (SELECT a.vec_id AS q, b.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 9) AS sim
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)), k10 AS (SELECT * FROM kn WHERE r <= 10)"""


def neighbours(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = table(s, d, "embeddings")
    return knn(e, e.where("vec_id % 50 = 0"), k, key="vec_id", vector="embedding")


@query("ge1_knn_exact", f"WITH {_KNN} SELECT q AS query, r AS rank, n AS neighbour, round(sim, 6) AS score FROM k10")
def ge1(s, d):
    return neighbours(s, d).withColumn("score", F.round("score", 6))


_DIST = ", ds AS (SELECT q, r, acos(least(1.0, sim)) AS dist FROM k10)"


@query("ge2_twonn", f"WITH {_KNN}{_DIST}, mu AS (SELECT q, max(CASE WHEN r = 2 THEN dist END) / max(CASE WHEN r = 1 THEN dist END) AS mu FROM ds GROUP BY q), o AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu, q) AS i, count(*) OVER () AS n FROM mu WHERE mu > 0), f AS (SELECT x, -ln(1 - i / n::DOUBLE) AS y FROM o WHERE i <= 0.9 * n) SELECT round(sum(x * y) / sum(x * x), 4) AS dimension FROM f")
def ge2(s, d):
    k = neighbours(s, d, 2).withColumn("dist", F.acos(F.least(F.lit(1.0), "score")))
    mu = k.groupBy("query").agg((F.max(F.when(F.col("rank") == 2, F.col("dist"))) / F.max(F.when(F.col("rank") == 1, F.col("dist")))).alias("mu")).where("mu > 0")
    o = running.ranks(mu, [], [F.col("mu"), F.col("query")], "i", "n").withColumn("x", F.log("mu")).where("i <= 0.9 * n")
    y = -F.log(1 - F.col("i") / F.col("n"))
    return o.agg(F.round(F.sum(F.col("x") * y) / F.sum(F.col("x") * F.col("x")), 4).alias("dimension"))


@query("ge3_levina_bickel", f"WITH {_KNN}{_DIST}, m AS (SELECT q, max(CASE WHEN r = 10 THEN dist END) AS dk FROM ds GROUP BY q), e AS (SELECT q, sum(ln(dk / dist)) AS s FROM ds JOIN m USING (q) WHERE r < 10 AND dist > 0 GROUP BY q) SELECT round(1 / (avg(s) / 8), 4) AS dimension FROM e")
def ge3(s, d):
    k = neighbours(s, d).withColumn("dist", F.acos(F.least(F.lit(1.0), "score")))
    k = k.withColumn("dk", F.max(F.when(F.col("rank") == 10, F.col("dist"))).over(Window.partitionBy("query"))).where("rank < 10 AND dist > 0")
    return k.groupBy("query").agg(F.sum(F.log(F.col("dk") / F.col("dist"))).alias("s")).agg(F.round(1 / (F.avg("s") / 8), 4).alias("dimension"))


@query("ge4_nested_subsets", "SELECT f, count(*) AS n FROM (SELECT ('0x' || substr(md5('nest|' || vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM embeddings), (VALUES (0.1), (0.3), (1.0)) t(f) WHERE u < f GROUP BY f")
def ge4(s, d):
    u = table(s, d, "embeddings").select(sampling.hash_uniform("nest", "vec_id").alias("u"))
    return u.select(F.explode(F.filter(F.array(*map(F.lit, (0.1, 0.3, 1.0))), lambda f: F.col("u") < f)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


def map_knn(s, d, k: int = 10) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("p"))
    return knn(e, e.where("vec_id % 50 = 0"), k, key="vec_id", vector="p")


_MAP = f""", mn AS (SELECT q, vec_id AS n, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM (SELECT a.vec_id AS q, b.vec_id, round({_DOT.format('a.embedding[1:8]', 'b.embedding[1:8]')} / (sqrt({_DOT.format('a.embedding[1:8]', 'a.embedding[1:8]')}) * sqrt({_DOT.format('b.embedding[1:8]', 'b.embedding[1:8]')})), 9) AS sim
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))"""


@query("ge5_map_recall", f"WITH {_KNN}{_MAP} SELECT round(count(*) / (SELECT count(*) FROM k10)::DOUBLE, 6) AS kept FROM k10 JOIN mn ON mn.q = k10.q AND mn.n = k10.n AND mn.r <= 10")
def ge5(s, d):
    a, b = neighbours(s, d), map_knn(s, d).withColumn("hit", F.lit(1)).select("query", "neighbour", "hit")
    return a.join(b, ["query", "neighbour"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("kept"))


@query("ge6_neighbour_shares", f"WITH {_KNN} SELECT round(avg((a.label = b.label)::INT), 6) AS same_label, round(avg((a.vec_id % 7 = b.vec_id % 7)::INT), 6) AS share_any FROM k10 JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = n")
def ge6(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    j = neighbours(s, d).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("b")), "neighbour")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return j.agg(share(F.col("a") == F.col("b")).alias("same_label"), share(F.col("query") % 7 == F.col("neighbour") % 7).alias("share_any"))


@query("ge7_distance_correlation", f"""WITH p AS (SELECT round({_DOT.format('a.embedding', 'b.embedding')}, 9) AS x, round({_DOT.format('a.embedding[1:8]', 'b.embedding[1:8]')}, 9) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 31 + 7) % (SELECT count(*) FROM embeddings)),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) SELECT round(corr(rx, ry), 6) AS spearman FROM r""")
def ge7(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    pairs = e.select((((F.col("vec_id") * 31 + 7) % n)).alias("other"), F.col("embedding").alias("a")).join(e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b")), "other")
    p = pairs.select(F.round(ranking.dot(F.col("a"), F.col("b")), 9).alias("x"), F.round(ranking.dot(F.slice("a", 1, 8), F.slice("b", 1, 8)), 9).alias("y"))
    return running.average_rank(running.average_rank(p, "x", "rx"), "y", "ry").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


# label 9 is noise
_TOGETHER = f"""{_KNN}, lb AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS l FROM embeddings), tq AS (SELECT q, max(a.l) AS l, avg(CASE WHEN b.l >= 0 THEN (a.l = b.l)::INT END) AS t, avg((a.l = b.l AND a.l >= 0)::INT) AS t_all FROM k10 JOIN lb a ON a.vec_id = q JOIN lb b ON b.vec_id = n GROUP BY q)"""


def together(s, d, near: DataFrame) -> DataFrame:
    """One row: over the queries of near, the share of neighbours in the query's cluster, without noise and with it (a noise query scores 0), and their number."""
    l = table(s, d, "embeddings").select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("l"))  # noqa: E741
    j = near.join(l.toDF("query", "a"), "query").join(l.toDF("neighbour", "b"), "neighbour")
    same = (F.col("a") == F.col("b")).cast("double")
    q = j.groupBy("query", "a").agg(F.avg(F.when(F.col("b") >= 0, same)).alias("t"), F.avg(F.when(F.col("a") >= 0, same).otherwise(0.0)).alias("t_all"))
    return q.agg(F.round(F.avg(F.when(F.col("a") >= 0, F.col("t"))), 6).alias("together"), F.round(F.avg("t_all"), 6).alias("together_all"), F.count("*").alias("queries"))


@query("ge8_cluster_scores", f"""WITH {_TOGETHER}, c AS (SELECT label, vec_id % 7 AS g, count(*) AS n FROM embeddings WHERE label <> 9 GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT label) FROM c) AS clusters, round((SELECT count(*) FILTER (WHERE label = 9) / count(*)::DOUBLE FROM embeddings), 6) AS noise, (SELECT round(avg(CASE WHEN l >= 0 THEN t END), 6) FROM tq) AS together, (SELECT round(avg(t_all), 6) FROM tq) AS together_all,
 round((SELECT sum(n * (n - 1.0)) FROM c) / (SELECT sum(l * (l - 1.0)) FROM (SELECT sum(n) AS l FROM c GROUP BY label)) / ((SELECT sum(l * (l - 1.0)) FROM (SELECT sum(n) AS l FROM c GROUP BY g)) / (SELECT sum(n) * (sum(n) - 1.0) FROM c)), 6) AS lift,
 (SELECT round(sum(m) / sum(n)::DOUBLE, 6) FROM (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY label)) AS purity""")
def ge8(s, d):
    e = table(s, d, "embeddings")
    c = e.where("label <> 9").groupBy("label", (F.col("vec_id") % 7).alias("g")).agg(F.count("*").alias("n"))
    # lift is exact over all pairs: P(share | same cluster) over P(share), from counts of counts
    pairs = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("l")).agg(F.sum(F.col("l") * (F.col("l") - 1.0)).alias("p"))
    both, lab, grp, every = pairs(c, ["label", "g"]), pairs(c, ["label"]), pairs(c, ["g"]), pairs(c, [])
    lift = both.withColumnRenamed("p", "a").crossJoin(lab.withColumnRenamed("p", "b")).crossJoin(grp.withColumnRenamed("p", "c")).crossJoin(every.withColumnRenamed("p", "e"))  # one row each
    pure = c.groupBy("label").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(F.count("*").alias("clusters"), F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))
    noise = e.agg(F.round(F.count_if(F.col("label") == 9) / F.count("*"), 6).alias("noise"))
    return pure.crossJoin(noise).crossJoin(together(s, d, neighbours(s, d)).drop("queries")).crossJoin(lift.select(F.round(F.col("a") / F.col("b") / (F.col("c") / F.col("e")), 6).alias("lift")))


@query("ge9_vote_assign", f"WITH {_KNN} SELECT q AS vec_id, CASE WHEN q % 100 = 0 THEN (SELECT label FROM embeddings WHERE vec_id = q) ELSE l END::BIGINT AS label FROM (SELECT q, label AS l, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS rn FROM k10 JOIN embeddings ON vec_id = n GROUP BY q, label) WHERE rn = 1")
def ge9(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    votes = neighbours(s, d).join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    win = votes.groupBy(F.col("query").alias("vec_id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("vote"))
    own = e.where("vec_id % 100 = 0")  # those that have a label of their own
    return win.join(own, "vec_id", "left").select("vec_id", F.coalesce("label", "vote").alias("label"))


@query("ge12_held_out_scores", f"WITH {_TOGETHER} SELECT round(avg(CASE WHEN l >= 0 THEN t END), 6) AS together, round(avg(t_all), 6) AS together_all, count(*) AS queries FROM tq WHERE q % 30 <> 0")
def ge12(s, d):
    fitted = table(s, d, "embeddings").where("vec_id % 30 = 0").select(F.col("vec_id").alias("query"))
    return together(s, d, neighbours(s, d).join(fitted, "query", "left_anti"))


@query("ge13_vector_subset", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings SEMI JOIN labels ON doc_id = vec_id")
def ge13(s, d):
    return table(s, d, "embeddings").join(table(s, d, "labels"), F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("ge11_resume_settings", "SELECT label, k, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label), (VALUES (5), (15), (50)) a(k)")
def ge11(s, d):
    # a first run stops after some settings; the second computes those whose results are not there, and only these
    path, e = sinks.scratch(s), table(s, d, "embeddings")
    grid = e.select("label").distinct().select("label", F.explode(F.array(*map(F.lit, (5, 15, 50)))).alias("k"))
    run = lambda settings: settings.join(e.groupBy("label").agg(F.count("*").alias("n")), "label")
    sinks.fill(grid.where("k = 15 OR label % 3 = 0"), path, ["label", "k"], run)
    return sinks.fill(grid, path, ["label", "k"], run)


# axes

_AX = "c0 AS (SELECT i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) WHERE label = 0 GROUP BY i), c1 AS (SELECT i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) WHERE label = 1 GROUP BY i), ax AS (SELECT i, c1.v - c0.v AS v FROM c0 JOIN c1 USING (i)), nr AS (SELECT sqrt(sum(v * v)) AS n FROM ax)"


def _axis(s, d) -> np.ndarray:
    from tidemark.operators.vectors import centroids

    c = {r["label"]: np.array(r["centroid"]) for r in centroids(table(s, d, "embeddings").where("label IN (0, 1)"), "label", "embedding").collect()}  # two rows
    v = c[1] - c[0]
    return v / np.linalg.norm(v)


def _positions(s, d) -> DataFrame:
    v = _axis(s, d)
    return axes.project(table(s, d, "embeddings"), "embedding", np.zeros(len(v)), np.array([v]), ["x"])


@query("ax1_axis_position", f"WITH {_AX} SELECT vec_id, round(sum(embedding[i]::DOUBLE * v / n), 6) AS x FROM embeddings, ax, nr GROUP BY vec_id")
def ax1(s, d):
    return _positions(s, d).select("vec_id", F.round("x", 6).alias("x"))


@query("ax2_pca")
def ax2(s, d):
    e = table(s, d, "embeddings")
    mean, both = axes.principal(e, "embedding", 2)
    return axes.project(e, "embedding", mean, both, ["x", "y"]).select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("ax3_contrastive")
def ax3(s, d):
    e = table(s, d, "embeddings")
    mean, both = axes.contrastive(e.where("label = 3"), e, "embedding", 2)
    return axes.project(e.where("label = 3"), "embedding", mean, both, ["x", "y"]).select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_POS = f"{_AX}, ps AS (SELECT vec_id, label, sum(embedding[i]::DOUBLE * v / n) AS x FROM embeddings, ax, nr GROUP BY vec_id, label)"


@query("ax4_axis_sign", f"WITH {_POS} SELECT CASE WHEN corr(x, vec_id) >= 0 THEN 1 ELSE -1 END AS sign, round(corr(x, vec_id), 5) AS r FROM ps")
def ax4(s, d):
    r = F.corr("x", F.col("vec_id").cast("double"))
    return _positions(s, d).agg(F.when(r >= 0, 1).otherwise(-1).alias("sign"), F.round(r, 5).alias("r"))


@query("ax5_axis_ends", f"WITH {_POS}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(x, 8), vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM ps) SELECT label::BIGINT AS label, vec_id, CASE WHEN i <= 0.1 * n THEN 'low' ELSE 'high' END AS pole FROM o WHERE i <= 0.1 * n OR i > 0.9 * n")
def ax5(s, d):
    o = running.ranks(_positions(s, d).select("label", "vec_id", F.round("x", 8).alias("x")), ["label"], [F.col("x"), F.col("vec_id")], "i", "n")
    low = F.col("i") <= 0.1 * F.col("n")
    return o.where(low | (F.col("i") > 0.9 * F.col("n"))).select("label", "vec_id", F.when(low, "low").otherwise("high").alias("pole"))


@query("ax6_axis_quality", f"WITH {_POS}, m AS (SELECT avg(x) AS g FROM ps), l AS (SELECT label, count(*) AS n, avg(x) AS m FROM ps GROUP BY label) SELECT round((SELECT sum(n * power(m - g, 2)) FROM l, m) / sum(power(x - g, 2)), 6) AS eta2, round(var_pop(x), 6) AS variance FROM ps, m")
def ax6(s, d):
    p = _positions(s, d).select("label", "x")
    l = p.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))  # noqa: E741
    n, sx, q = F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum("q")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - sx * sx / n
    return l.agg(F.round(between / (q - sx * sx / n), 6).alias("eta2"), F.round(q / n - (sx / n) * (sx / n), 6).alias("variance"))


@query("ax7_axis_description", f"WITH {_POS}, z AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM ps) SELECT label::BIGINT AS label, round(avg((x - m) / s), 6) AS mean_z, arg_max(vec_id, (round(x, 8), -vec_id)) AS extreme FROM ps, z GROUP BY label")
def ax7(s, d):
    p = _positions(s, d).select("label", "vec_id", "x")
    z = p.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return p.crossJoin(F.broadcast(z)).groupBy("label").agg(F.round(F.avg((F.col("x") - F.col("m")) / F.col("s")), 6).alias("mean_z"), F.max_by("vec_id", F.struct(F.round("x", 8), -F.col("vec_id"))).alias("extreme"))  # z is one row


@query("ax8_axis_families")
def ax8(s, d):
    # each family is fitted on both halves of the rows: how alike its axes come out tells how stable they are
    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    two = lambda h: h.where("label IN (0, 1)")
    families = {
        "principal": lambda h: axes.principal(h, "embedding", 3)[1], "varimax": lambda h: axes.varimax(axes.principal(h, "embedding", 3)[1]), "independent": lambda h: axes.independent(h, "embedding", 3),
        "contrastive": lambda h: axes.contrastive(h.where("label = 3"), h, "embedding", 2)[1], "ridge_time": lambda h: axes.ridge(h, "embedding", F.col("vec_id")), "discriminant": lambda h: axes.discriminant(h, "embedding", "label", 3),
        "fisher": lambda h: axes.discriminant(two(h), "embedding", "label", 1), "concept": lambda h: axes.contrast(h.where("label = 0"), h.where("label = 1"), "embedding"),
    }
    halves = [e.where(sampling.hash_uniform("half", "vec_id").between(a, b)) for a, b in ((0.0, 0.4999999), (0.5, 1.0))]
    out = []
    for name, fit in families.items():
        a, b = (fit(h) for h in halves)
        out += [(name, i + 1, round(float(x), 4)) for i, x in enumerate(abs(a @ b.T).max(1))]
    return s.createDataFrame(out, "family string, axis long, stability double")


@query("ax9_concept_tags", f"WITH {_KNN}, t AS (SELECT q, b.label AS concept, count(*) AS n FROM k10 JOIN embeddings b ON b.vec_id = n GROUP BY 1, 2) SELECT concept::BIGINT AS concept, count(*) AS tagged, round(count(*) / (SELECT count(DISTINCT q) FROM k10)::DOUBLE, 6) AS share FROM t GROUP BY concept")
def ax9(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("neighbour"), F.col("label").alias("concept"))
    k = neighbours(s, d)
    t = k.join(e, "neighbour").select("query", "concept").distinct().groupBy("concept").agg(F.count("*").alias("tagged"))
    return t.crossJoin(F.broadcast(k.agg(F.countDistinct("query").alias("n")))).select("concept", "tagged", F.round(F.col("tagged") / F.col("n"), 6).alias("share"))  # one row
