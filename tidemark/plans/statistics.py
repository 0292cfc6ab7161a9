"""Queries: paired tests, intervals, agreement, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import stats
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# paired differences: pair = region of the customer, unit = month, diff = mean order price difference of two priorities, in thousands
_DIFF = """dm AS (SELECT r_name AS pair, month(o_orderdate)::BIGINT AS unit, round(avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) / 1000 - avg(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice END) / 1000, 4) AS diff
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, month(o_orderdate)),
df AS (SELECT * FROM dm WHERE diff IS NOT NULL)"""


def diffs(s: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(s, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    mean = lambda p: F.avg(F.when(F.col("o_orderpriority").startswith(p), F.col("o_totalprice"))) / 1000
    out = j.groupBy(F.col("r_name").alias("pair"), F.month("o_orderdate").cast("long").alias("unit")).agg(F.round(mean("1") - mean("5"), 4).alias("diff"))
    return out.where("diff IS NOT NULL")


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("sg1_sign_flip_exact", "WITH " + _DIFF + """, n AS (SELECT pair, count(*) AS n, sum(diff) AS obs FROM df GROUP BY pair), pl AS (SELECT df.*, row_number() OVER (PARTITION BY pair ORDER BY unit) - 1 AS i FROM df),
s AS (SELECT pl.pair, n, obs, p, sum(CASE WHEN ((p >> i) & 1) = 1 THEN diff ELSE -diff END) AS s FROM pl JOIN n USING (pair), range(0, 4096) t(p) WHERE p < (1 << n) GROUP BY pl.pair, n, obs, p)
SELECT pair, n, round(obs / n, 6) AS mean, round(avg(CASE WHEN abs(s) >= abs(obs) - 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p FROM s GROUP BY pair, n, obs""")
def sg1(s, d):
    return r6(stats.sign_flip_exact(diffs(s, d)))


_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"


@query("sg2_sign_flip_sampled", "WITH " + _DIFF + f""", s AS (SELECT pair, r, sum(CASE WHEN {_H.format("r::VARCHAR || '|' || unit::VARCHAR")} % 2 = 0 THEN diff ELSE -diff END) AS s FROM df, range(0, 1000) t(r) GROUP BY pair, r), o AS (SELECT pair, sum(diff) AS obs, avg(diff) AS mean FROM df GROUP BY pair)
SELECT pair, round(mean, 6) AS mean, round((1 + count(*) FILTER (WHERE abs(s) >= abs(obs) - 1e-9)) / 1001.0::DOUBLE, 6) AS p FROM s JOIN o USING (pair) GROUP BY pair, mean""")
def sg2(s, d):
    return r6(stats.sign_flip_sampled(diffs(s, d), 1000))


@query("sg3_mcnemar", "WITH RECURSIVE " + _DIFF + """, t AS (SELECT pair, count(*) FILTER (WHERE diff > 0) AS b, count(*) FILTER (WHERE diff < 0) AS c FROM df GROUP BY pair),
lf AS (SELECT n, coalesce(sum(ln(greatest(n, 1)::DOUBLE)) OVER (ORDER BY n), 0) AS lf FROM range(0, 40) t(n))
SELECT pair, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp((SELECT lf FROM lf WHERE n = b + c) - x.lf - y.lf - (b + c) * ln(2))) FROM lf x JOIN lf y ON y.n = t.b + t.c - x.n WHERE x.n <= least(t.b, t.c))), 6) END AS p FROM t""")
def sg3(s, d):
    t = diffs(s, d).groupBy("pair").agg(F.count_if(F.col("diff") > 0).alias("b"), F.count_if(F.col("diff") < 0).alias("c"))
    return r6(stats.mcnemar(t))


_BOOT = "WITH " + _DIFF + f""", n AS (SELECT pair, count(*) AS n, avg(diff) AS mean FROM df GROUP BY pair), pl AS (SELECT df.*, row_number() OVER (PARTITION BY pair ORDER BY unit) - 1 AS i FROM df),
dr AS (SELECT pair, n, mean, r, {_H.format("r::VARCHAR || '|' || j::VARCHAR")} % n AS i FROM n, range(0, 500) a(r), range(0, 12) b(j) WHERE j < n), m AS (SELECT dr.pair, mean, r, avg(diff) AS m FROM dr JOIN pl ON pl.pair = dr.pair AND pl.i = dr.i GROUP BY dr.pair, mean, r)"""


@query("sg4_bootstrap_ci", _BOOT + " SELECT pair, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY pair, mean")
def sg4(s, d):
    return r6(stats.bootstrap(diffs(s, d), 500).drop("p"))


@query("sg5_cluster_bootstrap", f"""WITH per AS (SELECT user_id, sum(value) AS x, count(*) AS k FROM events GROUP BY user_id), pl AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS i FROM per), n AS (SELECT count(*) AS n FROM per),
dr AS (SELECT r, {_H.format("r::VARCHAR || '|' || j::VARCHAR")} % n AS i FROM n, range(0, 100) a(r), range(0, (SELECT n FROM n)) b(j))
SELECT r, round(sum(x) / sum(k), 6) AS mean FROM dr JOIN pl USING (i) GROUP BY r""")
def sg5(s, d):
    return r6(stats.cluster_bootstrap(table(s, d, "events"), 100, "user_id", "value"))


@query("sg6_bootstrap_p", _BOOT + " SELECT pair, round(least(1.0, 2 * least(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN m >= 0 THEN 1.0::DOUBLE ELSE 0 END))), 6) AS p FROM m GROUP BY pair")
def sg6(s, d):
    return r6(stats.bootstrap(diffs(s, d), 500).select("pair", "p"))


_P = """, o AS (SELECT pair, round(abs(avg(diff)) / 30 - floor(abs(avg(diff)) / 30), 6) AS p FROM df GROUP BY pair)"""


def _pvalues(s, d):
    x = F.abs(F.avg("diff")) / 30
    return diffs(s, d).groupBy("pair").agg(F.round(x - F.floor(x), 6).alias("p"))


@query("sg7_holm", "WITH " + _DIFF + _P + """, k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, pair) AS i FROM o) SELECT pair, p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 6) AS p_holm FROM k""")
def sg7(s, d):
    return r6(stats.holm(_pvalues(s, d)))


@query("sg8_tied_borderline", "WITH " + _DIFF + _P + """, k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, pair) AS i FROM o), h AS (SELECT pair, p, max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i) AS ph, sqrt(p * (1 - p) / 1000) AS se FROM k)
SELECT pair, ph > 0.05 AS tied, (ph - 2 * se > 0.05) <> (ph + 2 * se > 0.05) AS borderline FROM h""")
def sg8(s, d):
    h = stats.holm(_pvalues(s, d)).withColumn("se", F.sqrt(F.col("p") * (1 - F.col("p")) / 1000))
    return h.select("pair", (F.col("p_holm") > 0.05).alias("tied"), ((F.col("p_holm") - 2 * F.col("se") > 0.05) != (F.col("p_holm") + 2 * F.col("se") > 0.05)).alias("borderline"))


#: Means of systems differ when they are farther apart than this, so systems that share a letter are runs in the order of their means; the SQL finds the largest runs.
_MARGIN = 2


@query("sg9_letter_display", "WITH " + _DIFF + f""", mn AS (SELECT 'all' AS grp, pair, avg(diff) AS m FROM df GROUP BY pair UNION ALL SELECT 'even', pair, avg(diff) FROM df WHERE unit % 2 = 0 GROUP BY pair), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY m DESC, pair) AS i FROM mn),
e AS (SELECT a.grp, a.i AS s, max(b.i) AS e FROM r a JOIN r b ON a.grp = b.grp AND b.i >= a.i AND abs(a.m - b.m) <= {_MARGIN} GROUP BY a.grp, a.i), k AS (SELECT grp, s, e, row_number() OVER (PARTITION BY grp ORDER BY s) AS c FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.grp = x.grp AND y.s < x.s AND y.e >= x.e))
SELECT r.grp, pair AS system, string_agg(chr((96 + c)::INT), '' ORDER BY c) AS letters FROM r JOIN k ON k.grp = r.grp AND i BETWEEN s AND e GROUP BY r.grp, pair""")
def sg9(s, d):
    df = diffs(s, d)
    means = df.groupBy(F.lit("all").alias("grp"), "pair").agg(F.avg("diff").alias("m")).unionByName(df.where("unit % 2 = 0").groupBy(F.lit("even").alias("grp"), "pair").agg(F.avg("diff").alias("m")))
    shown = stats.letter_display(_MARGIN)("pair", "m")  # an aggregate: each group is a handful of systems
    return means.groupBy("grp").agg(shown.alias("x")).select("grp", F.inline("x"))


@query("sg10_claim_table", "WITH " + _DIFF + _P + """, pl AS (SELECT * FROM (VALUES ('ASIA'), ('EUROPE'), ('ATLANTIS')) c(pair)) SELECT pl.pair, CASE WHEN p IS NULL THEN 'not run' ELSE 'ready' END AS status, CASE WHEN p IS NULL THEN NULL WHEN p < 0.05 THEN 'supported' ELSE 'not supported' END AS decision FROM pl LEFT JOIN o USING (pair)""")
def sg10(s, d):
    claims = s.createDataFrame([("ASIA",), ("EUROPE",), ("ATLANTIS",)], "pair string")
    j = claims.join(_pvalues(s, d), "pair", "left")
    return j.select("pair", F.when(F.col("p").isNull(), "not run").otherwise("ready").alias("status"), F.when(F.col("p").isNull(), None).when(F.col("p") < 0.05, "supported").otherwise("not supported").alias("decision"))


# two judges' grades of orders: arithmetic on keys
_J = "jg AS (SELECT o_orderkey AS item, (o_orderkey % 3)::BIGINT AS a, ((o_orderkey * 7 + o_custkey) % 10 < 6)::INT AS keep, o_custkey FROM orders), jj AS (SELECT item, a, CASE WHEN keep = 1 THEN a ELSE (o_custkey % 3)::BIGINT END AS b FROM jg)"


def judged(s, d):
    o = table(s, d, "orders")
    a = F.col("o_orderkey") % 3
    return o.select(F.col("o_orderkey").alias("item"), a.alias("a"), F.when((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 10 < 6, a).otherwise(F.col("o_custkey") % 3).alias("b"), "o_custkey")


@query("sg11_agreement", "WITH " + _J + " SELECT round(avg((a = b)::INT), 6) AS exact, round(avg(((a >= 1) = (b >= 1))::INT), 6) AS at_least_1, round(avg(((a = 2) = (b = 2))::INT), 6) AS equal_2 FROM jj")
def sg11(s, d):
    f = lambda c: F.round(F.avg(c.cast("double")), 6)
    a, b = F.col("a"), F.col("b")
    return judged(s, d).agg(f(a == b).alias("exact"), f((a >= 1) == (b >= 1)).alias("at_least_1"), f((a == 2) == (b == 2)).alias("equal_2"))


@query("sg12_kappa", "WITH " + _J + """, c AS (SELECT a, b, count(*) AS n FROM jj GROUP BY a, b), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT x.a, y.b, x.n * y.n / (SELECT t FROM t)::DOUBLE AS e FROM (SELECT a, sum(n)::DOUBLE AS n FROM c GROUP BY a) x, (SELECT b, sum(n)::DOUBLE AS n FROM c GROUP BY b) y),
f AS (SELECT e.a, e.b, e, coalesce(n, 0) AS n FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b)
SELECT (SELECT t FROM t)::BIGINT AS n, round(1 - sum(n * abs(a - b) / 2.0) / sum(e * abs(a - b) / 2.0), 6) AS kappa_linear, round(1 - sum(n * power(abs(a - b) / 2.0, 2)) / sum(e * power(abs(a - b) / 2.0, 2)), 6) AS kappa_quadratic FROM f""")
def sg12(s, d):
    j = judged(s, d)
    one, two = stats.kappa(j, "a", "b", 1, 3), stats.kappa(j, "a", "b", 2, 3)
    return r6(one.withColumnRenamed("kappa", "kappa_linear").join(two.withColumnRenamed("kappa", "kappa_quadratic"), "n"))


@query("sg13_transitions", "WITH " + _J + " SELECT a, b, count(*) AS n, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'same' END AS direction FROM jj GROUP BY a, b")
def sg13(s, d):
    return judged(s, d).groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("direction", F.when(F.col("b") > F.col("a"), "up").when(F.col("b") < F.col("a"), "down").otherwise("same"))


@query("sg14_inter_rater", """WITH r AS (SELECT event_id % 97 AS item, user_id % 6 AS labeller, event_id % 2 AS pass, max_by(event_id % 3, event_id) AS grade FROM events GROUP BY 1, 2, 3), l AS (SELECT * FROM r WHERE pass = 0),
p AS (SELECT x.labeller AS a, y.labeller AS b, x.grade AS ga, y.grade AS gb, 'inter' AS kind FROM l x JOIN l y ON x.item = y.item AND x.labeller < y.labeller UNION ALL SELECT x.labeller, x.labeller, x.grade, y.grade, 'intra' FROM r x JOIN r y ON x.item = y.item AND x.labeller = y.labeller AND x.pass = 0 AND y.pass = 1)
SELECT kind, a, b, count(*) AS n, round(avg((ga = gb)::INT), 6) AS agree FROM p GROUP BY kind, a, b HAVING count(*) >= 5 OR kind = 'intra'""")
def sg14(s, d):
    e = table(s, d, "events")
    key = ["item", "labeller"]
    lab = e.groupBy((F.col("event_id") % 97).alias("item"), (F.col("user_id") % 6).alias("labeller"), (F.col("event_id") % 2).alias("pass")).agg(F.max_by(F.col("event_id") % 3, "event_id").alias("grade"))
    first = lab.where("pass = 0")
    agree = (F.count("*").alias("n"), F.round(F.avg((F.col("ga") == F.col("gb")).cast("double")), 6).alias("agree"))
    again = first.select(*key, F.col("grade").alias("ga")).join(lab.where("pass = 1").select(*key, F.col("grade").alias("gb")), key)
    intra = again.groupBy(F.lit("intra").alias("kind"), F.col("labeller").alias("a"), F.col("labeller").alias("b")).agg(*agree)
    # pairs are made inside an item, whose labellers are few
    x, y = first.select("item", F.col("labeller").alias("a"), F.col("grade").alias("ga")), first.select("item", F.col("labeller").alias("b"), F.col("grade").alias("gb"))
    return x.join(y, "item").where("a < b").groupBy(F.lit("inter").alias("kind"), "a", "b").agg(*agree).where("n >= 5").unionByName(intra)


@query("sg15_merged_grade", "WITH " + _J + " SELECT item, (a + b) // 2 AS merged, a AS without_b, b AS without_a FROM jj WHERE a IS NOT NULL AND b IS NOT NULL")
def sg15(s, d):
    return judged(s, d).where("a IS NOT NULL AND b IS NOT NULL").select("item", F.expr("(a + b) div 2").alias("merged"), F.col("a").alias("without_b"), F.col("b").alias("without_a"))


@query("sg16_judge_conflicts", """WITH sy AS (SELECT p_partkey AS system_id, p_name AS system FROM part), j AS (SELECT * FROM (VALUES ('red'), ('blue'), ('steel')) v(judge))
SELECT system_id, judge FROM sy JOIN j ON contains(system, judge)""")
def sg16(s, d):
    judges = s.createDataFrame([("red",), ("blue",), ("steel",)], "judge string")
    p = table(s, d, "part").select(F.col("p_partkey").alias("system_id"), F.col("p_name").alias("system"))
    return p.join(F.broadcast(judges), F.contains("system", "judge")).select("system_id", "judge")  # a few judges


@query("sg17_rule_readout", "WITH " + _DIFF + " SELECT pair, round(avg(diff), 6) AS drop, CASE WHEN avg(diff) <= 0.02 THEN 'keep' ELSE 'reject' END AS verdict FROM df GROUP BY pair")
def sg17(s, d):
    return diffs(s, d).groupBy("pair").agg(F.round(F.avg("diff"), 6).alias("drop"), F.when(F.avg("diff") <= 0.02, "keep").otherwise("reject").alias("verdict"))


@query("sg18_pick_with_tolerance", """WITH m AS (SELECT p_brand AS system, round(avg(p_retailprice), 3) AS score, min(p_size) AS cost FROM part GROUP BY p_brand), t AS (SELECT *, row_number() OVER (ORDER BY round(score, 0) DESC, cost, system) AS rn FROM m)
SELECT system, score, cost::BIGINT AS cost FROM t WHERE rn = 1""")
def sg18(s, d):
    m = table(s, d, "part").groupBy(F.col("p_brand").alias("system")).agg(F.round(F.avg("p_retailprice"), 3).alias("score"), F.min("p_size").cast("long").alias("cost"))
    return m.orderBy(F.desc(F.round("score", 0)), "cost", "system").limit(1)


@query("sg19_pareto", """WITH p AS (SELECT p_partkey, p_size::BIGINT AS cost, p_retailprice AS score, max(p_retailprice) OVER (ORDER BY p_size, p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM part)
SELECT p_partkey, cost, score FROM p WHERE b IS NULL OR score > b""")
def sg19(s, d):
    p = table(s, d, "part").groupBy("p_size").agg(F.max(F.struct("p_retailprice", -F.col("p_partkey"))).alias("x"))  # best of each cost first
    p = p.select((-F.col("x.col2")).alias("p_partkey"), F.col("p_size").cast("long").alias("cost"), F.col("x.p_retailprice").alias("score"))
    return stats.pareto(p, "cost", "score", "p_partkey")


@query("sg20_cost_table", "SELECT l_returnflag AS step, round(sum(l_extendedprice), 2) AS cost, 'sum of ' || count(*)::VARCHAR || ' rows' AS source FROM lineitem GROUP BY l_returnflag")
def sg20(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("step")).agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.concat(F.lit("sum of "), F.count("*").cast("string"), F.lit(" rows")).alias("source"))


@query("sg21_probe_bands", """WITH g AS (SELECT o_custkey AS q, o_orderkey AS want, o_orderkey % 4 = 0 AS hit FROM orders), b AS (SELECT q, count(*) AS n FROM g GROUP BY q)
SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' ELSE '16+' END AS band, count(*) AS golds, round(avg(hit::INT), 6) AS recall FROM g JOIN b USING (q) GROUP BY 1""")
def sg21(s, d):
    g = table(s, d, "orders").select(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 4 == 0).cast("double").alias("hit"))
    per = g.groupBy("q").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    band = F.when(F.col("n") <= 5, "1-5").when(F.col("n") <= 15, "6-15").otherwise("16+")
    return per.groupBy(band.alias("band")).agg(F.sum("n").alias("golds"), F.round(F.sum("h") / F.sum("n"), 6).alias("recall"))


@query("sg22_wording_check", """WITH a AS (SELECT l_partkey AS pair, l_returnflag AS arm, avg(l_quantity) AS g FROM lineitem GROUP BY 1, 2), k AS (SELECT pair FROM a GROUP BY pair HAVING count(DISTINCT arm) = 3)
SELECT arm, count(*) AS n, round(avg(g), 6) AS mean FROM a SEMI JOIN k USING (pair) GROUP BY arm""")
def sg22(s, d):
    a = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("pair"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_quantity").alias("g"))
    a = a.withColumn("arms", F.size(F.collect_set("arm").over(Window.partitionBy("pair")))).where("arms = 3")
    return a.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean"))


@query("sg23_paired_ablation", """WITH t AS (SELECT l_suppkey AS model, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS on_t, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS off_t FROM lineitem GROUP BY 1)
SELECT model, round(1 - off_t / on_t, 6) AS saving FROM t WHERE on_t > 0 AND off_t IS NOT NULL""")
def sg23(s, d):
    part = lambda x: F.sum(F.when(F.col("l_linestatus") == x, F.col("l_quantity")))
    t = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(part("O").alias("on_t"), part("F").alias("off_t")).where("on_t > 0 AND off_t IS NOT NULL")
    return t.select("model", F.round(1 - F.col("off_t") / F.col("on_t"), 6).alias("saving"))


@query("sg24_sensitivity_recheck", "SELECT event_type, count(*) FILTER (WHERE value > 20 AND NOT value > 40) AS gained, count(*) FILTER (WHERE value > 20 AND NOT value > 40) <= 0.5 * count(*) AS stable FROM events GROUP BY event_type")
def sg24(s, d):
    gained = F.count_if((F.col("value") > 20) & ~(F.col("value") > 40))
    return table(s, d, "events").groupBy("event_type").agg(gained.alias("gained"), (gained <= 0.5 * F.count("*")).alias("stable"))
