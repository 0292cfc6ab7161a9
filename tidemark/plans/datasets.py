"""Queries: dataset building, set closure, sampling, label store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators import batches, closure, greedy, labels, running, sampling
from tidemark.operators.running import cut
from tidemark.plans.fixtures import RUNS_SQL, gold, runs
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_EDGES = """ed AS (SELECT 'C' || c_custkey::VARCHAR AS child, 'N' || c_nationkey::VARCHAR AS parent FROM customer UNION SELECT 'N' || n_nationkey::VARCHAR, 'R' || n_regionkey::VARCHAR FROM nation UNION SELECT 'R' || r_regionkey::VARCHAR, 'W' FROM region)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, a, b, x, y: table(s, d, t).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("child"), F.concat(F.lit(y), F.col(b).cast("string")).alias("parent"))
    top = table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("W").alias("parent"))
    return one("customer", "c_custkey", "c_nationkey", "C", "N").union(one("nation", "n_nationkey", "n_regionkey", "N", "R")).union(top)


@query("db1_closure", f"WITH RECURSIVE {_EDGES}, cl AS (SELECT child, parent AS ancestor FROM ed UNION SELECT cl.child, ed.parent FROM cl JOIN ed ON cl.ancestor = ed.child) SELECT DISTINCT child, ancestor FROM cl WHERE child <> ancestor")
def db1(s, d):
    return closure.transitive(edges(s, d))


@query("db2_mixed_closure", f"""WITH RECURSIVE {_EDGES}, tw AS (SELECT 'N' || a.n_nationkey::VARCHAR AS x, 'N' || b.n_nationkey::VARCHAR AS y FROM nation a JOIN nation b ON substr(a.n_name, 1, 1) = substr(b.n_name, 1, 1) AND a.n_nationkey <> b.n_nationkey),
su AS (SELECT * FROM tw UNION SELECT child, parent FROM ed), sd AS (SELECT * FROM tw UNION SELECT parent, child FROM ed), up AS (SELECT x, y FROM su UNION SELECT up.x, su.y FROM up JOIN su ON up.y = su.x), down AS (SELECT x, y FROM sd UNION SELECT down.x, sd.y FROM down JOIN sd ON down.y = sd.x)
SELECT x AS node, y AS related FROM up UNION SELECT x, y FROM down UNION SELECT child, child FROM ed UNION SELECT 'W', 'W'""")
def db2(s, d):
    # nations whose names begin alike are twins
    n = table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("n"), F.substring("n_name", 1, 1).alias("c"))
    twins = n.join(n.toDF("m", "c"), "c").where("n < m").select("n", "m")  # a letter has a handful of nations
    return closure.mixed(twins, edges(s, d))


@query("db3_category_relation", "SELECT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def db3(s, d):
    n = table(s, d, "nation")
    return n.select(F.col("n_nationkey").alias("x"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("y"), "n_regionkey"), "n_regionkey").where("x <> y").select("x", "y")


@query("db4_relation_reason", """WITH r AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y, 1 AS p FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey UNION ALL SELECT a.n_nationkey, b.n_nationkey, 2 FROM nation a JOIN nation b ON substr(a.n_name, 1, 1) = substr(b.n_name, 1, 1))
SELECT x::BIGINT AS x, y::BIGINT AS y, CASE min(p) WHEN 1 THEN 'ontology' ELSE 'names' END AS reason FROM r WHERE x <> y GROUP BY x, y""")
def db4(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_regionkey", F.substring("n_name", 1, 1).alias("c"))
    pair = lambda key, p: n.select(F.col("n_nationkey").alias("x"), key).join(n.select(F.col("n_nationkey").alias("y"), key), key).select("x", "y", F.lit(p).alias("p"))
    r = pair("n_regionkey", 1).union(pair("c", 2)).where("x <> y")
    return r.groupBy("x", "y").agg(F.when(F.min("p") == 1, "ontology").otherwise("names").alias("reason"))


@query("db5_guard", "WITH rl AS (SELECT * FROM (VALUES ('A', 'R'), ('R', 'A'), ('N', 'N')) v(x, y)) SELECT DISTINCT q.l_suppkey AS k, q.l_returnflag AS v, g.l_partkey AS doc FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) q JOIN rl ON x = q.l_returnflag JOIN lineitem g ON g.l_suppkey = q.l_suppkey AND g.l_returnflag = y")
def db5(s, d):
    # documents linked to the key with a related value
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), F.col("l_partkey").alias("doc")).distinct()
    related = s.createDataFrame([("A", "R"), ("R", "A"), ("N", "N")], "v string, w string")
    asked = li.select("k", "v").distinct().join(F.broadcast(related), "v")  # three pairs
    return asked.join(li.withColumnRenamed("v", "w"), ["k", "w"]).select("k", "v", "doc").distinct()


@query("db6_negative_pools", "WITH l AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v, l_partkey AS doc FROM lineitem) SELECT k, v, count(*) AS pool FROM (SELECT DISTINCT q.k, q.v, o.doc FROM (SELECT DISTINCT k, v FROM l) q JOIN l o ON o.k = q.k AND o.v <> q.v EXCEPT SELECT k, v, doc FROM l) GROUP BY k, v")
def db6(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), F.col("l_partkey").alias("doc")).distinct()
    q = li.select("k", "v").distinct()
    other = q.join(li.withColumnRenamed("v", "w"), "k").where("v <> w").select("k", "v", "doc").distinct()
    return other.join(li, ["k", "v", "doc"], "left_anti").groupBy("k", "v").agg(F.count("*").alias("pool"))


@query("db7_candidate_funnel", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_gold < 2 THEN 'few gold' WHEN spread > 6 THEN 'too wide' WHEN total < 100000 THEN 'small' ELSE 'kept' END AS reason FROM (SELECT l_orderkey, count(*) AS n_gold, count(DISTINCT l_suppkey) AS spread, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)) GROUP BY reason")
def db7(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_gold"), F.countDistinct("l_suppkey").alias("spread"), F.sum("l_extendedprice").alias("total"))
    why = F.when(F.col("n_gold") < 2, "few gold").when(F.col("spread") > 6, "too wide").when(F.col("total") < 100000, "small").otherwise("kept")
    return g.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


#: Queries of each instance; negatives of each pool; instances, by the seed of their order.
DB8_QUERIES, DB8_NEEDS, DB8_SEEDS = 25, {"same_key": 3, "same_value": 2}, ("one", "two")


#: Lines in the first range of an order by hash, about; how much longer each next end lies; pairs that are sent to all tasks, at most.
DB8_FIRST, DB8_GROWTH, DB8_SENT = 2 * greedy.SLICE * DB8_QUERIES, 16, 100_000


def pair_candidates(s: SparkSession, d: str, some: Column, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, value) with one gold document, of those for which `some` holds, and what each touches: supplier and part, with the orders that hold both.

    Guarded are the other orders of the supplier with a part of the same brand. The pools are the supplier's and the part's
    other orders; a candidate needs enough of both outside its guard. Only lines of these suppliers and parts are written.
    """
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("value"), F.col("l_orderkey").alias("doc"))
    brands = table(s, d, "part").select(F.col("p_partkey").alias("value"), "p_brand")
    pairs = lines.where(some) if without is None else lines.where(some).join(without, "key", "left_anti")
    gold = cut(pairs.distinct().join(brands, "value").distinct().groupBy("key", "value", "p_brand").agg(F.count("*").alias("n"), F.min("doc").alias("gold")).where("n = 1").drop("n"))
    few = F.broadcast if gold.count() <= DB8_SENT else lambda df: df  # at most DB8_SENT rows are sent
    near = [lines.join(few(gold.select(c).distinct()), c, "left_semi").select("key", "value", "doc") for c in ("key", "value")]
    held = cut(near[0].unionByName(near[1]).distinct().join(brands, "value").select("key", "value", "p_brand", "doc").distinct())
    per = held.groupBy("key").agg(F.countDistinct("doc").alias("k")), held.groupBy("value").agg(F.countDistinct("doc").alias("v")), held.groupBy("key", "p_brand").agg(F.countDistinct("doc").alias("g"))
    # a bound from counts: what the guard leaves of the supplier's orders, and the part's orders but the gold and the guard
    wide = gold.join(per[0], "key").join(per[1], "value").join(per[2], ["key", "p_brand"]).where((F.col("k") - F.col("g") >= DB8_NEEDS["same_key"]) & (F.col("v") - 1 >= DB8_NEEDS["same_value"]))
    return wide.select("key", "value", "p_brand", "gold"), held


def pair_ranges(s: SparkSession, d: str, seed: str, without: DataFrame | None) -> Iterator[tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]]:
    """The candidates in the order by hash, in ranges of it that grow until all are looked at, as greedy.accept_ranges takes them."""
    at = sampling.order_hash(seed, "key", "value")
    low, end = "", DB8_FIRST / max(1, table(s, d, "lineitem").count())
    while low is not None:
        high = f"{int(end * 16**12):012x}" if end < 1 else None  # hashes are hexadecimal, so their order is that of numbers
        wide, held = pair_candidates(s, d, (at >= low) & (at < high) if high else at >= low, without)
        order = wide.withColumn("id", F.struct("key", "value")).withColumn("place", F.concat(at, F.lit("|"), F.format_string("%012d|%012d", "key", "value")))
        order = cut(order.withColumn("marks", F.array(F.concat(F.lit("k"), "key"), F.concat(F.lit("v"), "value"))))
        yield order.select("id", "place", "marks"), order, partial(touched, held=held)
        low, end = high, end * DB8_GROWTH


def touched(some: DataFrame, held: DataFrame) -> DataFrame:
    """(id, doc, role) of candidates (id, key, value, p_brand, gold)."""
    by_key = some.join(held.select("key", F.col("p_brand").alias("b"), "doc"), "key").where("doc <> gold")
    guard = by_key.where("b = p_brand").select("id", "doc", F.lit("guard").alias("role"))
    same_key = by_key.where("b <> p_brand").select("id", "doc", F.lit("same_key").alias("role"))
    same_value = some.join(held.select("value", "doc"), "value").where("doc <> gold").select("id", "doc", F.lit("same_value").alias("role"))
    return some.select("id", F.col("gold").alias("doc"), F.lit("gold").alias("role")).unionByName(guard).unionByName(same_key).unionByName(same_value).distinct()


@query("db8_greedy_accept")
def db8(s, d):
    used, out = None, None
    for seed in DB8_SEEDS:  # an instance uses no key of an earlier one
        rules = greedy.Rules(DB8_NEEDS, F.md5(F.concat_ws("|", F.lit(seed), F.col("id.key"), F.col("id.value"), F.col("doc"))))
        got = cut(greedy.accept_ranges(pair_ranges(s, d, seed, used), rules, DB8_QUERIES))
        keys = got.select(F.col("id.key").alias("key")).distinct()
        used = keys if used is None else used.unionByName(keys)
        rows = got.select(F.lit(seed).alias("instance"), "id.key", "id.value", "doc", "role")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Accepted orders wanted, and how many parts they may use together.
DB9_TARGET, DB9_BUDGET = 100, 250


@query("db9_paced_budget")
def db9(s, d):
    # orders of two to six parts, by hash; each must keep the union of parts on the pace of the orders accepted
    held = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set("l_partkey").alias("docs")).where(F.size("docs").between(2, 6))
    return greedy.pace(held, [sampling.order_hash("pace", "key"), F.col("key")], DB9_BUDGET, DB9_TARGET)


@query("db10_topup", "WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), n AS (SELECT count(*) AS n FROM g) SELECT doc_id, 'gold' AS kind FROM g UNION ALL SELECT doc_id, 'distractor' FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('top|' || doc_id::VARCHAR), doc_id) AS rn FROM documents ANTI JOIN g USING (doc_id)), n WHERE rn <= greatest(400 - n, 0)")
def db10(s, d):
    g = table(s, d, "labels").where("quality = 1").select("doc_id").distinct()
    need = max(0, 400 - g.count())
    rest = table(s, d, "documents").select("doc_id").join(g, "doc_id", "left_anti").orderBy(sampling.order_hash("top", "doc_id"), "doc_id").limit(need)
    return g.withColumn("kind", F.lit("gold")).union(rest.withColumn("kind", F.lit("distractor")))


@query("db11_stratified_split", "SELECT doc_id, CASE WHEN rn <= 5 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('split|' || doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 20")
def db11(s, d):
    w = Window.partitionBy("lang").orderBy(sampling.order_hash("split", "doc_id"), "doc_id")
    return table(s, d, "documents").select("doc_id", F.row_number().over(w).alias("rn")).where("rn <= 20").select("doc_id", F.when(F.col("rn") <= 5, "test").otherwise("train").alias("split"))


@query("db12_balance_sample", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t FROM n) SELECT doc_id FROM (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5('bal|' || doc_id::VARCHAR), doc_id) AS rn FROM documents d) x JOIN n ON n.lang = x.lang, t WHERE rn <= round(100 * n / t::DOUBLE)")
def db12(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    quota = n.withColumn("q", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))).select("lang", "q")  # a row per language
    return sampling.first_by_hash(docs.join(quota, "lang"), F.col("q"), ["lang"], ["doc_id"], "bal").select("doc_id")


@query("db13_matched_negatives", "WITH q AS (SELECT p_brand AS ns, count(*) AS q FROM part WHERE p_partkey % 10 = 0 GROUP BY 1), o AS (SELECT p_brand AS ns, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY md5('neg|' || p_partkey::VARCHAR), p_partkey) AS rn FROM part WHERE p_partkey % 10 <> 0) SELECT ns, id FROM o JOIN q USING (ns) WHERE rn <= q")
def db13(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("ns"), F.col("p_partkey").alias("id"))
    pos = p.where("id % 10 = 0")
    quota = pos.groupBy("ns").agg(F.count("*").alias("q"))
    return sampling.first_by_hash(p.where("id % 10 <> 0").join(quota, "ns"), F.col("q"), ["ns"], ["id"], "neg").select("ns", "id")


@query("db14_dedup_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def db14(s, d):
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_REG = "rg AS (SELECT 'doc' AS kind, doc_id::VARCHAR AS id, 'gold' AS source FROM labels WHERE quality = 1 UNION SELECT 'doc', doc_id::VARCHAR, 'toxic' FROM labels WHERE toxic = 1 UNION SELECT 'key', c_custkey::VARCHAR, 'poor' FROM customer WHERE c_acctbal < 0)"


def registry(s, d):
    one = lambda t, where, kind, key, source: table(s, d, t).where(where).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(source).alias("source"))
    return one("labels", "quality = 1", "doc", "doc_id", "gold").union(one("labels", "toxic = 1", "doc", "doc_id", "toxic")).union(one("customer", "c_acctbal < 0", "key", "c_custkey", "poor")).distinct()


@query("db15_registry", f"WITH {_REG} SELECT kind, id, string_agg(source, ',' ORDER BY source) AS parts FROM rg GROUP BY kind, id")
def db15(s, d):
    return registry(s, d).groupBy("kind", "id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("parts"))


@query("db16_ban_list", f"WITH {_REG} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM rg WHERE kind = 'doc')")
def db16(s, d):
    ban = registry(s, d).where("kind = 'doc'").select(F.col("id").cast("bigint").alias("doc_id"))
    return table(s, d, "documents").select("doc_id").join(ban, "doc_id", "left_anti")


@query("db17_leakage", "WITH t AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 = 0), r AS (SELECT doc_id, md5(text) AS h, source FROM documents WHERE doc_id % 10 <> 0) SELECT r.doc_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.h = r.h) THEN 'text' WHEN EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id - 1) THEN 'neighbour' ELSE 'clean' END AS reason FROM r")
def db17(s, d):
    docs = table(s, d, "documents").select("doc_id", F.md5("text").alias("h"))
    held = docs.where("doc_id % 10 = 0")
    rest = docs.where("doc_id % 10 <> 0").join(held.select("h").distinct().withColumn("t", F.lit(True)), "h", "left").join(held.select((F.col("doc_id") + 1).alias("doc_id"), F.lit(True).alias("n")), "doc_id", "left")
    return rest.select("doc_id", F.when(F.col("t"), "text").when(F.col("n"), "neighbour").otherwise("clean").alias("reason"))


_U = "(('0x' || substr(md5('group|' || o_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


@query("db18_group_split", f"SELECT o_orderkey, CASE WHEN {_U} < 0.05 THEN 'valid' ELSE 'train' END AS split FROM orders")
def db18(s, d):
    return table(s, d, "orders").select("o_orderkey", F.when(sampling.hash_uniform("group", "o_custkey") < 0.05, "valid").otherwise("train").alias("split"))


@query("db19_slot_quota", "WITH c AS (SELECT l_suppkey AS q, l_returnflag AS t, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY md5('slot|' || l_orderkey::VARCHAR || '|' || l_partkey::VARCHAR), l_orderkey, l_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_orderkey, l_partkey FROM lineitem) WHERE l_returnflag IN ('A', 'R')) SELECT q, t, l_orderkey, l_partkey FROM c WHERE rn <= CASE t WHEN 'A' THEN 2 ELSE 1 END")
def db19(s, d):
    c = table(s, d, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_suppkey").alias("q"), F.col("l_returnflag").alias("t"), "l_orderkey", "l_partkey").distinct()
    return sampling.first_by_hash(c, F.when(F.col("t") == "A", 2).otherwise(1), ["q", "t"], ["l_orderkey", "l_partkey"], "slot")


@query("db20_template_choice", "SELECT c_custkey, CASE WHEN h < 60 THEN 'plain' WHEN h < 90 THEN 'long' ELSE 'odd' END AS template FROM (SELECT c_custkey, ('0x' || substr(md5('tpl|' || c_custkey::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM customer)")
def db20(s, d):
    h = F.conv(F.substring(sampling.order_hash("tpl", "c_custkey"), 1, 8), 16, 10).cast("bigint") % 100
    return table(s, d, "customer").select("c_custkey", F.when(h < 60, "plain").when(h < 90, "long").otherwise("odd").alias("template"))


@query("db21_core_words", "SELECT p_partkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 OR len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS mention FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'blue'] AS b FROM part)")
def db21(s, d):
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("blue"))
    return table(s, d, "part").select("p_partkey", ((F.size(F.array_except(b, a)) == 0) | (F.size(F.array_except(a, b)) == 0)).alias("mention"))


@query("db22_solo_key", "SELECT l_partkey, bool_and(l_suppkey % 2 = 0) AS solo FROM lineitem GROUP BY l_partkey")
def db22(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.bool_and(F.col("l_suppkey") % 2 == 0).alias("solo"))


@query("db23_guard_list", "SELECT o_orderkey, coalesce(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR), '') AS guards FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def db23(s, d):
    g = table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("guards"))
    return table(s, d, "orders").select("o_orderkey").join(g, "o_orderkey", "left").na.fill("")


@query("db24_guarded_batches")
def db24(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("docs"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("guard"))
    rows = rows.withColumnRenamed("l_orderkey", "row")
    return batches.plan(rows, [sampling.order_hash("batch", "row"), F.col("row")], 16)


@query("db25_wide_to_long", "SELECT c_custkey, kind, v FROM (SELECT c_custkey, 'name' AS kind, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)")
def db25(s, d):
    return table(s, d, "customer").unpivot("c_custkey", [F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")], "kind", "v")


@query("db26_judging_pool", "WITH " + RUNS_SQL + """, lk AS (SELECT qid, doc_id, n / least(n, 5)::DOUBLE AS w FROM (SELECT qid, doc_id, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY md5('pool|' || qid::VARCHAR || '|' || doc_id::VARCHAR), doc_id) AS rn FROM (SELECT DISTINCT qid, doc_id FROM runs WHERE rank > 20)) WHERE rn <= 5),
tp AS (SELECT qid, doc_id, min(rank) AS best_rank, string_agg(system, ',' ORDER BY system) AS systems FROM runs WHERE rank <= 10 GROUP BY qid, doc_id), al3 AS (SELECT qid, doc_id FROM tp UNION SELECT qid, doc_id FROM gold UNION SELECT qid, doc_id FROM lk)
SELECT al3.qid, al3.doc_id, gold.qid IS NOT NULL AS in_gold, best_rank, coalesce(systems, '') AS systems, round(w, 6) AS lookup_weight FROM al3 LEFT JOIN tp ON tp.qid = al3.qid AND tp.doc_id = al3.doc_id LEFT JOIN gold ON gold.qid = al3.qid AND gold.doc_id = al3.doc_id LEFT JOIN lk ON lk.qid = al3.qid AND lk.doc_id = al3.doc_id""")
def db26(s, d):
    r, key = runs(s, d), ["qid", "doc_id"]
    top = r.where("rank <= 10").groupBy(*key).agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_list("system")), ",").alias("systems"))
    look = r.where("rank > 20").select(*key).distinct().withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    w = Window.partitionBy("qid").orderBy(sampling.order_hash("pool", *key), "doc_id")
    look = look.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select(*key, F.round(F.col("n") / F.least("n", F.lit(5)), 6).alias("lookup_weight"))
    g = gold(s, d).withColumn("in_gold", F.lit(True))
    return top.join(g, key, "full").join(look, key, "full").select(*key, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), "best_rank", F.coalesce("systems", F.lit("")).alias("systems"), "lookup_weight")


@query("db27_alias_cleaning", "WITH a AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS alias FROM part), sh AS (SELECT alias FROM a GROUP BY alias HAVING count(*) > 100) SELECT id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM a WHERE length(alias) >= 4 AND alias NOT IN (SELECT alias FROM sh) AND alias NOT IN (SELECT lower(n_name) FROM nation) GROUP BY id")
def db27(s, d):
    a = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("alias"))
    shared = a.groupBy("alias").count().where("count > 100").select("alias")
    names = table(s, d, "nation").select(F.lower("n_name").alias("alias"))
    kept = a.where(F.length("alias") >= 4).join(shared, "alias", "left_anti").join(names, "alias", "left_anti")
    return kept.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query("db28_pending_chunks", "WITH p AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('chunk|' || o_orderkey::VARCHAR), o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F') SELECT o_custkey, o_orderkey, (rn - 1) * ((n + 4) // 5) // n + 1 AS chunk FROM p")
def db28(s, d):
    # near-equal chunks of at most five pending rows
    p = table(s, d, "orders").where("o_orderstatus <> 'F'")
    by = Window.partitionBy("o_custkey")
    p = p.select("o_custkey", "o_orderkey", F.count("*").over(by).alias("n"), F.row_number().over(by.orderBy(sampling.order_hash("chunk", "o_orderkey"), "o_orderkey")).alias("rn"))
    return p.select("o_custkey", "o_orderkey", F.expr("(rn - 1) * ((n + 4) div 5) div n + 1").alias("chunk"))


@query("db29_first_grade", "SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS grade FROM events WHERE value > 1 GROUP BY user_id, event_type")
def db29(s, d):
    return table(s, d, "events").where("value > 1").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("grade"))


# the i-th item of a stratum comes in round i; within a round, strata come in the order of their names
@query("db30_balanced_rounds", "WITH p AS (SELECT doc_id, '(' || quality || ', ' || toxic || ')' AS stratum, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('round|' || doc_id::VARCHAR), doc_id) AS i FROM labels), o AS (SELECT row_number() OVER (ORDER BY i, stratum) - 1 AS place, doc_id, stratum FROM p) SELECT place, doc_id, stratum FROM o WHERE place < 60")
def db30(s, d):
    # always taking from the least-filled stratum is taking in rounds; no stratum can give more than its first 60
    items = table(s, d, "labels").select("doc_id", F.format_string("(%s, %s)", "quality", "toxic").alias("stratum"), sampling.order_hash("round", "doc_id").alias("h"))
    items = items.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "doc_id"))).where("i <= 60")
    first = items.orderBy("i", "stratum").limit(60)
    return first.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("i", "stratum")) - 1).alias("place"), "doc_id", "stratum")  # 60 rows


@query("db31_block_schedule", """WITH f AS (SELECT row_number() OVER (ORDER BY md5('block|' || doc_id::VARCHAR), doc_id) - 1 AS place, doc_id FROM labels), w AS (SELECT (count(*) + 19) // 20 AS w FROM f)
SELECT place % 20 AS block, place // 20 + w * k AS slot, doc_id FROM f, w, range(0, 2) r(k)""")
def db31(s, d):
    # twenty blocks go twice over all labelled documents, a step of twenty apart, each from its own offset
    items = running.ranks(table(s, d, "labels").select("doc_id").withColumn("h", sampling.order_hash("block", "doc_id")), [], [F.col("h"), F.col("doc_id")], "place").select("doc_id", (F.col("place") - 1).alias("item"))
    width = -(-items.count() // 20)
    slots = s.range(20 * 2 * width).select((F.col("id") % 20).alias("block"), F.expr("id div 20").alias("slot"))
    return slots.withColumn("item", labels.block_item(F.col("slot"), 20, max(1, width), F.col("block"))).join(items, "item").select("block", "slot", "doc_id")


@query("db32_repeat_order", "WITH f AS (SELECT row_number() OVER (ORDER BY md5('once|' || doc_id::VARCHAR), doc_id) - 1 AS place, doc_id FROM labels) SELECT place, doc_id, 1 AS pass FROM f UNION ALL SELECT place // 4 + (SELECT count(*) FROM f), doc_id, 2 FROM f WHERE place % 4 = 0")
def db32(s, d):
    labelled = table(s, d, "labels").select("doc_id")
    order = [sampling.order_hash("once", "doc_id"), F.col("doc_id")]
    first = running.totals(labelled, order, {"at": F.lit(1)}).select((F.col("at") - 1).alias("place"), "doc_id")
    again = first.where("place % 4 = 0").select(F.expr("place div 4").alias("place"), "doc_id")
    n = labelled.count()
    return first.withColumn("pass", F.lit(1)).union(again.select(F.col("place") + n, "doc_id", F.lit(2)))  # repeats wait for the second part


_LOG = "lg AS (SELECT user_id AS labeller, event_id % 50 AS item_id, ts, event_id, (event_id % 3)::BIGINT AS grade, value FROM events)"


def log(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("labeller"), (F.col("event_id") % 50).alias("item_id"), "ts", "event_id", (F.col("event_id") % 3).alias("grade"), "value")


@query("db33_label_latest", f"WITH {_LOG}, c AS (SELECT *, coalesce((grade <> lag(grade) OVER (PARTITION BY labeller, item_id ORDER BY ts, event_id))::INT, 0) AS ch FROM lg) SELECT labeller, item_id, arg_max(grade, (ts, event_id)) AS grade, sum(ch)::BIGINT AS n_changes, round(sum(value), 4) AS value, min(ts) AS first_at, max(ts) AS updated_at FROM c GROUP BY 1, 2")
def db33(s, d):
    return labels.latest(log(s, d), ["labeller", "item_id"], "ts", "event_id", "grade", "value").withColumn("value", F.round("value", 4))


@query("db34_progress", f"WITH {_LOG} SELECT labeller, count(DISTINCT item_id) AS done, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS locked_until FROM lg GROUP BY labeller")
def db34(s, d):
    return log(s, d).groupBy("labeller").agg(F.countDistinct("item_id").alias("done"), F.min("ts").alias("started"), (F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("locked_until"))


@query("db35_slot_allocation", f"WITH {_LOG}, m AS (SELECT max(ts) AS now FROM lg), h AS (SELECT item_id FROM lg, m GROUP BY item_id, now HAVING max(ts) > now - INTERVAL 2 HOUR) SELECT min(i) AS free FROM range(0, 51) t(i) WHERE i NOT IN (SELECT item_id FROM h)")
def db35(s, d):
    lg = log(s, d)
    now = lg.agg(F.max("ts").alias("now"))
    held = lg.groupBy("item_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).where("last > now - INTERVAL 2 HOURS").select(F.col("item_id").alias("i"))  # now is one row
    return s.range(51).select(F.col("id").alias("i")).join(held, "i", "left_anti").agg(F.min("i").alias("free"))
