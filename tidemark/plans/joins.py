"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import running
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("jn1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn2_composite_inner", "WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, a.q FROM lineitem l JOIN a USING (l_orderkey, l_partkey, l_suppkey)")
def jn2(s, d):
    li, keys = table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    return li.join(li.groupBy(*keys).agg(F.sum("l_quantity").alias("q")), keys).select("l_orderkey", "l_linenumber", "q")


@query("jn3_left_coalesce", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def jn3(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("jn4_full_compare", "SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both_sides FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') b USING (k)")
def jn4(s, d):
    li = table(s, d, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct().withColumn(f, F.lit(1))
    j = side("R").join(side("A"), "k", "full")
    return j.agg(F.count_if(F.col("A").isNull()).alias("only_left"), F.count_if(F.col("R").isNull()).alias("only_right"), F.count_if(F.col("A").isNotNull() & F.col("R").isNotNull()).alias("both_sides"))


@query("jn5_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def jn5(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn6_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def jn6(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn7_exists_three_way", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'query' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'other' ELSE 'none' END AS tag FROM orders")
def jn7(s, d):
    tags = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return table(s, d, "orders").join(tags, "o_orderkey", "left").select("o_orderkey", F.when(F.col("r"), "query").when(F.col("r").isNotNull(), "other").otherwise("none").alias("tag"))


@query("jn8_scalar_list", "SELECT s_suppkey, coalesce((SELECT array_to_string(list(DISTINCT l_returnflag ORDER BY l_returnflag), ',') FROM lineitem WHERE l_suppkey = s_suppkey), '') AS flags FROM supplier")
def jn8(s, d):
    f = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    return table(s, d, "supplier").join(f, "s_suppkey", "left").select("s_suppkey", F.coalesce("flags", F.lit("")).alias("flags"))


_REFS = "(SELECT o_orderkey, list(DISTINCT 'P:' || l_partkey::VARCHAR) AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


def _refs(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("P:"), F.col("l_partkey").cast("string"))).alias("refs"))


@query("jn9_unnest_join", f"SELECT o_orderkey, p_brand FROM (SELECT o_orderkey, unnest(refs) AS ref FROM {_REFS}) JOIN part ON ref = 'P:' || p_partkey::VARCHAR")
def jn9(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("ref"), "p_brand")
    return _refs(s, d).select("o_orderkey", F.explode("refs").alias("ref")).join(p, "ref").select("o_orderkey", "p_brand")


@query("jn10_multivalue_key", "WITH m AS (SELECT p_partkey, p_name FROM part), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM m) SELECT word, count(DISTINCT p_partkey) AS parts FROM w GROUP BY word")
def jn10(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("parts"))


_NORM = r"rtrim(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), '.')"


@query("jn11_normalised_title", rf"SELECT a.p_partkey AS a, count(*) AS same FROM part a JOIN (SELECT {_NORM} AS t FROM part) b ON {_NORM.replace('p_name', 'a.p_name')} = b.t GROUP BY 1")
def jn11(s, d):
    title = F.rtrim(F.lower(F.trim(F.regexp_replace("p_name", r"\s+", " "))), F.lit("."))
    p = table(s, d, "part").select(F.col("p_partkey").alias("a"), title.alias("t"))
    return p.join(p.groupBy("t").agg(F.count("*").alias("same")), "t").select("a", "same")  # counted before the join


@query("jn12_text_equality", "SELECT a.doc_id, min(b.doc_id) AS first_id, count(*) AS n FROM documents a JOIN documents b ON a.text = b.text GROUP BY a.doc_id")
def jn12(s, d):
    t = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.join(t.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "h").select("doc_id", "first_id", "n")


@query("jn13_shared_attribute", "SELECT a.p_brand AS x, b.p_brand AS y, count(DISTINCT a.p_type) AS shared FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand < b.p_brand GROUP BY 1, 2")
def jn13(s, d):
    e = table(s, d, "part").select("p_brand", "p_type").distinct()
    return e.select(F.col("p_brand").alias("x"), "p_type").join(e.select(F.col("p_brand").alias("y"), "p_type"), "p_type").where("x < y").groupBy("x", "y").agg(F.count("*").alias("shared"))


@query("jn14_system_pairs", "WITH m AS (SELECT l_shipmode_ AS sys, l_suppkey AS qid, avg(l_quantity) AS x FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1, 2) SELECT a.sys AS x, b.sys AS y, count(*) AS n, round(avg(a.x - b.x), 6) AS diff FROM m a JOIN m b ON a.qid = b.qid AND a.sys < b.sys GROUP BY 1, 2")
def jn14(s, d):
    m = table(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("sys"), F.col("l_suppkey").alias("qid")).agg(F.avg("l_quantity").alias("v"))
    a, b = m.select("qid", F.col("sys").alias("x"), F.col("v").alias("vx")), m.select("qid", F.col("sys").alias("y"), F.col("v").alias("vy"))
    return a.join(b, "qid").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.avg(F.col("vx") - F.col("vy")), 6).alias("diff"))


@query("jn15_conflicts", "SELECT a.l_orderkey AS order_key, count(*) AS clashes FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag < b.l_returnflag GROUP BY 1")
def jn15(s, d):
    # pairs with different flags = all pairs less those with equal flags, from counts by order and flag
    n = table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    pairs = n.groupBy(F.col("l_orderkey").alias("order_key")).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("bigint").alias("clashes"))
    return pairs.where("clashes > 0")


@query("jn16_substring_theta", "SELECT r_name, count(*) AS n FROM region JOIN nation ON contains(n_name, substr(r_name, 1, 2)) GROUP BY r_name")
def jn16(s, d):
    r = table(s, d, "region").select("r_name")  # five names
    return table(s, d, "nation").join(F.broadcast(r), F.expr("contains(n_name, substr(r_name, 1, 2))")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("jn17_array_overlap", f"SELECT o_orderkey FROM {_REFS} WHERE list_has_any(refs, ['P:1', 'P:2', 'P:3'])")
def jn17(s, d):
    return _refs(s, d).where(F.arrays_overlap("refs", F.array(F.lit("P:1"), F.lit("P:2"), F.lit("P:3")))).select("o_orderkey")


@query("jn18_list_contains", f"SELECT o_orderkey FROM {_REFS} WHERE list_contains(refs, 'P:7')")
def jn18(s, d):
    return _refs(s, d).where(F.array_contains("refs", "P:7")).select("o_orderkey")


@query("jn19_lookup_or_minus_one", "SELECT doc_id, coalesce(vec_id, -1) AS at FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def jn19(s, d):
    return table(s, d, "documents").join(table(s, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", F.coalesce("vec_id", F.lit(-1)).alias("at"))


@query("jn20_nearest_parameter", "SELECT p_partkey, (SELECT s_suppkey FROM supplier ORDER BY abs(s_acctbal - p_retailprice), s_suppkey LIMIT 1) AS nearest FROM part")
def jn20(s, d):
    return running.nearest(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", table(s, d, "supplier"), "s_acctbal", "s_suppkey").select("p_partkey", "nearest")


@query("jn21_precedence_merge", "SELECT k, v FROM (SELECT c_custkey AS k, 'paper' AS v FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT c_custkey, 'ours' FROM customer WHERE c_custkey % 3 <> 0")
def jn21(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    a, b = c.where("k % 3 = 0").withColumn("v", F.lit("paper")), c.withColumn("v", F.lit("ours"))
    return a.unionByName(b.join(a, "k", "left_anti"))


@query("jn22_alias", "SELECT coalesce(CASE n_name WHEN 'UNITED STATES' THEN 'USA' WHEN 'UNITED KINGDOM' THEN 'UK' END, n_name) AS name FROM nation")
def jn22(s, d):
    alias = s.createDataFrame([("UNITED STATES", "USA"), ("UNITED KINGDOM", "UK")], "n_name string, alias string")
    return table(s, d, "nation").join(F.broadcast(alias), "n_name", "left").select(F.coalesce("alias", "n_name").alias("name"))  # a fixed list of aliases


@query("jn23_id_mapping", "SELECT 'S' || s_suppkey::VARCHAR AS id, s_nationkey::BIGINT AS target FROM supplier UNION SELECT 'C' || c_custkey::VARCHAR, c_nationkey FROM customer")
def jn23(s, d):
    a = table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("target"))
    b = table(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("target"))
    return a.union(b).distinct()
