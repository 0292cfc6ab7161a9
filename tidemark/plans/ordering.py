"""Queries: windows, sorts and top-k, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import running, sampling
from tidemark.plans.registry import query
from tidemark.sources.tables import table


def _rn(by: list, order: list):
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


@query("wn1_dedup", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def wn1(s: SparkSession, d: str) -> DataFrame:
    # the smallest id of each text is an aggregate, so copies meet as one row per map task
    return table(s, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc_id", "lang")).alias("x")).select("x.*")


@query("wn2_topk", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def wn2(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", _rn(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).alias("rn")).where("rn <= 3")


@query("wn3_hash_sample", "SELECT l_suppkey, l_returnflag, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY md5('s1|' || l_orderkey::VARCHAR || '|' || l_partkey::VARCHAR), l_orderkey, l_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_orderkey, l_partkey FROM lineitem)) WHERE rn <= 2")
def wn3(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_partkey").distinct()
    return sampling.first_by_hash(rows, 2, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_partkey"], "s1")


@query("wn4_inverse_weight", "SELECT o_orderkey, round(n / least(n, 5)::DOUBLE, 6) AS weight FROM (SELECT o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('w|' || o_orderkey::VARCHAR)) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE rn <= 5")
def wn4(s, d):
    o = table(s, d, "orders")
    o = o.select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), _rn(["o_custkey"], [sampling.order_hash("w", "o_orderkey")]).alias("rn"))
    return o.where("rn <= 5").select("o_orderkey", F.round(F.col("n") / F.least("n", F.lit(5)), 6).alias("weight"))


@query("wn5_ntile", "SELECT c_mktsegment, c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def wn5(s, d):
    # a segment may hold a third of all rows: places come from range partitions, and quarters from places
    r = running.ranks(table(s, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")], "i", "n")
    more = F.col("n") % 4 * (F.expr("n div 4") + 1)  # rows in the quarters that have one more
    return r.select("c_mktsegment", "c_custkey", F.when(F.col("i") <= more, F.expr("(i - 1) div (n div 4 + 1)") + 1).otherwise(F.expr("(i - n % 4 * (n div 4 + 1) - 1) div greatest(n div 4, 1) + n % 4 + 1")).cast("int").alias("quartile"))


@query("wn6_rerank_after_removal", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem WHERE l_returnflag <> 'R'")
def wn6(s, d):
    return table(s, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_suppkey", _rn(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).alias("rank"))


@query("wn7_cumcount", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at FROM conversations")
def wn7(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", (_rn(["conv_id"], ["turn"]) - 1).alias("at"))


@query("wn8_optimistic_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part")
def wn8(s, d):
    return table(s, d, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("rank"))


@query("wn9_null_aware_rank", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN row_number() OVER (PARTITION BY source, quality IS NULL ORDER BY quality DESC, doc_id) END AS rank FROM documents LEFT JOIN labels USING (doc_id)")
def wn9(s, d):
    j = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left")
    ranked = running.ranks(j.where("quality IS NOT NULL"), ["source"], [F.desc("quality"), F.col("doc_id")], "rank").select("doc_id", "rank")
    return ranked.unionByName(j.where("quality IS NULL").select("doc_id", F.lit(None).cast("int").alias("rank")))


@query("wn10_head", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2")
def wn10(s, d):
    return table(s, d, "events").select("user_id", "event_id", _rn(["user_id"], ["ts", "event_id"]).alias("rn")).where("rn <= 2").drop("rn")


@query("wn11_nunique_transform", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def wn11(s, d):
    return table(s, d, "orders").select("o_orderkey", F.size(F.collect_set("o_orderpriority").over(Window.partitionBy("o_custkey"))).alias("n"))


@query("wn12_max_transform", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders")
def wn12(s, d):
    return table(s, d, "orders").select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("best"))


@query("wn13_running_best", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders")
def wn13(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("best"))


@query("wn14_running_count_above", "SELECT event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS errors_before FROM events")
def wn14(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "events").select("event_id", F.coalesce(F.sum((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)).cast("long").alias("errors_before"))


@query("wn15_majority_vote", "SELECT l_orderkey, vote FROM (SELECT l_orderkey, l_returnflag AS vote, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def wn15(s, d):
    n = table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return n.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), "l_returnflag")).alias("vote"))


@query("wn16_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def wn16(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("wn17_cumulative_plan", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS spent, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 500000 AS within FROM orders")
def wn17(s, d):
    spent = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey", F.round(spent, 2).alias("spent"), (spent <= 500000).alias("within"))


@query("so1_order_by_all", "SELECT n_regionkey::BIGINT AS n_regionkey, n_name FROM nation ORDER BY ALL")
def so1(s, d):
    return table(s, d, "nation").select("n_regionkey", "n_name").orderBy("n_regionkey", "n_name")


@query("so2_numeric_sort_of_text", "SELECT id, row_number() OVER (ORDER BY id::BIGINT) AS pos FROM (SELECT s_suppkey::VARCHAR AS id FROM supplier)")
def so2(s, d):
    ids = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return running.totals(ids, [F.col("id").cast("bigint")], {"pos": F.lit(1)})


@query("so3_topk_stable", "SELECT label::BIGINT AS label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 2) DESC, vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def so3(s, d):
    e = table(s, d, "embeddings")
    return e.select("label", "vec_id", _rn(["label"], [F.desc(F.round(F.col("embedding")[0].cast("double"), 2)), "vec_id"]).alias("rn")).where("rn <= 5").drop("rn")


@query("so4_global_topk", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 100")
def so4(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey").limit(100)


@query("so5_nulls_last", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality ASC NULLS LAST, doc_id) AS up, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, doc_id) AS down FROM documents LEFT JOIN labels USING (doc_id)")
def so5(s, d):
    j = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id", "left")
    up = running.ranks(j, ["source"], [F.asc_nulls_last("quality"), F.col("doc_id")], "up")
    return running.ranks(up, ["source"], [F.desc_nulls_last("quality"), F.col("doc_id")], "down").select("source", "doc_id", "up", "down")


@query("so6_count_then_id", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def so6(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


#: Pages asked for: a common one, one before the first and one behind the last.
_PAGES = (3, 0, 10**9)


@query("so7_page", f"WITH n AS (SELECT greatest(1, (count(*) + 49) // 50) AS n_pages FROM orders), p AS (SELECT asked, least(greatest(asked, 1), n_pages) AS page, n_pages FROM n, (VALUES {', '.join(f'({p})' for p in _PAGES)}) v(asked)), o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) SELECT asked::BIGINT AS asked, page::BIGINT AS page, n_pages::BIGINT AS n_pages, o_orderkey, o_totalprice FROM p JOIN o ON i > 50 * (page - 1) AND i <= 50 * page")
def so7(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    n_pages = max(1, -(-o.count() // 50))
    pages = s.createDataFrame([(p, min(max(p, 1), n_pages), n_pages) for p in _PAGES], "asked long, page long, n_pages long")
    ranked = running.totals(o, [F.desc("o_totalprice"), F.col("o_orderkey")], {"i": F.lit(1)})
    return ranked.withColumn("page", F.expr("(i - 1) div 50 + 1")).join(F.broadcast(pages), "page").select("asked", "page", "n_pages", "o_orderkey", "o_totalprice")  # three rows


@query("so8_multiplicative_hash_sample", "SELECT doc_id FROM documents ORDER BY (doc_id * 2654435761) % 4294967296, doc_id LIMIT 100")
def so8(s, d):
    return table(s, d, "documents").select("doc_id").orderBy(F.expr("pmod(cast(pmod(doc_id, 4294967296) as decimal(20, 0)) * 2654435761, 4294967296)"), "doc_id").limit(100)


@query("so9_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey::VARCHAR), c_custkey LIMIT 75")
def so9(s, d):
    return table(s, d, "customer").select("c_custkey").orderBy(sampling.order_hash("42", "c_custkey"), "c_custkey").limit(75)


@query("so10_keep_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('k|' || event_id::VARCHAR), event_id) AS rn FROM events) WHERE rn <= 10")
def so10(s, d):
    return sampling.first_by_hash(table(s, d, "events").select("user_id", "event_id"), 10, ["user_id"], ["event_id"], "k")


@query("so11_topn_score_id", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 4")
def so11(s, d):
    return table(s, d, "part").select("p_brand", "p_partkey", _rn(["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).alias("rn")).where("rn <= 4").drop("rn")


@query("so12_restore_order", "SELECT conv_id, i - 1 AS pos, role FROM (SELECT conv_id, unnest(list(role ORDER BY turn)) AS role, unnest(range(1, count(*) + 1)) AS i FROM conversations GROUP BY conv_id)")
def so12(s, d):
    lists = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return lists.select("conv_id", F.posexplode("roles").alias("pos", "role"))


@query("st1_union_distinct", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT p_partkey FROM part WHERE p_size < 5")
def st1(s, d):
    return table(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).union(table(s, d, "part").where("p_size < 5").select("p_partkey")).distinct()


@query("st2_union_all", "SELECT 'customer' AS kind, c_nationkey::BIGINT AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def st2(s, d):
    parts = [table(s, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return reduce(DataFrame.unionByName, parts)


@query("st3_intersect_union", "SELECT * FROM ((SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) UNION SELECT p_partkey FROM part WHERE p_size = 1)")
def st3(s, d):
    li, k = table(s, d, "lineitem"), F.col("l_partkey").alias("k")
    return li.where("l_returnflag = 'R'").select(k).intersect(li.where("l_discount > 0.08").select(k)).union(table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("k"))).distinct()


@query("st4_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def st4(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(s, d, "orders").select("o_custkey").distinct())


@query("st5_overlap_size", "SELECT a.l_suppkey AS supp, len(list_intersect(a.x, b.x)) AS both_n, round(len(list_intersect(a.x, b.x)) / len(a.x)::DOUBLE, 6) AS recall FROM (SELECT l_suppkey, list(DISTINCT l_partkey) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, list(DISTINCT l_partkey) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b USING (l_suppkey)")
def st5(s, d):
    li = table(s, d, "lineitem")
    sets = li.groupBy(F.col("l_suppkey").alias("supp")).agg(*[F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey"))).alias(f) for f in "RA"]).where((F.size("R") > 0) & (F.size("A") > 0))
    n = F.size(F.array_intersect("R", "A"))
    return sets.select("supp", n.alias("both_n"), F.round(n / F.size("R"), 6).alias("recall"))


@query("st6_array_union_except", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))), ',') AS u, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(p_type, ' '), x)))), ',') AS e FROM part")
def st6(s, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    j = lambda x: F.array_join(F.array_sort(x), ",")
    return table(s, d, "part").select("p_partkey", j(F.array_union(a, b)).alias("u"), j(F.array_except(a, b)).alias("e"))


@query("st7_symmetric_compare", "SELECT count(*) FILTER (WHERE b.k IS NOT NULL AND a.k IS NOT NULL) AS shared, count(*) AS all_keys, count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL) = 0 AS identical FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b USING (k)")
def st7(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(1))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, "k", "full").agg(F.count_if(both).alias("shared"), F.count("*").alias("all_keys"), (F.count_if(~both) == 0).alias("identical"))
