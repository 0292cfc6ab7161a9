"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import running, vectors
from tidemark.plans.registry import query
from tidemark.sources.tables import table


def _r(c, n=6):
    return F.round(c, n)


@query("ag1_counts", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def ag1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("ag2_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND bool_or(o_orderstatus = 'F')")
def ag2(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    return g.where("n >= 12 AND f").drop("f")


@query("ag3_filtered_counts", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem GROUP BY l_suppkey")
def ag3(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"))


@query("ag4_group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL")
def ag4(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("ag4_lineitem")
    return s.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM ag4_lineitem GROUP BY ALL")


@query("ag5_ordered_distinct_list", "SELECT l_orderkey, array_to_string(list(DISTINCT l_suppkey ORDER BY l_suppkey), ',') AS supps FROM lineitem GROUP BY l_orderkey")
def ag5(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("supps"))


@query("ag6_list_by_count", "SELECT p_type, array_to_string(list(p_brand ORDER BY n DESC, p_brand), ',') AS brands FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_type")
def ag6(s, d):
    n = table(s, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return n.groupBy("p_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "p_brand"))), lambda x: x["p_brand"]), ",").alias("brands"))


@query("ag7_string_agg", "SELECT c_nationkey::BIGINT AS c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FILTER (WHERE c_acctbal > 0) AS segments FROM customer GROUP BY c_nationkey")
def ag7(s, d):
    t = table(s, d, "customer").withColumn("m", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return t.groupBy("c_nationkey").agg(F.expr("listagg(DISTINCT m, '|') WITHIN GROUP (ORDER BY m)").alias("segments"))


@query("ag8_nested_list_merge", "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), '|') AS words FROM part GROUP BY p_brand")
def ag8(s, d):
    words = F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_list("w"))), lambda x: x != ""))
    # words are made distinct in each part before they meet
    return table(s, d, "part").select("p_brand", F.array_distinct(F.split("p_name", " ")).alias("w")).groupBy("p_brand").agg(F.array_join(words, "|").alias("words"))


@query("ag9_struct_list", "SELECT l_orderkey, array_to_string(list_transform(list_sort(list({'p': l_partkey, 'q': l_quantity})), lambda x: x.p::VARCHAR || ':' || x.q::BIGINT::VARCHAR), ';') AS items FROM lineitem GROUP BY l_orderkey")
def ag9(s, d):
    items = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), x["q"].cast("bigint").cast("string"))), ";").alias("items"))


@query("ag10_arg_max_min", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY o_custkey")
def ag10(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@query("ag11_bool_aggregates", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_quantity > 3) AS all_many FROM lineitem GROUP BY l_orderkey")
def ag11(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_r"), F.every(F.col("l_quantity") > 3).alias("all_many"))


@query("ag12_percentiles", "SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def ag12(s, d):
    q = running.quantiles(table(s, d, "events"), ["event_type"], F.col("value"), {"med": 0.5, "p5": 0.05, "p95": 0.95})
    return q.select("event_type", *[_r(n).alias(n) for n in ("med", "p5", "p95")])


@query("ag13_macro_micro", "SELECT round(avg(r / n::DOUBLE), 6) AS macro, round(sum(r) / sum(n)::DOUBLE, 6) AS micro FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1)")
def ag13(s, d):
    g = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return g.agg(_r(F.avg(F.col("r") / F.col("n"))).alias("macro"), _r(F.sum("r") / F.sum("n")).alias("micro"))


@query("ag14_mode", "SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def ag14(s, d):
    n = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"))


@query("ag15_best_tier", "SELECT l_partkey, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) WHEN 1 THEN 'exact' WHEN 2 THEN 'near' ELSE 'far' END AS tier FROM lineitem GROUP BY l_partkey")
def ag15(s, d):
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.element_at(F.array(*map(F.lit, ("exact", "near", "far"))), F.min(tier)).alias("tier"))


@query("ag16_strongest_class", "SELECT l_suppkey, ['R', 'A', 'N'][min(list_position(['R', 'A', 'N'], l_returnflag))] AS strongest FROM lineitem GROUP BY l_suppkey")
def ag16(s, d):
    order = F.array(*map(F.lit, ("R", "A", "N")))
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.element_at(order, F.min(F.array_position(order, F.col("l_returnflag"))).cast("int")).alias("strongest"))


@query("ag17_reciprocal_rank_sum", "SELECT l_partkey, round(sum(1.0::DOUBLE / (60 + l_linenumber)), 9) AS score FROM lineitem GROUP BY l_partkey")
def ag17(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(_r(F.sum(1.0 / (60 + F.col("l_linenumber"))), 9).alias("score"))


@query("ag18_conditional_share", "SELECT l_suppkey, count(*) FILTER (WHERE l_tax > 0.04) AS hi, count(*) FILTER (WHERE l_tax <= 0.04) AS lo, round(count(*) FILTER (WHERE l_tax > 0.04) / count(*)::DOUBLE, 6) AS share FROM lineitem GROUP BY l_suppkey")
def ag18(s, d):
    hi = F.count_if(F.col("l_tax") > 0.04)
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(hi.alias("hi"), F.count_if(F.col("l_tax") <= 0.04).alias("lo"), _r(hi / F.count("*")).alias("share"))


@query("ag19_crosstab", "WITH c AS (SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1) SELECT priority, F, O, P, round(F / (F + O + P)::DOUBLE, 6) AS share_f FROM c")
def ag19(s, d):
    p = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.withColumn("share_f", _r(F.col("F") / (F.col("F") + F.col("O") + F.col("P"))))


@query("ag20_complete_pivot", "WITH c AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) SELECT l_suppkey, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R FROM c WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL")
def ag20(s, d):
    p = table(s, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity")).dropna()
    return p.select("l_suppkey", *[_r(c).alias(c) for c in "ANR"])


@query("ag21_macro_coverage", "SELECT sys, round(avg(m), 6) AS macro, count(*) AS tasks FROM (SELECT l_suppkey AS sys, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY sys")
def ag21(s, d):
    m = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sys"), "l_returnflag").agg(F.avg("l_discount").alias("m"))
    return m.groupBy("sys").agg(_r(F.avg("m")).alias("macro"), F.count("*").alias("tasks"))


_CATS = "(SELECT l_returnflag AS cat, l_linestatus AS task, l_suppkey AS sys, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3)"


def _cats(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("cat"), F.col("l_linestatus").alias("task"), F.col("l_suppkey").alias("sys")).agg(F.avg("l_quantity").alias("m"))


@query("ag22_mean_of_category_means", f"SELECT sys, round(avg(c), 6) AS score FROM (SELECT sys, cat, avg(m) AS c FROM {_CATS} GROUP BY 1, 2) GROUP BY sys")
def ag22(s, d):
    return _cats(s, d).groupBy("sys", "cat").agg(F.avg("m").alias("c")).groupBy("sys").agg(_r(F.avg("c")).alias("score"))


@query("ag23_best_rendered", f"SELECT cat, arg_max(sys, (round(c, 6), -sys))::VARCHAR || ' (' || round(max(round(c, 6)), 1)::VARCHAR || ')' AS best FROM (SELECT sys, cat, avg(m) AS c FROM {_CATS} GROUP BY 1, 2) GROUP BY cat")
def ag23(s, d):
    c = _cats(s, d).groupBy("sys", "cat").agg(_r(F.avg("m")).alias("c"))
    return c.groupBy("cat").agg(F.concat(F.max_by("sys", F.struct("c", -F.col("sys"))).cast("string"), F.lit(" ("), F.round(F.max("c"), 1).cast("string"), F.lit(")")).alias("best"))


@query("ag24_top_classes", "WITH t AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5) SELECT p_partkey, p_type FROM part SEMI JOIN t USING (p_type)")
def ag24(s, d):
    p = table(s, d, "part")
    top = p.groupBy("p_type").count().orderBy(F.desc("count"), "p_type").limit(5)
    return p.join(top, "p_type", "left_semi").select("p_partkey", "p_type")


@query("ag25_rollup_groups", "SELECT grp, count(*) AS n, round(avg(l_quantity), 6) AS q FROM (SELECT l_returnflag AS grp, l_quantity FROM lineitem UNION ALL SELECT 'test', l_quantity FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'all', l_quantity FROM lineitem) GROUP BY grp")
def ag25(s, d):
    labels = F.array_compact(F.array(F.col("l_returnflag"), F.lit("all"), F.when(F.col("l_returnflag") != "N", F.lit("test"))))
    return table(s, d, "lineitem").select("l_quantity", F.explode(labels).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"), _r(F.avg("l_quantity")).alias("q"))


@query("ag25b_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def ag25b(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ag26_usage_summary", "SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value < 5) AS failures, round(sum(value), 4) AS cost, round(sum(value) / count(*) * 1000, 4) AS per_1k FROM events GROUP BY event_type")
def ag26(s, d):
    cost = F.sum("value")
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 5).alias("failures"), _r(cost, 4).alias("cost"), _r(cost / F.count("*") * 1000, 4).alias("per_1k"))


@query("ag27_token_cost", "SELECT l_suppkey AS model, round(sum((l_quantity * 1000 * (1 - l_discount) * 0.5 + l_quantity * 1000 * l_discount * 0.1 + l_quantity * 50 * 1.5) / 1e6), 6) AS cost FROM lineitem GROUP BY 1")
def ag27(s, d):
    tokens, cached = F.col("l_quantity") * 1000, F.col("l_discount")
    cost = (tokens * (1 - cached) * 0.5 + tokens * cached * 0.1 + F.col("l_quantity") * 50 * 1.5) / 1e6
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(_r(F.sum(cost)).alias("cost"))


@query("ag28_throughput", "SELECT l_suppkey AS model, round(quantile_cont(l_extendedprice / l_quantity, 0.05), 4) AS p5, round(median(l_extendedprice / l_quantity), 4) AS med, round(0.48 / median(l_extendedprice / l_quantity) / 3600 * 1e6, 6) AS per_mtok FROM lineitem GROUP BY 1")
def ag28(s, d):
    li = table(s, d, "lineitem").withColumnRenamed("l_suppkey", "model")
    q = running.quantiles(li, ["model"], F.col("l_extendedprice") / F.col("l_quantity"), {"p5": 0.05, "med": 0.5})
    return q.select("model", _r("p5", 4).alias("p5"), _r("med", 4).alias("med"), _r(0.48 / F.col("med") / 3600 * 1e6).alias("per_mtok"))


@query("ag29_job_durations", """WITH e AS (SELECT user_id, event_id, ts, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM events)
SELECT user_id, event_id, (epoch(ts) - epoch(start))::BIGINT AS seconds FROM e WHERE event_type = 'purchase' AND start IS NOT NULL""")
def ag29(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(s, d, "events").withColumn("start", F.last(F.when(F.col("event_type") == "view", F.col("ts")), True).over(w))
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return e.where("event_type = 'purchase' AND start IS NOT NULL").select("user_id", "event_id", F.round(sec("ts") - sec("start")).cast("bigint").alias("seconds"))


@query("ag30_estimate_missing", "WITH m AS (SELECT median(l_extendedprice / l_quantity) AS r FROM lineitem WHERE l_linenumber <> 3) SELECT l_orderkey, l_partkey, round(CASE WHEN l_linenumber = 3 THEN l_quantity * r ELSE l_extendedprice END, 4) AS price FROM lineitem, m")
def ag30(s, d):
    li = table(s, d, "lineitem")
    m = running.quantiles(li.where("l_linenumber <> 3"), [], F.col("l_extendedprice") / F.col("l_quantity"), {"r": 0.5})
    return li.crossJoin(F.broadcast(m)).select("l_orderkey", "l_partkey", _r(F.when(F.col("l_linenumber") == 3, F.col("l_quantity") * F.col("r")).otherwise(F.col("l_extendedprice")), 4).alias("price"))  # m is one row


@query("ag31_cluster_card", """WITH e AS (SELECT label, vec_id, vec_id % 7 AS item, vec_id % 5 AS field, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT label, item, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT item, sum(n) / (SELECT count(*) FROM e)::DOUBLE AS base FROM n GROUP BY item), z AS (SELECT label, count(*) AS size, round(avg((x > 0)::INT), 6) AS core, round(median(x), 6) AS x, round(median(y), 6) AS y FROM e GROUP BY label),
top AS (SELECT label, string_agg(item::VARCHAR, ' ' ORDER BY n DESC, item) AS items FROM (SELECT n.label, item, n FROM n JOIN t USING (item) JOIN z USING (label) WHERE round(n / size::DOUBLE / base, 6) >= 1.1 QUALIFY row_number() OVER (PARTITION BY n.label ORDER BY n DESC, item) <= 3) GROUP BY label),
f AS (SELECT label, arg_min(field, (-n, field)) AS field FROM (SELECT label, field, count(*) AS n FROM e WHERE field > 0 GROUP BY 1, 2) GROUP BY label)
SELECT z.label::BIGINT AS label, size, core, x, y, coalesce(items, '') AS items, field FROM z LEFT JOIN top USING (label) LEFT JOIN f USING (label)""")
def ag31(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("item"), (F.col("vec_id") % 5).alias("field"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    size = e.groupBy("label").agg(F.count("*").alias("size"), _r(F.avg((F.col("x") > 0).cast("double"))).alias("core"))
    for c in "xy":
        size = size.join(running.quantiles(e, ["label"], F.col(c), {c: 0.5}).withColumn(c, _r(c)), "label")
    n = e.groupBy("label", "item").agg(F.count("*").alias("n"))
    by = lambda c: F.sum("n").over(Window.partitionBy(*c))
    lift = _r(F.col("n") / by(["label"]) / (by(["item"]) / by([F.lit(1)])))  # label x item counts only
    top = n.withColumn("lift", lift).where("lift >= 1.1").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "item"))).where("rn <= 3")
    top = top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "item"))), lambda z: z["item"].cast("string")), " ").alias("items"))
    field = e.where("field > 0").groupBy("label", "field").agg(F.count("*").alias("n")).groupBy("label").agg(F.min_by("field", F.struct(-F.col("n"), "field")).alias("field"))
    return size.join(top, "label", "left").join(field, "label", "left").select("label", "size", "core", "x", "y", F.coalesce("items", F.lit("")).alias("items"), "field")


@query("ag32_centroid", "SELECT label::BIGINT AS label, i AS pos, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def ag32(s, d):
    return vectors.centroids(table(s, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("pos"), _r("x").alias("x"))


@query("ag33_second_moments", "SELECT i, j, round(avg(embedding[i]::DOUBLE * embedding[j]::DOUBLE), 6) AS m FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j")
def ag33(s, d):
    return vectors.second_moments(table(s, d, "embeddings"), "embedding", 64).select("i", "j", _r("m").alias("m"))


@query("ag34_shape_statistics", """WITH r AS (SELECT value AS x, user_id::DOUBLE AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rx, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS ry FROM events)
SELECT round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 4) AS skew, round(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 4) AS kurt, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r, (SELECT avg(value) AS m FROM events)""")
def ag34(s, d):
    e = table(s, d, "events").select(F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    r = running.average_rank(running.average_rank(e, "x", "rx"), "y", "ry")
    return r.agg(_r(F.skewness("x"), 4).alias("skew"), _r(F.kurtosis("x"), 4).alias("kurt"), _r(F.corr("x", "y")).alias("pearson"), _r(F.corr("rx", "ry")).alias("spearman"))


@query("ag35_token_estimate", "SELECT m.model, p.protocol, round(sum(length(text) / 4.0) * m.ratio * p.passes / 1e6 * m.price, 6) AS cost FROM conversations, (VALUES ('a', 1.1, 0.5), ('b', 0.9, 2.0)) m(model, ratio, price), (VALUES ('once', 1), ('twice', 2)) p(protocol, passes) GROUP BY m.model, p.protocol, m.ratio, p.passes, m.price")
def ag35(s, d):
    chars = table(s, d, "conversations").agg((F.sum(F.length("text")) / 4.0).alias("t"))
    m = s.createDataFrame([("a", 1.1, 0.5), ("b", 0.9, 2.0)], "model string, ratio double, price double")
    p = s.createDataFrame([("once", 1), ("twice", 2)], "protocol string, passes int")
    return m.crossJoin(p).crossJoin(chars).select("model", "protocol", _r(F.col("t") * F.col("ratio") * F.col("passes") / 1e6 * F.col("price")).alias("cost"))  # one row, models and protocols


@query("ag36_cache_statistics", "SELECT role, count(*) AS replies, count(DISTINCT text) AS uniques, count(*) FILTER (WHERE length(text) > 200) AS long_ones, string_agg(DISTINCT (turn % 3)::VARCHAR, ',' ORDER BY (turn % 3)::VARCHAR) AS providers FROM conversations GROUP BY role")
def ag36(s, d):
    return table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("replies"), F.countDistinct("text").alias("uniques"), F.count_if(F.length("text") > 200).alias("long_ones"), F.array_join(F.array_sort(F.collect_set((F.col("turn") % 3).cast("string"))), ",").alias("providers"))
