"""Queries: projections, filters, predicates, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import config
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("prj1_composite_key", "SELECT l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS qid, split_part(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR, '|', 1) AS target FROM lineitem")
def prj1(s: SparkSession, d: str) -> DataFrame:
    q = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(s, d, "lineitem").select(q.alias("qid"), F.split_part(q, F.lit("|"), F.lit(1)).alias("target"))


@query("prj2_section_after_marker", "SELECT page_id, CASE WHEN position('<p>' IN html) > 0 THEN trim(substr(html, position('<p>' IN html) + 3)) ELSE '' END AS section FROM pages")
def prj2(s, d):
    at = F.locate("<p>", "html")
    return table(s, d, "pages").select("page_id", F.when(at > 0, F.trim(F.substr("html", at + 3))).otherwise("").alias("section"))


_DOC = "CASE WHEN doc_id % 3 <> 0 THEN source || chr(10) || chr(10) || text ELSE text END"


def _doc_text():
    return F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit("\n\n"), "text")).otherwise(F.col("text"))


@query("prj3_document_text", f"SELECT doc_id, md5({_DOC}) AS h, length({_DOC}) AS n FROM documents")
def prj3(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(_doc_text()).alias("h"), F.length(_doc_text()).alias("n"))


@query("prj4_split_text_back", f"SELECT doc_id, title, md5(CASE WHEN title IS NULL THEN t ELSE substr(t, length(title) + 3) END) AS body FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN split_part(t, chr(10) || chr(10), 1) END AS title FROM (SELECT doc_id, {_DOC} AS t FROM documents))")
def prj4(s, d):
    t = table(s, d, "documents").select("doc_id", _doc_text().alias("t"))
    title = F.when(F.col("doc_id") % 3 != 0, F.split_part("t", F.lit("\n\n"), F.lit(1)))  # others have none in front
    return t.select("doc_id", title.alias("title"), F.md5(F.when(title.isNull(), F.col("t")).otherwise(F.substr("t", F.length(title) + 3))).alias("body"))


@query("prj5_banding", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' ELSE 'large' END AS band FROM part")
def prj5(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select("p_partkey", F.when(z.between(1, 10), "small").when(z.between(11, 30), "medium").otherwise("large").alias("band"))


@query("prj6_half_open_cut", "SELECT CASE WHEN value <= 0 THEN NULL WHEN value <= 10 THEN '(0,10]' WHEN value <= 50 THEN '(10,50]' ELSE '(50,inf]' END AS bin, count(*) AS n FROM events GROUP BY 1")
def prj6(s, d):
    v = F.col("value")
    return table(s, d, "events").groupBy(F.when(v <= 0, None).when(v <= 10, "(0,10]").when(v <= 50, "(10,50]").otherwise("(50,inf]").alias("bin")).agg(F.count("*").alias("n"))


@query("prj7_five_year_bin", "SELECT (year(o_orderdate) // 5 * 5)::VARCHAR || '-' || (year(o_orderdate) // 5 * 5 + 4)::VARCHAR AS bin, count(*) AS n FROM orders GROUP BY 1")
def prj7(s, d):
    lo = F.expr("year(o_orderdate) div 5 * 5")
    return table(s, d, "orders").groupBy(F.concat(lo.cast("string"), F.lit("-"), (lo + 4).cast("string")).alias("bin")).agg(F.count("*").alias("n"))


@query("prj8_json_field", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def prj8(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("prj9_digits_only", "SELECT count(*) FILTER (WHERE regexp_matches(split_part(url, '/', -1), '^[0-9]+$')) AS digits, count(*) AS n FROM pages")
def prj9(s, d):
    return table(s, d, "pages").agg(F.count_if(F.split_part("url", F.lit("/"), F.lit(-1)).rlike("^[0-9]+$")).alias("digits"), F.count("*").alias("n"))


@query("prj10_like_escape", r"SELECT p_partkey, p_name LIKE '%\_%' ESCAPE '\' AS underscore, p_name LIKE 'a%' OR p_name LIKE '%red%' AS any_of FROM part")
def prj10(s, d):
    return table(s, d, "part").select("p_partkey", F.expr(r"p_name LIKE '%/_%' ESCAPE '/'").alias("underscore"), F.expr("p_name LIKE ANY ('a%', '%red%')").alias("any_of"))


@query("prj11_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def prj11(s, d):
    o = table(s, d, "orders")
    c = table(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    gone = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


_SRC = "(SELECT l_partkey, list(DISTINCT l_suppkey) AS srcs, bool_or(l_returnflag = 'R') AS flag FROM lineitem GROUP BY l_partkey)"


def _srcs(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("srcs"), F.bool_or(F.col("l_returnflag") == "R").alias("flag"))


@query("prj12_three_valued_flag", f"SELECT l_partkey, CASE WHEN list_contains(srcs, 1) THEN coalesce(flag, false) END AS green FROM {_SRC}")
def prj12(s, d):
    return _srcs(s, d).select("l_partkey", F.when(F.array_contains("srcs", F.lit(1).cast("bigint")), F.coalesce("flag", F.lit(False))).alias("green"))


@query("prj13_quality_flags", f"SELECT l_partkey, len(srcs) >= 2 AND NOT flag AS clean, len(srcs) >= 2 OR NOT flag AS clean_lenient FROM {_SRC}")
def prj13(s, d):
    many = F.size("srcs") >= 2
    return _srcs(s, d).select("l_partkey", (many & ~F.col("flag")).alias("clean"), (many | ~F.col("flag")).alias("clean_lenient"))


@query("prj14_glob_filter", "SELECT p_partkey FROM part WHERE p_name GLOB 'b*red*' OR p_name GLOB '?l*'")
def prj14(s, d):
    return table(s, d, "part").where(F.expr("p_name LIKE 'b%red%' OR p_name LIKE '_l%'")).select("p_partkey")


_STEM = "(SELECT l_orderkey, l_returnflag || '__' || l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN '__x' ELSE '+y' END AS stem FROM lineitem)"


def _stems(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.lit("__"), "l_linestatus", F.when(F.col("l_linenumber") % 2 == 0, "__x").otherwise("+y")).alias("stem"))


@query("prj15_system_class", f"SELECT stem, contains(stem, '__') AND NOT contains(stem, '+') AND NOT contains(stem, '-of-') AS dense, count(*) AS n FROM {_STEM} GROUP BY 1, 2")
def prj15(s, d):
    c = F.col("stem")
    return _stems(s, d).groupBy("stem", (c.contains("__") & ~c.contains("+") & ~c.contains("-of-")).alias("dense")).agg(F.count("*").alias("n"))


@query("prj16_right_split", f"SELECT DISTINCT stem, regexp_extract(stem, '^(.*)__(.*)$', 1) AS system, regexp_extract(stem, '^(.*)__(.*)$', 2) AS track FROM {_STEM}")
def prj16(s, d):
    part = lambda i: F.regexp_extract("stem", "^(.*)__(.*)$", i)
    return _stems(s, d).select("stem").distinct().select("stem", part(1).alias("system"), part(2).alias("track"))


@query("prj17_year_window", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate) END AS year, o_orderkey % 10 = 0 AS undated FROM orders WHERE o_orderkey % 10 = 0 OR year(o_orderdate) BETWEEN 1994 AND 1996")
def prj17(s, d):
    undated = F.col("o_orderkey") % 10 == 0
    return table(s, d, "orders").where(undated | F.year("o_orderdate").between(1994, 1996)).select("o_orderkey", F.when(~undated, F.year("o_orderdate")).alias("year"), undated.alias("undated"))


@query("prj18_filter_funnel", """WITH f AS (SELECT *, l_quantity > 5 AS s1, l_quantity > 5 AND l_discount > 0.02 AS s2, l_quantity > 5 AND l_discount > 0.02 AND l_tax > 0.03 AS s3 FROM lineitem)
SELECT step, count(*) FILTER (WHERE ok) AS row_count, count(DISTINCT CASE WHEN ok THEN l_partkey END) AS docs, count(DISTINCT CASE WHEN ok THEN l_orderkey END) AS keys FROM (SELECT 0 AS step, true AS ok, l_partkey, l_orderkey FROM f UNION ALL SELECT 1, s1, l_partkey, l_orderkey FROM f UNION ALL SELECT 2, s2, l_partkey, l_orderkey FROM f UNION ALL SELECT 3, s3, l_partkey, l_orderkey FROM f) GROUP BY step""")
def prj18(s, d):
    li = table(s, d, "lineitem")
    rules = [F.lit(True), F.col("l_quantity") > 5, F.col("l_discount") > 0.02, F.col("l_tax") > 0.03]
    passed = [F.lit(True)]
    for r in rules[1:]:
        passed.append(passed[-1] & r)
    # one row per (row, step it passes), counted in one aggregation
    long = li.select("l_partkey", "l_orderkey", F.explode(F.filter(F.array(*[F.when(p, F.lit(i)) for i, p in enumerate(passed)]), lambda x: x.isNotNull())).alias("step"))
    return long.groupBy("step").agg(F.count("*").alias("row_count"), F.countDistinct("l_partkey").alias("docs"), F.countDistinct("l_orderkey").alias("keys"))


@query("prj19_first_reject_reason", "SELECT coalesce(CASE WHEN l_quantity < 5 THEN 'few' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, 'kept') AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def prj19(s, d):
    why = F.coalesce(F.when(F.col("l_quantity") < 5, "few"), F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_returnflag") == "R", "returned"), F.lit("kept"))
    return table(s, d, "lineitem").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("prj20_integrity", "SELECT (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS repeated_keys, (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS out_of_domain, (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) AS orphans")
def prj20(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    a = o.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("repeated_keys"))
    b = li.agg(F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("out_of_domain"))
    c = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("prj21_required_columns", "SELECT * FROM (VALUES ('documents', 'text', true), ('documents', 'title', false), ('labels', 'quality', true)) v(tbl, col, present)")
def prj21(s, d):
    need = [("documents", "text"), ("documents", "title"), ("labels", "quality")]
    return s.createDataFrame([(t, c, c in table(s, d, t).columns) for t, c in need], "tbl string, col string, present boolean")


#: A configuration as text for each part: n may be missing or not positive, seed may be no number, and a key may be unknown.
_CONFIG = """to_json(map_filter(map('n', if(p_size % 3 = 0, null, string(p_size - 25)), 'seed', if(p_size % 4 = 0, 'a', '3'), 'typo', if(p_size % 5 = 0, '1', null)), (k, v) -> v IS NOT NULL))"""


@query("prj22_config_errors", """SELECT p_partkey, 'n' AS key, CASE WHEN p_size % 3 = 0 THEN 'is missing' ELSE 'is not positive' END AS error FROM part WHERE p_size % 3 = 0 OR p_size <= 25
UNION ALL SELECT p_partkey, 'seed', 'is not an int' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'typo', 'is unknown' FROM part WHERE p_size % 5 = 0""")
def prj22(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(config.listed(F.expr(_CONFIG), ["n", "seed"])).alias("e")).select("p_partkey", "e.key", "e.error")


@query("prj23_text_starts_with_title", "SELECT count(*) FILTER (WHERE NOT starts_with(source || ': ' || text, source)) AS broken, count(*) AS n FROM documents WHERE source IS NOT NULL")
def prj23(s, d):
    return table(s, d, "documents").where("source IS NOT NULL").agg(F.count_if(~F.startswith(F.concat("source", F.lit(": "), "text"), F.col("source"))).alias("broken"), F.count("*").alias("n"))


@query("prj24_label_index", "SELECT p_partkey AS text_id, dense_rank() OVER (ORDER BY p_type) - 1 AS label FROM part")
def prj24(s, d):
    p = table(s, d, "part")
    # ranks are given to the few distinct labels, not to all rows in one window
    index = p.select("p_type").distinct().withColumn("label", F.row_number().over(Window.orderBy("p_type")) - 1)
    return p.join(index, "p_type").select(F.col("p_partkey").alias("text_id"), "label")


@query("prj25_stack_text_columns", "SELECT kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT 'name' AS kind, p_name AS t FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'brand', p_brand FROM part) GROUP BY kind")
def prj25(s, d):
    long = table(s, d, "part").selectExpr("stack(3, 'name', p_name, 'type', p_type, 'brand', p_brand) AS (kind, t)")
    return long.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))
