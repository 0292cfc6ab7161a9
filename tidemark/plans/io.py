"""Queries: sources, sinks, streams and the accounting around external producers. What is written goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import bpe
from tidemark.plans.registry import query
from tidemark.sources import readers, shards, sinks
from tidemark.sources.tables import table
from tidemark.streaming import keyed, twins


@query("src1_parquet_glob", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def src1(s: SparkSession, d: str) -> DataFrame:
    return readers.parquet(s, f"{d}/documents.parquet*").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("src2_headerless_tsv", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def src2(s, d):
    path = sinks.scratch(s)
    sinks.write_tsv(table(s, d, "part").select("p_partkey", "p_brand", "p_name"), path)
    return readers.tsv(s, path, "id string, p_brand string, names string").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("src3_typed_tsv", "SELECT p_partkey, p_brand FROM part")
def src3(s, d):
    path = sinks.scratch(s)
    sinks.write_tsv(table(s, d, "part").select("p_partkey", "p_brand"), path)
    return readers.tsv(s, path, "p_partkey long, p_brand string")


@query("src4_tsv_with_header", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def src4(s, d):
    path = sinks.scratch(s)
    sinks.write_tsv(table(s, d, "nation").select("n_nationkey", "n_name"), path, header=True)
    return readers.tsv(s, path, header=True, quote='"')


@query("src5_preamble_and_comments", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region")
def src5(s, d):
    path = sinks.scratch(s)
    rows = table(s, d, "region").select((10 + F.col("r_regionkey")).alias("i"), F.concat_ws(",", "r_regionkey", "r_name").alias("line"))
    head = s.createDataFrame([(i, f"about this file {i}") for i in range(4)], "i int, line string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("i").select("line").write.text(path)
    return readers.csv_after_preamble(s, path, 4, "k bigint, name string")


@query("src6_ndjson", "SELECT c_custkey AS id, c_name AS name FROM customer")
def src6(s, d):
    path = sinks.scratch(s)
    table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.json(path)
    return readers.ndjson(s, path, "id long, name string, other string").select("id", "name")


@query("src7_result_files", "SELECT 'model' || s_nationkey::VARCHAR AS model, count(*) AS tasks, round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY 1")
def src7(s, d):
    path = sinks.scratch(s)
    sup = table(s, d, "supplier").select(F.concat(F.lit("model"), F.col("s_nationkey").cast("string")).alias("model"), F.to_json(F.struct(F.struct(F.array(F.struct(F.col("s_acctbal").alias("main_score"))).alias("test")).alias("scores"))).alias("value"))
    # a folder for each model holding one JSON document a line
    sup.write.partitionBy("model").text(path)
    lines = s.read.text(path).select("model", F.from_json("value", "scores struct<test: array<struct<main_score: double>>>").alias("doc"))
    return lines.groupBy("model").agg(F.count("*").alias("tasks"), F.round(F.sum(F.col("doc.scores.test")[0]["main_score"]), 4).alias("total"))


@query("src8_csv_tables", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region")
def src8(s, d):
    path = sinks.scratch(s)
    table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).coalesce(1).write.option("header", True).csv(path)
    return s.read.schema("k bigint, name string").option("header", True).csv(path)


@query("src9_registered_frame", "SELECT doc_id FROM documents WHERE doc_id IN (1, 5, 9)")
def src9(s, d):
    readers.relation(s, [1, 5, 9], "doc_id").createOrReplaceTempView("src9_need")
    table(s, d, "documents").createOrReplaceTempView("src9_documents")
    return s.sql("SELECT doc_id FROM src9_documents JOIN src9_need USING (doc_id)")


@query("src10_bound_list", "SELECT c_custkey FROM customer WHERE c_custkey IN (2, 4, 8, 16)")
def src10(s, d):
    table(s, d, "customer").createOrReplaceTempView("src10_customer")
    return s.sql("SELECT c_custkey FROM src10_customer WHERE c_custkey IN (SELECT explode(:ids))", args={"ids": F.array(*map(F.lit, (2, 4, 8, 16)))})


@query("src11_row_store", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE event_type <> 'view' GROUP BY user_id")
def src11(s, d):
    # a database in this process's memory stands for the file: rows go in through its driver and come out through a query that it runs
    e = table(s, d, "events").select("user_id", "event_type", "value")
    if s.sparkContext.master.startswith("local["):
        url, name = f"jdbc:derby:memory:{uuid.uuid4().hex}", "events"
        e.coalesce(1).write.format("jdbc").option("url", f"{url};create=true").option("dbtable", name).option("createTableColumnTypes", "event_type varchar(32)").save()
        e = readers.jdbc(s, url, "SELECT \"user_id\", \"value\" FROM events WHERE \"event_type\" <> 'view'")
    else:  # executors of a cluster have memories of their own
        e = e.where("event_type <> 'view'")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("src12_markup_rows", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, coalesce(length(array_to_string(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda p: regexp_replace(p, '<[^>]*>', '', 'g')), chr(10))), 0)::BIGINT AS n FROM pages")
def src12(s, d):
    return readers.markup_rows(table(s, d, "pages")).select("page_id", "title", F.length("abstract").cast("bigint").alias("n"))


@query("src13_job_log", "SELECT user_id::VARCHAR AS job, count(*) FILTER (WHERE event_type = 'view') AS starts, count(*) FILTER (WHERE event_type = 'purchase') AS exits FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type IN ('view', 'purchase')) > 0")
def src13(s, d):
    path = sinks.scratch(s)
    e = table(s, d, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "exit 0").otherwise("note"))
    e.select(line.alias("value")).write.text(path)
    j = readers.job_lines(s.read.text(path))
    return j.groupBy("job").agg(F.count_if(F.col("event") == "start").alias("starts"), F.count_if(F.col("event") == "exit").alias("exits"))


@query("src14_range_read", "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 50 AND doc_id < 120")
def src14(s, d):
    return readers.key_range(table(s, d, "documents"), "doc_id", 50, 120).select("doc_id", "n_chars")


def _shards(df: DataFrame, key: str, **options) -> str:
    """The rows in Arrow shards, in the order of the key; the path."""
    s, path = df.sparkSession, sinks.scratch(df.sparkSession)
    shards.register(s)
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, key).sortWithinPartitions(key).write.format("arrow_shards").mode("overwrite").options(key=key, **options).save(path)
    return path


@query("src15_random_access", "SELECT l.doc_id AS place, d.doc_id, d.lang FROM labels l JOIN (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) d ON d.n = l.doc_id * 13 % (SELECT count(*) + 50 FROM documents)")
def src15(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang")
    path = _shards(docs, "doc_id", batch=1000)
    n = docs.agg((F.count("*") + 50).alias("n"))  # fifty numbers are beyond the last row
    asked = table(s, d, "labels").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("place"), (F.col("doc_id") * 13 % F.col("n")).alias("number"))  # one row
    return shards.take(s, path, asked, ["doc_id", "lang"])


@query("src16_vector_gather", "SELECT doc_id, vec_id IS NOT NULL AS ok, round(embedding[1], 2) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def src16(s, d):
    path = _shards(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", batch=1000)  # whole: half floats round to other hundredths
    ids = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"))
    return shards.gather(s, path, ids, "vec_id", ["embedding"]).select(F.col("vec_id").alias("doc_id"), "ok", F.round(F.get("embedding", F.lit(0)), 2).alias("first"))


@query("src16b_shards_by_id", "SELECT vec_id, len(embedding) AS n FROM embeddings WHERE vec_id >= 100 AND vec_id < 300")
def src16b(s, d):
    # the filters reach the shards, of which only those in the range are read
    path = _shards(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", batch=100, half="embedding")
    return s.read.format("arrow_shards").load(path).where("vec_id >= 100 AND vec_id < 300").select("vec_id", F.size("embedding").alias("n"))


@query("snk1_sorted_parquet", "SELECT s_suppkey, s_name FROM supplier ORDER BY ALL")
def snk1(s, d):
    path = sinks.scratch(s)
    sinks.write_sorted(table(s, d, "supplier").select("s_suppkey", "s_name"), path)
    return s.read.parquet(path)


@query("snk2_arrow_batches", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def snk2(s, d):
    path = _shards(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")
    return s.read.format("arrow_shards").load(path)


@query("snk3_atomic_replace", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_regionkey = 2")
def snk3(s, d):
    path, n = sinks.scratch(s), table(s, d, "nation").select("n_nationkey", "n_regionkey")
    for key in (0, 1, 2):
        sinks.replace(n.where(F.col("n_regionkey") == key).select("n_nationkey"), path)
    return s.read.parquet(sinks.current(s, path))


@query("snk4_resumable_fill", "SELECT s_suppkey, s_suppkey % 2 = 0 AS first_pass, (s_suppkey * 3) % 11 AS score FROM supplier")
def snk4(s, d):
    path, sup = sinks.scratch(s), table(s, d, "supplier").select("s_suppkey")
    score = lambda first: lambda df: df.select("s_suppkey", F.lit(first).alias("first_pass"), ((F.col("s_suppkey") * 3) % 11).alias("score"))
    sinks.fill(sup.where("s_suppkey % 2 = 0"), path, ["s_suppkey"], score(True))
    return sinks.fill(sup, path, ["s_suppkey"], score(False))


@query("snk5_upsert", "SELECT c_custkey, 'new' AS v FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 4 <> 0")
def snk5(s, d):
    path, c = sinks.scratch(s), table(s, d, "customer").select("c_custkey")
    sinks.upsert(c.withColumn("v", F.lit("old")), path, ["c_custkey"])
    sinks.upsert(c.where("c_custkey % 4 = 0").withColumn("v", F.lit("new")), path, ["c_custkey"])
    return s.read.parquet(sinks.current(s, path))


@query("snk6_append_absent", "SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS x FROM nation WHERE n_regionkey < 3")
def snk6(s, d):
    # the second time, names that are there already stay as they are
    path, n = sinks.scratch(s), table(s, d, "nation")
    for x, regions in enumerate(((0, 1), (1, 2))):
        sinks.append_absent(n.where(F.col("n_regionkey").isin(*regions)).select(F.col("n_name").alias("name"), F.lit(x).cast("long").alias("x")), path, ["name"])
    return s.read.parquet(path)


@query("snk7_markdown", "SELECT string_agg('| ' || n_name || ' | ' || n_regionkey::VARCHAR || ' |', chr(10) ORDER BY n_name) AS report FROM nation")
def snk7(s, d):
    n = table(s, d, "nation").withColumn("line", sinks.markdown_row(F.col("n_name"), F.col("n_regionkey")))
    return n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "line"))), lambda x: x["line"]), "\n").alias("report"))


@query("snk8_manifest", """SELECT '{"documents":' || (SELECT count(*) FROM documents)::VARCHAR || ',"labels":' || (SELECT count(*) FROM labels)::VARCHAR || '}' AS manifest""")
def snk8(s, d):
    a, b = table(s, d, "documents").agg(F.count("*").alias("documents")), table(s, d, "labels").agg(F.count("*").alias("labels"))
    return sinks.manifest(a.crossJoin(b))


@query("snk9_csv_download", "SELECT regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') || '.csv' AS file, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def snk9(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.concat_ws("; ", F.array_sort(F.collect_set("c_mktsegment"))).alias("segments"))
    return table(s, d, "nation").join(c, "n_nationkey").select(F.concat(sinks.ascii_name(F.col("n_name")), F.lit(".csv")).alias("file"), "segments")


_SESS = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS value, floor(epoch(min(ts)))::BIGINT AS start FROM s GROUP BY user_id, k"""


@query("sm1_sessions", _SESS)
def sm1(s, d):
    x = twins.sessions(twins.events(s, d, stream=False))
    return x.select("user_id", "n", F.round("value", 4).alias("value"), F.unix_timestamp("start").alias("start"))


@query("sm1_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def sm1c(s, d):
    return twins.tumbling(twins.events(s, d, stream=False)).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("sm1_sliding", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT - 86400 * k AS start, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def sm1d(s, d):
    return twins.sliding(twins.events(s, d, stream=False)).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("sm1_label_state_stream", "SELECT user_id AS labeller, event_id % 50 AS item_id, arg_max(event_id % 3, (ts, event_id)) AS grade FROM events GROUP BY 1, 2")
def sm1b(s, d):
    path = sinks.scratch(s)
    ev = twins.events(s, d, stream=True)
    last = twins.label_state(ev.select(F.col("user_id").alias("labeller"), (F.col("event_id") % 50).alias("item_id"), "ts", "event_id", (F.col("event_id") % 3).alias("grade")), f"{path}/state", f"{path}/checkpoint")
    return s.read.parquet(last).select("labeller", "item_id", F.col("x.grade").alias("grade"))


@query("sm1b_keyed_labels", """WITH e AS (SELECT user_id AS labeller, event_id % 50 AS item_id, ts, event_id, event_id % 3 AS grade, lag(event_id % 3) OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts, event_id) AS before FROM events)
SELECT labeller, item_id, arg_max(grade, (ts, event_id)) AS grade, count(*) FILTER (WHERE grade <> before) AS n_changes FROM e GROUP BY labeller, item_id""")
def sm1e(s, d):
    # each key keeps its own state; what is written is a version of a key for each micro-batch that changes it
    path = sinks.scratch(s)
    log = twins.events(s, d, stream=True).select(F.col("user_id").alias("labeller"), (F.col("event_id") % 50).alias("item_id"), "ts", "event_id", (F.col("event_id") % 3).alias("grade"), F.col("value").cast("double").alias("seconds"))
    keyed.played(log, keyed.labels, f"{path}/out", f"{path}/checkpoint")
    return keyed.current(s.read.parquet(f"{path}/out")).select("labeller", "item_id", "grade", "n_changes")


@query("db35b_hand_outs_stream")
def db35b(s, d):
    # users ask for slots of five pools; a view is a label, which keeps what its user holds
    path = sinks.scratch(s)
    asks = twins.events(s, d, stream=True).select((F.col("user_id") % 5).alias("pool"), F.col("user_id").alias("who"), "ts", "event_id", (F.col("event_type") != "view").alias("asks"))
    keyed.played(asks, keyed.hand_outs, f"{path}/out", f"{path}/checkpoint")
    return s.read.schema(keyed.HANDED).parquet(f"{path}/out").withColumn("at", F.unix_timestamp("at"))


@query("ud3_reply_rows", "SELECT event_id, kv AS k FROM (SELECT event_id, unnest(regexp_extract_all(props, '[0-9]+')) AS kv FROM events)")
def ud3(s, d):
    return table(s, d, "events").select("event_id", F.explode(F.regexp_extract_all("props", F.lit("[0-9]+"), F.lit(0))).alias("k"))


@query("xp2_budget", "SELECT user_id, event_id, round(sum(value) OVER w, 4) AS spent, sum(value) OVER w <= 500 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def xp2(s, d):
    spent = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(s, d, "events").select("user_id", "event_id", F.round(spent, 4).alias("spent"), (spent <= 500).alias("within"))


@query("xp7_token_proxy", "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def xp7(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4.0)).alias("tokens"))


@query("xp7b_token_counts")
def xp7b(s, d):
    import public_tokenizers

    return bpe.token_counts(table(s, d, "documents"), "source", str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


# measured here only

@query("ex1_weighted_miss_rate", "SELECT l_suppkey, round(sum(w * hit) / sum(w), 6) AS estimate FROM (SELECT l_suppkey, count(*) OVER (PARTITION BY l_suppkey, l_returnflag)::DOUBLE AS w, (l_discount > 0.05)::INT AS hit FROM lineitem) GROUP BY l_suppkey")
def ex1(s, d):
    # rows of a stratum weigh as much as it has rows, so its sums can be taken before weighting
    per = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("w"), F.count_if(F.col("l_discount") > 0.05).alias("h"))
    return per.groupBy("l_suppkey").agg(F.round(F.sum(F.col("w") * F.col("h")) / F.sum(F.col("w") * F.col("w")), 6).alias("estimate"))


@query("ex2_cluster_agreement", "WITH c AS (SELECT label AS a, vec_id % 9 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS s FROM c), x AS (SELECT sum(l * (l - 1) / 2) AS x FROM (SELECT sum(n) AS l FROM c GROUP BY a)), y AS (SELECT sum(l * (l - 1) / 2) AS y FROM (SELECT sum(n) AS l FROM c GROUP BY b)) SELECT round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM t, x, y")
def ex2(s, d):
    c = table(s, d, "embeddings").groupBy(F.col("label").alias("a"), (F.col("vec_id") % 9).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda df, name: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias(name))
    one = c.agg(F.sum("n").alias("t")).crossJoin(pairs(c, "s")).crossJoin(pairs(c.groupBy("a").agg(F.sum("n").alias("n")), "x")).crossJoin(pairs(c.groupBy("b").agg(F.sum("n").alias("n")), "y"))  # one row each
    chance = F.col("x") * F.col("y") / (F.col("t") * (F.col("t") - 1) / 2)
    return one.select(F.round((F.col("s") - chance) / ((F.col("x") + F.col("y")) / 2 - chance), 6).alias("ari"))


@query("ex3_specificity_weight", "SELECT l_partkey, round(ln((SELECT count(DISTINCT l_orderkey) FROM lineitem) / count(DISTINCT l_orderkey)::DOUBLE), 6) AS weight FROM lineitem GROUP BY l_partkey")
def ex3(s, d):
    li = table(s, d, "lineitem")
    n = li.agg(F.countDistinct("l_orderkey").alias("n"))
    return li.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("k")).crossJoin(F.broadcast(n)).select("l_partkey", F.round(F.log(F.col("n") / F.col("k")), 6).alias("weight"))  # one row


@query("ex4_short_tag_share", "SELECT brand, round(avg(short::INT), 6) AS share FROM (SELECT p_brand AS brand, p_partkey, bool_and(length(m) <= 4) AS short FROM (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS m FROM part) GROUP BY 1, 2) GROUP BY brand")
def ex4(s, d):
    short = F.forall(F.split("p_name", " "), lambda m: F.length(m) <= 4)
    return table(s, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg(short.cast("double")), 6).alias("share"))


@query("ex5_interaction_test", "SELECT round(avg(CASE WHEN g = 0 THEN v END) - avg(CASE WHEN g = 1 THEN v END), 6) AS observed FROM (SELECT user_id % 2 AS g, avg(CASE WHEN event_type = 'view' THEN value END) - avg(CASE WHEN event_type = 'click' THEN value END) AS v FROM events GROUP BY user_id)")
def ex5(s, d):
    part = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    u = table(s, d, "events").groupBy("user_id").agg((part("view") - part("click")).alias("v"))
    side = lambda g: F.avg(F.when(F.col("user_id") % 2 == g, F.col("v")))
    return u.agg(F.round(side(0) - side(1), 6).alias("observed"))
