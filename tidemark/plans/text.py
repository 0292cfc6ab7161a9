"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import english, text as tx
from tidemark.operators import automaton, dictionary, fuzzy, ranking, running
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("fn1_strings", "SELECT p_partkey, replace(p_name, ' ', '_') AS a, upper(trim(p_brand)) AS b, substr(p_type, 2, 4) AS c, position('e' IN p_name) AS at, length(p_name) AS n, concat_ws('|', p_brand, p_type) AS j FROM part")
def fn1(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("a"), F.upper(F.trim("p_brand")).alias("b"), F.substring("p_type", 2, 4).alias("c"), F.locate("e", "p_name").alias("at"), F.length("p_name").alias("n"), F.concat_ws("|", "p_brand", "p_type").alias("j"))


@query("fn2_split_literal", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, len(string_split(l_returnflag || '|' || l_linestatus || '|', '|')) AS n FROM lineitem")
def fn2(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", F.size(F.split(F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit("|")), r"\|", -1)).alias("n"))


@query("fn3_squeeze", r"SELECT page_id, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS h FROM pages")
def fn3(s, d):
    return table(s, d, "pages").select("page_id", F.md5(tx.squeeze(F.col("html"))).alias("h"))


@query("fn4_regex_dotall", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def fn4(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@query("fn5_strip_markup", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def fn5(s, d):
    return table(s, d, "pages").select("page_id", F.length(tx.squeeze(F.regexp_replace("html", "<[^>]*>", " "))).alias("n"))


@query("fn6_title_normalise", r"SELECT item_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\.+$', '') AS t FROM benchmark")
def fn6(s, d):
    return table(s, d, "benchmark").select("item_id", F.regexp_replace(F.lower(tx.squeeze(F.col("text"))), r"\.+$", "").alias("t"))


@query("fn7_accent_fold")
def fn7(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("h"))


@query("fn8_hyphen_join", "SELECT page_id, regexp_replace(regexp_replace(lower(url) || '/a-b-c--d', '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g'), '([a-z0-9])-([a-z0-9])', '\\1\\2', 'g') AS u FROM pages")
def fn8(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_replace(F.concat(F.lower("url"), F.lit("/a-b-c--d")), "(?<=[a-z0-9])-(?=[a-z0-9])", "").alias("u"))


@query("fn9_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, len(regexp_extract_all(lower(text), '[a-z][a-z0-9-]+')) AS terms FROM documents")
def fn9(s, d):
    n = lambda p: F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)))
    return table(s, d, "documents").select("doc_id", n("[a-z0-9]+").alias("words"), n("[a-z][a-z0-9-]+").alias("terms"))


@query("fn10_stop_words", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: NOT list_contains(['the', 'of', 'and', 'in', 'to', 'a'], x))) AS kept FROM documents")
def fn10(s, d):
    stop = F.array(*map(F.lit, ("the", "of", "and", "in", "to", "a")))
    return table(s, d, "documents").select("doc_id", F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda t: ~F.array_contains(stop, t))).alias("kept"))


@query("fn11_stems", "WITH wd AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS form FROM documents), " + english.stem_sql("wd") + " SELECT d.doc_id, count(DISTINCT stem) AS n_stems, count(DISTINCT form) AS n_words FROM documents d LEFT JOIN (SELECT doc_id, form, stem FROM wd JOIN st USING (form)) w ON w.doc_id = d.doc_id GROUP BY d.doc_id")
def fn11(s, d):
    words = F.array_distinct(ranking.tokens(F.col("text")))
    return table(s, d, "documents").select("doc_id", F.size(F.array_distinct(english.stems(words))).alias("n_stems"), F.size(words).alias("n_words"))


@query("fn12_bigrams", "WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z ]+')) AS part FROM documents), w AS (SELECT doc_id, regexp_extract_all(part, '[a-z]+') AS w FROM p), x AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w), b AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS bigram FROM x) SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY bigram HAVING count(DISTINCT doc_id) >= 20")
def fn12(s, d):
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z ]+"), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit("[a-z]+"), F.lit(0)))
    w = table(s, d, "documents").select(F.filter(words, lambda w: F.size(w) > 1).alias("w"))
    pairs = F.flatten(F.transform("w", lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    return w.select(pairs.alias("t")).select(F.inline(tx.counted("t"))).groupBy(F.col("term").alias("bigram")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where("docs >= 20")


#: nm: names of benchmark passages: their first word, first two and first three, and one with signs in it.
_NAMES = """nm AS (SELECT DISTINCT item_id AS entity, unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '), 'of the', 'a.b']) AS name FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))"""


def names(s, d):
    w = ranking.tokens(F.col("text"))
    lead = [F.array_join(F.slice(w, 1, n), " ") for n in (1, 2, 3)]
    return table(s, d, "benchmark").select(F.col("item_id").alias("entity"), F.explode(F.array(*lead, F.lit("of the"), F.lit("a.b"))).alias("name")).distinct()


@query("fn13_phrase_dictionary", "WITH " + _NAMES + r""", al AS (SELECT '\b(?:' || string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) || ')\b' AS p FROM (SELECT DISTINCT name FROM nm)), x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7f]', 'x', 'g') || ' a.b', p)) AS phrase FROM documents, al)
SELECT doc_id, phrase, count(*) AS n FROM x GROUP BY doc_id, phrase""")
def fn13(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", "x"), F.lit(" a.b")).alias("text"))  # the SQL's boundaries know ASCII only
    return dictionary.mentions(docs, names(s, d)).groupBy("doc_id", F.col("folded").alias("phrase")).agg(F.count("*").alias("n"))


@query("fn14_case_rule", r"SELECT doc_id, len(regexp_extract_all(text, '\bThe\b')) AS exact, len(regexp_extract_all(text, '(?i)\bthorre')) AS any_case FROM documents")
def fn14(s, d):
    return table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\bThe\b")).alias("exact"), F.regexp_count("text", F.lit(r"(?i)\bthorre")).alias("any_case"))


@query("fn15_unicode_boundary", r"SELECT doc_id, regexp_matches(text, '(?:^|[^\pL\pN])été(?:[^\pL\pN]|$)') AS hit FROM documents")
def fn15(s, d):
    return table(s, d, "documents").select("doc_id", F.col("text").rlike(r"(?:^|[^\p{L}\p{N}])été(?:[^\p{L}\p{N}]|$)").alias("hit"))


#: wr: texts that write a Greek letter and gaps in different ways.
_WRITTEN = """wr AS (SELECT p_partkey, 'see TNF' || CASE p_partkey % 4 WHEN 0 THEN '-α' WHEN 1 THEN ' Alpha' WHEN 2 THEN '–alpha' ELSE ' alphas' END || ' and ' || CASE p_partkey % 3 WHEN 0 THEN 'IL 1beta' WHEN 1 THEN 'IL−1β' ELSE 'IL1β' END || ' with ' || replace(p_name, ' ', CASE p_partkey % 2 WHEN 0 THEN '-' ELSE '  ' END) AS text FROM part)"""


@query("fn16_greek_loose", "WITH " + _WRITTEN + r""", nm(name, p) AS (VALUES ('TNF alpha', 'TNF[\s\-–−]+(?:alpha|α)'), ('IL-1β', 'IL[\s\-–−]+1(?:beta|β)'))
SELECT p_partkey, name FROM wr, nm WHERE regexp_matches(text, '(?i)(?:^|[^\pL\pN])' || p || '(?:[^\pL\pN]|$)') UNION ALL SELECT p_partkey, 'own' FROM wr""")
def fn16(s, d):
    n = F.col("p_partkey")
    greek = F.when(n % 4 == 0, "-α").when(n % 4 == 1, " Alpha").when(n % 4 == 2, "–alpha").otherwise(" alphas")
    other = F.when(n % 3 == 0, "IL 1beta").when(n % 3 == 1, "IL−1β").otherwise("IL1β")
    own = F.replace("p_name", F.lit(" "), F.when(n % 2 == 0, "-").otherwise("  "))
    written = table(s, d, "part").select("p_partkey", F.concat(F.lit("see TNF"), greek, F.lit(" and "), other, F.lit(" with "), own).alias("text"), "p_name")
    fold = lambda c: F.lower(tx.loose(c))
    wanted = s.createDataFrame([("TNF alpha",), ("IL-1β",)], "name string").withColumn("folded", fold(F.col("name")))
    found = dictionary.hits(written, wanted, key="p_partkey", fold=fold).select("p_partkey", "folded").distinct().join(wanted, "folded").select("p_partkey", "name")
    # every part's own name, however its gaps are written
    named = dictionary.hits(written, written.select(F.col("p_name").alias("name")), key="p_partkey", fold=fold).join(written.select("p_partkey", fold(F.col("p_name")).alias("folded")), ["p_partkey", "folded"], "left_semi")
    return found.unionByName(named.select("p_partkey", F.lit("own").alias("name")).distinct())


@query("fn17_regex_count", "SELECT doc_id, len(regexp_extract_all(text, '[aeiou]+')) AS n FROM documents")
def fn17(s, d):
    return table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[aeiou]+")).alias("n"))


@query("fn18_regex_any", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])th') AND regexp_matches(text, '(?:^|[^A-Za-z0-9_])re') AND regexp_matches(text, '(?:^|[^A-Za-z0-9_])an')")
def fn18(s, d):
    return table(s, d, "documents").where(tx.contains_all(F.col("text"), ["th", "re", "an"])).select("doc_id")


@query("fn19_longest_spans")
def fn19(s, d):
    # names of passages in two kinds: of several words, and single words, which count inside sentences only; the former lead
    n = names(s, d).select(F.col("name").alias("phrase")).distinct()
    several = F.contains("phrase", F.lit(" "))
    phrases = n.select("phrase", F.when(several, "name").otherwise("word").alias("kind"), F.lit(False).alias("cased"), (~several).alias("inside"))
    return automaton.marked(table(s, d, "documents"), phrases, ("name", "word"))


@query("fn20_truncate_words", r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:20], ' ') || CASE WHEN len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) > 20 THEN ' ...' ELSE '' END AS t FROM documents")
def fn20(s, d):
    w = F.split(tx.squeeze(F.col("text")), " ")
    return table(s, d, "documents").select("doc_id", F.concat(F.array_join(F.slice(w, 1, 20), " "), F.when(F.size(w) > 20, " ...").otherwise("")).alias("t"))


@query("fn21_prompt", "SELECT conv_id, md5(string_agg('[' || turn::VARCHAR || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id")
def fn21(s, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), t["turn"].cast("string"), F.lit("] "), t["text"])), "\n\n")).alias("prompt"))


@query("fn22_hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def fn22(s, d):
    return table(s, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("fn23_fuzzy_title")
def fn23(s, d):
    # every name's others at a ratio of 90 or more
    return fuzzy.links(table(s, d, "part"), "p_partkey", "p_name").withColumn("best_ratio", F.round("best_ratio", 4))


@query("fn24_digits_only", r"SELECT c_custkey, regexp_replace(c_name, '\D', '', 'g') AS digits FROM customer")
def fn24(s, d):
    return table(s, d, "customer").select("c_custkey", F.regexp_replace("c_name", r"\D", "").alias("digits"))


_TPL = r"'^(\S+) \((.*?)\) in (.+)$'"


@query("fn25_template", f"SELECT p_partkey, regexp_extract(t, {_TPL}, 1) AS symbol, regexp_extract(t, {_TPL}, 2) AS name, regexp_extract(t, {_TPL}, 3) AS place FROM (SELECT p_partkey, p_brand || ' (' || p_name || ') in ' || p_type AS t FROM (SELECT p_partkey, replace(p_brand, ' ', '') AS p_brand, p_name, p_type FROM part))")
def fn25(s, d):
    t = F.format_string("%s (%s) in %s", F.replace("p_brand", F.lit(" "), F.lit("")), "p_name", "p_type")
    part = lambda i: F.regexp_extract("t", r"^(\S+) \((.*?)\) in (.+)$", i)
    return table(s, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", part(1).alias("symbol"), part(2).alias("name"), part(3).alias("place"))


@query("fn26_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::BIGINT AS year, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days FROM orders")
def fn26(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").select("o_orderkey", day.alias("day"), F.substring(day, 1, 4).cast("bigint").alias("year"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).alias("days"))


@query("fn27_math", "SELECT p_partkey, round(log2(p_size + 1), 6) AS a, round(ln(p_retailprice), 6) AS b, round(exp(-p_size / 10.0), 6) AS c, greatest(p_size, 25)::BIGINT AS d, round(degrees(acos(p_size / 100.0)), 6) AS e, floor(p_retailprice / 7)::BIGINT AS f FROM part")
def fn27(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select("p_partkey", F.round(F.log2(z + 1.0), 6).alias("a"), F.round(F.log("p_retailprice"), 6).alias("b"), F.round(F.exp(-z / 10.0), 6).alias("c"), F.greatest(z, F.lit(25)).cast("long").alias("d"), F.round(F.degrees(F.acos(z / 100.0)), 6).alias("e"), F.floor(F.col("p_retailprice") / 7).alias("f"))


@query("fn28_rounding", "SELECT p_partkey, round(p_retailprice / 7, 4) AS r FROM part")
def fn28(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 4).alias("r"))


@query("fn29_arrays", "SELECT p_partkey, len(list_distinct(w)) AS n, list_contains(w, 'red') AS red, list_position(w, 'blue') AS at, w[1] AS first, array_to_string(list_sort(w), ' ') AS sorted FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def fn29(s, d):
    w = F.split("p_name", " ")
    at = F.array_position(w, F.lit("blue"))
    return table(s, d, "part").select("p_partkey", F.size(F.array_distinct(w)).alias("n"), F.array_contains(w, "red").alias("red"), F.when(at > 0, at).alias("at"), F.try_element_at(w, F.lit(1)).alias("first"), F.array_join(F.array_sort(w), " ").alias("sorted"))


@query("fn30_struct_comprehension", "SELECT conv_id, array_to_string(list_transform(list_sort(list({'t': turn, 'r': role})), lambda x: x.r), '>') AS roles FROM conversations GROUP BY conv_id")
def fn30(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@query("fn31_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(regexp_extract(props, '[0-9]+') AS BIGINT) AS by_regex FROM events")
def fn31(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint").alias("by_regex"))


#: gr: graded replies of several forms, made from conversations.
_GRADES = """gr AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '```json' || chr(10) || '{"A": {"grade": ' || turn % 4 || ', "reason": "x"}, "Abstract_B": 1, "c": "0", "D": 7}' || chr(10) || '```' WHEN 1 THEN 'Here: {"A": ' || conv_id % 3 || ', "[B]": "2"} as asked' WHEN 2 THEN '{"A": 1, ' WHEN 3 THEN '[1, 2]' ELSE text END AS reply FROM conversations)"""


@query("fn31b_reply_grades", "WITH " + _GRADES + r""", b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(reply, '^\s*```\w*\s*', ''), '\s*```\s*$', '') AS body FROM gr), o AS (SELECT conv_id, turn, coalesce(CASE WHEN json_type(try_cast(body AS JSON)) = 'OBJECT' THEN try_cast(body AS JSON) END, CASE WHEN try_cast(body AS JSON) IS NULL THEN try_cast(regexp_extract(body, '(?s)\{.*\}') AS JSON) END) AS js FROM b),
k AS (SELECT conv_id, turn, js, unnest(json_keys(js)) AS k FROM o WHERE json_type(js) = 'OBJECT'), v AS (SELECT conv_id, turn, upper(regexp_replace(regexp_replace(k, '(?i)^[\W_]*(abstract[\W_]*)?', ''), '[\W_]+$', '')) AS shown, coalesce(json_extract_string(js, '$."' || k || '".grade'), json_extract_string(js, '$."' || k || '"')) AS g FROM k)
SELECT conv_id, turn, shown, try_cast(g AS BIGINT) AS grade FROM v WHERE regexp_full_match(shown, '[A-Z]') AND g IN ('0', '1', '2')""")
def fn31b(s, d):
    c, t = F.col("conv_id"), F.col("turn")
    forms = [
        F.concat(F.lit('```json\n{"A": {"grade": '), (t % 4).cast("string"), F.lit(', "reason": "x"}, "Abstract_B": 1, "c": "0", "D": 7}\n```')), F.concat(F.lit('Here: {"A": '), (c % 3).cast("string"), F.lit(', "[B]": "2"} as asked')),
        F.lit('{"A": 1, '), F.lit("[1, 2]"),
    ]
    reply = F.col("text")
    for k, form in enumerate(forms):
        reply = F.when((c + t) % 5 == k, form).otherwise(reply)
    graded = table(s, d, "conversations").select("conv_id", "turn", F.explode(tx.reply_grades(reply)).alias("shown", "grade"))
    return graded.select("conv_id", "turn", "shown", F.col("grade").cast("long"))


@query("fn32_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS sq, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 6) AS mean FROM embeddings")
def fn32(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(ranking.dot(e, e), 6).alias("sq"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(e), 6).alias("mean"))


@query("fn33_casts", "SELECT p_partkey, p_size::VARCHAR AS a, try_cast(p_name AS BIGINT) AS b, p_retailprice::BIGINT AS c FROM part")
def fn33(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), F.col("p_name").try_cast("bigint").alias("b"), F.bround("p_retailprice").cast("bigint").alias("c"))


@query("fn34_name_class", "SELECT p_type, regexp_matches(p_type, '(?i)steel|brass|tin') AS metal, count(*) AS n FROM part GROUP BY 1, 2")
def fn34(s, d):
    return table(s, d, "part").groupBy("p_type", F.col("p_type").rlike("(?i)steel|brass|tin").alias("metal")).agg(F.count("*").alias("n"))


@query("fn35_binomial_tail", """WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), lf AS (SELECT n, sum(ln(greatest(n, 1)::DOUBLE)) OVER (ORDER BY n) AS lf FROM range(0, (SELECT max(n) + 1 FROM g)) t(n))
SELECT l_suppkey, g.n, g.k, round(sum(exp(a.lf - b.lf - c.lf - g.n * ln(2))), 6) AS tail FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM g) g JOIN lf a ON a.n = g.n JOIN lf b ON b.n = g.i JOIN lf c ON c.n = g.n - g.i GROUP BY ALL""")
def fn35(s, d):
    # for each supplier the chance of at most as many returns among its lines, were half of all returned; logarithms of factorials are running totals
    g = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    most = g.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    lf = running.totals(s.range(most + 1), [F.col("id")], {"lf": F.log(F.greatest("id", F.lit(1)).cast("double"))})
    of = lambda key, name: lf.select(F.col("id").alias(key), F.col("lf").alias(name))
    terms = g.join(of("n", "all"), "n").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k")))).withColumn("j", F.col("n") - F.col("i"))
    part = F.exp(F.col("all") - F.col("own") - F.col("rest") - F.col("n") * F.log(F.lit(2.0)))
    return terms.join(of("i", "own"), "i").join(of("j", "rest"), "j").groupBy("l_suppkey", "n", "k").agg(F.round(F.sum(part), 6).alias("tail"))
