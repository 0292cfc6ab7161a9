"""Ranking: postings, BM25, dense ranking, rank fusion and rerank merging.

A run is (system, qid, doc_id, score, rank); ranks start at 1 and ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.running import cut

TOKEN = "[a-z0-9]+"
#: Lucene's English stop words, which are those of bm25s.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(qid, term): a query's distinct terms, less the stop words."""
    return queries.select(F.col(key).alias("qid"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, term, tf) of the given terms, and a row with the empty term for each document, which no token is.

    Read in one scan and written once; tokens that are not asked for leave before anything is shuffled.
    """
    asked = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    split = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "_t")).alias("term"))
    return cut(split.join(asked, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf")))


def matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, term, tf, dl, df, n, avgdl): the postings of query terms, with the statistics of the whole collection."""
    post = postings(docs, terms)
    lengths = post.where("term = '' AND dl > 0").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    return terms.join(post, "term").join(df, "term").crossJoin(F.broadcast(lengths))  # lengths is one row


def bm25(matched: DataFrame, k1: float = 1.5, b: float = 0.75, by: tuple[str, ...] = ("qid", "doc_id")) -> DataFrame:
    score = F.sum(idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    return matched.groupBy(*by).agg(F.round(score, 6).alias("score"), F.count("*").alias("hits"))


def top_k(scored: DataFrame, k: int, *, by: tuple[str, ...] = ("qid",), score: str = "score", tie: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def rrf(runs: DataFrame, top: int = 1000, k: int = 60) -> DataFrame:
    """(qid, doc_id, score, rank): reciprocal rank fusion; a run without the document adds nothing."""
    fused = runs.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top_k(fused, top)


def rerank_merge(run: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """The first `depth` ranks by new score (ties by old rank), the rest in their order with a null score."""
    both = run.select("qid", "doc_id", F.col("rank").alias("old")).join(scores.select("qid", "doc_id", F.col("score").alias("new")), ["qid", "doc_id"], "left")
    both = both.withColumn("score", F.when(F.col("old") <= depth, F.col("new")))
    w = Window.partitionBy("qid").orderBy(F.col("old") > depth, F.desc_nulls_last("score"), "old")
    return both.select("qid", "doc_id", "score", F.row_number().over(w).alias("rank"))


def listwise_merge(run: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """answers (qid, order array<int>): 1-based places shown. Valid ones lead in answer order, then the rest shown, then the tail."""
    said = answers.select("qid", F.posexplode(F.array_distinct(F.filter("order", lambda x: (x >= 1) & (x <= depth)))).alias("at", "place"))
    both = run.select("qid", "doc_id", F.col("rank").alias("old")).join(said, (run["qid"] == said["qid"]) & (F.col("old") == F.col("place")), "left").drop(said["qid"])
    w = Window.partitionBy("qid").orderBy(F.col("at").isNull(), "at", "old")
    return both.select("qid", "doc_id", F.row_number().over(w).alias("rank")).withColumn("score", -F.col("rank").cast("double"))
