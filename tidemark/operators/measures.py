"""Ranking measures in long form, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def ideal(n: Column, k: int) -> Column:
    """Sum of the first min(n, k) discounts."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + discount(i))


def binary(runs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Per system and gold query: recall at each k, ndcg10, mrr10, hit1. Queries without a ranking count 0."""
    n_gold = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = runs.join(gold, ["qid", "doc_id"])
    per = hits.groupBy("system", "qid").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks],
        F.sum(F.when(F.col("rank") <= 10, discount(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"),
    )
    systems = runs.agg(F.collect_set("system").alias("systems"))  # one row, of names that people gave
    every = n_gold.crossJoin(F.broadcast(systems)).select(F.explode("systems").alias("system"), "qid", "n_gold")
    per = every.join(per, ["system", "qid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.select(
        "system", "qid", *[zero(F.col(f"h{k}") / F.col("n_gold")).alias(f"recall{k}") for k in ks], zero(F.col("dcg") / ideal(F.col("n_gold"), 10)).alias("ndcg10"),
        zero(F.when(F.col("first") <= 10, 1.0 / F.col("first"))).alias("mrr10"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("hit1"),
    )


def condense(runs: DataFrame, drop: DataFrame) -> DataFrame:
    """Runs without the pairs of drop, ranked anew in the old order."""
    w = Window.partitionBy("system", "qid").orderBy("rank")
    return runs.join(drop.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti").withColumn("rank", F.row_number().over(w)).select(*runs.columns)


def graded(runs: DataFrame, grades: DataFrame, k: int = 10, thresholds: tuple[int, ...] = (1, 2)) -> DataFrame:
    """ndcg (null without a positive grade), precision at each threshold over k (null if none reaches it), judged share and bpref."""
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")
    best = grades.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("grade") * discount(F.col("r"))).alias("idcg"))
    have = grades.groupBy("qid").agg(*[F.count_if(F.col("grade") >= t).alias(f"R{t}") for t in thresholds], F.count_if(F.col("grade") < 1).alias("N"))
    joined = runs.join(grades, ["qid", "doc_id"], "left")
    top = joined.where(F.col("rank") <= k).groupBy("system", "qid").agg(
        F.sum(F.coalesce(F.col("grade"), F.lit(0)) * discount(F.col("rank"))).alias("dcg"), *[F.count_if(F.col("grade") >= t).alias(f"n{t}") for t in thresholds],
        F.count("grade").alias("judged"), F.count("*").alias("shown"),
    )
    above = Window.partitionBy("system", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rel = joined.where(F.col("grade").isNotNull()).withColumn("bad", F.coalesce(F.sum((F.col("grade") < 1).cast("int")).over(above), F.lit(0))).where("grade >= 1")
    pref = rel.join(have, "qid").groupBy("system", "qid").agg(F.sum(F.when(F.col("bad") == 0, 1.0).otherwise(1.0 - F.least(F.col("bad"), F.col("R1"), F.col("N")) / F.least("R1", "N"))).alias("pref"))
    out = top.join(best, "qid", "left").join(have, "qid", "left").join(pref, ["system", "qid"], "left")
    return out.select(
        "system", "qid", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).alias("ndcg"), *[F.when(F.col(f"R{t}") > 0, F.col(f"n{t}") / k).alias(f"p_ge{t}") for t in thresholds],
        (F.col("judged") / F.col("shown")).alias("judged"), F.when(F.col("R1") > 0, F.coalesce("pref", F.lit(0.0)) / F.col("R1")).alias("bpref"),
    )


def average_precision(runs: DataFrame, gold: DataFrame, k: int = 20) -> DataFrame:
    """Per system and query with hits: sum over gold of the precision at its rank, over the number of gold."""
    w = Window.partitionBy("system", "qid").orderBy("rank")
    hit = runs.where(F.col("rank") <= k).join(gold, ["qid", "doc_id"]).withColumn("p", F.row_number().over(w) / F.col("rank"))
    return hit.groupBy("system", "qid").agg(F.sum("p").alias("p")).join(gold.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("system", "qid", (F.col("p") / F.col("n")).alias("ap"))
