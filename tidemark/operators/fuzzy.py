"""Similarity join of short texts by the indel ratio of their sorted words: 100 * 2 LCS / (lengths) >= least.

Two texts at that ratio are at most t = (100 - least) % of their lengths in insertions and deletions apart. Cut the shorter
into t + 1 pieces: as each edit touches one piece, one piece is whole in the longer text, and shifted by no more than the
edits allow. So pieces of texts are joined by equality with the pieces of longer ones at those places, for each length that
a partner can have; what meets must pass a bounded edit distance inside the join, and is compared exactly at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import indel_column
from tidemark.operators.running import cut


def sorted_words(text: Column) -> Column:
    """The text's words, lowered, in order of code points, with single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")), " ")


def _edits(a: str, b: str, least: int) -> str:
    """SQL: insertions and deletions that texts of two lengths may be apart."""
    return f"((({a}) + ({b})) * {100 - least} div 100)"


def pairs(texts: DataFrame, least: int = 90) -> DataFrame:
    """(a, b, ratio) of all pairs of the distinct, non-null texts in column `t` at the ratio or over it, each pair once.

    The empty text has no partner. least is a whole number from 51 to 100.
    """
    top = f"(n * {least} + {200 - least} - 1) div {200 - least}"  # the least length of a partner of a text of length n
    t = cut(texts.where("t IS NOT NULL AND t <> ''").select("t").distinct().withColumn("n", F.length("t")))
    # pieces of a text: of n characters into e + 1, where e is what a partner up to the longest allows
    longest = f"(n * {200 - least}) div {least}"
    own = t.withColumn("e", F.expr(_edits("n", longest, least)))
    own = own.select("t", "n", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"), "e")
    start = "(i * n div (e + 1))"
    own = own.select(F.col("t").alias("a"), "n", "i", F.expr(f"substring(t, {start} + 1, ((i + 1) * n div (e + 1)) - {start})").alias("piece"))
    # where the pieces of a text of m characters, m <= n, may stand in this one
    far = t.select("t", "n", F.explode(F.expr(f"sequence({top}, n)")).alias("m"))
    far = far.withColumn("e", F.expr(_edits("m", f"(m * {200 - least}) div {least}", least))).withColumn("d", F.expr(f"({_edits('m', 'n', least)} - (n - m)) div 2"))
    far = far.where("d >= 0").select("t", "n", "m", "e", "d", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"))
    far = far.withColumn("s", F.expr("i * m div (e + 1)")).withColumn("w", F.expr("((i + 1) * m div (e + 1)) - s"))
    far = far.where("w > 0").select("t", "n", "m", "i", "w", F.explode(F.expr("sequence(greatest(0, s - d), greatest(greatest(0, s - d), least(n - w, s + (n - m) + d)))")).alias("at"))
    far = far.select(F.col("t").alias("b"), F.col("m").alias("n"), "i", F.expr("substring(t, at + 1, w)").alias("piece")).distinct()
    apart = F.expr(f"levenshtein(a, b, cast({_edits('length(a)', 'length(b)', least)} AS int)) >= 0")
    met = own.where("piece <> ''").join(far, ["n", "i", "piece"]).where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).where(apart).select("a", "b").distinct()
    return met.withColumn("ratio", indel_column(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def links(rows: DataFrame, key: str, text: str, least: int = 90) -> DataFrame:
    """One row per row: key, n_links (other rows at the ratio or over it) and best_ratio, the highest among them (null without any).

    Rows of one text meet as a class, so copies are counted, not paired. Null texts and texts without words have no links.
    """
    named = cut(rows.select(F.col(key).alias("_key"), sorted_words(F.col(text)).alias("t")))
    classes = named.where("t <> ''").groupBy("t").agg(F.count("*").alias("n"))
    near = cut(pairs(classes, least))
    both = near.select(F.col("a").alias("t"), F.col("b").alias("o"), "ratio").unionByName(near.select(F.col("b").alias("t"), F.col("a").alias("o"), "ratio"))
    others = both.join(classes.select(F.col("t").alias("o"), F.col("n").alias("_n")), "o").groupBy("t").agg(F.sum("_n").alias("_others"), F.max("ratio").alias("_best"))
    per = classes.join(others, "t", "left").select(
        "t", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"), F.when(F.col("n") > 1, F.lit(100.0)).otherwise(F.col("_best")).alias("best_ratio"))
    out = named.join(cut(per), "t", "left")
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best_ratio")
