"""Paired statistics with hash-drawn randomness: every draw is a function of (seed, replicate, unit)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.running import totals


def hash32(*parts: Column) -> Column:
    """A portable integer below 2^32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def sign_flip_exact(diffs: DataFrame, by: str = "pair", unit: str = "unit", value: str = "diff") -> DataFrame:
    """(by, n, mean, p): all 2^n sign patterns of each group, of at most 16 units; larger groups are for sign_flip_sampled."""
    n = diffs.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("obs"))
    most = n.agg(F.max("n")).first()[0] or 0
    if most > 16:
        raise ValueError(f"a group has {most} units: 2^{most} sign patterns are too many, use sign_flip_sampled")
    placed = diffs.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(unit)) - 1).join(n, by)
    flipped = placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.col("n")).cast("int") - 1)))
    bit = F.expr("shiftright(p, i) & 1")
    sums = flipped.groupBy(by, "n", "obs", "p").agg(F.sum(F.when(bit == 1, F.col(value)).otherwise(-F.col(value))).alias("s"))
    return sums.groupBy(by, "n", "obs").agg(F.avg((F.abs("s") >= F.abs("obs") - 1e-9).cast("double")).alias("p")).select(by, "n", (F.col("obs") / F.col("n")).alias("mean"), "p")


def sign_flip_sampled(diffs: DataFrame, draws: int, by: str = "pair", unit: str = "unit", value: str = "diff") -> DataFrame:
    """(by, mean, p): (1 + draws at least as far from 0) / (1 + draws); signs shared by all groups for one unit."""
    r = diffs.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sign = F.when(hash32(F.col("r").cast("string"), F.col(unit).cast("string")) % 2 == 0, 1.0).otherwise(-1.0)
    sums = r.groupBy(by, "r").agg(F.sum(sign * F.col(value)).alias("s"))
    obs = diffs.groupBy(by).agg(F.sum(value).alias("obs"), F.avg(value).alias("mean"))
    return sums.join(obs, by).groupBy(by, "mean").agg(((1 + F.count_if(F.abs("s") >= F.abs("obs") - 1e-9)) / (1.0 + draws)).alias("p"))


def holm(pvalues: DataFrame, p: str = "p", by: str = "pair") -> DataFrame:
    """Adds p_holm: the running maximum of min(1, (m - i) p) in order of p."""
    everyone = Window.partitionBy(F.lit(1))
    ranked = pvalues.withColumns({"_m": F.count("*").over(everyone), "_i": F.row_number().over(everyone.orderBy(p, by))})
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return ranked.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(everyone.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_i", "_s")


def bootstrap(diffs: DataFrame, draws: int, by: str = "pair", unit: str = "unit", value: str = "diff") -> DataFrame:
    """(by, mean, lo, hi, p): percentile interval of the mean over hash-drawn units; p = 2 min(P(<=0), P(>=0))."""
    n = diffs.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    placed = diffs.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(unit)) - 1)
    drawn = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = drawn.withColumn("i", (hash32(F.col("r").cast("string"), F.col("j").cast("string")) % F.col("n")).cast("int"))
    means = drawn.join(placed.select(by, "i", value), [by, "i"]).groupBy(by, "mean", "r").agg(F.avg(value).alias("m"))
    out = means.groupBy(by, "mean").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("le"), F.avg((F.col("m") >= 0).cast("double")).alias("ge"))
    return out.select(by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p"))


def cluster_bootstrap(rows: DataFrame, draws: int, cluster: str, value: str) -> DataFrame:
    """(r, mean): means over clusters drawn with replacement, as weights on cluster sums."""
    per = rows.groupBy(cluster).agg(F.sum(value).alias("x"), F.count("*").alias("k"))
    placed = totals(per, [F.col(cluster)], {"_at": F.lit(1)}).withColumn("i", (F.col("_at") - 1).cast("int")).drop("_at")
    n = placed.count()
    # a number for each draw, dealt over the tasks; counted before they meet the clusters, and never broadcast
    drawn = rows.sparkSession.range(draws * n).select(F.expr(f"CAST(id DIV {max(n, 1)} AS INT)").alias("r"), (F.col("id") % F.lit(max(n, 1))).alias("j"))
    drawn = drawn.withColumn("i", (hash32(F.col("r").cast("string"), F.col("j").cast("string")) % F.lit(n)).cast("int"))
    times = drawn.groupBy("r", "i").agg(F.count("*").alias("times"))
    return times.hint("shuffle_merge").join(placed.hint("shuffle_merge"), "i").groupBy("r").agg((F.sum(F.col("x") * F.col("times")) / F.sum(F.col("k") * F.col("times"))).alias("mean"))


def mcnemar(table: DataFrame, b: str = "b", c: str = "c") -> DataFrame:
    """Adds p: the exact two-sided binomial test of b against c, 1 when both are 0."""
    n, k = F.col(b) + F.col(c), F.least(b, c)
    # each term from the one before: log C(n, i) = log C(n, i - 1) + log (n - i + 1) - log i
    first = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("log"), (s["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), first, add)["sum"]
    return table.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def kappa(pairs: DataFrame, a: str, b: str, power: int, levels: int) -> DataFrame:
    """(n, kappa): weighted Cohen's kappa with weights (|i - j| / (levels - 1))^power, from the contingency table."""
    w = lambda x, y: F.pow(F.abs(x - y) / (levels - 1.0), F.lit(power))
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.col("n") * w(F.col(a), F.col(b))).alias("o"))
    left, right = cells.groupBy(a).agg(F.sum("n").alias("x")), cells.groupBy(b).agg(F.sum("n").alias("y"))
    expected = left.crossJoin(right).agg(F.sum(F.col("x") * F.col("y") * w(F.col(a), F.col(b))).alias("e"))  # levels x levels rows
    return total.crossJoin(expected).select(F.col("t").alias("n"), (1 - (F.col("o") / F.col("t")) / (F.col("e") / F.col("t") / F.col("t"))).alias("kappa"))


def pareto(points: DataFrame, cost: str, score: str, tie: str) -> DataFrame:
    """The points that no cheaper (or equally dear and better) point matches, in order of cost."""
    w = Window.partitionBy(F.lit(1)).orderBy(cost, F.desc(score), tie)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_b", best).where(F.col("_b").isNull() | (F.col(score) > F.col("_b"))).drop("_b")


def letters(names: list[str], different: set[tuple[str, str]]) -> dict[str, str]:
    """Compact letter display: one letter for each largest set of names of which no two differ.

    Those sets are the maximal cliques of the graph of pairs that do not differ, found by branching on the neighbours of
    a pivot; a letter for every one of them is what inserting and absorbing columns ends in.
    """
    apart = {n: set() for n in names}
    for a, b in different:
        if a in apart and b in apart:
            apart[a].add(b)
            apart[b].add(a)
    near = {n: {m for m in names if m != n} - apart[n] for n in names}
    found, stack = [], [(frozenset(), set(names), set())]
    while stack:
        held, open_, shut = stack.pop()
        if not open_ and not shut:
            found.append(held)
            continue
        pivot = max(sorted(open_ | shut), key=lambda n: len(near[n] & open_))
        for n in sorted(open_ - near[pivot]):
            stack.append((held | {n}, open_ & near[n], shut & near[n]))
            open_ = open_ - {n}
            shut = shut | {n}
    found.sort(key=lambda c: [n not in c for n in names])
    sign = lambda i: (sign(i // 26 - 1) if i >= 26 else "") + chr(97 + i % 26)
    return {n: "".join(sign(i) for i, c in enumerate(found) if n in c) for n in names}


def letter_display(margin: float):
    """An aggregate of (system, mean) rows: array<struct<system, letters>>, where means that differ by more than the margin share no letter."""

    def show(names: pd.Series, means: pd.Series) -> list:
        order = sorted(zip(names, means), key=lambda x: (-x[1], x[0]))
        far = {(a, b) for i, (a, x) in enumerate(order) for b, y in order[i + 1 :] if abs(x - y) > margin}
        return [{"system": n, "letters": l} for n, l in letters([n for n, _ in order], far).items()]

    return F.pandas_udf(show, "array<struct<system: string, letters: string>>", F.PandasUDFType.GROUPED_AGG)
