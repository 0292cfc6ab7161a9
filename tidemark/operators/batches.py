"""Conflict-free batches of a whole table: rows of a batch share no doc, and none has a doc that another guards."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.running import cut, totals

_KEYS = "docs array<long>, guard array<long>"


def fit(rows: Iterable[tuple[Iterable, Iterable]], batches: Iterable[tuple[int, Iterable, Iterable]], size: int) -> list[int]:
    """The batch of each row (docs, guard), -1 if it fits none; batches (rows, docs, guard) may hold rows already.

    The first batch that fits, from a start that moves on with each row. Bit j of a mask stands for batch j.
    """
    n, held, guarded, free = [], {}, {}, 0
    for j, (count, docs, guard) in enumerate(batches):
        n.append(count)
        free |= (count < size) << j
        for d in docs:
            held[d] = held.get(d, 0) | 1 << j
        for g in guard:
            guarded[g] = guarded.get(g, 0) | 1 << j
    out = []
    for k, (docs, guard) in enumerate(rows):
        fits = free
        for d in docs:
            fits &= ~(held.get(d, 0) | guarded.get(d, 0))
        for g in guard:
            fits &= ~held.get(g, 0)
        if not fits:
            out.append(-1)
            continue
        start = k % len(n)
        later = fits >> start << start or fits
        j = (later & -later).bit_length() - 1
        n[j] += 1
        if n[j] >= size:
            free &= ~(1 << j)
        for d in docs:
            held[d] = held.get(d, 0) | 1 << j
        for g in guard:
            guarded[g] = guarded.get(g, 0) | 1 << j
        out.append(j)
    return out


def _settled(left: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The rows of left with a key for which each of the n open batches is barred; batches only fill, so they stay out."""
    held = state.select("batch", F.explode("docs").alias("key"))
    barred = lambda d, kind: d.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == n).select("key", F.lit(kind).alias("kind"))
    full = barred(held.union(state.select("batch", F.explode("guard").alias("key"))), "doc").union(barred(held, "guard"))
    keys = left.select("row", F.explode("docs").alias("key"), F.lit("doc").alias("kind")).union(left.select("row", F.explode("guard"), F.lit("guard")))
    return keys.join(full, ["key", "kind"], "left_semi").select("row").distinct()


def plan(rows: DataFrame, order: list[Column], size: int, group: int = 2048) -> DataFrame:
    """(row, batch) of all rows (row, docs, guard): ceil(n / size) batches, and -1 for a row that conflicts with each or finds it full.

    Runs of `group` rows in the order (a multiple of size) fill their own batches in parallel. What fits none there is
    tried on the open batches of all runs, in as many passes as there are groups of such rows, so that each meets each.
    """
    if group % size:
        raise ValueError("group must be a multiple of size")
    ranked = totals(rows, order, {"_at": F.lit(1)}).withColumn("_group", F.floor((F.col("_at") - 1) / group))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        got = pd.Series(fit(zip(rows["docs"], rows["guard"], strict=True), [(0, (), ())] * -(-len(rows) // size), size), rows.index)
        rows["batch"] = got.where(got < 0, got + rows["_group"] * (group // size))
        return rows[["row", "_at", "docs", "guard", "batch"]]

    def again(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows, state = rows.sort_values("_at"), state.sort_values("batch")
        got = fit(zip(rows["docs"], rows["guard"], strict=True), zip(state["n"].tolist(), state["docs"], state["guard"], strict=True), size)
        rows["batch"] = [state["batch"].iloc[j] if j >= 0 else -1 for j in got]
        return rows[["row", "_at", "docs", "guard", "batch"]]

    out = f"row {dict(rows.dtypes)['row']}, _at long, {_KEYS}, batch long"
    tried = cut(ranked.groupBy("_group").applyInPandas(first, out))
    placed, left = tried.where("batch >= 0"), tried.where("batch < 0").drop("batch")
    n, passes, k, lost = tried.count(), 1, 0, []
    while k < passes and not left.isEmpty():
        flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        have = placed.groupBy("batch").agg(F.count("*").alias("n"), flat("docs"), flat("guard"))
        state = rows.sparkSession.range(-(-n // size)).withColumnRenamed("id", "batch").join(have, "batch", "left")
        none = F.array().cast("array<long>")
        state = cut(state.select("batch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("docs", none).alias("docs"), F.coalesce("guard", none).alias("guard")).where(F.col("n") < size))
        out_for_good = cut(_settled(left, state, state.count()))
        lost.append(left.join(out_for_good, "row", "left_semi"))
        left = cut(left.join(out_for_good, "row", "left_anti"))
        if k == 0:
            passes = max(1, -(-left.count() // group))
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("row") + k, F.lit(passes)))
        tried = cut(dealt.groupBy("_group").cogroup(state.withColumn("_group", F.pmod(F.xxhash64("batch"), F.lit(passes))).groupBy("_group")).applyInPandas(again, out))
        placed, left = placed.unionByName(tried.where("batch >= 0")), tried.where("batch < 0").drop("batch")
        k += 1
    done = placed.select("row", "batch")
    for rest in [*lost, left]:
        done = done.unionByName(rest.select("row", F.lit(-1).cast("long").alias("batch")))
    return done
