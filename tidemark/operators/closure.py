"""Set closure over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.running import cut


def _doubled(paths: DataFrame, rounds: int) -> DataFrame:
    """(a, b): paths double in length each round until none is new."""
    paths = cut(paths)
    n = paths.count()
    for _ in range(rounds):
        longer = paths.join(paths.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a <> b")
        paths = cut(paths.union(longer).distinct())
        m = paths.count()
        if m == n:
            break
        n = m
    return paths


def transitive(edges: DataFrame, child: str = "child", parent: str = "parent", rounds: int = 64) -> DataFrame:
    """(child, ancestor) pairs, self excluded, cycles allowed.

    Only nodes that paths lead through, with an edge in and an edge out, are closed in rounds; the leaves, most of all nodes
    in a hierarchy, are joined to what they begin or end once, at the end.
    """
    edges = cut(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).where("a <> b").distinct())
    inner = cut(edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").distinct())
    starts = edges.join(inner, "a", "left_anti")
    ends = edges.join(inner.toDF("b"), "b", "left_anti").select("a", "b")
    core = _doubled(edges.join(inner, "a", "left_semi").join(inner.toDF("b"), "b", "left_semi").select("a", "b"), rounds)
    # from an inner node: to inner nodes, to ends behind itself, and to ends behind those
    over = core.union(ends.join(inner, "a", "left_semi").select("a", "b")).union(core.join(ends.toDF("b", "c"), "b").select("a", "c"))
    over = cut(over.where("a <> b").distinct())
    out = over.union(starts).union(starts.join(over.toDF("b", "c"), "b").select("a", "c")).where("a <> b").distinct()
    return out.select(F.col("a").alias(child), F.col("b").alias("ancestor"))


def mixed(twins: DataFrame, edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, related), itself included: what twin edges lead to together with steps up only, or with steps down only."""
    flat = edges.select(F.col(child).alias("a"), F.col(parent).alias("b"))
    pairs = twins.toDF("a", "b")
    pairs = pairs.union(pairs.select("b", "a"))
    # twins lead both ways, so the paths down are those up, reversed
    up = cut(transitive(pairs.union(flat), "a", "b").toDF("a", "b"))
    nodes = flat.select("a").union(flat.select("b")).union(pairs.select("a")).distinct()
    return up.union(up.select("b", "a")).union(nodes.select("a", "a")).distinct().toDF("node", "related")
