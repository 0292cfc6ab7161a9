"""Deterministic sampling by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import running


def order_hash(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def hash_uniform(seed: str, *keys: str) -> Column:
    """A portable number in [0, 1)."""
    return F.conv(F.substring(order_hash(seed, *keys), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def first_by_hash(df: DataFrame, n: int | Column, by: list[str], keys: list[str], seed: str) -> DataFrame:
    """The first n rows of each group in hash order; keys make the order total. A number that differs by group may be large: groups are not held whole."""
    if isinstance(n, Column):
        return running.ranks(df.withColumn("_h", order_hash(seed, *keys)), by, [F.col("_h"), *map(F.col, keys)], "_rn").where(F.col("_rn") <= n).drop("_rn", "_h")
    w = Window.partitionBy(*by).orderBy(order_hash(seed, *keys), *keys)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
