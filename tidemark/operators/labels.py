"""Label stores: the latest state of an append-only log, progress and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(log: DataFrame, keys: list[str], at: str, tie: str, value: str, seconds: str) -> DataFrame:
    """One row per key: the latest value (ties by `tie`), how often it changed, seconds in all, first and last time."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    changed = log.withColumn("_changed", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("long"), F.lit(0)))
    return changed.groupBy(*keys).agg(
        F.max_by(value, F.struct(at, tie)).alias(value), F.sum("_changed").alias("n_changes"), F.sum(seconds).alias(seconds),
        F.min(at).alias("first_at"), F.max(at).alias("updated_at"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def block_item(s: Column, step: int, width: int, offset: Column) -> Column:
    """The overlapping schedule's item: step * (s mod width) + offset."""
    return step * (s % width) + offset
