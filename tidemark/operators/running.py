"""Totals, ranks and nearest values along a global order, without a single-task window.

Rows are range-partitioned on the order once (and kept in the shared checkpoint folder, so that both passes see the same
partitions); a window runs inside each partition, and what comes before a partition is added from one summary row each.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; a local session may use its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *order: Column) -> DataFrame:
    """df with `_part`, the number of its range partition in the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums in the order; the order must be total for them to be determined."""
    d = dealt(df.withColumns({f"_s_{k}": c for k, c in sums.items()}), *order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("_part").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    per = per.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    out = d.join(F.broadcast(per), "_part")  # one row per partition
    return out.withColumns({k: F.sum(f"_s_{k}").over(w) + F.col(f"_b_{k}") for k in sums}).drop("_part", *[f"_{x}_{k}" for k in sums for x in "sb"])


def ranks(df: DataFrame, by: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """Adds the row number in each group (and the group's size), in an order that must be total; no task needs a whole group.

    Rows are range-partitioned by group and order. Only groups that reach over a partition's edge need counts from
    elsewhere, and there are at most two of them for each partition.
    """
    d = dealt(df, *[F.col(c) for c in by], *order)
    own, across = Window.partitionBy("_part", *by), Window.partitionBy(*(by or [F.lit(1)]))
    per = d.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    per = per.select("_part", F.struct(F.lit(0), *by).alias("_by"), F.count("*").over(across).alias("_parts"), F.sum("_n").over(across).alias("_total"), F.coalesce(F.sum("_n").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    edges = F.broadcast(per.where("_parts > 1").withColumnRenamed("_part", "_p"))  # at most two rows per partition
    out = d.join(edges, (F.col("_part") == F.col("_p")) & F.struct(F.lit(0), *by).eqNullSafe(F.col("_by")), "left")
    out = out.withColumn(name, F.row_number().over(own.orderBy(*order)) + F.coalesce("_b", F.lit(0)))
    if size:
        out = out.withColumn(size, F.coalesce("_total", F.count("*").over(own)))
    return out.drop("_part", "_p", "_by", "_parts", "_total", "_b")


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles of value, between two values in proportion; nulls take no part. No buffer holds a group."""
    r = ranks(df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL"), by, [F.col("_v")], "_i", "_n")
    at = {k: (F.col("_n") - 1) * p for k, p in shares.items()}
    ends = [e for x in at.values() for e in (F.floor(x), F.ceil(x))]
    r = r.withColumn("_i", F.col("_i") - 1).where(F.col("_i").isin(*ends))
    pick = lambda e: F.max(F.when(F.col("_i") == e, F.col("_v")))
    out = r.groupBy(*by, "_n").agg(*[f for k, x in at.items() for f in (pick(F.floor(x)).alias(f"_lo_{k}"), pick(F.ceil(x)).alias(f"_hi_{k}"))])
    return out.select(*by, *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (x - F.floor(x))).alias(k) for k, x in at.items()])


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of value from 1, ties sharing their mean; only distinct values are ordered."""
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranked = totals(n, [F.col(value)], {"_upto": F.col("_n")})
    return df.join(ranked.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), value)


def nearest(points: DataFrame, at: str, params: DataFrame, value: str, key: str) -> DataFrame:
    """points with `nearest`, the key of the parameter closest to `at`; of equally close ones the smaller key.

    What follows a row is read in the falling order: a frame up to the end would be read anew for every row.
    """
    one = params.groupBy(F.col(value).cast("double").alias("_v")).agg(F.min(key).alias("_k")).select("_v", F.struct("_v", "_k").alias("_x"))
    rows = points.withColumn("_row", F.struct(*points.columns)).select(F.col(at).cast("double").alias("_v"), "_row")
    both = rows.withColumn("_x", F.lit(None).cast(one.schema["_x"].dataType)).unionByName(one.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).select("_v", "_row", "_x"))
    d = dealt(both, F.col("_v"))
    own = Window.partitionBy("_part")
    parts = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("_part").agg(F.max("_x").alias("hi"), F.min("_x").alias("lo"))
    per = per.select("_part", F.last("hi", True).over(parts.orderBy("_part")).alias("_before"), F.last("lo", True).over(parts.orderBy(F.desc("_part"))).alias("_after"))
    below = F.last("_x", True).over(own.orderBy("_v", F.col("_x").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.last("_x", True).over(own.orderBy(F.desc("_v"), F.col("_x").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"_lo": below, "_hi": above}).where("_row IS NOT NULL").join(F.broadcast(per), "_part")  # one row per partition
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["_v"] - F.col("_v")).alias("gap"), c["_k"].alias("k")))
    return d.select("_row.*", F.least(gap(F.coalesce("_lo", "_before")), gap(F.coalesce("_hi", "_after")))["k"].alias("nearest"))
