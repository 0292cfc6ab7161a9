"""Streaming forms of batch operators on an event table: label state and session durations.

A stream's events must carry a timestamp; test tables store local timestamps, which are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.sinks import exists


def events(spark: SparkSession, sf_dir: str, *, stream: bool) -> DataFrame:
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*") if stream else batch
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(ev: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n, value): sessions that end after a gap; late events within the watermark are counted."""
    marked = ev.withWatermark("ts", delay) if ev.isStreaming else ev
    g = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "value")


def tumbling(ev: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    marked = ev.withWatermark("ts", delay) if ev.isStreaming else ev
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(ev: DataFrame, width: str = "2 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n): windows that overlap; an event counts in each that holds it."""
    marked = ev.withWatermark("ts", delay) if ev.isStreaming else ev
    return marked.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def label_state(log: DataFrame, path: str, checkpoint: str) -> str:
    """Keep the latest label per (labeller, item_id) at path/<version>, and return the last version's path: each micro-batch is merged by event time, so late rows never overwrite newer ones."""
    keys, last = ["labeller", "item_id"], [""]

    def merge(batch: DataFrame, version: int) -> None:
        new = batch.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "grade")).alias("x"))
        if version:
            if not exists(batch.sparkSession, f"{path}/{version - 1}"):
                raise FileNotFoundError(f"{path}/{version - 1}: the state before version {version} is gone")
            new = new.unionByName(batch.sparkSession.read.parquet(f"{path}/{version - 1}")).groupBy(*keys).agg(F.max("x").alias("x"))
        last[0] = f"{path}/{version}"
        new.write.mode("overwrite").parquet(last[0])

    log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return last[0]


def replay(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is available and append its rows to path."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


__all__ = ["events", "sessions", "tumbling", "sliding", "label_state", "replay"]
