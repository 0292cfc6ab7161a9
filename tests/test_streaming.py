"""Streams give their batch twin's rows."""

from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.streaming import twins


def test_tumbling_windows_equal_the_batch(spark, sf, tmp_path):
    twins.replay(twins.tumbling(twins.events(spark, sf, stream=True)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in twins.tumbling(twins.events(spark, sf, stream=False)).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) - 10  # the last day stays open below the watermark


def test_late_labels_do_not_overwrite(spark, tmp_path):
    src = tmp_path / "in"
    schema = "labeller long, item_id long, ts timestamp, event_id long, grade long"
    rows = lambda *r: spark.createDataFrame([(1, 1, None, i, g) for i, _, g in r], schema).withColumn("ts", F.timestamp_seconds(F.element_at(F.create_map(*[F.lit(x) for i, t, _ in r for x in (i, t)]), F.col("event_id").cast("int"))))
    rows((1, 100, 2)).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    twins.label_state(stream(), str(tmp_path / "state"), str(tmp_path / "cp"))
    rows((2, 50, 0)).write.mode("append").parquet(str(src))
    last = twins.label_state(stream(), str(tmp_path / "state"), str(tmp_path / "cp"))
    assert [r["x"]["grade"] for r in spark.read.parquet(last).collect()] == [2]


def test_fill_scores_each_pair_once(spark, tmp_path):
    calls = []

    def score(df):
        calls.append(df.count())
        return df.withColumn("score", F.col("k") * 2)

    path = str(tmp_path / "cache")
    sinks.fill(spark.range(3).withColumnRenamed("id", "k"), path, ["k"], score)
    got = sinks.fill(spark.range(5).withColumnRenamed("id", "k"), path, ["k"], score)
    assert calls == [3, 2] and got.count() == 5
