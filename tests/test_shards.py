"""Arrow shards: commit and abort, pushed filters, row numbers and keys, half floats."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import shards


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    shards.register(spark)


def write(df, path, mode="overwrite", **options):
    df.write.format("arrow_shards").mode(mode).options(**options).save(str(path))


def sample(spark, n=500):
    return spark.range(n).select((F.col("id") * 3).alias("k"), F.concat(F.lit("t"), "id").alias("t"), F.array(F.col("id") / 8, F.lit(None), F.lit(-1.5)).cast("array<float>").alias("v")).repartitionByRange(5, "k").sortWithinPartitions("k")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rows_come_back(spark, tmp_path):
    df = sample(spark)
    write(df, tmp_path, key="k", batch=30, half="v")
    back = spark.read.format("arrow_shards").load(str(tmp_path))
    assert back.schema.simpleString() == df.schema.simpleString() and rows(back) == rows(df)
    held = shards.index(str(tmp_path))
    assert all(b["rows"] <= 30 for f in held["files"] for b in f["batches"]) and sum(b["rows"] for f in held["files"] for b in f["batches"]) == 500
    for f in held["files"]:  # plain Arrow streams
        with pa.ipc.open_stream(pa.memory_map(f"{tmp_path}/{f['name']}")) as r:
            assert r.schema.field("v").type == pa.list_(pa.float16()) and r.read_all().num_rows == sum(b["rows"] for b in f["batches"])


def test_write_again_and_append(spark, tmp_path):
    df = sample(spark, 40)
    write(df, tmp_path, key="k")
    write(df.where("k < 30"), tmp_path, key="k")
    assert rows(spark.read.format("arrow_shards").load(str(tmp_path))) == rows(df.where("k < 30"))
    write(df.where("k >= 30"), tmp_path, "append", key="k")
    assert rows(spark.read.format("arrow_shards").load(str(tmp_path))) == rows(df)
    names = {f["name"] for f in shards.index(str(tmp_path))["files"]}
    assert set(os.listdir(tmp_path)) - {shards.INDEX} == names
    with pytest.raises(Exception, match="another schema"):
        write(df.select("k"), tmp_path, "append", key="k")
    assert set(os.listdir(tmp_path)) - {shards.INDEX} == names


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    df = sample(spark, 60)
    write(df, tmp_path, key="k")
    before = set(os.listdir(tmp_path))
    with pytest.raises(Exception):
        write(df.withColumn("t", F.when(F.col("k") > 150, F.raise_error(F.lit("no"))).otherwise(F.col("t"))), tmp_path, key="k")
    assert set(os.listdir(tmp_path)) == before and rows(spark.read.format("arrow_shards").load(str(tmp_path))) == rows(df)


@pytest.mark.parametrize("condition", ["k = 33", "k IN (3, 900, 4)", "k > 1400", "k >= 300 AND k < 330", "k <= 2", "k = 5000", "k IS NULL", "t = 't7'"])
def test_pushed_filters(spark, tmp_path, condition):
    df = sample(spark)
    write(df, tmp_path, key="k", batch=20)
    assert rows(spark.read.format("arrow_shards").load(str(tmp_path)).where(condition)) == rows(df.where(condition))


def test_filters_leave_batches_unread(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    write(sample(spark), tmp_path, key="k", batch=20)
    r = shards._Reader(str(tmp_path), spark.read.format("arrow_shards").load(str(tmp_path)).schema)
    assert len(list(r.pushFilters([EqualTo(("k",), 33)]))) == 1
    assert sum(len(p.batches) for p in r.partitions()) == 1
    r = shards._Reader(str(tmp_path), spark.read.format("arrow_shards").load(str(tmp_path)).schema)
    list(r.pushFilters([GreaterThan(("k",), 1400), EqualTo(("t",), "t7")]))
    assert 0 < sum(n for p in r.partitions() for _, n in p.batches) <= 60


def test_take_by_row_number(spark, tmp_path):
    df = sample(spark)
    write(df, tmp_path, key="k", batch=17)
    asked = spark.createDataFrame([(0, 499), (1, 0), (2, 0), (3, 500), (4, -1), (5, None), (6, 250)], "place long, number long")
    got = shards.take(spark, str(tmp_path), asked, ["t", "v"]).orderBy("place").collect()
    assert [(r["place"], r["t"]) for r in got] == [(0, "t499"), (1, "t0"), (2, "t0"), (6, "t250")] and got[0]["v"] == [499 / 8, None, -1.5]
    # a batch that nobody asks for is not read: its file may even be gone
    files = shards.index(str(tmp_path))["files"]
    os.remove(f"{tmp_path}/{files[-1]['name']}")
    assert [r["t"] for r in shards.take(spark, str(tmp_path), asked.where("place IN (1, 2)"), ["t"]).collect()] == ["t0", "t0"]


def test_gather_by_key(spark, tmp_path):
    write(sample(spark), tmp_path, key="k", batch=17, half="v")
    ids = spark.createDataFrame([(9,), (9,), (10,), (None,), (1497,), (10**9,)], "k long")
    got = sorted(((r["k"], r["t"], r["ok"]) for r in shards.gather(spark, str(tmp_path), ids, "k", ["t", "v"]).collect()), key=str)
    assert got == sorted([(9, "t3", True), (9, "t3", True), (10, None, False), (None, None, False), (1497, "t499", True), (10**9, None, False)], key=str)


def test_empty_tables(spark, tmp_path):
    df = sample(spark).limit(0)
    write(df, tmp_path, key="k")
    assert spark.read.format("arrow_shards").load(str(tmp_path)).collect() == []
    assert shards.take(spark, str(tmp_path), spark.createDataFrame([(0, 0)], "place long, number long"), ["t"]).collect() == []
