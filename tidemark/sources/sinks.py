"""Writers: reproducible files, atomic replacement, resumable fills, reports."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import labels


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local session may use its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared}/tidemark-{uuid.uuid4().hex}"


def write_sorted(df: DataFrame, path: str) -> None:
    """Rows in the order of all columns, so that equal tables give equal files."""
    df.orderBy(*df.columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tsv(df: DataFrame, path: str, *, header: bool = False, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("compression", compression).csv(path)


class _Sink(io.RawIOBase):
    """A file of any store that Spark writes to, as Arrow wants it."""

    def __init__(self, spark: SparkSession, path: str):
        at = _path(spark, path)
        self._out = _store(spark, at).create(at, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
        super().close()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the table that replace() put at path; None before the first."""
    return f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}" if exists(spark, f"{path}/CURRENT") else None


def replace(df: DataFrame, path: str) -> None:
    """Write a new version beside the old, then move the pointer to it in one atomic rename: readers of current() see the old table or the new one.

    The version before stays for those who are reading it; older ones are deleted.
    """
    spark = df.sparkSession
    old, name = current(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    with _Sink(spark, f"{path}/.{name}") as f:
        f.write(name.encode())
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    target = _path(spark, f"{path}/CURRENT")
    fs.FileContext.getFileContext(_store(spark, target).getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(_path(spark, f"{path}/.{name}"), target, how)
    for entry in _store(spark, target).listStatus(_path(spark, path)):
        at = entry.getPath()
        if at.getName().startswith("v-") and at.getName() not in (name, (old or "").rsplit("/", 1)[-1]):
            _store(spark, at).delete(at, True)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Put the rows of new into the table at path in place of those with their keys, in the order of all columns."""
    at = current(new.sparkSession, path)
    rows = new if at is None else labels.upsert(new.sparkSession.read.parquet(at), new, keys)
    replace(rows.orderBy(*rows.columns), path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return _store(spark, p).exists(p)


def fill(pairs: DataFrame, cache: str, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the pairs that the cache lacks, append them, and return the cache's rows for the pairs."""
    spark = pairs.sparkSession
    have = spark.read.parquet(cache) if exists(spark, cache) else None
    todo = pairs if have is None else pairs.join(have, keys, "left_anti")
    score(todo).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).dropDuplicates(keys).join(pairs.select(*keys).distinct(), keys, "left_semi")


def append_absent(row: DataFrame, path: str, keys: list[str]) -> None:
    spark = row.sparkSession
    (row.join(spark.read.parquet(path), keys, "left_anti") if exists(spark, path) else row).write.mode("append").parquet(path)


def markdown_row(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in columns]), F.lit(" |"))


def manifest(counts: DataFrame) -> DataFrame:
    """One row with the JSON text of a one-row table of counts."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("manifest"))


def ascii_name(c: Column) -> Column:
    """A file name of letters, digits and hyphens."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
