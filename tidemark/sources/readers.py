"""Readers: typed text formats, nested result files, logs, markup, random access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def parquet(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.parquet(glob)


def tsv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, header: bool = False, quote: str = "", comment: str | None = None) -> DataFrame:
    """Tab-separated text, gzip or not; without a schema all columns are strings named by the header."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", quote)
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_after_preamble(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """CSV rows of one file below a preamble of `skip` lines, which lie at the start of its first partition."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).where(F.col("_n") >= skip)
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def result_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per JSON file under root: the folders above it as `model`, its name as `task`, and the parsed document."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return text.select(F.element_at(parts, -2).alias("model"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("task"), F.from_json("value", schema).alias("doc"))


def relation(spark: SparkSession, values: list, name: str, kind: str = "long") -> DataFrame:
    """A list as a one-column relation."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def jdbc(spark: SparkSession, url: str, query: str) -> DataFrame:
    """A database's query; its driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).load()


def job_lines(lines: DataFrame) -> DataFrame:
    """(at, job, event, code) from lines such as `2024-01-01T00:00:00 job-7 start` and `... exit 0`."""
    p = r"^(\S+) (\S+) (start|exit)(?: (\d+))?$"
    part = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(F.to_timestamp(part(1)).alias("at"), part(2).alias("job"), part(3).alias("event"), part(4).try_cast("int").alias("code"))


def markup_rows(pages: DataFrame, text: str = "html") -> DataFrame:
    """title, paragraphs (joined by newline) and the first four-digit year of markup replies."""
    paragraphs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.regexp_replace(p, "<[^>]*>", ""))
    return pages.withColumns({"title": F.regexp_extract(text, "(?s)<title>(.*?)</title>", 1), "abstract": F.array_join(paragraphs, "\n"), "year": F.regexp_extract(text, r"(?:19|20)\d\d", 0).try_cast("int")})


def key_range(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows start <= key < stop; the predicate reaches the scan and prunes row groups."""
    return df.where((F.col(key) >= start) & (F.col(key) < stop))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column if the table has it, else nulls: an optional column degrades a feature instead of failing."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
