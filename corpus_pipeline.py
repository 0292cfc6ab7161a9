"""A training corpus from raw documents: language ID, line dedup, near-dedup, source mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import dart_minhash, language_id, line_dedup, mixing, packing
from tidemark.llm.common import ensure_checkpoint_dir
from tidemark.llm.queries import tokenizer_path

ORACLE_SQL = None  # language ID learns a model and packing runs a tokenizer; the tests hold run() against brute force


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source and all columns but text in one struct, so that no name clashes with an operator's."""
    box = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", "lang", "source", box.alias("_row"))


def _unboxed(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs in their order, with the given text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def _few(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows in no more tasks than docs is read in, or eight a core: a stage keeps or repeats rows, and every task writes a file."""
    return rows.coalesce(max(docs.rdd.getNumPartitions(), 8 * docs.sparkSession.sparkContext.defaultParallelism))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected, unchanged."""
    rows = language_id.identify(_boxed(docs), carry=("text", "_row")).where(~F.col("rejected"))
    return rows.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that lose every line go."""
    rows = line_dedup.line_dedup(_boxed(docs), carry=("_row",), with_text=True)
    return _few(_unboxed(rows.where(F.col("n_dropped") < F.col("n_lines")), docs, "kept_text"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; of rows equal in id and text the least stays."""
    named = _boxed(docs.where(F.col("doc_id").isNotNull()))
    rows = dart_minhash.near_duplicates(named, carry=("text", "_row")).where("kept").withColumn("_th", F.xxhash64("text"))
    rows = rows.groupBy("doc_id", "_th").agg(F.min_by(F.struct("text", "_row"), F.to_json("_row")).alias("_one")).select("_one.*")
    rows = rows.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
    return _few(rows.unionByName(docs.where(F.col("doc_id").isNull())), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole."""
    rows = mixing.mix(_boxed(docs), boundary="nearest", carry=("text", "_row")).where("copies > 0")
    rows = rows.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return _few(rows.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between is written to the shared checkpoint folder, and deleted when the next stage is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # what this stage was made from is read no more
                _delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
