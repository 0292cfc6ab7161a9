"""A stored inverted index with bounds for each block, and exact top-k search that leaves blocks unread.

Documents are dealt to areas of about AREA documents by a hash of their key. A block is one term's postings in one area,
with its largest count and its shortest document: no posting in it can score more than these two together, whatever k1
and b are. Blocks lie in the order of term and area, so a term's blocks are neighbours on disk.

A search scores the postings of a query's rarest terms first; the k-th best of these partial scores is a floor. Areas whose
blocks cannot reach the floor together are left out. Terms whose bounds stay below the floor together cannot bring in a
document by themselves: their blocks are read only where a document from the other terms is still in reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import english
from tidemark.operators import ranking
from tidemark.operators.running import cut, shared_folder

#: Documents of an area, about; blocks that a file holds, about; slack for scores that are rounded to six digits.
AREA, FILE_BLOCKS, SLACK = 128, 100_000, 2e-6
#: A query's first terms hold at least this many times k postings, if it has so many.
AHEAD = 4


def words(text: Column) -> Column:
    return ranking.tokens(text)


def stemmed(text: Column) -> Column:
    """Stems of the words that are no stop words."""
    stop = F.array(*map(F.lit, ranking.STOP_WORDS))
    return english.stems(F.filter(ranking.tokens(text), lambda t: ~F.array_contains(stop, t)))


ANALYZERS: dict[str, Callable[[Column], Column]] = {"words": words, "stemmed": stemmed}


@dataclass(frozen=True)
class Index:
    """blocks (term, area, n, most_tf, least_dl, postings), terms (term, df), docs (doc_id, dl), and the statistics of all documents with terms.

    held (term, area, doc_id, tf, dl: arrays) are the same postings, and tiles is the number of areas, if that is another.
    """

    blocks: DataFrame
    terms: DataFrame
    docs: DataFrame
    n: float
    avgdl: float
    held: DataFrame | None = None
    tiles: int = 0

    @property
    def areas(self) -> int:
        return self.tiles or _areas(self.n)

    @property
    def lists(self) -> DataFrame:
        """(term, area, doc_id, tf, dl): a block's postings as an array of each."""
        return self.held if self.held is not None else self.blocks.select("term", "area", *[F.col(f"postings.{c}").cast(t).alias(c) for c, t in (("doc_id", "array<bigint>"), ("tf", "array<int>"), ("dl", "array<int>"))])

    def postings(self, terms: DataFrame) -> DataFrame:
        """(doc_id, term, tf, dl) of the given terms."""
        return self.blocks.join(terms.select("term").distinct(), "term", "left_semi").select("term", F.inline("postings"))

    def matches(self, terms: DataFrame) -> DataFrame:
        """(qid, doc_id, term, tf, dl, df, n, avgdl), as ranking.bm25 takes them; terms (qid, term)."""
        known = terms.join(self.terms, "term")
        return known.join(self.blocks.select("term", "postings"), "term").select("qid", "term", "df", F.inline("postings")).withColumns({"n": F.lit(self.n), "avgdl": F.lit(self.avgdl)})


def _areas(documents: float) -> int:
    return max(1, -(-int(documents) // AREA))


_BLOCK = "term string, area long, n long, most_tf long, least_dl long, postings array<struct<doc_id: bigint, tf: bigint, dl: bigint>>"


def _blocks(key: tuple, held: pa.Table) -> pa.Table:
    """The blocks of an area, from its documents' terms (area, doc_id, t); a document may have several rows."""
    lists = held.column("t").combine_chunks()
    docs, row = np.unique(held.column("doc_id").to_numpy(), return_inverse=True)
    code = lists.flatten().dictionary_encode()
    each = np.repeat(row, lists.value_lengths().to_numpy())
    dl = np.bincount(each, minlength=len(docs))
    pair, tf = np.unique(code.indices.to_numpy().astype(np.int64) * len(docs) + each, return_counts=True)
    term, doc = np.divmod(pair, len(docs))
    start = np.flatnonzero(np.diff(term, prepend=-1))
    postings = pa.StructArray.from_arrays([pa.array(docs[doc]), pa.array(tf), pa.array(dl[doc])], ["doc_id", "tf", "dl"])
    return pa.table({
        "term": code.dictionary.take(pa.array(term[start])), "area": pa.array(np.full(len(start), key[0].as_py())), "n": pa.array(np.diff(start, append=len(pair))),
        "most_tf": pa.array(np.maximum.reduceat(tf, start)), "least_dl": pa.array(np.minimum.reduceat(dl[doc], start)),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(start, len(pair)).astype(np.int32)), postings),
    })


def _written(docs: DataFrame, folder: str, key: str, text: str, analyze: Callable[[Column], Column]) -> None:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if docs.rdd.getNumPartitions() < parts:
        docs = docs.repartition(parts)
    split = cut(docs.select("doc_id", analyze(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("dl"), "t").where("dl > 0"))
    held = split.groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    held.write.parquet(f"{folder}/docs")
    areas = _areas(docs.sparkSession.read.parquet(f"{folder}/docs").count())
    # an area's terms are counted where its documents are, so that no token is a row
    dealt = split.select(F.pmod(F.xxhash64("doc_id"), F.lit(areas)).alias("area"), "doc_id", "t").repartition(max(parts, areas // 64), "area")
    blocks = cut(dealt.groupBy("area").applyInArrow(_blocks, _BLOCK))
    blocks.groupBy("term").agg(F.sum("n").cast("double").alias("df")).write.parquet(f"{folder}/terms")
    files = max(1, -(-blocks.count() // FILE_BLOCKS))
    blocks.repartitionByRange(files, "term", "area").sortWithinPartitions("term", "area").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{folder}/blocks")


def opened(spark: SparkSession, folder: str) -> Index:
    docs = spark.read.parquet(f"{folder}/docs")
    total = docs.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).first()
    return Index(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/terms"), docs, total["n"], total["avgdl"] or 0.0)


def stored(spark: SparkSession, path: str, *, key: str = "doc_id", text: str = "text", analyzer: str = "words", folder: str | None = None) -> Index:
    """The index of the documents at path: that of an earlier call if it is whole and the files are the same, else a new one.

    It lies in `folder`, by default in the shared checkpoint folder, under a name made of the files' names, sizes and times
    and of what is indexed, so changed documents are never answered from an old index. Rows with one key are one
    document; documents without terms and null keys are not in it.
    """
    shared = folder or shared_folder(spark)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.getFileStatus(at)
    parts = [status] if status.isFile() else sorted(files.listStatus(at), key=lambda f: f.getPath().toString())
    seen = [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in parts]
    name = hashlib.sha256("\n".join([*seen, key, text, analyzer, str(AREA)]).encode()).hexdigest()[:24]
    home = f"{shared}/index-{name}"
    done = jvm.org.apache.hadoop.fs.Path(f"{home}/blocks/_SUCCESS")  # blocks are written last
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not there.exists(done):
        there.delete(jvm.org.apache.hadoop.fs.Path(home), True)  # what an attempt that failed has left
        _written(spark.read.parquet(path).where(F.col(key).isNotNull()), home, key, text, ANALYZERS[analyzer])
    return opened(spark, home)


@dataclass(frozen=True)
class Found:
    """top (the queries' columns, doc_id, score, rank) and read (the queries' columns, postings of the query, postings read)."""

    top: DataFrame
    read: DataFrame


def search(index: Index, queries: DataFrame, k: int, *, by: tuple[str, ...] = ("qid",), k1: Column | float = 1.5, b: Column | float = 0.75, candidates: DataFrame | None = None) -> Found:
    """The k best documents of each query by BM25 rounded to six digits, ties to the smaller doc_id.

    queries: the columns in by, and term (once each). k1 and b are numbers or columns of by. candidates (qid, doc_id) limit
    each query to some documents, over statistics of the whole index; those without a term of the query follow with score
    0. Unknown terms add nothing, as do null ones.
    """
    k1, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (k1, b))
    by_ = list(by)
    asked = queries.select(*by_, "term").distinct().join(index.terms, "term").withColumn("_idf", ranking.idf(F.lit(index.n), F.col("df")))
    part = lambda tf, dl: F.col("_idf") * ranking.saturation(F.col(tf), F.col(dl), F.lit(index.avgdl), k1, b)
    meta = index.blocks.select("term", "area", "n", "most_tf", "least_dl")
    blocks = asked.join(meta, "term").withColumn("_most", part("most_tf", "least_dl"))
    if candidates is not None:
        wanted = candidates.select("qid", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(_areas(index.n))).alias("area")).distinct()
        blocks = blocks.join(wanted.select("qid", "area").distinct(), ["qid", "area"], "left_semi")
    blocks = cut(blocks.select(*by_, "term", "area", "n", "_idf", "_most"))
    # a query's terms, a handful, by how much one of their postings can bring
    terms = blocks.groupBy(*by_, "term").agg(F.max("_most").alias("_top"), F.sum("n").alias("_n"))
    falling = Window.partitionBy(*by_).orderBy(F.desc("_top"), "term").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(terms.withColumn("_first", F.coalesce(F.sum("_n").over(falling), F.lit(0)) < AHEAD * k))

    def read(some: DataFrame) -> DataFrame:
        """(by, doc_id, area, term, s) of the given blocks, of wanted documents."""
        full = some.select(*by_, "term", "area", "_idf").join(index.blocks.select("term", "area", "postings"), ["term", "area"]).select(*by_, "term", "area", "_idf", F.inline("postings"))
        scored = full.select(*by_, "doc_id", "area", "term", part("tf", "dl").alias("s"))
        return scored if candidates is None else scored.join(wanted.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")

    ahead = cut(read(blocks.join(first.where("_first").select(*by_, "term"), [*by_, "term"])))
    partial = ahead.groupBy(*by_, "doc_id").agg(F.sum("s").alias("s"))
    best = Window.partitionBy(*by_).orderBy(F.desc("s"), "doc_id")
    floor = partial.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy(*by_).agg(F.max("_r").alias("_r"), F.min("s").alias("_floor"))
    floor = floor.select(*by_, F.when(F.col("_r") == k, F.col("_floor") - SLACK).otherwise(F.lit(0.0)).alias("_floor"))
    rising = Window.partitionBy(*by_).orderBy("_top", F.desc("term"))
    first = cut(first.join(floor, by_, "left").na.fill(0.0, ["_floor"]).withColumn("_main", F.col("_first") | (F.sum("_top").over(rising) >= F.col("_floor"))))
    # what a document of an area can reach: with all its blocks, and with those of the terms that bring no document in
    kind = blocks.join(first.select(*by_, "term", "_first", "_main", "_floor"), [*by_, "term"])
    reach = kind.groupBy(*by_, "area", "_floor").agg(F.sum("_most").alias("_all"), F.sum(F.when(~F.col("_main"), F.col("_most")).otherwise(0.0)).alias("_rest"))
    open_ = cut(reach.where("_all >= _floor"))
    live = cut(kind.drop("_floor").join(open_.select(*by_, "area"), [*by_, "area"], "left_semi"))
    middle = live.where("_main AND NOT _first")
    held = ahead.join(open_.select(*by_, "area"), [*by_, "area"], "left_semi").select(*by_, "doc_id", "area", "s").unionByName(read(middle).select(*by_, "doc_id", "area", "s"))
    held = held.groupBy(*by_, "area", "doc_id").agg(F.sum("s").alias("s")).join(open_, [*by_, "area"]).where(F.col("s") + F.col("_rest") >= F.col("_floor"))
    held = cut(held.select(*by_, "area", "doc_id", "s"))
    tail = live.where("NOT _main").join(held.select(*by_, "area").distinct(), [*by_, "area"], "left_semi")
    more = read(tail).join(held.select(*by_, "doc_id"), [*by_, "doc_id"], "left_semi")
    scored = held.select(*by_, "doc_id", "s").unionByName(more.select(*by_, "doc_id", "s"))
    if candidates is not None:
        scored = scored.unionByName(queries.select(*by_).distinct().join(candidates.select("qid", "doc_id").distinct(), "qid").select(*by_, "doc_id", F.lit(0.0).alias("s")))
    top = ranking.top_k(scored.groupBy(*by_, "doc_id").agg(F.round(F.sum("s"), 6).alias("score")), k, by=by)
    used = blocks.join(first.where("_first").select(*by_, "term"), [*by_, "term"]).select(*by_, "n").unionByName(middle.select(*by_, "n")).unionByName(tail.select(*by_, "n"))
    report = blocks.groupBy(*by_).agg(F.sum("n").alias("postings")).join(used.groupBy(*by_).agg(F.sum("n").alias("read")), by_)
    return Found(top, report)
