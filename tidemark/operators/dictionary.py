"""Names of a dictionary in texts, as whole words.

A dictionary of a bounded size, which is counted, is an automaton that goes over the texts in Arrow batches. A larger one
is joined: windows of words, of the lengths that names have, meet equal names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import automaton

#: A text's words and what stands between them, in turn.
PARTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))


def _windows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, _row, start, stop, folded) by a join; start and stop count words and gaps."""
    wanted = wanted.withColumn("len", F.size(_parts(F.col("folded"))))
    lengths = sorted(r["len"] for r in wanted.select("len").distinct().collect())  # how many words and gaps names have
    split = rows.select(key, "_row", _parts(F.col("_text")).alias("p"))

    def window(length: int) -> Column:
        starts = F.when(F.size("p") >= length, F.sequence(F.lit(1), F.size("p") - length + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice("p", i, F.lit(length)), "").alias("folded")))

    seen = split.select(key, "_row", F.inline(F.flatten(F.array(*[window(n) for n in lengths])) if lengths else F.array().cast("array<struct<at: int, len: int, folded: string>>")))
    return seen.join(wanted, ["folded", "len"], "left_semi").select(key, "_row", F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("stop"), "folded")


def _searched(names, longest: bool, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automaton.built(names.name, lambda: automaton.Names(names.held.value))
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(held.found(batch.column(2)[i].as_py() or ""))
                if longest:
                    found = automaton.leftmost(found, lambda x: x[2])
                for at in range(0, len(found), 10_000):
                    a, b, n = zip(*found[at : at + 10_000], strict=True)
                    where = pa.array([i] * len(a))
                    yield pa.record_batch([batch.column(0).take(where), batch.column(1).take(where), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.string())], names=[key, "_row", "start", "stop", "folded"])

    return run


def _leftmost(key: str):
    def run(hits: pa.Table) -> pa.Table:
        rows = list(zip(hits.column("start").to_pylist(), hits.column("stop").to_pylist(), hits.column("folded").to_pylist(), range(hits.num_rows), strict=True))
        return hits.take(pa.array([x[3] for x in automaton.leftmost(rows, lambda x: x[2])], pa.int64()))

    return run


def _found(docs: DataFrame, names: DataFrame, longest: bool, key: str, text: str, name: str, fold: Callable[[Column], Column], most: int) -> DataFrame:
    wanted = names.select(fold(F.col(name)).alias("folded")).where("folded <> ''").distinct()
    size = wanted.agg(F.sum(F.length("folded"))).first()[0] or 0
    rows = docs.select(key, F.monotonically_increasing_id().alias("_row"), fold(F.col(text)).alias("_text"))
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, _row long, start int, stop int, folded string"
    if size <= most:
        held = automaton.Sent(docs.sparkSession.sparkContext, [r["folded"] for r in wanted.collect()])
        return rows.mapInArrow(_searched(held, longest, key), schema)
    hits = _windows(rows, wanted, key)
    return hits.groupBy(key, "_row").applyInArrow(_leftmost(key), schema) if longest else hits


def hits(docs: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "name", fold: Callable[[Column], Column] = F.lower, most: int = automaton.MOST) -> DataFrame:
    """(key, _row, start, stop, folded): every place where a folded name stands in the folded text as whole words.

    Names begin and end with a letter, digit or underscore; signs inside them are taken as they are. _row tells rows with
    one key apart. start and stop grow along a text; what they count is the automaton's code points or the join's parts.
    `most` is the size in characters up to which names become an automaton.
    """
    return _found(docs, names, False, key, text, name, fold, most)


def mentions(docs: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "name", fold: Callable[[Column], Column] = F.lower, most: int = automaton.MOST) -> DataFrame:
    """(key, _row, start, stop, folded): the hits that do not overlap, from the left, of those that begin together the longest."""
    return _found(docs, names, True, key, text, name, fold, most)
