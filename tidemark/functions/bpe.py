"""Token counts by byte-pair merges: pieces of texts are counted on the cluster, and each distinct piece is merged once a task.

A rank file gives the byte strings that merges may make, the lower rank first. A piece starts as single bytes; while two
neighbours together have a rank, the pair with the lowest rank, the first of equals, becomes one.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts counted before pieces leave a task; and pieces kept with their number of tokens.
TEXTS, MEMORY = 256, 1 << 18


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines: a byte string in base64, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece. Pairs wait in a heap, so a piece of n bytes takes n log n steps."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a byte

    def pair(i: int):
        j = after[i]
        return rank.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], after[i] = stop, after[j]
        end[j] = 0
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heappush(heap, (r, k, end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = after[i]
    return out


def _pieces(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                own = batch.slice(at, TEXTS)
                n = Counter((i, p) for i, t in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True) for p in split.findall(t or ""))
                if n:
                    (keys, pieces), counts = zip(*n, strict=True), list(n.values())
                    yield pa.record_batch([pa.array(keys, own.column(0).type), pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], names=["_key", "piece", "n"])

    return run


def _tokens(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, memory = held.value, {}
        for batch in batches:
            out = []
            for piece in batch.column(1).to_pylist():
                if piece not in memory:
                    raw = piece.encode()
                    found = 1 if raw in rank else len(merged(raw, rank))
                    if len(memory) < MEMORY and len(raw) < 64:
                        memory[piece] = found
                    out.append(found)
                else:
                    out.append(memory[piece])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.int64())], names=["_key", "n", "tokens"])

    return run


def token_counts(docs: DataFrame, by: str, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """(by, pieces, tokens): pieces and tokens of all texts of each value of `by`, null included.

    path is a rank file that holds every single byte; pattern cuts texts into pieces (a regular expression of the regex
    library). Null and empty texts have none; a value without any piece has zeros. Equal pieces of a value meet as one row
    from each task, and whole words that are tokens need no merge.
    """
    kind = dict(docs.dtypes)[by]
    held = docs.sparkSession.sparkContext.broadcast(ranks(path))  # a vocabulary, whose size is fixed
    own = docs.select(F.col(by).alias("_key"), F.col(text).alias("_text"))
    counted = own.mapInArrow(_pieces(pattern), f"_key {kind}, piece string, n long").groupBy("_key", "piece").agg(F.sum("n").alias("n"))
    sums = counted.select("_key", "piece", "n").mapInArrow(_tokens(held), f"_key {kind}, n long, tokens long")
    every = own.select("_key").distinct().select("_key", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("tokens"))
    return every.unionByName(sums).groupBy("_key").agg(F.sum("n").alias("pieces"), F.sum(F.col("n") * F.col("tokens")).alias("tokens")).withColumnRenamed("_key", by)
