"""Lempel-Ziv phrase fingerprints: the minimum hashes of a text's LZ78 phrase set.

A text is parsed into phrases, each the longest known phrase and one more character; the phrase set stands for what a
compressor would learn from it. The fingerprint holds the SIZE smallest 32-bit hashes of the set, from which the
Jaccard similarity of two phrase sets is estimated (exactly, if both sets are smaller).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, slices
from .shingles import spans_hash

SIZE = 128


def parse(text: str, known: set[str], ends: list[int], at: int = 0) -> int:
    """LZ78 phrases of text[at:]: adds them to known and their ends to ends. Returns where an unfinished phrase starts."""
    add, push, start, phrase = known.add, ends.append, at, ""
    i = at
    for c in text[at:] if at else text:
        phrase += c
        i += 1
        if phrase not in known:
            add(phrase)
            push(i)
            phrase, start = "", i
    return start


def _sketch(text: str, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = spans_hash(points, starts, ends) >> np.uint64(32)
    return np.unique(h.astype(np.uint32))[:size]


def _finish(text: str, ends: list[int], tail: int, size: int) -> np.ndarray:
    bounds = np.array([0, *ends], np.int64)
    starts, stops = bounds[:-1], bounds[1:]
    if tail < len(text):  # the rest is a known phrase, already in the set unless the text is shorter than any phrase
        starts, stops = np.append(starts, tail), np.append(stops, len(text))
    return _sketch(text, starts, stops, size)


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    """Ascending minimum hashes; empty for an empty or null text."""
    text = text or ""
    ends: list[int] = []
    return _finish(text, ends, parse(text, set(), ends), size)


def fingerprint_pair(text: str, replaced: int, tail: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of text, and of text with its last `replaced` characters replaced by tail. The parse of the common part is shared."""
    keep = len(text) - replaced
    known: set[str] = set()
    ends: list[int] = []
    start = parse(text[:keep], known, ends)
    edited, known2, ends2 = text[:keep] + tail, known.copy(), ends.copy()
    a = _finish(text, ends, parse(text, known, ends, start), size)
    b = _finish(edited, ends2, parse(edited, known2, ends2, start), size)
    return a, b


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Jaccard estimate from the smallest hashes of the union; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def packed(values: np.ndarray) -> bytes:
    return values.astype(">u4").tobytes()


def encode(values: np.ndarray) -> str:
    return packed(values).hex()


def decode(fingerprint_hex: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint_hex), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of docs: key, n_chars, fingerprint. Null text is empty; an empty text's fingerprint is ''."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(fingerprint(t, size)) for t in texts], pa.string())], names=["_key", "n_chars", "fingerprint"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, n_chars long, fingerprint string")
    return out.withColumnRenamed("_key", key)


_SCHEMA = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()),
])
_DDL = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, kind int, part int, text string"


def _compare(text: str, following: str, size: int) -> tuple[tuple, np.ndarray]:
    n = len(text)
    tail = following[: n // 3]
    own, edited = fingerprint_pair(text, n // 3, tail, size)
    sha = hashlib.sha256((text[: n - n // 3] + tail).encode()).digest()
    return (n, sha, packed(own), packed(edited), likeness(own, edited, size)), own


def _chain(size: int):
    """Over documents in order: kind 0 rows are done; a partition's first text is kind 1, and its last row, which lacks a follower, kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, waiting, head = TaskContext.get().partitionId(), None, None, True
        for batch in (own for whole in batches for own in slices(whole, 1)):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if head:
                    out.append((doc, None, None, None, None, None, None, 1, part, text))
                    head = False
                if held is not None:
                    # the row before has its follower now; its near_next waits for the follower's own parse
                    done, own = _compare(held[1], text, size)
                    if waiting is not None:
                        out.append((*waiting[0], likeness(waiting[1], own, size), 0, part, None))
                    waiting = ((held[0], *done), own)
                held = (doc, text)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
        if held is not None:
            out = []
            if waiting is not None:
                out.append((*waiting[0], likeness(waiting[1], fingerprint(held[1], size), size), 0, part, None))
            out.append((held[0], None, None, None, None, None, None, 2, part, held[1]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def _ends(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, following in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                done, own = _compare(text, following, size)
                out.append((doc, *done, likeness(own, fingerprint(following, size), size)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types[:7], strict=True)], names=_SCHEMA.names[:7])

    return run


def edited_likeness(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A row's edited text has its last third (rounded down) replaced by as many first characters of the next row, in
    descending key order (repeated keys: by a hash of the text; null keys last; after the last row: the first). A lone
    row is its own next. Null text is empty. Rows are range-partitioned once, by key and text; each partition hands on
    its first and last row only.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]  # rows that share a key are dealt by their texts
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text"))
    found = cut(dealt.mapInArrow(_chain(size), _DDL))
    heads = sorted(r["part"] for r in found.where("kind = 1").select("part").collect())  # one number per partition
    follows = docs.sparkSession.createDataFrame(list(zip(heads, heads[1:] + heads[:1], strict=True)), "part int, to int")
    last = found.where("kind = 2").select("id", "text", "part").join(F.broadcast(follows), "part").select("id", "text", "to")  # one row per partition
    head = found.where("kind = 1").select(F.col("part").alias("to"), F.col("text").alias("following"))
    names = [f.name for f in _SCHEMA][:7]
    tails = last.join(head, "to").select("id", "text", "following").mapInArrow(_ends(size), ", ".join(_DDL.split(", ")[:7]))
    out = found.where("kind = 0").select(*names).unionByName(tails)
    return out.select(F.col("id").alias(key), *[F.lower(F.hex(c)).alias(c) if c.endswith(("fingerprint", "sha256")) else F.col(c) for c in names[1:]])
