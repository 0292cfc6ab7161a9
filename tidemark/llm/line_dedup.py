"""Line deduplication: key hashes range-partitioned with a secondary sort by document, streamed for first occurrences.

Only 128-bit line keys, ids and positions are shuffled; the answer is a compressed keep bitmap per document. The range
partitioning is on (key, document), so a line that a third of all documents share spreads over many partitions; runs
that touch a partition's edge are settled from one summary row per edge.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WS_CHARS, cut, slices

MIN_CHARS, MIN_DOCS = 20, 3
_KEYS = "h1 long, h2 long, id long, tx long, pos array<int>"
_RUNS = "kind int, h1 long, h2 long, id long, tx long, pos array<int>, n long"
_START = object()  # before a run's first document, whose id may be null
_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("tx", pa.int64()), ("pos", pa.list_(pa.int32())), ("n", pa.int64())])


def line_key(line: str) -> bytes | None:
    """The key's UTF-8 bytes: white space stripped, A-Z lowered; None for a key under MIN_CHARS code points."""
    stripped = line.strip(WS_CHARS)
    return stripped.encode().lower() if len(stripped) >= MIN_CHARS else None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        h, ids, txs, pos = [], [], [], []
        for doc, tx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own: dict[bytes, list[int]] = {}
            for i, line in enumerate((text or "").split("\n")):
                if (key := line_key(line)) is not None:
                    own.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
            h += own
            pos += own.values()
            ids += [doc] * len(own)
            txs += [tx] * len(own)
        if h:
            pair = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(txs, pa.int64()), pa.array(pos, pa.list_(pa.int32()))], names=["h1", "h2", "id", "tx", "pos"])


def _runs(least: int):
    """Streams sorted rows. kind 0: drop these lines; 1: belongs to an edge run that is settled later; 2: an edge run's summary (id: its largest document)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, docs, top, last = None, True, 0, None, _START
        held: list[tuple] = []  # rows of a run's documents while they are fewer than `least`
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            pos = batch.column(4)
            for i, (h1, h2, doc, tx) in enumerate(zip(*cols, strict=True)):
                if (h1, h2) != run:
                    if run is not None and first:
                        out.append((2, *run, top, 0, [], docs))
                    first = run is None
                    run, docs, top, last, held = (h1, h2), 0, doc, _START, []
                if doc != last:
                    docs, last = docs + 1, doc
                if first:
                    out.append((1, h1, h2, doc, tx, pos[i].as_py(), 0))
                elif docs < least:
                    held.append((1, h1, h2, doc, tx, pos[i].as_py(), 0))
                else:
                    out += [(0, *x[1:]) for x in held if x[3] != top]
                    held = []
                    if doc != top:
                        out.append((0, h1, h2, doc, tx, pos[i].as_py(), 0))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        if run is not None:
            out = [*held, (2, *run, top, 0, [], docs)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return stream


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, tx, drop array<int>): 0-based lines to drop, by document id and xxhash64 of the text."""
    slim = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tx"), F.col(text).alias("text"))
    keys = slim.mapInArrow(_keys, _KEYS)
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_runs(min_docs), _RUNS))
    edges = runs.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= min_docs)
    # at most two summary rows for each range partition, so the broadcast is bounded by twice the partition count
    late = runs.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("top")))
    drop = runs.where("kind = 0").select("id", "tx", "pos").unionByName(late.select("id", "tx", "pos"))
    return drop.groupBy("id", "tx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("drop"))


def pack_bitmap(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("_text"))):
            out = []
            for text, drop in zip(batch.column("_text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                keep = np.ones(len(lines), bool)
                if drop:
                    keep[drop] = False
                    kept = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
                else:
                    kept = text or ""
                out.append((len(lines), len(drop or ()), pack_bitmap(keep), hashlib.sha256(kept.encode()).hexdigest(), kept))
            n, d, bits, sha, kept = zip(*out, strict=True) if out else ([],) * 5
            extra = [pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(bits, pa.binary()), pa.array(sha, pa.string())]
            names = ["n_lines", "n_dropped", "keep_bitmap", "kept_sha256"]
            if with_text:
                extra, names = [*extra, pa.array(kept, pa.string())], [*names, "kept_text"]
            rest = [i for i, c in enumerate(batch.schema.names) if c not in ("_text", "drop")]
            yield pa.record_batch([batch.column(i) for i in rest] + extra, names=[batch.schema.names[i] for i in rest] + names)

    return run


def line_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row per row of docs: key, n_lines, n_dropped, keep_bitmap (zlib of packed bits, first line first),
    kept_sha256, kept_text (if with_text) and the columns in carry.

    A line's key: the line without white space at both ends, A-Z lowered. Keys of at least MIN_CHARS code points found
    in at least min_docs documents lose all their lines except in the largest id that holds them. Null or empty text is
    one empty line. Rows with one id count as one document; a null id counts as one document below all others. An
    empty table gives no rows.
    """
    drop = dropped_lines(docs, key=key, text=text, min_docs=min_docs).select(F.col("id").alias("_id"), F.col("tx").alias("_tx"), "drop")
    own = docs.select(F.col(key).alias("_key"), F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_tx"), F.col(text).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    drop = drop.select(F.col("_id").alias("_id2"), F.col("_tx").alias("_tx2"), "drop")
    joined = own.join(drop, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_tx") == F.col("_tx2")), "left").drop("_id", "_tx", "_id2", "_tx2")
    kinds = {f.name: f.dataType for f in joined.schema}
    schema = T.StructType([T.StructField("_key", kinds["_key"]), *[T.StructField(f"_carry_{c}", kinds[f"_carry_{c}"]) for c in carry]])
    schema = schema.add("n_lines", "long").add("n_dropped", "long").add("keep_bitmap", "binary").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    out = joined.mapInArrow(_apply(with_text), schema)
    return out.select(F.col("_key").alias(key), "n_lines", "n_dropped", "keep_bitmap", "kept_sha256", *(["kept_text"] if with_text else []), *[F.col(f"_carry_{c}").alias(c) for c in carry])


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, (f.k IS NOT NULL AND l.doc_id <> f.top) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
