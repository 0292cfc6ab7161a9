"""Many queries against documents that no index holds: a tile of documents is read once, with all that is asked of it.

Texts are dealt to tiles of at most about DOCS documents by a hash of their key, which is the only time that they are
shuffled. A task splits its texts into tokens byte by byte in arrays, and keeps the postings of the terms asked for, or the
passages that it finds; no token is a row, and terms that nobody asks for leave the task that has read them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import english
from tidemark.operators import ranking
from tidemark.operators.inverted import Index
from tidemark.operators.running import cut

#: Documents of a tile, at most and (where cores would idle) at least; terms or passages that meet a tile at once; tokens in a row that tell where a passage may be.
DOCS, LEAST, ASKED, WINDOW = 1 << 14, 1 << 10, 1 << 16, 4
_STOP = frozenset(ranking.STOP_WORDS)
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens (ranking.TOKEN) of lower-cased texts one after the other, and how many each text has."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, int)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = word[edges]
    kept, at = data[word], np.flatnonzero(first[word]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, np.int32(len(kept)))), pa.py_buffer(kept))
    return tokens, np.diff(np.searchsorted(np.flatnonzero(first), ends))


def _number(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def _dealt(docs: DataFrame, n: int, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """asked and docs (n rows at most), each by block of what is asked and tile (_a, _d), and the number of tiles."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-asked.count() // ASKED))
    down = max(1, -(-n // DOCS), min(-(-n // LEAST), -(-2 * parts // across)))
    deal = lambda d: d.repartition(max(parts, across * down), "_a", "_d")
    left = asked.withColumn("_a", F.pmod(F.xxhash64(key), F.lit(across)).cast("long")).withColumn("_d", _number(down))
    right = docs.withColumn("_d", F.pmod(F.xxhash64("doc_id"), F.lit(down)).cast("long")).withColumn("_a", _number(across))
    return deal(left), deal(right), down


_BLOCK = "analyzer string, term string, area long, n long, total long, doc_id array<bigint>, tf array<int>, dl array<int>"
_BLOCKS = pa.schema([("analyzer", pa.string()), ("term", pa.string()), ("area", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32())), ("dl", pa.list_(pa.int32()))])


def _analyzed(tokens: pa.Array, terms: pa.Array, analyzer: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its place in terms, -1 if it is none of them, and whether it counts, as inverted.ANALYZERS do; a distinct token is stemmed once."""
    if analyzer == "words":
        return pc.index_in(tokens, terms).fill_null(-1).to_numpy(zero_copy_only=False), np.ones(len(tokens), bool)
    coded = tokens.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts = np.array([w not in _STOP for w in words], bool)
    code = pc.index_in(pa.array(map(english.stem, words), pa.string()), terms).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(counts, code, -1)[at], counts[at]


def _blocks(key: tuple, asked: pa.Table, docs: pa.Table) -> pa.Table:
    """A tile's blocks of the terms asked for, by analyzer; the empty term, which no token is, stands for all documents with tokens."""
    if not asked.num_rows or not docs.num_rows:
        return _BLOCKS.empty_table()
    wanted = {a: asked.filter(pc.equal(asked.column("analyzer"), a)).column("term").combine_chunks() for a in asked.column("analyzer").unique().to_pylist()}
    ids, row = np.unique(docs.column("doc_id").to_numpy(), return_inverse=True)
    dl, found, at = {a: np.zeros(len(ids)) for a in wanted}, {a: [] for a in wanted}, 0
    for texts in docs.column("text").chunks:
        tokens, each = split(texts)
        doc = np.repeat(row[at : at + len(texts)], each)
        at += len(texts)
        for a, terms in wanted.items():
            code, counts = _analyzed(tokens, terms, a)
            dl[a] += np.bincount(doc[counts], minlength=len(ids))
            hit = code >= 0
            found[a].append(np.unique(code[hit].astype(np.int64) * len(ids) + doc[hit], return_counts=True))
    return pa.concat_tables([_kind(a, key[1].as_py(), terms, ids, dl[a], found[a]) for a, terms in wanted.items()])


def _kind(analyzer: str, area: int, terms: pa.Array, ids: np.ndarray, dl: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    pair, where = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    tf = np.bincount(where, np.concatenate([t for _, t in found]), len(pair)).astype(np.int64)
    term, doc = np.divmod(pair, len(ids))
    every = np.flatnonzero(dl) if terms.index("").as_py() >= 0 else np.zeros(0, int)
    start = np.flatnonzero(np.diff(term, prepend=-1))
    names = pa.concat_arrays([terms.take(pa.array(term[start])), pa.array([""] * (len(every) > 0), pa.string())])
    doc, tf = np.concatenate([doc, every]), np.concatenate([tf, np.ones(len(every), int)])
    starts = np.concatenate([start, [len(pair)] * (len(every) > 0)]).astype(int)
    offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
    n = np.diff(starts, append=len(doc))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((ids[doc], pa.int64()), (tf, pa.int32()), (dl[doc].astype(np.int64), pa.int32()))]
    total = np.where(np.array(names.to_pylist()) == "", int(dl.sum()), 0) if len(n) else n
    return pa.Table.from_arrays([pa.array([analyzer] * len(n), pa.string()), names, pa.array(np.full(len(n), area, np.int64)), pa.array(n), pa.array(total, pa.int64()), *lists], schema=_BLOCKS)


def index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The postings of the terms asked for (term), with the statistics of all documents, as an index that holds no others.

    Rows with one key are one document; documents without tokens and null keys are not in it.
    """
    return indexes(docs, {"words": terms}, key, text)["words"]


def indexes(docs: DataFrame, terms: dict[str, DataFrame], key: str = "doc_id", text: str = "text") -> dict[str, Index]:
    """An index as `index` for the terms of each analyzer (a name of inverted.ANALYZERS), all from one pass over the texts."""
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.lower(F.col(text)).alias("text"))
    asked = docs.sparkSession.createDataFrame([(a, "") for a in terms], "analyzer string, term string")
    for a, of in terms.items():
        asked = asked.union(of.select(F.lit(a), "term").where("term <> ''"))
    left, right, down = _dealt(texts, docs.count(), asked.distinct(), "term")
    held = cut(left.groupBy("_a", "_d").cogroup(right.groupBy("_a", "_d")).applyInArrow(_blocks, _BLOCK))
    return {a: _index(held.where(F.col("analyzer") == a), down) for a in terms}


def _index(held: DataFrame, down: int) -> Index:
    every, held = held.where("term = ''"), held.where("term <> ''")
    total = every.agg(F.sum("n").cast("double").alias("n"), F.sum("total").cast("double").alias("dl")).first()
    n = total["n"] or 0.0
    blocks = held.select("term", "area", "n", F.array_max("tf").cast("long").alias("most_tf"), F.array_min("dl").cast("long").alias("least_dl"), F.arrays_zip("doc_id", "tf", "dl").cast("array<struct<doc_id: bigint, tf: bigint, dl: bigint>>").alias("postings"))
    df = held.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    lengths = every.select(F.inline(F.arrays_zip("doc_id", "dl"))).select("doc_id", F.col("dl").cast("long").alias("dl"))
    return Index(blocks, df, lengths, n, (total["dl"] or 0.0) / n if n else 0.0, held.select("term", "area", "doc_id", "tf", "dl"), down)


_PAIR = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64())])


def _windows(code: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for the tokens from each place on; equal ones have equal numbers."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (code[at + i] + 2).astype(np.uint64)
    return out


def _found(key: tuple, asked: pa.Table, docs: pa.Table) -> pa.Table:
    """(qid, doc_id) of passages (qid, passage, words: its inner tokens) that a text holds."""
    if not asked.num_rows or not docs.num_rows:
        return _PAIR.empty_table()
    words = asked.column("words").combine_chunks()
    known = words.flatten().unique()
    inner = np.split(pc.index_in(words.flatten(), known).to_numpy(), np.cumsum(words.value_lengths().to_numpy())[:-1])
    passages, qids = asked.column("passage").cast(pa.binary()).to_pylist(), asked.column("qid").to_pylist()
    kinds = []
    for width in range(1, WINDOW + 1):
        of = [i for i, c in enumerate(inner) if min(len(c), WINDOW) == width]
        if of:
            start = np.zeros(len(known) + 1, bool)
            start[[inner[i][0] for i in of]] = True
            number, which = np.unique(np.array([_windows(inner[i], np.zeros(1, int), width)[0] for i in of]), return_inverse=True)
            order = np.argsort(which, kind="stable")
            kinds.append((width, start, number, np.split(np.array(of)[order], np.cumsum(np.bincount(which))[:-1])))
    ids, out = docs.column("doc_id").combine_chunks(), ([], [])
    at = 0
    for texts, low in zip(docs.column("text").chunks, docs.column("low").chunks, strict=True):
        tokens, each = split(low)
        code, row = pc.index_in(tokens, known).fill_null(-1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(low)), each)
        texts = texts.cast(pa.binary())
        for width, start, number, of in kinds:
            place = np.flatnonzero(start[code[: max(0, len(code) - width + 1)]])
            place = place[row[place] == row[place + width - 1]]
            seen = _windows(code, place, width)
            which = np.minimum(np.searchsorted(number, seen), len(number) - 1)
            hit = number[which] == seen
            for r, w in np.unique(np.stack([row[place[hit]], which[hit]], 1), axis=0):
                whole = texts[r].as_py()
                for i in of[w]:
                    if passages[i] in whole:
                        out[0].append(qids[i])
                        out[1].append(at + r)
        at += len(low)
    return pa.Table.from_arrays([pa.array(out[0], pa.int64()), ids.take(pa.array(out[1], pa.int64()))], schema=_PAIR)


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id), more than once where an id repeats: documents (doc_id, text) that hold a passage (qid, passage, words).

    words are the passage's tokens less the first and last, which may be cut from longer ones; there must be one. They are a
    run of the document's tokens too; where the first of them are, the whole passage is compared.
    """
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left, right, _ = _dealt(texts, docs.count(), passages.select(F.col("qid").cast("long").alias("qid"), "passage", "words"), "qid")
    return left.groupBy("_a", "_d").cogroup(right.withColumn("low", F.lower("text")).groupBy("_a", "_d")).applyInArrow(_found, "qid long, doc_id long")
