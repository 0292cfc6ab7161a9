"""Words and word pairs of texts, counted by class in arrays; no use of a term is a row.

A task splits its texts byte by byte and gives each term of a few megabytes of text once for each class. Pairs are only
counted where both words are in as many documents as a pair must be; these words are told by BITS bits, set by a hash, so
what a task is sent does not grow with the words. A bit that is set by mistake costs a row, which the floor drops.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import ranking
from tidemark.operators.running import cut

#: Bits that tell frequent words; those of one row; bytes of text that are counted together.
BITS, ROW, CHUNK = 1 << 26, 1 << 15, 1 << 24


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTER, _ALNUM = _table("abcdefghijklmnopqrstuvwxyz"), _table("abcdefghijklmnopqrstuvwxyz0123456789")
_RUN = _ALNUM | _table("-")
_BREAK = ~(_RUN | _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ_ \t\n\f\r'"))


def _at(places: np.ndarray, index: np.ndarray, none: int) -> np.ndarray:
    """places[index], none beyond its ends."""
    return np.concatenate([places, [none]])[np.where((index < 0) | (index >= len(places)), len(places), index)]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    r"""The matches of \b[a-z][a-z0-9-]+\b in lower-cased texts, each with its text's place and the number of its phrase.

    A phrase ends where [^\w\s'-] matches. A run of [a-z0-9-] holds one match at most: from its first letter behind a
    boundary to its last boundary.
    """
    joined = pc.binary_join_element_wise(texts, "", ",")  # each text ends with a break
    ends = np.frombuffer(joined.buffers()[1], np.int32)[1 : len(texts) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[: ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    run = _RUN[data]
    before = np.concatenate([[False], run[:-1]])
    first, last = np.flatnonzero(run & ~before), np.flatnonzero(before & ~run) - 1
    joins = data[last + 1] == ord("_")
    hyphen, letter = data == ord("-"), _LETTER[data]
    opens = np.zeros(len(data), bool)
    opens[1:] = letter[1:] & hyphen[:-1]
    opens[first] = letter[first] & ~((first > 0) & (data[first - 1] == ord("_")))
    late = np.flatnonzero(~opens[first])
    places = np.flatnonzero(opens)
    start, stop = first.copy(), last.copy()
    start[late] = _at(places, np.searchsorted(places, first[late]), len(data))
    for early, ok in ((np.flatnonzero(~joins & hyphen[last]), ~hyphen & run), (np.flatnonzero(joins & ~hyphen[last]), hyphen)):
        if len(early):
            places = np.flatnonzero(ok)
            stop[early] = _at(places, np.searchsorted(places, last[early], "right") - 1, -1)
    match = start < stop  # places before or behind a run are never a match of it
    start, stop = start[match], stop[match] + 1
    inside = np.zeros(len(data), np.int8)
    inside[start], inside[stop] = 1, -1
    kept = data[np.cumsum(inside, dtype=np.int8) > 0]
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)), pa.py_buffer(kept))
    return tokens, np.searchsorted(ends, start, "right"), np.searchsorted(np.flatnonzero(_BREAK[data]), start)


_COUNT = pa.schema([("class", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]:
    """(codes of the words, places, phrases, words, classes' codes of the texts by rising class, classes) for some megabytes of text each."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.unique(np.concatenate([np.searchsorted(size, np.arange(CHUNK, size[-1], CHUNK)) if len(size) else [], [0, len(size)]]).astype(int))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            part = part.take(pc.sort_indices(part.column("class")))
            tokens, row, phrase = words(part.column("text"))
            coded, kinds = tokens.dictionary_encode(), part.column("class").dictionary_encode()
            yield coded.indices.to_numpy().astype(np.int64), row, phrase, coded.dictionary, kinds.indices.to_numpy().astype(np.int64), kinds.dictionary


def _counted(code: np.ndarray, row: np.ndarray, kind: np.ndarray, classes: pa.Array, names: Callable[[np.ndarray], pa.Array]) -> pa.RecordBatch:
    """Uses and texts of each code by class; texts lie by class."""
    used, n = np.unique(code * len(kind) + row, return_counts=True)
    code, row = np.divmod(used, max(1, len(kind)))
    start = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(kind[row], prepend=-1) != 0))
    n = np.add.reduceat(n, start) if len(start) else n
    docs = np.diff(start, append=len(code))
    return pa.RecordBatch.from_arrays([classes.take(pa.array(kind[row[start]])), names(code[start]), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNT)


def _plain(vocabulary: pa.Array) -> np.ndarray:
    return ~pc.is_in(vocabulary, pa.array(ranking.STOP_WORDS)).to_numpy(zero_copy_only=False)


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for code, row, _, vocabulary, kind, classes in _chunks(batches):
        use = _plain(vocabulary)[code]
        yield _counted(code[use], row[use], kind, classes, lambda c: vocabulary.take(pa.array(c)))  # noqa: B023


def _pairs(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8)
        for code, row, phrase, vocabulary, kind, classes in _chunks(batches):
            at = np.array([zlib.crc32(w) for w in vocabulary.cast(pa.binary()).to_pylist()], np.int64) % BITS
            use = (_plain(vocabulary) & (bits[at >> 3] >> (at & 7) & 1).astype(bool))[code]
            both = np.flatnonzero(use[:-1] & use[1:] & (phrase[:-1] == phrase[1:]))
            pair, which = np.unique(code[both] * len(vocabulary) + code[both + 1], return_inverse=True)
            left, right = np.divmod(pair, max(1, len(vocabulary)))
            yield _counted(which, row[both], kind, classes, lambda c: pc.binary_join_element_wise(vocabulary.take(pa.array(left[c])), vocabulary.take(pa.array(right[c])), " "))  # noqa: B023

    return run


def _bits(terms: DataFrame) -> bytes:
    """BITS bits with those of the terms set: rows of ROW bits each, however many terms there are."""
    at = terms.select((F.crc32(F.encode("term", "UTF-8")) % BITS).alias("at"))
    rows = at.groupBy(F.expr(f"at div {ROW}").alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["row"] * ROW // 8 : (r["row"] + 1) * ROW // 8] = r["bits"]
    return bytes(out)


def counts(texts: DataFrame, floor: int) -> DataFrame:
    """(class, term, tt, n): uses in a class and in all of the words and word pairs in at least `floor` texts; texts (class, text), lower-cased, a row each."""
    texts = texts.where("text IS NOT NULL").select("class", "text")

    def frequent(count: Callable) -> DataFrame:
        n = texts.mapInArrow(count, "class string, term string, n long, docs long").groupBy("class", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # a text has one class, so a term's texts in all classes are summed; a list has an entry for each class
        per = n.groupBy("term").agg(F.sum("n").alias("tt"), F.sum("docs").alias("df"), F.collect_list(F.struct("class", "n")).alias("c"))
        return cut(per.where(F.col("df") >= floor).select("term", "tt", F.inline("c")))

    single = frequent(_singles)
    bits = texts.sparkSession.sparkContext.broadcast(_bits(single))  # BITS / 8 bytes
    return single.unionByName(frequent(_pairs(bits))).select("class", "term", "tt", "n")
