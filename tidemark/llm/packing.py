"""Concatenate and cut: token streams of all documents end to end, cut into fixed windows.

Pass one tokenizes each partition and notes every document's offset in it. The partitions' totals (one number each)
give every partition's global offset by a prefix sum; pass two cuts the stored tokens at multiples of the window and
writes one boundary record for each piece of a document in a window. Only the last sequence can be short.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, slices, text_buffer
from .shingles import spans_hash, words

WINDOW, END_ID = 2048, 1
#: Words that a worker remembers at most (about 40 bytes each); beyond, it forgets all and starts anew.
CACHE = 1_500_000
#: Lowered words of these letters, and runs of these marks, are pre-tokens of their own wherever they stand.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%&$*]*)")


class _Memory:
    """64-bit word hashes to runs of a token pool, in two sorted tiers; the small one is merged when it has grown."""

    def __init__(self, dtype: np.dtype):
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tiers, self.pool, self.used = [empty, empty], np.zeros(1 << 16, dtype), 0

    def __len__(self) -> int:
        return len(self.tiers[0][0]) + len(self.tiers[1][0])

    def store(self, tokens: np.ndarray) -> int:
        while self.used + len(tokens) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.pool.dtype)])
        at = self.used
        self.pool[at : at + len(tokens)] = tokens
        self.used += len(tokens)
        return at

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys that it lacks."""
        tier = 1
        if len(self.tiers[1][0]) + len(keys) > 1 << 15 and len(self.tiers[1][0]):
            self.tiers[0] = self._merged(self.tiers[0], self.tiers[1])
            self.tiers[1] = tuple(x[:0] for x in self.tiers[1])
        self.tiers[tier] = self._merged(self.tiers[tier], (keys, at, n))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length in the pool; length -1 where unknown."""
        at, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, places, lengths in self.tiers:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], n[hit] = places[i[hit]], lengths[i[hit]]
        return at, n


class WordTokenizer:
    """Encodes whole Arrow batches by words between ASCII white space, which the tokenizer drops, so words are independent.

    Each distinct word of a batch is looked up by its hash; only new ones reach the tokenizer. New words of letters and
    marks are split first, so that a word is tokenized once whatever its case and the marks after it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        vocabulary = self._tok.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self._ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._memory = _Memory(self.dtype)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _simple(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of distinct pre-tokens."""
        lengths = np.array([len(p.encode()) for p in parts], np.int64)
        stop = np.cumsum(lengths)
        keys = spans_hash(np.frombuffer("".join(parts).encode(), np.uint8), stop - lengths, stop)
        at, n = self._memory.find(keys)
        new = np.flatnonzero(n < 0)
        for lo in range(0, len(new), 512):
            own = new[lo : lo + 512]
            ids = self._ids(" ".join([parts[i] for i in own]))
            stops = np.flatnonzero(self._ends[ids]) + 1
            if len(stops) != len(own):  # not one pre-token each after all
                runs = [self._ids(parts[i]) for i in own]
                ids, stops = np.concatenate(runs), np.cumsum([len(r) for r in runs])
            base = self._memory.store(ids)
            n[own] = np.diff(stops, prepend=0)
            at[own] = base + stops - n[own]
        if len(new):
            self._memory.add(keys[new], at[new], n[new])
        return at, n

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        split = list(map(_SIMPLE.fullmatch, words))
        at, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        simple = np.flatnonzero([m is not None for m in split])
        pairs = [m.groups() for m in split if m is not None]
        cores, marks = [c.lower() for c, _ in pairs], [m for _, m in pairs]
        index = {p: i for i, p in enumerate(dict.fromkeys(cores + marks)) if p}
        index = {p: i for i, p in enumerate(index)}
        if index:
            places, lengths = self._simple(list(index))
            core = np.array([index[c] for c in cores])
            at[simple], n[simple] = places[core], lengths[core]
            marked = np.flatnonzero([bool(m) for m in marks])
            if len(marked):
                # the core's run and the marks' run, copied end to end
                both = np.stack([core[marked], np.array([index[m] for m in marks if m])], 1).ravel()
                runs = lengths[both]
                begin = np.cumsum(runs) - runs
                base = self._memory.store(self._memory.pool[np.repeat(places[both] - begin, runs) + np.arange(int(runs.sum()))])
                at[simple[marked]], n[simple[marked]] = base + begin[::2], runs[::2] + runs[1::2]
        for i in np.flatnonzero([m is None for m in split]):
            ids = self._ids(words[i])
            at[i], n[i] = self._memory.store(ids), len(ids)
        lacking = self._memory.find(keys)[1] < 0  # a lowered word without marks is stored by now
        self._memory.add(keys[lacking], at[lacking], n[lacking])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each closed by `end`, and the number of each."""
        if len(self._memory) > CACHE:
            self._memory = _Memory(self.dtype)
        start, stop, doc = words(data, offsets)
        docs = len(offsets) - 1
        keys, first, inverse = np.unique(spans_hash(data, start, stop), return_index=True, return_inverse=True)
        new = np.flatnonzero(self._memory.find(keys)[1] < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
        closing = self._memory.store(np.array([end], self.dtype))
        at, n = self._memory.find(keys)
        # words and closing ids in order: word i stands behind as many closing ids as texts before its own
        all_at, all_n = np.full(len(start) + docs, closing), np.ones(len(start) + docs, np.int64)
        place = np.arange(len(start)) + doc
        all_at[place], all_n[place] = at[inverse], n[inverse]
        begin = np.cumsum(all_n) - all_n
        ids = self._memory.pool[np.repeat(all_at - begin, all_n) + np.arange(int(all_n.sum()))]
        closed = np.cumsum(np.bincount(doc, minlength=docs)) + np.arange(docs)
        return ids, np.diff(begin[closed] + 1, prepend=0)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        tok = tokenizer(path)
        for whole in batches:
            for own in slices(whole, 1):
                ids, n = tok.encode(*text_buffer(own.column(1)), END_ID)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                bounds = (np.concatenate([[0], np.cumsum(n)]) * tok.dtype.itemsize).astype(np.int32)
                stored = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.record_batch([own.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), stored], names=["_key", "part", "at", "n", "ids"])

    return run


def _cut(base: dict[int, int], window: int, path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizer(path).dtype
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                row, out, held = [], [], []
                parts, ats, ns = (own.column(c).to_pylist() for c in ("part", "at", "n"))
                for i, (part, at, n) in enumerate(zip(parts, ats, ns, strict=True)):
                    ids = np.frombuffer(own.column("ids")[i].as_buffer(), dtype).astype("<u4")
                    begin, s = base[part] + at, 0
                    while s < n:
                        offset = (begin + s) % window
                        e = min(n, s + window - offset)
                        out.append((s, e - s, zlib.crc32(ids[s:e]), n, (begin + s) // window, offset))
                        row.append(i)
                        if with_ids:
                            held.append(ids[s:e].astype(np.int32))
                        s = e
                cols = [own.column("_key").take(pa.array(row)), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]] if out else []
                if out:
                    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                    if with_ids:
                        cols, names = [*cols, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.record_batch(cols, names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids array<int>).

    Documents follow one another in the table's stored order, each ended by id END_ID; null or empty text is that id
    alone. Every token lies in exactly one piece; sequences are full but for the last. Null and repeated keys are
    packed like any row; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    stored = cut(slim.mapInArrow(_tokenize(tokenizer_path), f"_key {kind}, part int, at long, n long, ids binary"))
    totals = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per partition
    base = dict(zip([p for p, _ in totals], accumulate([0, *[n for _, n in totals[:-1]]]), strict=True)) if totals else {}
    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return stored.mapInArrow(_cut(base, window, tokenizer_path, with_ids), schema).withColumnRenamed("_key", key)
