"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie of pre-tokens.

The distinct pre-tokens of a run of texts are sorted, so that words with a common prefix stand together and every run
of words with one prefix is a trie node. Depth by depth, the best score of each node is computed once, from its
ancestors and the pieces that end there, and words read their counts at their terminal nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .shingles import mix, powers

#: Words of one trie; its cells (words x longest word); words remembered at most, none longer than DEEP characters.
TRIE_WORDS, CELLS, CACHE, DEEP = 20_000, 1 << 20, 300_000, 48


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log probabilities; a character that is no piece costs `unknown` for each UTF-8 byte, which counts as a token."""

    scores: dict[str, float]
    unknown: float
    prefix: str = "▁"

    @staticmethod
    def ranked(pieces: list[str], prefix: str = "▁") -> "Vocabulary":
        """Zipf's law over pieces in order of frequency: log p = -ln(rank + 2) - ln(ln(n + 2))."""
        n = len(pieces)
        scores: dict[str, float] = {}
        for i, p in enumerate(pieces):
            scores.setdefault(p, float(-np.log(i + 2) - np.log(np.log(n + 2))))
        return Vocabulary(scores, min(scores.values(), default=0.0) - 10.0, prefix)


def segment(word: str, v: Vocabulary, longest: int) -> int:
    """Tokens of the best segmentation of one word; among equal scores the fewest tokens. Linear in the word's length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        top = None
        for n in range(1, min(d, longest) + 1):
            s = v.scores.get(word[d - n : d])
            k = 1
            if s is None:
                if n > 1:
                    continue
                k = len(word[d - 1].encode("utf-8", "surrogatepass"))
                s = v.unknown * k
            f, c = best[d - n]
            if top is None or f + s > top[0] or (f + s == top[0] and c + k < top[1]):
                top = (f + s, c + k)
        best.append(top)
    return best[-1][1]


class Trie:
    """Counts tokens of many words at once."""

    def __init__(self, v: Vocabulary):
        self.v, self.longest = v, max(map(len, v.scores), default=1)
        self.memory: dict[str, int] = {}
        size = 1 << max(12, (len(v.scores) * 24).bit_length())
        self._mask = np.uint64(size - 1)
        self._keys, self._values, self._probes = np.zeros(size, np.uint64), np.zeros(size), 1
        names = list(v.scores)
        for h, name in zip(self._hash_all(names).tolist(), names, strict=True):
            at, n = h & (size - 1), 1
            while self._keys[at]:
                at, n = (at + 1) & (size - 1), n + 1
            self._keys[at], self._values[at] = h, v.scores[name]
            self._probes = max(self._probes, n)

    @staticmethod
    def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), lengths

    def _prefix_hash(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        points, lengths = self._points(words)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(len(points) + 1)[0][: len(points)], out=sums[1:])
        return points, lengths, np.cumsum(lengths) - lengths, sums

    def _hash_all(self, words: list[str]) -> np.ndarray:
        _, lengths, start, sums = self._prefix_hash(words)
        return self._span(sums, start, start + lengths)

    @staticmethod
    def _span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inv = powers(len(sums))[1]
        return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64)) | np.uint64(1)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Scores, -inf where h is no piece."""
        out, at = np.full(len(h), -np.inf), h & self._mask
        for _ in range(self._probes):
            found = self._keys[at] == h
            out[found] = self._values[at[found]]
            at = (at + np.uint64(1)) & self._mask
        return out

    def _count(self, words: list[str]) -> dict[str, int]:
        words = sorted(words)
        points, lengths, start, sums = self._prefix_hash(words)
        deep = int(lengths.max())
        grid = np.zeros((len(words), deep), np.uint32)
        grid[np.arange(deep) < lengths[:, None]] = points
        same = grid[1:] == grid[:-1]
        shared = np.zeros(len(words), np.int64)
        shared[1:] = np.where(same.all(1), deep, same.argmin(1))
        shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
        width = np.where(grid < 0x80, 1, np.where(grid < 0x800, 2, np.where(grid < 0x10000, 3, 4)))
        best = np.full((deep + 1, len(words)), -np.inf)
        count = np.zeros((deep + 1, len(words)), np.int64)
        best[0] = 0.0
        for d in range(1, deep + 1):
            rows = np.flatnonzero(lengths >= d)
            # a new node begins where a word shares fewer than d characters with the one before it
            first = shared[rows] < d
            first[0] = True
            node = np.cumsum(first) - 1
            rep = rows[first]
            top, least = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int64)
            for n in range(1, min(d, self.longest) + 1):
                s = self._lookup(self._span(sums, start[rep] + d - n, start[rep] + d))
                k = np.ones(len(rep), np.int64)
                if n == 1:
                    k = np.where(np.isinf(s), width[rep, d - 1], 1)
                    s = np.where(np.isinf(s), self.v.unknown * k, s)
                f, c = best[d - n][rep] + s, count[d - n][rep] + k
                better = (f > top) | ((f == top) & (c < least))
                top, least = np.where(better, f, top), np.where(better, c, least)
            best[d][rows], count[d][rows] = top[node], least[node]
        return dict(zip(words, count[lengths, np.arange(len(words))].tolist(), strict=True))

    def counts(self, words: set[str]) -> dict[str, int]:
        """Tokens of each word. Words up to DEEP characters are remembered; longer ones are counted anew, so memory is bounded."""
        if len(self.memory) > CACHE:
            self.memory = {}
        long = sorted((w for w in words if len(w) + len(self.v.prefix) > DEEP), key=lambda w: (len(w), w))
        short = sorted(self.v.prefix + w for w in words if w not in self.memory and len(w) + len(self.v.prefix) <= DEEP)
        for at in range(0, len(short), TRIE_WORDS):
            for w, n in self._count(short[at : at + TRIE_WORDS]).items():
                self.memory[w[len(self.v.prefix) :]] = n
        if not long:
            return self.memory
        out = {w: self.memory[w] for w in words if len(w) + len(self.v.prefix) <= DEEP}
        while long:
            deep = len(long[-1]) + len(self.v.prefix)
            own = [self.v.prefix + w for w in long[-max(1, min(TRIE_WORDS, CELLS // deep)) :]]
            del long[-len(own) :]
            # a trie of one or a few branches is its words: without levels to share, they are walked one at a time
            got = self._count(own) if len(own) >= 16 else {w: segment(w, self.v, self.longest) for w in own}
            out |= {w[len(self.v.prefix) :]: n for w, n in got.items()}
        return out


_TRIES: dict[str, Trie] = {}


def piece_vocabulary(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (sp.IsControl, sp.IsUnknown, sp.IsByte, sp.IsUnused)
    return Vocabulary.ranked([sp.IdToPiece(i) for i in range(sp.GetPieceSize()) if not any(f(i) for f in special)])


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TRIES:
            _TRIES[path] = Trie(piece_vocabulary(path))
        trie = _TRIES[path]
        for batch in batches:
            for own in slices(batch, 1):
                split = [(t or "").split() for t in own.column(1).to_pylist()]
                get = trie.counts(set().union(*split)).__getitem__
                yield pa.record_batch([own.column(0), pa.array([len(x) for x in split], pa.int64()), pa.array([sum(map(get, x)) for x in split], pa.int64())], names=["_key", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words (pre-tokens: runs without Unicode white space), n_tokens.

    Null and empty texts count 0. Words of any length are counted whole. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(_counts(vocabulary_path), f"_key {kind}, n_words long, n_tokens long")
    return out.withColumnRenamed("_key", key)
