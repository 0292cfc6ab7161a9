"""Word shingles as 64-bit hashes, computed over whole Arrow batches in NumPy."""

from __future__ import annotations

import numpy as np

_M = np.uint64
#: Multiplier of the byte hash and its inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _M(30)
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            a, step = np.ones(1, np.uint64), base
            while len(a) < size:
                a = np.concatenate([a, a * _M(step)])
                step = step * step % (1 << 64)
            _powers[k] = a
    return _powers[0][:n], _powers[1][:n]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, the same wherever the span stands."""
    if not len(data):
        return np.zeros(len(start), np.uint64)
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _M(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the runs without white space; a run ends with its text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    start = np.flatnonzero(solid & (before | first[:-1]))
    end = np.flatnonzero(solid & (after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `size` words; a text of fewer words is one shingle of them all."""
    start, end, doc = words(data, offsets)
    docs = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = spans_hash(data, start, end)
    factor = mix(np.arange(1, size + 1, dtype=np.uint64)) | _M(1)
    m = len(w) - size + 1
    if m > 0:
        whole = np.flatnonzero(doc[:m] == doc[size - 1 :])
        h = np.zeros(len(whole), np.uint64)
        for i in range(size):
            h += w[whole + i] * factor[i]
        owner = doc[whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=docs)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        at = np.searchsorted(doc, few)
        short = count[few].astype(np.uint64) << _M(56)
        for i in range(size - 1):
            has = count[few] > i
            short[has] += w[at[has] + i] * factor[i]
        h, owner = np.concatenate([h, short]), np.concatenate([owner, few])
    return owner, mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, times) of each text's distinct shingles, by text and hash."""
    owner, h = shingles(data, offsets, size)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))
