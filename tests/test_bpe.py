"""Token counts against a plain merge loop and against the library that the rank file is made for."""

import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.functions import bpe
from tidemark.plans import registry

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def rank():
    return bpe.ranks(PATH)


def plain(piece, rank):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_the_plain_loop(rank):
    rng = random.Random(2)
    for _ in range(3000):
        piece = "".join(rng.choice("aetinos éß日 x") for _ in range(rng.randint(0, 24))).encode()
        assert bpe.merged(piece, rank) == plain(piece, rank)
    small = {bytes([c]): c for c in b"ab"} | {b"ab": 300, b"ba": 301, b"aa": 302, b"abab": 303}
    for _ in range(2000):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 15)))
        assert bpe.merged(piece, small) == plain(piece, small)


def test_a_long_piece_is_quick(rank):
    assert sum(map(len, bpe.merged(b"abcd" * 50_000, rank))) == 200_000


def test_counts_against_the_library(spark, sf, rank):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r["source"]] = want.get(r["source"], 0) + len(library.encode_ordinary(r["text"] or ""))
    assert {r["source"]: r["tokens"] for r in registry.queries()["xp7b_token_counts"](spark, sf).collect()} == want


def test_nulls_and_empty_texts(spark):
    docs = spark.createDataFrame([("a", None), ("a", ""), (None, "two words"), (None, "two words"), ("b", "x")], "source string, text string")
    got = {r["source"]: (r["pieces"], r["tokens"]) for r in bpe.token_counts(docs, "source", PATH, public_tokenizers.PATTERN).collect()}
    assert got == {"a": (0, 0), None: (4, 4), "b": (1, 1)}
    assert bpe.token_counts(docs.limit(0), "source", PATH, public_tokenizers.PATTERN).collect() == []
