"""Spans of phrases against searches by regular expressions, and the two ways of a dictionary against each other."""

import random
import re
import time

import pytest

from tidemark.operators import automaton, dictionary
from tidemark.operators.automaton import Marker, Phrase, marked
from tidemark.plans import registry

KINDS = ("d", "g")


def plain_spans(text, phrases):
    """All places of all phrases by regular expressions, abbreviations, then from the left."""
    bounded = lambda p, any_case: re.compile(rf"(?<![A-Za-z0-9])(?=((?i:{p})))" if any_case else rf"(?<![A-Za-z0-9])(?=({p}))")
    found = set()
    for x in phrases:
        for m in bounded(x.pattern().pattern, not x.cased).finditer(text):
            a, b = m.start(1), m.end(1)
            before = text[:a].rstrip()
            if not re.match("[A-Za-z0-9]", text[b : b + 1]) and not (x.inside and (not before or before[-1] in ".!?:")):
                found.add((a, b, x.kind, x.text))
    short = {}
    for a, b, k, _ in sorted(found, key=lambda s: (KINDS.index(s[2]), s[0])):
        m = re.compile(r"\s*\(([A-Z][A-Za-z0-9αβγδκ-]{1,11})\)").match(text, b)
        if m and re.search(r"[\s-]", text[a:b]) and sum(c.isupper() for c in m[1]) >= 2:
            short.setdefault(m[1], k)
    for s, k in short.items():
        found |= {(m.start(), m.end(), k, s) for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])", text)}
    out, free = [], 0
    for s in sorted(found, key=lambda s: (s[0], -s[1], KINDS.index(s[2]), s[3])):
        if s[0] >= free:
            out.append(s)
            free = s[1]
    return out


def test_hand_examples():
    m = Marker([Phrase("pulmonary fibrosis", "d"), Phrase("fibrosis", "d"), Phrase("TNF-alpha", "g"), Phrase("Cat", "g", True, True), Phrase("CAT", "g", True), Phrase("IPF", "g", True)], KINDS)
    of = lambda text: [(text[a:b], k) for a, b, k, _ in m.spans(text)]
    assert of("Pulmonary-fibrosis (IPF) and fibrosis; IPF again") == [("Pulmonary-fibrosis", "d"), ("IPF", "d"), ("fibrosis", "d"), ("IPF", "d")]
    assert of("TNFα, tnf alpha, TNF-ALPHA but TNF  alpha") == [("TNFα", "g"), ("tnf alpha", "g"), ("TNF-ALPHA", "g")]
    assert of("Cat models. Cat and a Cat, CAT, cat; concat") == [("Cat", "g"), ("CAT", "g")]
    assert m.spans("") == [] and Marker([], KINDS).spans("any text") == []


def test_random_texts_against_regular_expressions():
    rng = random.Random(3)
    parts = ["alpha", "beta", "β", "IL", "1", "il-1", "fibro", "sis", "lung", "(LF)", "(IPF)", "IPF", "LF", ".", ". ", " ", " ", "-", "\n", "İ", "α", "ß", ":", "Lung"]
    phrases = [Phrase("lung fibro", "d"), Phrase("lung", "d"), Phrase("IL-1 beta", "g"), Phrase("IL", "g", True), Phrase("fibro sis lung", "g"), Phrase("Lung", "g", True, True), Phrase("alpha", "d"), Phrase("1", "g"), Phrase("fibro-alpha", "d")]
    m = Marker(phrases, KINDS)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert m.spans(text) == plain_spans(text, phrases), text


def test_a_text_of_many_mentions_is_one_pass():
    m = Marker([Phrase("lung fibrosis", "d"), Phrase("lung", "g"), Phrase("fibrosis", "d", False, True)], KINDS)
    start = time.process_time()
    assert len(m.spans("lung fibrosis (LF) and LF. lung " * 100_000)) == 400_000
    assert time.process_time() - start < 40


def test_marked_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a lung fibrosis (LF), LF"), (1, "Lung"), (2, None), (None, "the lung"), (3, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([("lung fibrosis", "d", None, None), ("lung", "g", False, False), ("", "g", False, False), ("lung", "g", False, False)], "phrase string, kind string, cased boolean, inside boolean")
    want = [(1, 0, 4, "g", "lung"), (1, 2, 15, "d", "lung fibrosis"), (1, 17, 19, "d", "LF"), (1, 22, 24, "d", "LF"), (None, 4, 8, "g", "lung")]
    assert sorted(map(tuple, marked(docs, phrases, KINDS).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(automaton, "MOST", 8)  # a dictionary in parts
    assert sorted(map(tuple, marked(docs, phrases, KINDS).collect()), key=str) == sorted(want, key=str)
    assert marked(docs.limit(0), phrases, KINDS).collect() == [] and marked(docs, phrases.limit(0), KINDS).collect() == []


def test_the_query_against_regular_expressions(spark, sf):
    from tidemark.plans.text import names

    words = {r["name"] for r in names(spark, sf).select("name").distinct().collect()}
    some = [Phrase(w, "d" if " " in w else "g", False, " " not in w) for w in sorted(words)]
    got = {}
    for r in registry.queries()["fn19_longest_spans"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"], {"name": "d", "word": "g"}[r["kind"]], r["phrase"]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in [r for r in docs if len(r["text"] or "") < 3000][:60]:
        assert sorted(got.get(r["doc_id"], [])) == sorted(plain_spans(r["text"] or "", some))


@pytest.mark.parametrize("most", [0, 10**6])
def test_dictionary_hits_by_join_and_by_automaton(spark, most):
    docs = spark.createDataFrame([(1, "of the cat. The cat-fish of the_cat"), (1, "the cat"), (2, None), (3, "cat the cat the cat")], "doc_id long, text string")
    names = spark.createDataFrame([("the cat",), ("cat",), ("of the cat",), ("cat-fish",), ("cat the cat",), ("",)], "name string")
    hits = sorted((r["doc_id"], r["folded"]) for r in dictionary.hits(docs, names, most=most).collect())
    assert hits == [(1, "cat"), (1, "cat"), (1, "cat"), (1, "cat-fish"), (1, "of the cat"), (1, "the cat"), (1, "the cat"), (1, "the cat"), (3, "cat"), (3, "cat"), (3, "cat"), (3, "cat the cat"), (3, "cat the cat"), (3, "the cat"), (3, "the cat")]
    got = sorted((r["doc_id"], r["folded"]) for r in dictionary.mentions(docs, names, most=most).collect())
    assert got == [(1, "of the cat"), (1, "the cat"), (1, "the cat"), (3, "cat the cat"), (3, "the cat")]
