"""Words and word pairs counted in arrays against regular expressions and plain counts."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.operators import phrases, ranking
from tidemark.plans import registry


def split(text):
    return [re.findall(r"\b[a-z][a-z0-9-]+\b", p, re.A) for p in re.split(r"[^\w \t\n\f\r'-]+", text, flags=re.A)]


def odd(rng, n):
    return ["".join(rng.choice(["a", "bc", "-", "_", " ", "1", "'", ".", "é", "the", "zed", "\n", "\x0b", "\t", "9z", "--"]) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a", "-", "ab", "ab-", "_ab"]


def test_words_are_those_of_the_regular_expressions():
    texts = odd(random.Random(0), 3000)
    got = {}
    tokens, rows, numbers = phrases.words(pa.array(["cut off", *texts]).slice(1))
    for w, row, phrase in zip(tokens.to_pylist(), rows.tolist(), numbers.tolist(), strict=True):
        got.setdefault(row, {}).setdefault(phrase, []).append(w)
    assert [list(got.get(i, {}).values()) for i in range(len(texts))] == [[p for p in split(t) if p] for t in texts]
    assert len(phrases.words(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_counts_by_class(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "CHUNK", 200)
    monkeypatch.setattr(phrases, "BITS", bits)
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), t) for t in odd(rng, 400)] + [("x", None), ("new", "zed bc")]
    got = {(r["class"], r["term"]): (r["n"], r["tt"]) for r in phrases.counts(spark.createDataFrame(rows, "class string, text string").repartition(3), 5).collect()}
    n, tt, docs = Counter(), Counter(), Counter()
    for c, t in rows:
        terms = [x for p in split(t or "") for x in [*(w for w in p if w not in ranking.STOP_WORDS), *(f"{a} {b}" for a, b in zip(p, p[1:]) if not {a, b} & set(ranking.STOP_WORDS))]]
        n.update((c, x) for x in terms)
        tt.update(terms)
        docs.update(set(terms))
    assert got == {(c, x): (k, tt[x]) for (c, x), k in n.items() if docs[x] >= 5} and any(" " in x for _, x in got)
    assert phrases.counts(spark.createDataFrame([], "class string, text string"), 3).collect() == []


def test_no_use_of_a_term_is_a_row(spark, sf, monkeypatch):
    """Each word and pair of each document was a row, split by interpreted regular expressions (F3, mp1_ctfidf)."""
    frame, plans = type(spark.range(1)), []
    kept = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower()) or kept(df, *a))
    assert registry.queries()["mp1_ctfidf"](spark, sf).count() > 0
    assert plans and not any("regexp_extract_all" in p for p in plans)
