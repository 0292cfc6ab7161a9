"""The similarity join of titles against all pairs."""

import random

import pytest

from tidemark.functions.text import indel_ratio
from tidemark.operators import fuzzy


def folded(t):
    return " ".join(sorted((t or "").lower().split()))


def check(spark, titles, least=90):
    rows = spark.createDataFrame(list(enumerate(titles)), "k long, title string")
    texts = [folded(t) for t in titles]
    want = {}
    for i, a in enumerate(texts):
        near = [indel_ratio(a, b) for j, b in enumerate(texts) if i != j and a and b and 2 * min(len(a), len(b)) * 100 >= least * (len(a) + len(b))]
        near = [r for r in near if r >= least]
        want[i] = (len(near), max(near, default=None))
    got = {r["k"]: (r["n_links"], r["best_ratio"]) for r in fuzzy.links(rows, "k", "title", least).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == (want[i][1] and pytest.approx(want[i][1])) for i in want)
    return want


def test_titles_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(700)]
    for t in titles[:300]:  # edited copies
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "X", " "])
        titles.append("".join(t))
    want = check(spark, [*titles, None, "", "  ", titles[0], titles[0].upper()])
    assert sum(n > 0 for n, _ in want.values()) > 200


@pytest.mark.parametrize("least", [60, 80, 100])
def test_other_ratios_and_short_titles(spark, least):
    rng = random.Random(least)
    check(spark, ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) for _ in range(150)], least)


def test_empty_table(spark):
    assert fuzzy.links(spark.createDataFrame([], "k long, title string"), "k", "title").collect() == []
