"""The Snowball stemmer of English, as Arrow-batched function and as DuckDB SQL, both made from the same tables of endings."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

# Endings and exceptions of the published algorithm (snowballstem.org), of each step the longest that fits.
# An ending stands with what replaces it; REGION is where it must lie, BEFORE what must precede it.
FIRST_REGION = ("gener", "commun", "arsen")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = {e: "" for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")}
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}
IN_R2 = ("ative",)
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end; Y is a y that counts as a consonant.
SHORT = rf"(?:^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$"
REGION = rf"^.*?{VOWEL}{OTHER}"


def _longest(endings) -> list[str]:
    return sorted(endings, key=lambda e: (-len(e), e))


#: Endings of each step in the order of search; a word with none of MOVED and no apostrophe is its own stem.
STEPS = [(tuple(_longest(t)), t) for t in (STEP_2, STEP_3, STEP_4)]
MOVED = tuple({"s", "ed", "ing", "y", "e", "ll", *STEP_2, *STEP_3, *STEP_4})
_REGION, _SHORT, _VOWEL = re.compile(REGION, re.S), re.compile(SHORT), re.compile(VOWEL)


def _after(word: str, start: int) -> int:
    m = _REGION.match(word[start:])
    return start + m.end() if m else len(word)


def _replaced(w: str, endings: tuple[str, ...], table: dict[str, str], r1: int, r2: int, all_in_r2: bool = False) -> str:
    if not w.endswith(endings):
        return w
    for e in endings:
        if w.endswith(e):
            at = len(w) - len(e)
            ok = at >= (r2 if all_in_r2 or e in IN_R2 else r1) and (e not in BEFORE or w[at - 1 : at] in BEFORE[e] and at > 0)
            return w[:at] + table[e] if ok else w
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    if not word.endswith(MOVED) and "'" not in word:
        return word
    w = word.removeprefix("'")
    w = re.sub(f"(^|{VOWEL})y", r"\1Y", w) if "y" in w else w
    prefix = next((p for p in FIRST_REGION if w.startswith(p)), "")
    r1 = len(prefix) or _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub("'s?'?$", "", w) if "'" in w else w
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    # 1c
    w = re.sub(f"(?<=.{OTHER})[yY]$", "i", w) if w.endswith(("y", "Y")) else w
    for step, (endings, table) in enumerate(STEPS):
        w = _replaced(w, endings, table, r1, r2, step == 2)
    # 5
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column) -> Column:
    """The stems of an array of lower-cased words, in their order."""
    return F.pandas_udf(lambda column: column.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws]), "array<string>")(words)


def _case(table: dict[str, str], all_in_r2: bool = False) -> str:
    """w after a step, in SQL: the longest ending decides, whether it is replaced or not."""
    out = []
    for e in _longest(table):
        at = f"length(w) - {len(e)}"
        ok = f"{at} >= {'r2' if all_in_r2 or e in IN_R2 else 'r1'}" + (f" AND regexp_matches(w, '[{BEFORE[e]}]{e}$')" if e in BEFORE else "")
        out.append(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {ok} THEN left(w, {at}) || '{table[e]}' ELSE w END")
    return "CASE " + " ".join(out) + " ELSE w END"


def stem_sql(words: str, name: str = "st") -> str:
    """CTEs that end in `name` (form, stem), for DuckDB, of a relation's column `form` of words without apostrophes."""
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in WHOLE.items())
    prefix = " ".join(f"WHEN starts_with(w, '{p}') THEN {len(p)}" for p in FIRST_REGION)
    region = rf"length(regexp_extract(substr(w, {{}} + 1), '{REGION}'))"
    keep = "form, r1, r2"
    stop = "[" + ", ".join(f"'{x}'" for x in AFTER_1A) + "]"
    cut = lambda e: f"left(w, -{len(e)})"
    ends = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN regexp_matches({cut(e)}, '{VOWEL}') THEN {cut(e)} END" for e in ("ingly", "edly", "ing", "ed"))
    return f"""x1 AS (SELECT DISTINCT form, regexp_replace(form, '(^|{VOWEL})y', '\\1Y', 'g') AS w FROM {words}),
x2 AS (SELECT form, w, CASE {prefix} WHEN {region.format(0)} > 0 THEN {region.format(0)} ELSE length(w) END AS r1 FROM x1),
x3 AS (SELECT form, w, r1, CASE WHEN {region.format('r1')} > 0 THEN r1 + {region.format('r1')} ELSE length(w) END AS r2 FROM x2),
x4 AS (SELECT {keep}, CASE WHEN ends_with(w, 'sses') THEN left(w, -2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'ss') AND regexp_matches(left(w, -2), '{VOWEL}') THEN left(w, -1) ELSE w END AS w FROM x3),
x5 AS (SELECT {keep}, w, w AS u, CASE WHEN ends_with(w, 'eedly') OR ends_with(w, 'eed') THEN NULL {ends} END AS t FROM x4),
x6 AS (SELECT {keep}, u, CASE WHEN ends_with(w, 'eedly') THEN CASE WHEN length(w) - 5 >= r1 THEN left(w, -3) ELSE w END WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= r1 THEN left(w, -1) ELSE w END
  WHEN t IS NULL THEN w WHEN regexp_matches(t, '(at|bl|iz)$') THEN t || 'e' WHEN regexp_matches(t, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(t, -1) WHEN length(t) <= r1 AND regexp_matches(t, '{SHORT}') THEN t || 'e' ELSE t END AS w FROM x5),
x7 AS (SELECT {keep}, u, CASE WHEN regexp_matches(w, '.{OTHER}[yY]$') THEN left(w, -1) || 'i' ELSE w END AS w FROM x6),
x8 AS (SELECT {keep}, u, {_case(STEP_2)} AS w FROM x7), x9 AS (SELECT {keep}, u, {_case(STEP_3)} AS w FROM x8), x10 AS (SELECT {keep}, u, {_case(STEP_4, True)} AS w FROM x9),
x11 AS (SELECT form, u, CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, -1), '{SHORT}')) OR ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM x10),
{name} AS (SELECT form, CASE WHEN length(form) <= 2 THEN form WHEN e.k IS NOT NULL THEN e.v WHEN list_contains({stop}, u) THEN u ELSE replace(w, 'Y', 'y') END AS stem FROM x11 LEFT JOIN (VALUES {pairs}) e(k, v) ON e.k = form)"""
