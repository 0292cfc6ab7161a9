"""Text functions that Spark lacks, as Arrow-batched functions, and SQL-side normalisers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Names of Greek letters in search terms.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def loose(c: Column) -> Column:
    """Greek letters by name, and dashes and spaces as one hyphen, so that spellings compare equal."""
    for letter, name in GREEK.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return F.regexp_replace(c, r"[\s\p{Pd}−]+", "-")


def counted(terms: str) -> Column:
    """array<struct<term, n, docs>> of a document's terms: a use of each, and one more row for each distinct one. Summed by term they are uses and documents."""
    use = lambda n, docs: lambda t: F.struct(t.alias("term"), F.lit(n).cast("long").alias("n"), F.lit(docs).cast("long").alias("docs"))
    return F.concat(F.transform(terms, use(1, 0)), F.transform(F.array_distinct(terms), use(0, 1)))


def contains_all(text: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & text.rlike(rf"(?:^|[^A-Za-z0-9_]){w}")
    return out


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())


def fold(text: Column) -> Column:
    """Lower-case ASCII without accents."""
    return F.pandas_udf(_fold, "string")(text)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (lengths), by the bit-parallel longest common subsequence."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def indel_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64"), "double")(a, b)


def _token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(" ".join(sorted(x.lower().split())), " ".join(sorted(y.lower().split()))) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """indel_ratio of the texts with their words sorted."""
    return F.pandas_udf(_token_sort_ratio, "double")(a, b)


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s*```\w*\s*", ""), r"\s*```\s*$", "")


def listed_places(reply: Column, n: int) -> Column:
    """array<bigint>: the places 1 to n that a reply lists, each once, in its order.

    Of a JSON array its whole-number elements (also as strings), of a JSON object those of its first array, of any other
    text all numbers. Built-in functions only.
    """
    body = unfenced(reply)
    first = F.get(F.filter(F.map_values(F.from_json(body, "map<string,string>")), lambda v: F.startswith(v, F.lit("["))), F.lit(0))
    inner = F.when(F.ltrim(body).startswith("["), body).when(F.ltrim(body).startswith("{"), F.coalesce(first, F.lit("[]")))
    whole = F.filter(F.coalesce(F.from_json(inner, "array<string>"), F.array(body)), lambda x: x.rlike(r"^\s*\d+\s*$"))
    words = F.when(F.try_parse_json(body).isNotNull(), whole).otherwise(F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(words, lambda x: F.trim(x).try_cast("bigint")), lambda x: x.between(1, n)))


def reply_grades(reply: Column) -> Column:
    """map<string,int>: the grades 0 to 2 that a reply gives to what it was shown as A, B, ...

    The reply is a JSON object, fenced or not, or holds one between other words; a value is a grade or an object with
    one; names such as `Abstract_B` are read as B. What is no grade is left out. Built-in functions only.
    """
    body = unfenced(reply)
    object_ = F.when(F.try_parse_json(body).isNotNull(), F.when(F.ltrim(body).startswith("{"), body)).otherwise(F.regexp_extract(body, r"(?s)\{.*\}", 0))
    given = F.from_json(F.when(F.try_parse_json(object_).isNotNull(), object_), "map<string,string>")
    shown = lambda k: F.upper(F.regexp_replace(F.regexp_replace(k, r"(?i)^[\W_]*(abstract[\W_]*)?", ""), r"[\W_]+$", ""))
    grade = lambda v: F.when(F.startswith(v, F.lit("{")), F.get_json_object(v, "$.grade")).otherwise(v)
    read = F.transform(F.map_entries(given), lambda e: F.struct(shown(e["key"]).alias("key"), grade(e["value"]).alias("value")))
    kept = F.filter(read, lambda e: e["key"].rlike("^[A-Z]$") & e["value"].isin("0", "1", "2"))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"].cast("int"))))
