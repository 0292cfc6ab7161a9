"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. Each distinct blob is scanned once, and only with
the rule versions that the ledger does not hold for it; findings are then joined back to all paths of the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; those whose `group` is shorter than `least` are dropped.

    Texts (lowered) without any of `needs` hold no match and are not searched. `spans` finds the same matches where the
    pattern itself would search a long run once for each of its characters; every rule is linear in the text.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    spans: Callable[[str], Iterator[tuple[int, int]]] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_LOGIN, _SCHEME = re.compile(r"://[^\s/:@]+:[^\s/@]+@"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_RUN = re.compile(r"[A-Za-z0-9_-]+")


def url_logins(text: str) -> Iterator[tuple[int, int]]:
    """A scheme's characters run back from '://' and stop at any other, so no two schemes share one; it starts at its first letter."""
    for m in _LOGIN.finditer(text):
        at = m.start()
        while at and text[at - 1] in _SCHEME:
            at -= 1
        while at < m.start() and not "a" <= text[at] <= "z":
            at += 1
        if at < m.start():
            yield at, m.end()


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three whole runs joined by dots, the first from its first 'eyJ' that eight characters follow."""
    runs = [m.span() for m in _RUN.finditer(text)]
    i = 0
    while i + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[i : i + 3]
        at = text.find("eyJ", a, b)
        if 0 <= at <= b - 11 and c == b + 1 and text[b] == "." and d - c >= 8 and e == d + 1 and text[d] == "." and f - e >= 8:
            yield at, f
            i += 3
        else:
            i += 1


BASE_KINDS = ("assign", "access", "hex")
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs=("akia",)),  # runs are matched whole, so the length can stand in the pattern
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", needs=("private key-----",)),
    Rule("json_web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",), spans=web_tokens),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", needs=("://",), spans=url_logins),
)
_SPANS = "array<struct<kind: string, start: int, end: int>>"
#: A ledger's spans name the rule and version that found them.
_HELD = "array<struct<rule: string, kind: string, start: int, end: int>>"
_HELD_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int, str]]:
    """(start, rule's place, end, kind), in code points, end exclusive, sorted."""
    lowered, found = text.lower(), []
    for i, r in enumerate(rules):
        if r.needs and not any(x in lowered for x in r.needs):
            continue
        if r.spans:
            found += [(a, i, b, r.kind) for a, b in r.spans(text)]
            continue
        for m in re.finditer(r.pattern, text):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), i, m.end(), r.kind))
    return sorted(found)


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("_text"))):
            spans, names = [], []
            for text, seen in zip(batch.column("_text").to_pylist(), batch.column("_seen").to_pylist(), strict=True):
                todo = tuple(r for r in rules if r.name not in set(seen or ()))
                spans.append([{"rule": todo[i].name, "kind": k, "start": a, "end": b} for a, i, b, k in find(text, todo)])
                names.append([r.name for r in todo])
            yield pa.record_batch([batch.column("blob"), pa.array(names, pa.list_(pa.string())), pa.array(spans, _HELD_TYPE)], names=["blob", "rules", "spans"])

    return run


def address(text: Column) -> Column:
    """The blob's address; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules array<string>, spans) for the blob and rule-version pairs that the ledger lacks.

    versions: any number of versions of any paths; ledger: earlier results of this function, unioned.
    """
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is None:
        blobs = blobs.withColumn("_seen", F.lit(None).cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
        names = F.array(*[F.lit(r.name) for r in rules])
        blobs = blobs.join(seen, "blob", "left").where(F.col("_seen").isNull() | (F.size(F.array_except(names, F.col("_seen"))) > 0))
    return blobs.mapInArrow(_scan(rules), f"blob binary, rules array<string>, spans {_HELD}")


def findings(versions: DataFrame, ledger: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of versions: key, blob and spans (by start, then the rules' order), of exactly the given rule versions.

    What other versions of a rule found stays in the ledger and is left out. The ledger may hold several rows of a blob,
    as a union of scan_new's results does, and a rule's spans more than once.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    asked = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    held = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(asked))).alias("spans"))
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["rule"]).alias("rule"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(placed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    own = versions.select(F.col(key).alias("_key"), address(F.col(text)).alias("blob"))
    return own.join(held.select("blob", spans.alias("spans")), "blob", "left").select(F.col("_key").alias(key), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def merge_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """One ledger row per blob, with every rule version's spans, by start and rule."""
    both = old.unionByName(new).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return both.withColumn("spans", F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(a["end"] - b["end"])))


def scan(versions: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all rules on all rows, from an empty ledger: key, blob, spans.

    Null text is the empty blob and, like any text without secrets, has no spans. Null and repeated keys give a row for
    each row; equal texts share one scan; an empty table gives no rows.
    """
    return findings(versions, scan_new(versions, text=text, rules=rules), key=key, text=text, rules=rules)
