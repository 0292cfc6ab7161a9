"""Licence scan: normalised passages against templates by the Dice coefficient of their word bigrams.

Dice >= t needs sizes within a factor of (2 - t) / t, so templates are kept by size and only those in range are
compared. Passages are the whole text, its blocks between blank lines, its single lines, windows of words within a line
as long as a template, and the runs of adjacent lines that come nearest to a template. How many distinct bigrams a
window holds follows from each bigram's previous place, so all windows of a length take one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

THRESHOLD = 0.8
# Licence notices as published, each with its identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("proprietary", "All rights reserved."),
)
_WORD = re.compile(r"[^\W_]+")
_OWNER = re.compile(r"(?i)\W*(?:copyright|\(c\)|©)")
_YEAR = re.compile(r"\d{4}")


def owner(line: str) -> bool:
    """Whether a line names a copyright owner and a year. Linear in the line, like all that follows."""
    m = _OWNER.match(line)
    return bool(m and _YEAR.search(line, m.end()))


def bigrams(passage: str) -> frozenset[tuple[str, str]]:
    w = _WORD.findall(passage.lower())
    return frozenset(zip(w, w[1:]))


#: Words that a paragraph of a licence needs to be a template of its own.
LEAST_WORDS = 12


@cache
def licences() -> tuple[tuple[str, str], ...]:
    """The full texts beside this module, and their paragraphs that stand in one licence only."""
    full = [(p.stem, p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("licences").glob("*.txt"))]
    parts = {(name, bigrams(part)): part for name, text in full for part in re.split(r"\n\s*\n", text) if len(_WORD.findall(part)) >= LEAST_WORDS}
    names: dict[frozenset, set[str]] = {}
    for name, grams in parts:
        names.setdefault(grams, set()).add(name)
    return (*full, *[(name, part) for (name, grams), part in parts.items() if len(names[grams]) == 1])


class _Words:
    """A text's words in one row: where each bigram stood before, and which line a word is of."""

    def __init__(self, text: list[list[str]], index: dict):
        self.lines = len(text)
        counts = np.array([len(w) for w in text], np.int64)
        self.line = np.repeat(np.arange(self.lines), counts)
        self.rows = np.flatnonzero(counts)  # lines with words
        self.start = np.concatenate([[0], np.cumsum(counts)])  # of each line, and the end
        flat = [w for words in text for w in words]
        pairs, numbers = list(zip(flat, flat[1:])), {}
        ids = np.array([numbers.setdefault(g, len(numbers)) for g in pairs], np.int64)
        self.names = [g for g in numbers if g in index]
        places, order = np.arange(len(ids)), np.argsort(ids, kind="stable")
        same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
        self.before = np.full(len(ids), -1)
        self.before[order[same + 1]] = order[same]
        self.templates: dict[int, list[int]] = {}
        for g in self.names:
            for t in index[g]:
                self.templates.setdefault(t, []).append(numbers[g])
        self.ids, self.places = ids, places

    def of(self, index: dict, t: int) -> np.ndarray:
        """Which places hold a bigram of template t."""
        own = np.zeros(int(self.ids.max(initial=-1)) + 1, bool)
        own[self.templates.get(t, [])] = True
        return own[self.ids]

    def distinct(self, length: int, only: np.ndarray | None = None) -> np.ndarray:
        """Distinct bigrams in each window of `length` places: a place counts where the bigram's place before lies outside."""
        n = len(self.before) - length + 1
        p = self.places if only is None else np.flatnonzero(only)
        a = np.maximum(np.maximum(self.before[p] + 1, p - length + 1), 0)
        ok = a < np.minimum(p + 1, n)
        steps = np.bincount(a[ok], minlength=n + 1) - np.bincount(np.minimum(p[ok] + 1, n), minlength=n + 1)
        return np.cumsum(steps)[:n]

    def final(self, own: np.ndarray) -> np.ndarray:
        """For a start at each place, where the last of the bigrams in `own` that follow first appears; -1 if none does."""
        out = np.full(len(own), -1)
        for p in np.flatnonzero(own).tolist():
            out[self.before[p] + 1 : p + 1] = p
        return out


@dataclass
class Matcher:
    templates: tuple[tuple[str, str], ...] = field(default_factory=lambda: TEMPLATES + licences())
    threshold: float = THRESHOLD
    sizes: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    index: dict = field(default_factory=dict)

    def __post_init__(self):
        for t, (_, text) in enumerate(self.templates):
            grams = bigrams(text)
            self.sizes.append(len(grams))
            self.words.append(len(_WORD.findall(text)))
            for g in grams:
                self.index.setdefault(g, []).append(t)
        self.factor = (2 - self.threshold) / self.threshold
        self.grams = frozenset(self.index)
        self.most_words = max(self.sizes, default=0) * self.factor + 1

    def best(self, passage: str) -> tuple[float, int] | None:
        """(Dice, -template) of the nearest template at or over the threshold; the earliest of equals."""
        words = _WORD.findall(passage.lower())
        grams = set(zip(words, words[1:]))
        n, shared = len(grams), {}
        low, high = n / self.factor, n * self.factor
        if n > max(self.sizes, default=0) * self.factor or n < min(self.sizes, default=1) / self.factor:
            return None
        for g in grams:
            for t in self.index.get(g, ()):
                if low <= self.sizes[t] <= high:
                    shared[t] = shared.get(t, 0) + 1
        found = max(((2 * c / (n + self.sizes[t]), -t) for t, c in shared.items()), default=None)
        return found if found and found[0] >= self.threshold else None

    def scan(self, text: str) -> list[tuple[str, float, str, int, int]]:
        """(licence, Dice, unit, first line, lines) of the matching passages: lines, blocks of several lines, the whole text, then runs of lines that are nearer than what they overlap."""
        lines = text.split("\n")
        owned = [owner(line) for line in lines]
        found, blocks, begin = [], [], 0
        for i, line in enumerate([*lines, ""]):
            if not line.strip():
                if i - begin > 1:
                    blocks.append(("block", begin, i - begin))
                begin = i + 1
        units = [("line", i, 1) for i in range(len(lines))] + blocks
        if len(lines) > 1:
            units.append(("text", 0, len(lines)))
        for unit, at, n in units:
            passage = "\n".join(["" if o else x for x, o in zip(lines[at : at + n], owned[at : at + n], strict=True)]) if n > 1 else lines[at]
            if not passage or passage.count(" ") + passage.count("\n") > 4 * self.most_words:
                if not self._small(passage):
                    continue
            if hit := self.best(passage):
                found.append((self.templates[-hit[1]][0], hit[0], unit, at, n))
        words = _Words([[] if o else _WORD.findall(line.lower()) for line, o in zip(lines, owned, strict=True)], self.index)
        near = self._near(words)
        whole = list(found)  # a notice within a line does not stand for the run that begins with it
        near_by: list[tuple[int, int]] = []  # places of the windows named so far, none over another
        best = np.zeros(len(lines))
        for _, d, _, at, n in found:
            best[at : at + n] = np.maximum(best[at : at + n], d)
        for dice, t, at in sorted((w for t in near for w in self._windows(words, t)), key=lambda x: (-x[0], x[1], x[2])):
            line, span = int(words.line[at]), (at, at + self.words[t])
            k = bisect_left(near_by, span)
            if best[line] < dice and (k == 0 or near_by[k - 1][1] <= at) and (k == len(near_by) or near_by[k][0] >= span[1]):
                near_by.insert(k, span)
                found.append((self.templates[t][0], dice, "words", line, 1))
        for dice, t, at, n in self._runs(words, near, [x[3:] for x in whole if x[1] == 1.0]):
            if not any(d >= dice and a < at + n and at < a + m for _, d, _, a, m in whole):
                whole.append((self.templates[t][0], dice, "run", at, n))
                found.append(whole[-1])
        return found

    def _near(self, words: _Words) -> list[int]:
        """The templates of which the whole text has the threshold / 2 * (1 + 1 / factor) of bigrams that Dice needs."""
        shared: dict[int, int] = {}
        for g in words.names:
            for t in self.index[g]:
                shared[t] = shared.get(t, 0) + 1
        need = self.threshold / 2 * (1 + 1 / self.factor)
        return sorted(t for t, c in shared.items() if c >= need * self.sizes[t])

    def _windows(self, words: _Words, t: int) -> list[tuple[float, int, int]]:
        """(Dice, template, first word) of the windows of the template's length within a line, best first, that overlap no better one; the earlier leads among equals."""
        length = self.words[t] - 1
        n = len(words.before) - length + 1
        if n <= 0 or length <= 0:
            return []
        inside = words.line[:n] == words.line[length : length + n]  # the window's first and last word
        if not inside.any():
            return []
        both = words.distinct(length, words.of(self.index, t))[inside]
        dice = 2 * both / (words.distinct(length)[inside] + self.sizes[t])
        hits = np.flatnonzero(dice >= self.threshold)
        places = np.flatnonzero(inside)[hits]
        out, taken = [], []
        for i in np.lexsort((places, -dice[hits])).tolist():
            at = int(places[i])
            k = bisect_left(taken, at)
            if (k == 0 or at - taken[k - 1] > length) and (k == len(taken) or taken[k] - at > length):
                taken.insert(k, at)
                out.append((float(dice[hits[i]]), t, at))
        return out

    def _runs(self, words: _Words, near: list[int], exact: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
        """(Dice, template, first line, lines) of the best run from each line, best first; longer, then earlier ones lead among equals.

        Runs stay between the lines that a passage equal to a template covers (`exact`), as no run over these can be
        nearer. A run from a line with one of the template's bigrams ends at the latest where the last of them first
        appears, or where it has more distinct bigrams than the template allows.
        """
        covered = np.zeros(words.lines + 1, np.int64)
        for at, n in exact:
            covered[at] += 1
            covered[at + n] -= 1
        closed = np.cumsum(covered)[:-1] > 0
        rows = words.rows[~closed[words.rows]]
        if len(rows) < 2:
            return []
        found = []
        piece = np.searchsorted(np.flatnonzero(closed), rows)  # runs stay between covered lines
        first, last = words.start[rows], words.start[rows + 1] - 2  # the bigrams within a line; last + 1 leads into the next
        for t in near:
            own = words.of(self.index, t)
            held = np.concatenate([[0], np.cumsum(own)])
            final, most = words.final(own), int(self.sizes[t] * self.factor)
            for k in np.flatnonzero(held[np.minimum(last + 2, len(own))] > held[np.minimum(first, len(own))]).tolist():
                end = k + int(np.searchsorted(piece[k:], piece[k], "right")) - 1
                a = int(first[k])
                stop, step, distinct, both = min(int(last[end]), int(final[a])), 256, [], []
                if end == k or stop < a:
                    continue
                d = s = 0
                at = a
                while at <= stop and d <= most:
                    to = min(stop + 1, at + step)
                    new = words.before[at:to] < a
                    distinct.append(d + np.cumsum(new))
                    both.append(s + np.cumsum(new & own[at:to]))
                    d, s, at, step = int(distinct[-1][-1]), int(both[-1][-1]), to, 2 * step
                d, s = np.concatenate(distinct), np.concatenate(both)
                # lines that end here, and the first that ends beyond the last bigram that counts
                ends = last[k + 1 : end + 1] - a
                n = int(np.searchsorted(ends, len(d) - 1, "right"))
                whole = ends[:n]
                dice = np.where((whole >= 0) & (d[whole] <= most), 2 * s[whole] / (d[whole] + self.sizes[t]), 0.0)
                if n < len(ends) and at > stop:
                    more = d[-1] + int((words.before[a + len(d) : a + int(ends[n]) + 1] < a).sum())
                    dice = np.append(dice, 2 * s[-1] / (more + self.sizes[t]) if more <= most else 0.0)
                if len(dice) and dice.max() >= self.threshold:
                    j = k + 1 + int(dice.argmax())
                    found.append((float(dice.max()), t, int(rows[k]), int(rows[j] - rows[k]) + 1))
        return sorted(found, key=lambda x: (-x[0], -x[3], x[1], x[2]))

    def _small(self, passage: str) -> bool:
        """Whether a passage of many separators still has few enough distinct bigrams for some template."""
        return bool(passage) and len(bigrams(passage)) <= self.most_words


_TYPE = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("line", pa.int32()), ("lines", pa.int32())]))
_DDL = "array<struct<license: string, dice: double, unit: string, line: int, lines: int>>"


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key and matches, an array of (license, dice, unit, line, lines) in order of place.

    Without templates, those of this module and licences() are used. Passages are lowered and reduced to letters and digits; lines of copyright owners are left out of longer passages.
    Null and empty texts match nothing; ties go to the earlier template; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(TEMPLATES + licences() if templates is None else templates, threshold)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [[dict(zip(("license", "dice", "unit", "line", "lines"), x, strict=True)) for x in matcher.scan(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, _TYPE)], names=["_key", "matches"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, matches {_DDL}").withColumnRenamed("_key", key)
