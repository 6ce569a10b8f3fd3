"""License scans by patience alignment.

A template is aligned to a stretch of text by patience: words that occur once
in both are anchors, the longest increasing subsequence of anchors is kept,
and the gaps between neighbouring anchors are aligned the same way (equal ends
are matched first).  A gap without anchors is matched by its longest common
subsequence.  Coverage is the share of the template's words that are matched.

A long text is scanned in windows of three template lengths, one length apart,
so a word counts as unique within a window and a second copy of a license does
not hide the first; every stretch of up to two lengths (``density`` allows no
longer match) lies in some window.  Windows that do not hold enough template
words to reach the coverage are skipped; that loses nothing, as a match needs
those words.  A find is aligned once more from its end, which moves its start
behind stray words.  Of overlapping finds the best covered one stays.

Edge cases: null, empty and word-less texts and templates match nothing; ties
in coverage go to the denser, then the earlier find; repeated rows each give
their finds; a null ``doc_id`` is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
DENSITY = 0.5

# License notices (public texts).
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
}

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _increasing(seconds: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(seconds)
    for i, v in enumerate(seconds):
        at = bisect_left(tops, v)
        back[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    right = np.array([ids[w] for w in b])
    for i in range(len(a) - 1, -1, -1):
        row = np.where(right == ids[a[i]], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places ``(template word, text word)`` of a patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        ours, theirs = Counter(a[i:k]), Counter(b[j:m])
        at = {w: y for y, w in enumerate(b[j:m], j) if theirs[w] == 1}
        pairs = [(x, at[w]) for x, w in enumerate(a[i:k], i) if ours[w] == 1 and w in at]
        if not pairs:
            out += [(i + x, j + y) for x, y in _common(a[i:k], b[j:m])]
            continue
        anchors = [pairs[p] for p in _increasing([y for _, y in pairs])]
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (k, m)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def tightest(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """``(matched, first, end)`` of the alignment, with the later start that an
    alignment from the end finds if it matches as much."""
    pairs = align(a, b)
    if not pairs:
        return 0, 0, 0
    first, end = pairs[0][1], pairs[-1][1] + 1
    back = align(a[::-1], b[first:end][::-1])
    if len(back) >= len(pairs):
        return len(back), end - 1 - back[-1][1], end - back[0][1]
    return len(pairs), first, end


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, density: float):
        self.templates = [(n, w) for n, w in ((n, words(t)) for n, t in sorted(templates.items())) if w]
        self.vocabulary = frozenset(w for _, t in self.templates for w in t)
        self.coverage, self.density = coverage, density

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """``(template, coverage, start word, end word, matched words)``."""
        found: list[tuple[str, float, int, int, int]] = []
        tokens = words(text)
        have = self.vocabulary.intersection(tokens)
        array = None
        for name, template in self.templates:
            need = int(np.ceil(self.coverage * len(template) - 1e-9))
            if sum(w in have for w in template) < need:
                continue
            if array is None:
                ids = {w: i for i, w in enumerate(self.vocabulary)}
                array = np.array([ids.get(w, -1) for w in tokens], np.int64)
            own = np.unique([ids[w] for w in template])
            upto = np.concatenate(([0], np.cumsum(np.isin(array, own))))
            width, step = 3 * len(template), len(template)
            starts = np.arange(0, max(1, len(tokens) - width + step), step)
            held = upto[np.minimum(starts + width, len(tokens))] - upto[starts]
            ranked = []
            parts = [(at, min(at + width, len(tokens))) for at in starts[held >= need].tolist()]
            while parts:
                lo, hi = parts.pop()
                if upto[hi] - upto[lo] < need:
                    continue
                matched, first, last = tightest(template, tokens[lo:hi])
                if matched >= need and matched >= self.density * (last - first):
                    ranked.append((-matched, last - first, lo + first, lo + last))
                    parts += [(lo, lo + first), (lo + last, hi)]  # further copies in the same window
            taken: list[tuple[int, int]] = []
            for matched, _, first, last in sorted(set(ranked)):
                if all(last <= s or first >= e for s, e in taken):
                    taken.append((first, last))
                    found.append((name, -matched / len(template), first, last, -matched))
        return sorted(found, key=lambda f: (f[2], f[3], f[0]))


SCHEMA = "doc_id long, template string, coverage double, start_word int, end_word int, matched int"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per license found in ``docs(doc_id, text)``."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage, density)
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *f) for i, t in zip(batch.column(0), batch.column(1)) for f in scanner.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
