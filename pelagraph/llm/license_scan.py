"""License scans by patience alignment.

Text and template are words (runs of letters and digits, lower-cased). A template can only be covered to
the share c if its words that the text has at all make up c of it; texts that fail this go at once. In the
others, among any ``(1 - c) * length + 1`` words of the template one must be matched, so the places of its
rarest words in the text give every place where it can start. A match may drift from its start by a quarter of the template,
and two words, to either side; a start close to one before it has its window within that one's. A window is aligned: words unique to both
sides are anchors, the longest increasing subsequence of them is kept, the gaps between are aligned again,
and equal words at a gap's ends are matched; a gap without such words is aligned by a longest common subsequence.
The place itself, as long as the template, is aligned before the window around it, which may hold words of a
neighbouring copy. Coverage is the share of the template's words matched.

A match is reported with its characters' span in the text. Overlapping matches of several templates: the
one with more matched words stays (then higher coverage, then the name that sorts first, then the shorter span).

Defined results: null, empty and wordless texts have no match. Repeated rows are scanned each. A null id
stays null. Other columns are ignored. A text without match has no row in ``scan`` and an empty list in
``find``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagraph.llm import common as c

#: Share of a template to be covered, for templates under SHORT words and for others.
SHORT, COVER_SHORT, COVER = 20, 0.9, 0.75

# The templates, as their licences print them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of distinct values (patience sorting with back links)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = at[p - 1] if p else -1
        tops[p:p + 1] = [v]
        at[p:p + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and best[i][j]:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, at, end = todo.pop()
        while lo < hi and at < end and a[lo] == b[at]:
            out.append((lo, at))
            lo, at = lo + 1, at + 1
        while lo < hi and at < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            out.append((hi, end))
        if lo >= hi or at >= end:
            continue
        ca, cb = Counter(a[lo:hi]), Counter(b[at:end])
        place = {a[i]: i for i in range(lo, hi) if ca[a[i]] == 1 and cb[a[i]] == 1}
        unique = [(place[b[j]], j) for j in range(at, end) if b[j] in place]
        anchors = [unique[i] for i in increasing([x for x, _ in unique])]
        if not anchors:
            if not ca.keys().isdisjoint(cb):
                out += [(lo + x, at + y) for x, y in common(a[lo:hi], b[at:end])]
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(lo - 1, at - 1), *anchors], [*anchors, (hi, end)], strict=True):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    start: int  # characters in the text
    end: int


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = {k: words(v) for k, v in sorted((templates or TEMPLATES).items()) if words(v)}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}

    def find(self, text: str | None) -> list[Match]:
        if not text:
            return []
        low = text.lower()
        have = set(_WORD.findall(low))
        near = [k for k, n in self.counts.items() if sum(v for w, v in n.items() if w in have) >= self.least(k)]
        if not near:
            return []
        spans = [m.span() for m in _WORD.finditer(low)] if len(low) == len(text) else [m.span() for m in re.finditer(_WORD, text)]
        tokens = [text[x:y].lower() for x, y in spans]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(tokens):
            places.setdefault(w, []).append(i)
        found = []
        for name in near:
            t = self.templates[name]
            rare = sorted(range(len(t)), key=lambda q: (len(places.get(t[q], ())), q))[: len(t) - self.least(name) + 1]
            starts = sorted({p - q for q in rare for p in places.get(t[q], ())})
            slack, last = len(t) // 4 + 2, None
            for s in starts:
                if last is not None and s - last <= slack // 2:
                    continue
                last = s
                for more in (0, slack):
                    lo, hi = max(0, s - more), min(len(tokens), s + len(t) + more + (slack // 2 if more else 0))
                    held = Counter(tokens[lo:hi])
                    if sum(min(n, held[w]) for w, n in self.counts[name].items()) < self.least(name):
                        continue  # no alignment has more matches than that
                    got = align(tokens[lo:hi], t)
                    if len(got) >= self.least(name):
                        found.append(Match(name, len(got) / len(t), len(got), spans[lo + got[0][0]][0], spans[lo + got[-1][0]][1]))
                    if len(got) == len(t):
                        break
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.license, m.end - m.start, m.start))
        kept: list[Match] = []
        for m in found:
            if all(m.end <= k.start or m.start >= k.end for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)

    def least(self, name: str) -> int:
        n = len(self.templates[name])
        return -int(-(COVER_SHORT if n < SHORT else COVER) * n // 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each match: (doc_id, license, coverage, matched, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = [(i, m.license, m.coverage, m.matched, m.start, m.end) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scanner.find(t)]
            yield c.emit(schema, rows)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return c.map_arrow(texts, run, "doc_id long, license string, coverage double, matched long, start long, end long")
