"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8  # share of a template's words that must align
BLOCK = 1 << 20  # cells of a table of alignments; longer regions take several

# Public license notices, by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    """Words in lower case; version numbers stay whole."""
    return [w.lower() for w in WORD.findall(text)]


def cues(templates: dict[str, str], coverage: float = COVERAGE) -> list[str]:
    """Words of which a text with any template contains at least one.

    An alignment may miss some of a template's words; the longest ones are taken until
    they are more than that, so that one at least must be left.
    """
    out: set[str] = set()
    for text in templates.values():
        w = words(text)
        count = Counter(w)
        missed = len(w) - -(-coverage * len(w) // 1)
        have = sum(count[c] for c in out)
        for c in sorted(count, key=lambda c: (-len(c), c)):
            if have > missed:
                break
            if c not in out:
                out.add(c)
                have += count[c]
    return sorted(out)


def increasing(values: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v), piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def word_by_word(a: list[str], b: list[str], ao: int, bo: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two gaps; words of one side alone can't align and are left out first."""
    in_a, in_b = set(a), set(b)
    at, bt = [i for i, w in enumerate(a) if w in in_b], [j for j, w in enumerate(b) if w in in_a]
    n, m = len(at), len(bt)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[at[i]] == b[bt[j]] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[at[i]] == b[bt[j]]:
            out.append((ao + at[i], bo + bt[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) places, in order.

    Words unique in both are anchors; of those, a longest run that increases in
    both is kept, and the gaps between them are aligned in the same way. A gap
    without anchors gives its equal ends, and what is left of it is aligned word
    by word.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if in_template[w] == 1}
        pairs = [(i, where[text[i]]) for i in range(a, b) if in_text[text[i]] == 1 and text[i] in where]
        if not pairs:
            out += word_by_word(text[a:b], template[c:d], a, c)
            continue
        kept = [pairs[k] for k in increasing([j for _, j in pairs])]
        out += kept
        i, j = a, c
        for x, y in kept + [(b, d)]:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
    return sorted(out)


def windows(text: list[str], template: list[str], starts: Sequence[int], need: int) -> list[tuple[int, int, int]]:
    """(aligned words, first word, end) for each start and each number of aligned words from ``need``: the shortest window of up to twice the template.

    The aligned words are those of a longest common subsequence, for all windows
    of a block of starts at once.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys(template))}
    span = 2 * len(template)
    x = np.array([number.get(w, -1) for w in text] + [-1] * span, np.int16)
    out: list[tuple[int, int, int]] = []
    step = max(1, BLOCK // span)
    for k in range(0, len(starts), step):
        at = np.array(starts[k : k + step])
        seen = x[at[:, None] + np.arange(span)]
        best = np.zeros((len(at), span + 1), np.int16)
        for w in template:
            best[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + (seen == number[w]))
            np.maximum.accumulate(best, axis=1, out=best)
        for c in range(need, len(template) + 1):
            rows = np.flatnonzero(best[:, -1] >= c)
            if not len(rows):
                break
            out += [(c, int(s), int(s + e)) for s, e in zip(at[rows], (best[rows] >= c).argmax(axis=1))]
    return out


class Scanner:
    """Templates as words, with the templates of each cue word."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.templates = {k: words(v) for k, v in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.templates.items()}
        self.need = {k: max(1, next(c for c in range(len(w) + 1) if c >= coverage * len(w))) for k, w in self.templates.items()}
        self.cues = frozenset(cues(templates, coverage))
        self.names: dict[str, list[str]] = defaultdict(list)
        for name, count in self.counts.items():
            for x in count:
                if x in self.cues:
                    self.names[x].append(name)

    def regions(self, text: list[str], name: str) -> Iterator[tuple[list[int], int, int]]:
        """Starts of windows of twice the template that hold as many of its words as must align, with the most that one holds and all that they hold; by runs of windows that overlap."""
        often, need, span = self.counts[name], self.need[name], 2 * len(self.templates[name])
        at = [i for i, w in enumerate(text) if w in often]
        have: Counter[str] = Counter()
        total = most = end = first = 0
        group: list[int] = []
        for k, s in enumerate(at):
            while end < len(at) and at[end] < s + span:
                have[text[at[end]]] += 1
                total += have[text[at[end]]] <= often[text[at[end]]]
                end += 1
            if total >= need:
                if group and s >= group[-1] + span:
                    yield group, most, last - first
                    group, most = [], 0
                first = first if group else k
                group.append(s)
                most, last = max(most, total), end
            total -= have[text[s]] <= often[text[s]]
            have[text[s]] -= 1
        if group:
            yield group, most, last - first

    def notices(self, text: list[str], name: str) -> list[tuple[int, int, int]]:
        """(aligned words, first word, end) of all windows in which the template may stand, the closest first.

        Patience alignment settles a region with room for one notice if it aligns
        as many words as any alignment can, in about as many as the template has. In
        others no anchor may be left, as where copies stand together, or an anchor
        may stand for another copy; there all windows are aligned word by word.
        """
        t, need = self.templates[name], self.need[name]
        out: list[tuple[int, int, int]] = []
        for starts, most, held in self.regions(text, name):
            if held < 2 * need:
                a = starts[0]
                pairs = align(text[a : starts[-1] + 2 * len(t)], t)
                if len(pairs) == most and 4 * (pairs[-1][0] + 1 - pairs[0][0]) <= 5 * len(t):
                    out.append((most, a + pairs[0][0], a + pairs[-1][0] + 1))
                    continue
            out += windows(text, t, starts, need)
        return sorted(out, key=lambda x: (x[2] - x[1] - 2 * x[0], -x[0], x[1]))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end) of each template found; of overlapping ones, the one that aligns more words, and of one template's, the one that passes over fewer."""
        w = words(text or "")
        count = Counter(w)
        taken = np.zeros(len(w), bool)
        left: dict[str, Iterator[tuple[int, int, int]]] = {}
        for name in dict.fromkeys(n for x in count for n in self.names.get(x, ())):
            if sum(min(count[x], c) for x, c in self.counts[name].items()) >= self.need[name]:
                left[name] = iter(self.notices(w, name))
        out: list[tuple[str, float, int, int]] = []
        heads: dict[str, tuple[int, int, int]] = {}
        while True:
            for name, more in left.items():
                head = heads.pop(name, None) or next(more, None)
                while head and taken[head[1] : head[2]].any():
                    head = next(more, None)
                if head:
                    heads[name] = head
            if not heads:
                return sorted(out, key=lambda x: (x[2], x[0]))
            name = min(heads, key=lambda k: (-heads[k][0], -heads[k][0] / len(self.templates[k]), k))
            c, first, end = heads.pop(name)
            taken[first:end] = True
            out.append((name, c / len(self.templates[name]), first, end))


def may_hold(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains any cue word, if only inside another word."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, end_word: one row for each notice found in each document.

    A notice is found where a part of the text aligns with at least ``coverage``
    of a template's words and is at most twice as long. Notices of one document
    don't overlap. Null and empty texts have none; rows of equal keys are
    scanned one by one; an empty table gives an empty result.
    """
    scanner = Scanner(templates, coverage)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, name, round(share, 6), a, b) for k, t in zip(batch["doc_id"], batch["t"]) for name, share, a, b in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "first_word", "end_word"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).filter(may_hold(F.col("t"), sorted(scanner.cues)))
    kind = docs.schema[key].dataType.simpleString()
    return d.mapInPandas(run, f"doc_id {kind}, license string, coverage double, first_word long, end_word long")
