"""Licence scans by patience alignment of templates with whole texts.

Words are runs of ASCII letters and digits or non-ASCII characters, A-Z lower-cased. A template is
aligned with a stretch of text by matching equal heads and tails, anchoring on words that occur once in both,
taking the longest increasing subsequence of the anchors and aligning the gaps between them the same way. Coverage is
the share of the template's words that are matched; matches of at least ``coverage`` count.

Stretches come from an exact bound: a stretch can't reach the coverage unless that many of the template's
words, repeats included, occur in a window of it as long as the template and the words that may be missing
between them. Windows that pass are joined to runs; in a run, the stretch from every word that can be the first of a match
is aligned, so each occurrence within the bound lies whole in the stretch that begins with it. Overlapping matches are settled by coverage, then by matched words, then by place and name.

Edge cases: null and empty texts and texts without matches have an empty list; templates without words never match; a
licence that a text repeats is reported at each place; texts of any length are scanned whole; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_rows, sliced
from ledgerloom.llm.decontaminate import _UPPER, WORD, words_of

#: Notices of public licences: fixed values, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose seconds increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
        back.append(at[k - 1] if k else -1)
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        once_a, once_b = Counter(a[al:ah]), Counter(b[bl:bh])
        place = {b[j]: j for j in range(bl, bh) if once_b[b[j]] == 1}
        anchors = increasing([(i, place[a[i]]) for i in range(al, ah) if once_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        edges = [(al - 1, bl - 1), *anchors, (ah, bh)]
        out += anchors
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words for name, text in sorted(templates.items()) if (words := words_of(text))}
        self.needed = {name: ceil(coverage * len(w) - 1e-9) for name, w in self.templates.items()}
        self.counts = {name: Counter(w) for name, w in self.templates.items()}
        self.vocabulary = frozenset(w for words in self.templates.values() for w in words)

    def runs(self, name: str, words: list[bytes]) -> list[tuple[int, int]]:
        """Stretches of the text in which enough of the template's words lie close together."""
        counts, needed = self.counts[name], self.needed[name]
        width = 2 * len(self.templates[name]) - needed + 4
        hits = [i for i, w in enumerate(words) if w in counts]
        inside: Counter = Counter()
        have = left = 0
        out: list[list[int]] = []
        for i in hits:
            w = words[i]
            inside[w] += 1
            have += inside[w] <= counts[w]
            while hits[left] <= i - width:
                v = words[hits[left]]
                have -= inside[v] <= counts[v]
                inside[v] -= 1
                left += 1
            if have >= needed:
                start = hits[left]
                if out and start <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([start, i + 1])
        return [(a, b) for a, b in out]

    def starts(self, name: str, words: list[bytes], a: int, b: int) -> list[int]:
        """Places of a run at which a match can begin: a word that has enough of the template after it, in a stretch with enough of its words."""
        template, counts, needed = self.templates[name], self.counts[name], self.needed[name]
        size = 2 * len(template) - needed + 4
        first = frozenset(template[: len(template) - needed + 1])
        inside: Counter = Counter()
        have, end, out = 0, a, []
        for start in range(a, b):
            while end < min(b, start + size):
                w = words[end]
                if w in counts:
                    inside[w] += 1
                    have += inside[w] <= counts[w]
                end += 1
            w = words[start]
            if have >= needed and (w in first or start == a):
                out.append(start)
            if w in counts:
                have -= inside[w] <= counts[w]
                inside[w] -= 1
        return out

    def scan(self, words: list[bytes]) -> list[tuple[float, int, str, int, int]]:
        """``(coverage, matched words, template, first word, last word + 1)`` of each match, in text order."""
        held = self.vocabulary.intersection(words)
        found = []
        for name, template in self.templates.items() if held else ():
            if sum(n for w, n in self.counts[name].items() if w in held) < self.needed[name]:
                continue
            size = 2 * len(template) - self.needed[name] + 4
            for a, b in self.runs(name, words):
                past = a
                for start in self.starts(name, words, a, b):
                    if start < past:
                        continue
                    end = min(b, start + size)
                    while end - start >= self.needed[name]:  # what lies before a match may hold another one
                        match = patience(template, words[start:end])
                        if len(match) < self.needed[name]:
                            break
                        found.append((len(match) / len(template), len(match), name, start + match[0][1], start + match[-1][1] + 1))
                        if len(match) == len(template) == match[-1][1] - match[0][1] + 1:
                            past = max(past, found[-1][4])  # nothing that overlaps a verbatim notice can stand beside it
                        end = found[-1][3]
        kept: list[tuple[float, int, str, int, int]] = []
        for m in sorted(set(found), key=lambda m: (-m[0], -m[1], m[4] - m[3], m[3], m[2])):
            if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[3])


def scan_documents(df: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``licenses``, an array of (name, coverage, start, end) with offsets in code points of the text."""
    templates = TEMPLATES if templates is None else templates
    scanner = df.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))
    item = pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                matches = scanner.value.scan(words_of(text))
                at = [m.span() for m in WORD.finditer(text.translate(_UPPER))] if matches else []
                rows.append([{"name": name, "coverage": c, "start": at[a][0], "end": at[b - 1][1]} for c, _, name, a, b in matches])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=[id_col, "licenses"])

    return map_rows(df, id_col, text_col, run, "licenses array<struct<name: string, coverage: double, start: long, end: long>>")
