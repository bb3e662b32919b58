"""License scans by patience alignment.

A text and a license template are sequences of words. Anchors are words that are unique in
both; the longest increasing subsequence of their places fixes them, and the gaps between
fixed anchors are aligned the same way, after common ends are matched. Coverage is the share
of the template's words that are matched; a span counts from ``COVERAGE`` on, of a template of fewer than
``SHORT`` words only if all are matched. The words that name a license and its version (``NAMES``) must
be matched side by side, however long the template, so that no license passes for its neighbour.

Where to align is found without scanning windows: in an alignment with coverage c at most
(1 - c) of the template's words are missing, so of its rarest (1 - c) + 1 words in the text at
least one is matched. Only the places around those words are aligned, and only for templates of
which enough words occur in the text at all. A span is sought within a template's length and
a quarter of it on both sides of such a place.

Defined cases: a null or empty text has no license; whole texts are read; a license that occurs
several times is found at each place; overlapping spans keep the one with the highest coverage,
ties going to the longer template, then the shorter span, then the first place; rows are scanned one by one; an empty
table gives an empty result; a null doc_id is passed on; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

COVERAGE = 0.8
#: Templates of fewer words are matched whole.
SHORT = 20
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

_LEADS = ("Licensed under", "Released under")


def _line(*names: str) -> tuple[str, ...]:
    """The one-line notices of a license's names."""
    return tuple(f"{lead} {name}" for name in names for lead in _LEADS)


def _gpl(kind: str, version: str, subject: str = "This program is free software: you can redistribute it") -> str:
    return (
        f"{subject} and/or modify it under the terms of the GNU {kind}General Public License as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def _cc(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


#: The public notices, as their stewards word them; of several wordings any counts.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0 (line)": _line("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT (line)": _line("the MIT License", "MIT License"),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD (line)": _line("the BSD License", "a BSD License", *[f"the {name} License" for name in ("BSD 2-Clause", "2-Clause BSD", "BSD 3-Clause", "3-Clause BSD", "new BSD", "modified BSD", "simplified BSD")]),
    "ISC (line)": _line("the ISC License"),
    "MPL-2.0 (line)": _line("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0 (line)": _line("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"),
    "BSL-1.0 (line)": ("Distributed under the Boost Software License, Version 1.0.", *_line("the Boost Software License, version 1.0")),
    "GPL-2.0 (line)": ("This work is licensed under the GNU General Public License, version 2.", *_line("the GNU General Public License, version 2", "the GNU General Public License v2", "the GPL, version 2", "GPLv2")),
    "GPL-3.0 (line)": ("This work is licensed under the GNU General Public License, version 3.", *_line("the GNU General Public License, version 3", "the GNU General Public License v3", "the GPL, version 3", "GPLv3")),
    "LGPL-2.1 (line)": _line("the GNU Lesser General Public License, version 2.1", "the LGPL, version 2.1"),
    "LGPL-3.0 (line)": _line("the GNU Lesser General Public License, version 3", "the LGPL, version 3"),
    "AGPL-3.0 (line)": _line("the GNU Affero General Public License, version 3", "the AGPL, version 3"),
    "GPL-2.0": _gpl("", "2"),
    "GPL-3.0": _gpl("", "3"),
    "LGPL-2.1": _gpl("Lesser ", "2.1", "This library is free software; you can redistribute it"),
    "LGPL-3.0": _gpl("Lesser ", "3"),
    "AGPL-3.0": _gpl("Affero ", "3"),
    **{f"CC-{kind}-4.0 (line)": _line(f"CC {kind} 4.0") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC-BY-4.0": _cc("Attribution"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0 (line)": _line("CC0 1.0"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
}

_KINDS = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
#: What names a license in its templates; of a wording that holds it, it must be matched side by side.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0"), "MIT": ("mit license",), "ISC": ("isc license",),
    "BSD": tuple(f"{name} license" for name in ("bsd", "bsd 2 clause", "2 clause bsd", "bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "simplified bsd")),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0"), "BSL-1.0": ("boost software license version 1.0",), "CC0-1.0": ("cc0 1.0",),
    **{f"{kind}-{v}": (f"{name} version {v}", f"{name} v{v}", name, f"version {v}", f"{kind.lower()} version {v}", f"{kind.lower()}v{v}") for kind, name in _KINDS.items() for v in ("2", "2.1", "3")},
    **{f"CC-{kind}-4.0": (f"cc {kind.lower().replace('-', ' ')} 4.0", f"creative commons {name} 4.0") for kind, name in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"))},
}
NAMES |= {f"{kind}.0": NAMES[kind] for kind in ("GPL-2", "GPL-3", "LGPL-3", "AGPL-3")}


def patience(left: Sequence[str], right: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places (in left, in right), rising in both. Gaps are kept on a list, so depth is no limit."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        once = {word for word, n in Counter(left[a:b]).items() if n == 1} & {word for word, n in Counter(right[c:d]).items() if n == 1}
        place = {word: k for k, word in enumerate(right[c:d], c) if word in once}
        anchors = rising([(k, place[word]) for k, word in enumerate(left[a:b], a) if word in once])
        if anchors:
            matched.extend(anchors)
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]))
    return sorted(matched)


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence rising in the second place too (first places rise already)."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, value) in enumerate(pairs):
        pile = bisect_left(tails, value)
        before[k] = ends[pile - 1] if pile else -1
        tails[pile : pile + 1] = [value]
        ends[pile : pile + 1] = [k]
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


class Scanner:
    """The templates' words, compiled once per Python worker."""

    def __init__(self, templates: Mapping[str, str | tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        wordings = [(name, text) for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)]
        self.names = [name for name, _ in wordings]
        self.templates = [[w.lower() for w in _WORD.findall(text)] for _, text in wordings]
        self.needs = [1.0 if len(words) < SHORT else coverage for words in self.templates]
        self.fixed = [self._fixed(NAMES.get(name.removesuffix(" (line)"), ()), words) for name, words in zip(self.names, self.templates)]
        self.uses: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.templates):
            for word, n in Counter(words).items():
                self.uses[word].append((k, n))

    @staticmethod
    def _fixed(names: Sequence[str], words: list[str]) -> list[list[range]]:
        """Of each name that a template holds, its places there."""
        found = []
        for name in (name.split() for name in names):
            at = [range(k, k + len(name)) for k in range(len(words) - len(name) + 1) if words[k : k + len(name)] == name]
            if at:
                found.append(at)
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first character, character after the last) of each span, in order."""
        if not text:
            return []
        lower = text.lower()
        present = Counter()
        for word in self.uses.keys() & set(_WORD.findall(lower)):
            for k, n in self.uses[word]:
                present[k] += n
        hopeful = [k for k, n in present.items() if n >= self.needs[k] * len(self.templates[k])]
        if not hopeful:
            return []
        spots = [(m[0], m.start(), m.end()) for m in _WORD.finditer(lower)]
        words = [spot[0] for spot in spots]
        places = defaultdict(list)
        for k, word in enumerate(words):
            if word in self.uses:
                places[word].append(k)
        found = [hit for k in hopeful for hit in self._spans(k, words, places)]
        taken: list[tuple[int, int]] = []
        kept = []
        for cover, length, first, last, name in sorted(found, key=lambda hit: (-hit[0], -hit[1], hit[3] - hit[2], hit[2])):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                kept.append((name, round(cover, 6), spots[first][1], spots[last][2]))
        return sorted(kept, key=lambda span: span[2])

    def _spans(self, which: int, words: list[str], places: Mapping[str, list[int]]) -> Iterator[tuple[float, int, int, int, str]]:
        template, need = self.templates[which], self.needs[which]
        size = len(template)
        missing = int((1 - need) * size + 1e-9)
        rare = sorted(range(size), key=lambda t: (len(places.get(template[t], ())), t))[: missing + 1]
        slack = size // 4 + 2
        starts = sorted({k - t for t in rare for k in places.get(template[t], ())})
        reach = None
        for start in starts:
            if reach is not None and start - reach < slack // 2:
                continue  # the same window but for a few words
            reach = start
            for room in (0, slack):  # without room first: beside itself a notice has no unique words
                low = max(0, start - room)
                pairs = patience(template, words[low : start + size + room])
                if pairs and len(pairs) >= need * size and self._named(which, dict(pairs)):
                    yield len(pairs) / size, size, low + pairs[0][1], low + pairs[-1][1], self.names[which]

    def _named(self, which: int, at: Mapping[int, int]) -> bool:
        """Whether each of the template's names is matched side by side at one of its places."""
        return all(any(all(t in at and at[t] - at[place[0]] == t - place[0] for t in place) for place in places if place[0] in at) for places in self.fixed[which])


_SPANS = ArrayType(StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("first", IntegerType()), StructField("end", IntegerType())]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id and licenses, an array of (license, coverage, first, end) in the text's order."""

    @F.pandas_udf(_SPANS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates, coverage)
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "coverage", "first", "end"), span)) for span in scanner.scan(text)] for text in texts], dtype=object)

    return docs.select("doc_id", scanned(F.col("text")).alias("licenses"))
