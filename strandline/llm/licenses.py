"""License scan by patience alignment of known notices with the text.

Words that occur once in both the notice and the text anchor the alignment; the longest increasing run of anchors is
kept, and the gaps between them are aligned in the same way, where further words become unique. A gap in which no word
is unique is aligned by its longest common subsequence. The share of the notice's words that end up matched is its
coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from strandline.llm.common import map_texts

COVERAGE = 0.8
#: A notice's words stand in the text within so many times its length.
SPREAD = 1.5
#: In a notice of no more words, those that name the license (as its identifier does) must all be matched.
SHORT_WORDS = 20

# The notices by which these licenses are usually declared, and the openings of their texts.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_HEAD = "GNU {name} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License"
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        _MIT,
        _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", _BSD),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", _BSD + _BSD_THIRD),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        _GNU.format(name="General Public License", version=2),
        _GNU_HEAD.format(name="General Public License", version=2, date="June 1991", year="1989, 1991"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        _GNU.format(name="General Public License", version=3),
        _GNU_HEAD.format(name="General Public License", version=3, date="29 June 2007", year=2007),
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        _GNU.format(name="Affero General Public License", version=3),
        _GNU_HEAD.format(name="Affero General Public License", version=3, date="19 November 2007", year=2007),
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        _GNU.format(name="Lesser General Public License", version=2.1),
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        _GNU.format(name="Lesser General Public License", version=3),
        _GNU_HEAD.format(name="Lesser General Public License", version=3, date="29 June 2007", year=2007),
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", _CC.format(name="Attribution")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", _CC.format(name="Attribution-ShareAlike")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", _CC.format(name="Attribution-NonCommercial")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", _CC.format(name="Attribution-NoDerivatives")),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", _CC.format(name="Attribution-NonCommercial-ShareAlike")),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", _CC.format(name="Attribution-NonCommercial-NoDerivatives")),
    "CC0-1.0": (
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ),
}

#: Frequent words, which are the last choice for finding candidate places.
STOPS = frozenset(b"the by under in and of to is this any not can your or it for be that may with you are use a at".split())

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_KEEP).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs``, ordered by the first, that rises in the second."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [j]
        piles[at : at + 1] = [k]
    run, k = [], piles[-1] if piles else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def common(a: list, b: list, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Longest common subsequence of two gaps, from the rising runs of their equal words; a word of ``a`` takes one place."""
    places: dict = {}
    for j in range(j1 - 1, j0 - 1, -1):
        places.setdefault(b[j], []).append(j)
    return _increasing([(i, j) for i in range(i0, i1) for j in places.get(a[i], ())])


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, rising in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i0, i1, j0, j1 = gaps.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            matched.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            matched.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a = {w for w, n in Counter(a[i0:i1]).items() if n == 1}
        count_b = Counter(w for w in b[j0:j1] if w in once_a)
        place = {b[j]: j for j in range(j0, j1) if count_b.get(b[j]) == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(i0, i1) if a[i] in place])
        if not anchors:
            matched += common(a, b, i0, i1, j0, j1)
            continue
        matched += anchors
        for (i, j), (k, m) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)], strict=True):
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(matched)


class Notice:
    """A notice's words, and key words of which any text that covers enough of it has ``hits`` at least."""

    def __init__(self, license_id: str, text: str, coverage: float, usual: Counter) -> None:
        self.license_id, self.words, self.coverage = license_id, words_of(text), coverage
        n = len(self.words)
        self.reach = max(n, int(SPREAD * n))
        missing = int(n * (1 - coverage) + 1e-9)
        self.places: dict[bytes, tuple[int, int]] = {}
        held = 0
        for word in sorted(set(self.words), key=lambda w: (w in STOPS, usual[w], -len(w), w)):
            if held > 2 * missing:
                break
            at = [k for k, w in enumerate(self.words) if w == word]
            self.places[word] = at[0], at[-1]
            held += len(at)
        self.hits = held - missing
        names = set(words_of(license_id)) if n <= SHORT_WORDS else set()
        self.named = [k for k, w in enumerate(self.words) if w in names]

    def _align(self, words: list[bytes], start: int, end: int) -> tuple[int, float, int, int] | None:
        start = max(0, start)
        pairs = patience(self.words, words[start:end])
        share = len(pairs) / len(self.words)
        if share < self.coverage or pairs[-1][1] - pairs[0][1] >= self.reach or not {i for i, _ in pairs}.issuperset(self.named):
            return None
        return len(pairs), share, start + pairs[0][1], start + pairs[-1][1] + 1

    def find(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, float, int, int]]:
        """(matched words, coverage, first word, word after the last) of every place that reaches the coverage.

        Around each key word that has enough others near it, a window of the notice's length is aligned, and if that
        fails one as wide as the notice may be spread.
        """
        n, found = len(self.words), []
        at = sorted((p, key) for key in self.places for p in places.get(key, ()))
        k = 0
        while k + self.hits <= len(at):
            p, key = at[k]
            k += 1
            if at[k + self.hits - 2][0] - p >= self.reach:
                continue
            low, high = self.places[key]
            slack = n - int(n * self.coverage)
            hit = self._align(words, p - high - slack, p - low + n + slack) or self._align(words, p - high - (self.reach - n), p - low + self.reach)
            if hit:
                found.append(hit)
                while k < len(at) and at[k][0] < hit[3]:
                    k += 1
        return found


def notices(coverage: float = COVERAGE, texts: dict[str, tuple[str, ...]] = NOTICES) -> list[Notice]:
    usual = Counter(w for several in texts.values() for t in several for w in words_of(t))
    return [Notice(name, t, coverage, usual) for name, several in texts.items() for t in several]


ADDED = "license_id string, coverage double, matched_words int, start_word int, end_word int, licenses string, n_places int"


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, texts: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """One row per document: doc_id, license_id, coverage, matched_words, start_word, end_word, licenses, n_places.

    The license with most matched words leads (ties: higher coverage, then name, then place); ``licenses`` lists all that
    reach the coverage, sorted and joined by commas, and ``n_places`` counts their places. Where notices overlap in the
    text, the one with more matched words is listed only. Documents without a notice, null and empty texts have nulls,
    an empty list and no places. Repeated rows get equal results, an empty table gives no rows, ids of any kind and nulls
    pass as they are, further columns are ignored.
    """
    known = notices(coverage, texts)
    keys = {k for n in known for k in n.places}

    def one(text: str | None) -> tuple:
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        if not keys.isdisjoint(words):
            for k, w in enumerate(words):
                if w in keys:
                    places.setdefault(w, []).append(k)
        hits = [(n.license_id, *hit) for n in known if not n.places.keys().isdisjoint(places) for hit in n.find(words, places)]
        hits.sort(key=lambda h: (-h[1], -h[2], h[0], h[3]))
        kept: list[tuple] = []
        for h in hits:
            if all(h[4] <= k[3] or k[4] <= h[3] for k in kept):
                kept.append(h)
        if not kept:
            return None, None, None, None, None, "", 0
        lead = kept[0]
        return lead[0], lead[2], lead[1], lead[3], lead[4], ",".join(sorted({h[0] for h in kept})), len(kept)

    return map_texts(docs.select("doc_id", "text"), ADDED, lambda values: list(zip(*map(one, values), strict=True)) or [[]] * 7)
