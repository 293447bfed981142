"""Operator 9: license scan by patience alignment against templates.

Words of a text are looked up in the templates' vocabulary. Where a text holds enough of
a template's rare words (words found in the fewest templates) close together, a window
opens. Inside it, words unique to both window and template are anchors; their longest
increasing subsequence splits both into gaps, which are aligned the same way, after
common heads and tails are taken; gaps without unique words are filled by their common
heads and tails only. Coverage is the share of the template's words that are aligned.

Windows start at 2.5 times the template's length. Where none is accepted although the
whole text has the words (as many of the template's and all of an identity's), they double
until one window is the whole text, so a notice is found however far it is spread; where
one is accepted below ``GOOD``, the next width is tried as well.

A window counts only if it holds the template's ``IDENTITY``: phrases that
tell it from its relatives (name, variant, version, distinguishing clause). A phrase is
held if the aligned span has it word by word or, in templates of ``LOOSE`` words or more,
if its words are aligned and no word of a license's name stands between them. Of spans
that overlap by more than half of the smaller one, the one with more aligned words wins
(the shorter template of equals), so a header is not reported again as the notice inside it, nor BSD-3-Clause as
BSD-2-Clause.

The templates are a fixed list (names, notices, headers, and the whole texts of
``license_texts``), so they travel to the documents: the scan is map-only and its cost
follows the words, however many documents hold the same notice.

Defined cases: words are runs of letters, digits and dots inside numbers, in lower case;
null or empty text gives no row; a null doc_id is carried; a template below ``MIN_COVERAGE`` or without its
identity gives no row; each (row, template) pair gives one row, of its best window that
no other template wins, the first of equals; repeated rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session
from .license_texts import TEXTS

MIN_COVERAGE = 0.8
#: From this coverage on, no wider window is tried: it would reach into the next notice.
GOOD = 0.95
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

#: From this many words on, a template is compared with the word counts of the whole text first.
LONG = 400

#: From this many words on, other words may stand inside the phrases of a template's identity.
LOOSE = 20

#: Short notices and headers of public licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
NOTICES |= {
    f"{name}-header": NOTICES["GPL-3.0-header"].replace("General Public License", full).replace("version 3", f"version {version}")
    for name, full, version in (
        ("GPL-2.0", "General Public License", "2"),
        ("LGPL-2.0", "Library General Public License", "2"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"),
        ("AGPL-3.0", "Affero General Public License", "3"),
    )
}

_CC = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}

#: Licenses by name: the first name is the template, after "under the"; any of them is its identity.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License, version 3.0", "GNU Affero General Public License v3"],
    "Apache-2.0-name": ["Apache License, Version 2.0", "Apache License 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause-name": ["BSD 2-Clause License"],
    "BSD-3-Clause-name": ["BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License, version 2.0", "GNU General Public License v2"],
    "GPL-3.0-name": ["GNU General Public License, version 3", "GNU General Public License, version 3.0", "GNU General Public License v3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3.0", "GNU Lesser General Public License v3"],
    "MIT-name": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
NOTICES |= {name: names[0] if name == "Unlicense" else f"under the {names[0]}" for name, names in NAMES.items()}
for _short, _long in _CC.items():
    for _version, _end in (("4.0", "International"), ("3.0", "Unported")):
        _name = f"CC-BY{_short}-{_version}"
        NAMES[f"{_name}-short"] = [f"CC BY{_short} {_version}", f"CC-BY{_short}-{_version}"]
        NAMES[f"{_name}-name"] = [f"Creative Commons Attribution{_long} {_version}"]
        NOTICES[f"{_name}-short"] = f"under CC BY{_short} {_version}"
        NOTICES[f"{_name}-name"] = f"Creative Commons Attribution{_long} {_version} {_end} License"

TEMPLATES = NOTICES | TEXTS

#: Phrases that an aligned span has to hold, each as a list of alternatives. Names are whole and without gaps,
#: so a foreign word inside one (Lesser, NonCommercial) is another license; other names beside it (a choice of two) are not.
IDENTITY = {name: [names] for name, names in NAMES.items()} | {
    "Apache-2.0": [NAMES["Apache-2.0-name"]],
    "Apache-2.0-header": [["Apache License, Version 2.0"]],
    "Apache-2.0-text": [["Apache License, Version 2.0"]],
    "Artistic-1.0-Perl-text": [["Artistic License"]],
    "BSD-3-Clause": [["endorse or promote products"]],
    "BSD-4-Clause": [["endorse or promote products"], ["advertising materials mentioning features"]],
    "BSL-1.0-text": [["any person or organization obtaining a copy"]],
    "CC-BY-4.0": [NAMES["CC-BY-4.0-name"]],
    "CC-BY-NC-4.0": [NAMES["CC-BY-NC-4.0-short"]],
    "CC0-1.0-text": [["CC0 1.0 Universal"]],
    "GFDL-1.2-text": [["Version 1.2, November 2002"]],
    "GFDL-1.3-text": [["Version 1.3, 3 November 2008"]],
    "GPL-1.0-text": [["GNU General Public License Version 1, February 1989"]],
    "GPL-2.0-header": [["GNU General Public License as published"], ["version 2 of the License"]],
    "GPL-2.0-text": [["GNU General Public License Version 2, June 1991"]],
    "GPL-3.0": [NAMES["GPL-3.0-name"]],
    "GPL-3.0-header": [["GNU General Public License as published"], ["version 3 of the License"]],
    "GPL-3.0-text": [["GNU General Public License Version 3, 29 June 2007"]],
    "AGPL-3.0-header": [["GNU Affero General Public License as published"], ["version 3 of the License"]],
    "ISC-text": [["provided that the above copyright notice"]],
    "LGPL-2.0-header": [["GNU Library General Public License as published"], ["version 2 of the License"]],
    "LGPL-2.0-text": [["GNU Library General Public License Version 2, June 1991"]],
    "LGPL-2.1-header": [["GNU Lesser General Public License as published"], ["version 2.1 of the License"]],
    "LGPL-2.1-text": [["GNU Lesser General Public License Version 2.1, February 1999"]],
    "LGPL-3.0-header": [["GNU Lesser General Public License as published"], ["version 3 of the License"]],
    "LGPL-3.0-text": [["GNU Lesser General Public License Version 3, 29 June 2007"]],
    "MIT": [NAMES["MIT-name"]],
    "MIT-text": [["obtaining a copy of this software and associated documentation files"]],
    "MPL-1.1-text": [["Mozilla Public License Version 1.1"]],
    "MPL-2.0-header": [["Mozilla Public License, v. 2.0"]],
    "MPL-2.0-text": [["Mozilla Public License Version 2.0"]],
}


def word_list(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops, pile, back = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[k], pile[k] = p, i
        back[i] = pile[k - 1] if k else -1
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), both increasing. Gaps wait on a stack, so depth is no limit."""
    matched, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: c + k for k, w in enumerate(template[c:d]) if theirs[w] == 1}
        both = [(a + k, where[w]) for k, w in enumerate(text[a:b]) if mine[w] == 1 and w in where]
        anchors = [both[i] for i in increasing([y for _, y in both])]
        if anchors:
            matched += anchors
            for (a1, c1), (b1, d1) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                gaps.append((a1 + 1, b1, c1 + 1, d1))
    return sorted(matched)


#: Words that tell licenses apart: one of them inside a spread phrase makes it another license's.
NAME_WORDS = {w for names in NAMES.values() for name in names for w in word_list(name)} - {"the"}


def _phrase(words: list[str]) -> str:
    return f" {' '.join(words)} "


def _places_of(phrase: list[str], words: list[str]) -> list[range]:
    n = len(phrase)
    return [range(k, k + n) for k in range(len(words) - n + 1) if words[k : k + n] == phrase]


class Scanner:
    """Templates with the words that open their windows."""

    def __init__(self, templates: dict[str, str]):
        self.templates = {name: word_list(text) for name, text in templates.items()}
        spread = Counter(w for words in self.templates.values() for w in set(words))
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.need = {name: int(-(-MIN_COVERAGE * len(words) // 1)) for name, words in self.templates.items()}
        self.identity = {name: [[_phrase(word_list(x)) for x in any_of] for any_of in IDENTITY.get(name, ())] for name in self.templates}
        self.identity_words = {name: [[set(word_list(x)) for x in any_of] for any_of in IDENTITY.get(name, ())] for name in self.templates}
        self.identity_places = {name: [[at for x in any_of for at in _places_of(word_list(x), words)] for any_of in IDENTITY.get(name, ())] for name, words in self.templates.items() if len(words) >= LOOSE}
        self.long = [name for name, words in self.templates.items() if len(words) >= LONG]
        self.openers: dict[str, list[str]] = {}
        self.long_openers: dict[str, set[str]] = {}
        for name, words in self.templates.items():
            # A window with coverage MIN_COVERAGE misses fewer words than this, so it holds one of so many rare words.
            need = len(words) - self.need[name] + 1
            counts, taken = self.counts[name], 0
            for w in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
                if taken >= need:
                    break
                if name in self.long:
                    self.long_openers.setdefault(name, set()).add(w)
                else:
                    self.openers.setdefault(w, []).append(name)
                taken += counts[w]
        self.known = set(self.openers)
        self.least = min((self.need[name] for name in self.long), default=math.inf)

    def places(self, words: list[str]) -> dict[str, list[int]]:
        """Places of opening words, by template."""
        places: dict[str, list[int]] = {}
        if not self.known.isdisjoint(words):
            for k, w in enumerate(words):
                if w in self.known:
                    for name in self.openers[w]:
                        places.setdefault(name, []).append(k)
        if len(words) >= self.least:
            counts = Counter(words)
            for name in self.long:
                if len(words) >= self.need[name] and (counts & self.counts[name]).total() >= self.need[name]:
                    places[name] = [k for k, w in enumerate(words) if w in self.long_openers[name]]
        return places

    def accepts(self, name: str, words: list[str], got: list[tuple[int, int]]) -> bool:
        """Whether an alignment of a template covers enough and holds its identity."""
        if len(got) < self.need[name]:
            return False
        span, where = _phrase(words[got[0][0] : got[-1][0] + 1]), None
        for k, any_of in enumerate(self.identity[name]):
            if any(x in span for x in any_of):
                continue
            where = where or {y: x for x, y in got}
            if not any(self.spread(places, where, words) for places in self.identity_places.get(name, [()] * len(self.identity[name]))[k]):
                return False
        return True

    @staticmethod
    def spread(places: range, where: dict[int, int], words: list[str]) -> bool:
        """Whether all these words of the template are aligned without a license's name word between them."""
        if any(y not in where for y in places):
            return False
        return all(NAME_WORDS.isdisjoint(words[where[y] + 1 : where[y + 1]]) for y in places[:-1])

    def possible(self, name: str, counts: Counter) -> bool:
        """Whether a whole text has enough of a template's words, and all of its identity."""
        if (counts & self.counts[name]).total() < self.need[name]:
            return False
        return all(any(all(w in counts for w in x) for x in any_of) for any_of in self.identity_words[name])

    def hits(self, name: str, words: list[str], at: list[int], reach: int) -> list[tuple]:
        """Accepted windows of ``reach`` words around the opening words at ``at``."""
        template, need, found = self.templates[name], self.need[name], []
        merged: list[list[int]] = []
        for k in at:
            if merged and k - reach <= merged[-1][1]:
                merged[-1][1] = min(len(words), k + reach + 1)
            else:
                merged.append([max(0, k - reach), min(len(words), k + reach + 1)])
        for a, b in merged:
            # Long runs of windows are cut so that a word repeated in the next notice stays unique in its own.
            for start in range(a, max(a + 1, b - reach), max(1, reach // 2)):
                part = words[start : min(b, start + 2 * reach)]
                if (Counter(part) & self.counts[name]).total() < need:
                    continue
                got = align(part, template)
                if self.accepts(name, part, got):
                    found.append((-len(got), len(template), start + got[0][0], name, start + got[-1][0]))
        return found

    def scan(self, text: str | None) -> list[tuple]:
        """(license, coverage, matched words, first word, last word)."""
        words = word_list(text)
        found, counts = [], None
        for name, at in self.places(words).items():
            reach = len(self.templates[name]) * 5 // 4
            hits = self.hits(name, words, at, reach)
            if not hits and reach < len(words):
                counts = counts or Counter(words)
                while not hits and reach < len(words) and self.possible(name, counts):
                    reach *= 2
                    hits = self.hits(name, words, at, reach)
            if hits and reach < len(words) and -min(hits)[0] < GOOD * len(self.templates[name]):
                hits = hits + self.hits(name, words, at, 2 * reach)  # a notice cut by its window aligns better in a wider one
            found += hits
        won: list[tuple[str, int, int]] = []
        out = {}
        for n, _, first, name, last in sorted(found):
            if any(other != name and 2 * (min(last, b) - max(first, a) + 1) > min(last - first, b - a) + 1 for other, a, b in won):
                continue
            won.append((name, first, last))
            out.setdefault(name, (name, -n / len(self.templates[name]), -n, first, last))
        return [out[name] for name in sorted(out)]


def _scan(templates: dict[str, str]):
    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) for hit in scanner.scan(text)]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found: doc_id, license, coverage, n_matched, first_word, last_word."""
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(templates or TEMPLATES), "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long")
