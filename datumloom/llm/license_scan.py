"""Scanning documents for licence texts.

Templates are turned into word sequences. Winnowing keeps, of every window of
consecutive word trigrams, the one with the least hash; these fingerprints make an
inverted index from trigram to (template, place). Every trigram of a document is
looked up, and hits near one another and near one diagonal make a candidate region.
There, a banded alignment of the template with the document's words, with matches
gaining and gaps and substitutions costing, gives the matched words and the span.

The index holds the templates only, some ten thousand entries, and goes to all tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from datumloom.llm.common import pick

# Public licence notices, as their authors ask for them to be stated; sibling notices follow below.
TEMPLATES = {
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-statement": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = TEMPLATES["BSD"]
TEMPLATES |= {
    "MIT-text": f"{TEMPLATES['MIT']} {_AS_IS}",
    "ISC-text": f"{TEMPLATES['ISC']} {_ISC_AS_IS}",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_AS_IS}",
    "BSD-3-Clause": f"{_BSD_HEAD} {_BSD_ENDORSE} {_BSD_AS_IS}",
}
# Notices of one wording that differ in a licence's name and version.
_GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
for _id, _what, _sign, _name, _comma, _version in (
    ("GPL-2.0", "program", ";", "General Public License", ";", "2"),
    ("LGPL-2.0", "library", ";", "Library General Public License", ";", "2"),
    ("LGPL-2.1", "library", ";", "Lesser General Public License", ";", "2.1"),
    ("LGPL-3.0", "program", ":", "Lesser General Public License", ",", "3"),
    ("AGPL-3.0", "program", ":", "Affero General Public License", ",", "3"),
):
    TEMPLATES[f"{_id}-notice"] = _GNU.format(what=_what, sign=_sign, name=_name, comma=_comma, version=_version)
    TEMPLATES[f"{_id}-statement"] = f"This work is licensed under the GNU {_name}, version {_version}."
_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _id, _name in _CC.items():
    TEMPLATES.setdefault(f"CC-{_id}-4.0-statement", f"This work is licensed under a Creative Commons {_name} 4.0 International License.")
    TEMPLATES[f"CC-{_id}-4.0-name"] = f"Licensed under CC {_id} 4.0." if _id != "BY-NC" else f"This work is licensed under a Creative Commons {_name} 4.0 International License."
for _id in ("BSD", "ISC"):
    TEMPLATES[f"{_id}-statement"] = f"Released under the {_id} License."

WORD = re.compile(r"[a-z0-9]+")
GRAM, WINDOW, BAND = 3, 3, 12
#: Diagonals that the anchors of one region span at most: so many, or a part of a long template, through which more words may be put in or left out.
SPAN, SPAN_SHARE = 4 * BAND, 12
#: Templates of so many words are thinned more.
LONG, LONG_WINDOW = 500, 8
#: A region of a long template holds at least this share of its fingerprints; a few that any two legal texts share don't call for an alignment.
LEAST_ANCHORS = 0.1
#: Whole licence texts as published, one a file, named by their identifiers.
LICENCES = Path(__file__).parent / "licences"
#: Templates of fewer words keep all their trigrams.
SHORT = 20
MATCH, MISMATCH, GAP = 2, -1, -1


@cache
def every_template() -> dict[str, str]:
    """Notices, statements and whole licence texts."""
    return TEMPLATES | {f"{p.stem}-text": p.read_text() for p in sorted(LICENCES.glob("*.txt"))}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fingerprints(words: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[tuple[str, ...], int]]:
    """The winnowed grams of a word sequence, with their places: in each window of grams the last of least hash."""
    grams = list(zip(*(words[i:] for i in range(gram))))
    hashes = [xxhash.xxh3_64_intdigest(" ".join(g)) for g in grams]
    kept = set()
    for start in range(max(1, len(grams) - window + 1) if grams else 0):
        part = hashes[start : start + window]
        kept.add(start + len(part) - 1 - part[::-1].index(min(part)))
    return [(grams[i], i) for i in sorted(kept)]


class Index(NamedTuple):
    """Word numbers from 1, sorted gram codes, and for each code its (template, place) pairs."""

    names: list[str]
    sequences: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray
    places: list[list[tuple[int, int]]]
    #: How many anchors a region needs, for each template.
    needed: list[int]


def index_of(templates: dict[str, str]) -> Index:
    split = {name: words_of(text) for name, text in templates.items()}
    vocabulary = {w: i for i, w in enumerate(sorted({w for words in split.values() for w in words}), 1)}
    size, inverted, needed = len(vocabulary) + 1, defaultdict(list), []
    for t, words in enumerate(split.values()):
        chosen = fingerprints(words, window=1 if len(words) < SHORT else WINDOW if len(words) < LONG else LONG_WINDOW)
        needed.append(1 if len(words) < LONG else int(LEAST_ANCHORS * len(chosen)))
        for gram, at in chosen:
            code = 0
            for w in gram:
                code = code * size + vocabulary[w]
            inverted[code].append((t, at))
    codes = sorted(inverted)
    return Index(list(split), [np.array([vocabulary[w] for w in words], dtype=np.int64) for words in split.values()], vocabulary, np.array(codes, dtype=np.int64), [inverted[c] for c in codes], needed)


class Match(NamedTuple):
    template: int
    matched: int
    coverage: float
    first_word: int
    last_word: int


def align(template: np.ndarray, document: np.ndarray, offset: int, diagonal: int, band: int) -> tuple[int, int, int, int] | None:
    """Score, matched words, and the first and last place in the document of the best local alignment.

    Cells lie at most ``band`` from the diagonal (document place - template place), so a
    row of cells is an array over the band. Each cell holds its score, matches, and the
    document place where its path began; cells without a positive score are empty.
    """
    width = 2 * band + 1
    columns = np.arange(width)
    # The words of all rows, one after another; 0 is a word of no template, -1 a place outside.
    padded = np.full(len(template) + width - 1, -1, dtype=np.int64)
    low = diagonal - band - offset  # the document's index in the first row's first cell
    held = document[max(0, low) : max(0, low + len(padded))]
    padded[max(0, -low) : max(0, -low) + len(held)] = held
    score, matches, begun = (np.zeros(width, dtype=np.int64) for _ in range(3))
    best, found = 0, None
    for t, word in enumerate(template):
        row = padded[t : t + width]
        place = columns + t + diagonal - band
        same = row == word
        # From the cell before in both, which lies in the same column of the row above ...
        value = score + np.where(same, MATCH, MISMATCH)
        count = np.where(score > 0, matches, 0) + same
        start = np.where(score > 0, begun, place)
        # ... or from above alone, the template's word missing in the document ...
        above = np.append(score[1:], 0) + GAP
        better = (above > value) & (above > 0)
        value = np.where(better, above, value)
        count = np.where(better, np.append(matches[1:], 0), count)
        start = np.where(better, np.append(begun[1:], 0), start)
        same &= ~better
        value[row < 0] = 0
        # ... or from the left, words inserted in the document: the best value less a gap for each.
        reach = value - GAP * columns
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, columns, 0))
        source = np.where(value >= top + GAP * columns, columns, source)
        inserted = source != columns
        value, count, start = top + GAP * columns, count[source], start[source]
        value[(value <= 0) | (row < 0)] = 0
        score, matches, begun = value, count, start
        ends = np.where(same & ~inserted, value, 0)
        at = int(ends.argmax())
        if ends[at] > best:
            best = int(ends[at])
            found = best, int(count[at]), int(start[at]), int(place[at])
    return found


def most_matches(counts: np.ndarray, part: np.ndarray) -> int:
    """No alignment matches more words than a template and a part of a document share, order aside."""
    return int(np.minimum(counts, np.bincount(part, minlength=len(counts)))[1:].sum())


def scan(ids: np.ndarray, index: Index, least_coverage: float, band: int = BAND) -> list[Match]:
    """The matches in a document's word numbers (0: in no template), best first where spans overlap."""
    size = len(index.vocabulary) + 1
    if len(ids) < GRAM:
        return []
    at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
    codes = (ids[at] * size + ids[at + 1]) * size + ids[at + 2]
    where = np.minimum(np.searchsorted(index.codes, codes), len(index.codes) - 1)
    hits = defaultdict(list)
    for place, code in zip(at[index.codes[where] == codes].tolist(), where[index.codes[where] == codes].tolist()):
        for template, t in index.places[code]:
            hits[template].append((place - t, place))
    found = []
    for template, anchors in hits.items():
        sequence = index.sequences[template]
        needed = least_coverage * len(sequence)
        if np.count_nonzero(ids) < needed:
            continue
        counts = np.bincount(sequence, minlength=size)
        anchors.sort()
        spread = max(SPAN, len(sequence) // SPAN_SHARE)
        groups: list[list[tuple[int, int]]] = []
        # Neighbours by diagonal, up to a span, so that a licence repeated any number of times makes many small regions.
        for anchor in anchors:
            if groups and anchor[0] - groups[-1][-1][0] <= band and anchor[0] - groups[-1][0][0] <= spread:
                groups[-1].append(anchor)
            else:
                groups.append([anchor])
        # A region may hold the licence again beside what is found in it: both sides are searched too.
        regions = [(group, 0, len(ids)) for group in groups]
        while regions:
            group, least, most = regions.pop()
            if len(group) < index.needed[template]:
                continue
            low, high = group[0][0], group[-1][0]
            wide = band + (high - low + 1) // 2
            start, end = max(least, low - wide), min(most, high + len(sequence) + wide)
            if most_matches(counts, ids[start:end]) < needed:
                continue
            result = align(sequence, ids[start:end], start, (low + high) // 2, wide)
            if result:
                _, matched, first, last = result
                if matched >= needed:
                    found.append(Match(template, matched, matched / len(sequence), first, last))
                left = [a for a in group if a[1] < first]
                right = [a for a in group if a[1] > last]
                regions.extend(x for x in ((left, least, first), (right, last + 1, most)) if x[0])
    # Matched words less those unmatched in the template and inserted in the document.
    gain = lambda m: 3 * m.matched - len(index.sequences[m.template]) - (m.last_word - m.first_word + 1)
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-gain(m), -m.coverage, m.first_word, m.template)):
        # Kept matches don't overlap, so only the neighbours in order of place can overlap with this one.
        at = bisect_left(kept, m.first_word, key=lambda k: k.first_word)
        if (at == 0 or kept[at - 1].last_word < m.first_word) and (at == len(kept) or kept[at].first_word > m.last_word):
            kept.insert(at, m)
    return kept


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least_coverage: float = 0.75,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each match of ``templates`` (all that there are, if none are given): id, license, coverage, matched_words, first_word, last_word, char_start, char_end.

    Coverage is the share of the template's words that are matched in order. The span
    is given in words (from 0, of ``[a-z0-9]+`` in the lower-cased text) and in
    characters of that lower-cased text, end exclusive. Of overlapping matches the one
    stays that has most matched words less unmatched and inserted ones.

    - Null and empty texts have no match; a null id stays null.
    - Repeated rows each give their matches. A whole text is scanned, however long.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    index = index_of(every_template() if templates is None else templates)
    rows = pick(docs, id_col, text_col)
    names = (id_col, "license", "coverage", "matched_words", "first_word", "last_word", "char_start", "char_end")
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, license string, coverage double, matched_words int, first_word int, last_word int, char_start int, char_end int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocabulary.get
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                low = (text or "").lower()
                ids = np.array([get(w, 0) for w in WORD.findall(low)], dtype=np.int64)
                matches = scan(ids, index, least_coverage)
                if matches:
                    spans = [m.span() for m in WORD.finditer(low)]
                    out.extend((row, index.names[m.template], m.coverage, m.matched, m.first_word, m.last_word, spans[m.first_word][0], spans[m.last_word][1]) for m in matches)
            columns = list(zip(*out)) if out else [[]] * 8
            types = [pa.string(), pa.float64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *map(pa.array, columns[1:], types)], names=list(names))

    return rows.mapInArrow(search, schema)
