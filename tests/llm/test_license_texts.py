import time

import numpy as np
import pytest

from datumloom.llm import license_scan as scan


def names(text):
    index = scan.index_of(scan.TEMPLATES)
    ids = np.array([index.vocabulary.get(w, 0) for w in scan.words_of(text)], dtype=np.int64)
    return [(index.names[m.template], m.coverage) for m in scan.scan(ids, index, 0.75)]


GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text,want",
    [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        (GNU.format(";", "General Public License", "2"), "GPL-2.0"),
        (GNU.format(":", "General Public License", "3"), "GPL-3.0"),
        (GNU.format(":", "Lesser General Public License", "3"), "LGPL-3.0"),
        (GNU.format(":", "Affero General Public License", "3"), "AGPL-3.0"),
        ("Released under the MIT Licence.", "MIT"),
        ("Distributed under the MIT License.", "MIT"),
        ("Released under the BSD License.", "BSD"),
        (scan.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"),
        (scan.TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"),
    ],
)
def test_siblings_are_told_apart(text, want):
    found = names(f"Some words before. {text} And others behind.")
    assert len(found) == 1 and found[0][0].removesuffix("-statement").removesuffix("-notice").removesuffix("-name") == want


def plain_score(template, document):
    """The best local alignment's score that ends in a match, over all cells."""
    best, before = 0, [0] * (len(document) + 1)
    for word in template:
        row = [0]
        for d, other in enumerate(document, 1):
            step = scan.MATCH if word == other else scan.MISMATCH
            row.append(max(0, before[d - 1] + step, before[d] + scan.GAP, row[d - 1] + scan.GAP))
            if word == other:
                best = max(best, before[d - 1] + step)
        before = row
    return best


def test_alignment_against_all_cells():
    rng = np.random.default_rng(3)
    for _ in range(300):
        template, document = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        offset = int(rng.integers(0, 4))
        got = scan.align(template, document, offset, offset, 16)
        assert (got[0] if got else 0) == plain_score(template.tolist(), document.tolist())
        if got:
            _, matched, first, last = got
            assert offset <= first <= last < offset + len(document) and matched <= last - first + 1
            # Each match adds 2 at most, and what the span holds beside matches takes 1 at least.
            assert got[0] <= 2 * matched - (last - first + 1 - matched)


def test_one_word_edits_of_every_template_are_found():
    index = scan.index_of(scan.TEMPLATES)
    missed = []
    for name, text in scan.TEMPLATES.items():
        words = scan.words_of(text)
        if not 2 * scan.GRAM < len(words) <= 25:  # in shorter ones an edit may leave no trigram
            continue
        for i in range(len(words)):
            for edited in ([*words[:i], "qqq", *words[i + 1 :]], [*words[:i], *words[i + 1 :]], [*words[:i], "qqq", *words[i:]]):
                covered = sum(w != "qqq" for w in edited) / len(words)
                ids = np.array([index.vocabulary.get(w, 0) for w in ["x", *edited, "y"]], dtype=np.int64)
                if covered >= 0.75 and not scan.scan(ids, index, 0.75):
                    missed.append((name, i, edited))
    assert missed == []


def test_repeated_statements_take_linear_time_and_are_all_found():
    index = scan.index_of(scan.TEMPLATES)
    took = []
    for n in (100, 1600):
        ids = np.array([index.vocabulary.get(w, 0) for w in scan.words_of(scan.TEMPLATES["MIT-statement"]) * n], dtype=np.int64)
        began = time.process_time()
        assert len(scan.scan(ids, index, 0.75)) == n
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0]


@pytest.fixture(scope="module")
def everything():
    return scan.index_of(scan.every_template())


def found_in(index, text):
    ids = np.array([index.vocabulary.get(w, 0) for w in scan.words_of(text)], dtype=np.int64)
    return [(index.names[m.template], m.coverage, m.first_word, m.last_word) for m in scan.scan(ids, index, 0.75)]


FULL = sorted(n for n in scan.every_template() if n not in scan.TEMPLATES)


@pytest.mark.parametrize("name", FULL)
def test_whole_texts_are_found_as_they_are_and_edited(everything, name):
    text = scan.every_template()[name]
    n = len(scan.words_of(text))
    assert found_in(everything, f"some words before {text} and others behind")[0] == (name, 1.0, 3, n + 2)
    rng = np.random.default_rng(len(name))
    edited = []
    for i, paragraph in enumerate(text.split("\n\n")):
        words = paragraph.split()
        if words:
            at = int(rng.integers(len(words)))
            words[at : at + 1] = [["replaced"], [], [words[at], "inserted"]][i % 3]
        edited.append(" ".join(words))
    found = found_in(everything, "\n\n".join(edited))
    assert found[0][0] == name and found[0][1] > 0.9


def test_text_without_licences_is_left_alone(everything):
    words = scan.words_of(" ".join(scan.every_template()[n] for n in FULL))
    mixed = np.random.default_rng(4).permutation(words)
    assert [f for f in found_in(everything, " ".join(mixed)) if f[0] in FULL] == []
    began = time.process_time()
    assert found_in(everything, "the people of the country in the name of the law and any of the other rights of this kind " * 500) == []
    assert time.process_time() - began < 20
