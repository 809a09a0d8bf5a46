import re
from collections import Counter

import zstandard

from datumloom.llm import compression
from datumloom.llm.common import pick

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_base_counts_against_brute_force(documents, odd):
    for df in (documents, pick(odd, "doc_id", "text")):
        want = Counter((r.doc_id, *brute(r.text)) for r in df.collect())
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in compression.compression_bands(df).collect())
        assert got == want


def test_verdicts_follow_the_rules(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    compressor = zstandard.ZstdCompressor(level=3)
    for r in compression.compression_bands(documents).collect():
        data = texts[r.doc_id].encode()
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert abs(r.ratio - len(data) / len(compressor.compress(data))) < 1e-12
        band = next(b for b in compression.BANDS if len(data) <= b.max_bytes)
        inside = band.low <= r.ratio <= band.high and r.n_bad_chunks <= 0.3 * r.n_chunks
        assert r.kept == (inside and not r.base_failed)


def test_chunks_cover_all_bytes():
    data = bytes(range(256)) * 20
    for size in (100, 2048, 5000, 6000):
        assert b"".join(compression.chunks(data, size)) == data


def test_repetitive_and_random_passages_are_found():
    import random

    compressor = zstandard.ZstdCompressor(level=3)
    prose = " ".join(f"{random.Random(i).randrange(10**6):x}word" for i in range(2000)).encode()
    rng = random.Random(5)
    assert compression.verdict(prose, compressor)[3] is None
    assert compression.verdict(b"same words again " * 500, compressor)[3] == "repetitive"
    assert compression.verdict(rng.randbytes(20000), compressor)[3] == "incompressible"
    assert compression.verdict(prose[:9000] + b"again " * 3000 + prose[9000:], compressor)[3] in ("chunks", "repetitive")


def test_odd_rows(odd, odd_rows, none):
    rows = compression.compression_bands(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 7))
    assert {r.reason for r in rows if r.doc_id == 2} == {"empty"}
    assert compression.compression_bands(none).collect() == []
