import random
import re
from itertools import combinations

import numpy as np

from datumloom.llm import near_dedup as nd
from datumloom.llm.components import components


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        grams = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
        sets.setdefault(i, []).append(grams)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, sets


def near_copies(n, seed, words=120, edits=6):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randrange(edits)):
            copy[rnd.randrange(words)] = f"x{rnd.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def compare(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute(rows, k)
    got = nd.near_duplicates(df, k=k).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) and r.n_shingles in {len(s) for s in sets[r.doc_id]} for r in got)
    return want


def test_against_brute_force(spark, monkeypatch):
    texts = near_copies(60, 1, edits=9) + near_copies(25, 2) + [f"only {i} here and nothing {i} else" for i in range(20)] + ["Same Text", "same text", "same", "SAME", "", None]
    random.Random(0).shuffle(texts)
    # Ids with two texts tie their groups together.
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[5]), (3, texts[7])]
    want = compare(spark, rows, 2)
    assert len(set(want.values())) < len(want)
    # The same through stars and many blocks.
    monkeypatch.setattr(nd, "STAR_FROM", 4)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 1500)
    compare(spark, rows, 2)


def test_odd_rows(odd, odd_rows, none):
    rows = nd.near_duplicates(odd, k=5).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 1 and not by[5].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[7].n_shingles == 0 and by[2].kept and by[3].component_id == 3
    assert by[None].component_id is None and by[None].kept
    assert nd.near_duplicates(none).collect() == []


def test_bounds_prune_only_the_unlikely():
    rng = np.random.default_rng(0)
    bounds = nd.least_agreement(0.8, 1e-6)
    assert [n for n, _ in bounds][-1] == 200 and all(a[1] <= b[1] for a, b in zip(bounds, bounds[1:]))
    a = rng.integers(0, 256, (4000, 200)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    every = np.arange(4000)
    assert len(nd.surviving(a, b, every, every, bounds)[0]) == 4000
    c = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert len(nd.surviving(a, c, every, every, bounds)[0]) < 40


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, left, right = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    a, b = nd.signature(np.r_[common, left]), nd.signature(np.r_[common, right])
    assert abs((a == b).mean() - 0.6) < 0.12


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (500, 400)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_a_large_star_of_long_texts(spark, monkeypatch):
    """Near copies of one text in one bucket: its centre's set is sent to salted parts, and nothing is lost."""
    monkeypatch.setattr(nd, "STAR_FROM", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(1500)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([3, 40, 90])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    compare(spark, rows, 2)
