"""SimHash links against all pairs: fingerprints by hand, thresholds that can't miss, crowded buckets."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from datumloom.llm import simhash as sh

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint_by_hand(text, k=3):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(nodes):
    """Of (id, fingerprint): each id's least reachable id, over ids in common and fingerprints at most 2 bits apart."""
    up = {i: i for i, _ in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (x, f) in enumerate(nodes):
        for y, g in nodes[:i]:
            if (f ^ g).bit_count() <= 2:
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in nodes}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def linked(spark, fps, limit):
    values = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, node long").repartition(3)
    found = sh.components(sh.links(values, limit=limit))
    return {**{i: i for i in range(len(fps))}, **{r["node"]: r["component"] for r in found.collect()}}


def crowd(n, seed, spread=5, around=3):
    """Distinct fingerprints: some anywhere, many a few bits from a few centres, some alike in half of their bits."""
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 2**63, around)]
    out = {int(x) for x in rng.integers(0, 2**63, n // 4)} | {(centres[0] & 0xFFFFFFFF) | (int(x) << 32) for x in rng.integers(0, 2**32, n // 4)}
    while len(out) < n:
        f = centres[int(rng.integers(around))]
        for b in rng.integers(0, 64, int(rng.integers(spread))):
            f ^= 1 << int(b)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \n\t\v", "One", "one TWO", "a b c", "Ünïcödé É\x1cx 日本語 \x85 b c d", "the same words the same words the same words", "w " * 70_000])
def test_fingerprints(text):
    assert sh.fingerprint(text) == fingerprint_by_hand(text)


@pytest.mark.parametrize(("limit", "seed"), [(64, 1), (2, 2), (0, 3)])
def test_links_equal_those_of_all_pairs(spark, limit, seed):
    fps = crowd(600, seed)
    assert linked(spark, fps, limit) == components_by_hand(list(enumerate(fps)))


def test_large_buckets_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(sh, "BROADCAST_KEYS", 0)
    fps = crowd(400, 4)
    assert linked(spark, fps, 4) == components_by_hand(list(enumerate(fps)))


def test_constant_bits_and_few_fingerprints(spark):
    for fps in ([0], [0, 3], [0, 7], [0, 1, 2, 4, 8, 7, 2**64 - 1, 2**64 - 2]):
        assert linked(spark, fps, 64) == components_by_hand(list(enumerate(fps)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2), st.sampled_from(sh.PARTS), st.integers(0, 2**32))
def test_thresholds_miss_no_pair(f, flips, m, seed):
    g = f
    for b in flips:
        g ^= 1 << b
    rng = np.random.default_rng(seed)
    bits = rng.permutation(64).tolist()
    groups = [bits[i : i + 8] for i in range(0, 64, 8)]
    parts = [list(range(8))[i::m] for i in range(m)]
    near = rng.integers(0, 1000, (8, 256, 3))
    plan = sh.Plan(groups, parts, near, 1000, 2)
    units, cost = sh.allocated(plan.costs(np.array([f, g], dtype=np.uint64)))
    assert (units.sum(axis=1) == 3).all()
    costs = plan.costs(np.array([f, g], dtype=np.uint64))
    assert np.allclose(cost, [sum(costs[i, p, units[i, p]] for p in range(m)) for i in range(2)])
    assert any(((f ^ g) & int(plan.mask(p))).bit_count() <= units[0, p] - 1 for p in range(m))
    # No other way to deal three units is cheaper.
    ways = [(a, b, 3 - a - b) if m == 3 else (a, 3 - a) for a in range(4) for b in range(4 - a)] if m < 4 else []
    assert all(sum(costs[0, p, w[p]] for p in range(m)) >= cost[0] - 1e-6 for w in ways)


def test_groups_hold_correlated_bits():
    rng = np.random.default_rng(5)
    source = rng.integers(0, 2, (4000, 8))
    bits = np.concatenate([np.where(rng.random((4000, 8)) < 0.9, source, 1 - source) for _ in range(8)], axis=1)
    fps = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    counted = (sh.bits_of(fps).astype(np.int64).T @ sh.bits_of(fps)).ravel()
    groups = sh.grouped(sh.correlations(counted, len(fps)), [8] * 8)
    assert sorted(map(tuple, groups)) == [tuple(range(i, 64, 8)) for i in range(8)]


def test_documents_and_odd_rows(spark, documents, odd, odd_rows):
    for df, rows in ((documents, [tuple(r) for r in documents.select("doc_id", "text").collect()]), (odd, [(r[0], r[1]) for r in odd_rows])):
        nodes = [(i, fingerprint_by_hand(t)) for i, t in rows]
        least = components_by_hand([x for x in nodes if x[0] is not None])
        expected = sorted(((i, f"{f:016x}", least.get(i)) for i, f in nodes), key=repr)
        for n in (1, 6):
            assert sorted(map(tuple, sh.near_duplicates(df.repartition(n)).collect()), key=repr) == expected


def test_an_empty_table_gives_nothing(none):
    assert sh.near_duplicates(none).collect() == []
