"""Operators without SQL against plain forms of their methods: differencing with whole tuples, scores from features by the formula."""

import heapq
import math
import zlib

import numpy as np
import pytest

from datumloom.llm import packing
from datumloom.llm import pairwise_quality as quality


def differenced(sizes, m):
    """Karmarkar-Karp with all m sums of each partial partition: largest sums of one with the smallest of the other."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [(-sizes[i] if m > 1 else 0, made, [sizes[i]] + [0] * (m - 1)) for made, i in enumerate(order)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted((x + y for x, y in zip(sorted(a), sorted(b, reverse=True))), reverse=True)
        heapq.heappush(heap, (-(both[0] - both[-1]), made, both))
        made += 1
    return sorted(heap[0][2])


@pytest.mark.parametrize("seed", range(30))
def test_differencing_gives_the_sums_of_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [10, 100, 513][seed % 3], int(rng.integers(1, 60)))
    for m in {1, 2, 3, int(rng.integers(1, 12)), len(sizes)}:
        window = packing.difference(sizes, m)
        assert sorted(np.bincount(window, weights=sizes, minlength=m).astype(int).tolist()) == differenced(sizes.tolist(), m)


def test_scores_are_the_formula_of_the_features(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = (np.array(quality.features(r.text or "")) - model.mean) / model.scale
        strength = sum(w * min(8.0, max(-8.0, v)) for w, v in zip(model.weights, x))
        z = model.slope * (strength - model.threshold) + math.log(model.cut / (1 - model.cut))
        score = 1 / (1 + math.exp(-z)) if z > -500 else 0.0
        found = got[r.doc_id]
        assert found.score == pytest.approx(score, abs=1e-9)
        assert found.predicted == (found.score >= 0.3) and found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
