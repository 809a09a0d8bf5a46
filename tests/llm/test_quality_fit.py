import zlib

import numpy as np
import pytest

from datumloom.llm import labelled
from datumloom.llm import pairwise_quality as quality

SF = "/root/testdata/sf0.1"


def test_all_labelled_rows_are_taken(spark, monkeypatch):
    """More labelled documents than the earlier limit of 20,000, by a broadcast and by a shuffled join."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    marks = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    want = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 5]
    assert len(want) > 20_000
    for limit in (1_000_000, 10):
        monkeypatch.setattr(labelled, "BROADCAST_IDS", limit)
        assert sorted(r.doc_id for r in labelled.labelled_sample(docs, marks, "quality", None).select("doc_id").collect()) == want


def test_the_gradient_is_that_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.7).astype(int)
    z = rng.normal(size=(60, quality.N_FEATURES)) + 0.3 * y[:, None]
    seen = []
    monkeypatch.setattr(quality, "descend", lambda gradient, size: seen.append(gradient) or np.zeros(size))
    monkeypatch.setattr(quality, "BINS", 20_001)
    quality.pair_weights(z, y, 1e-3)
    w = rng.normal(size=quality.N_FEATURES)
    pairs = [g - b for g in z[y == 1] for b in z[y == 0]]
    plain = 1e-3 * w - sum(d / (1 + np.exp(d @ w)) for d in pairs) / len(pairs)
    assert np.allclose(seen[0](w), plain, atol=1e-3)


def test_blocks_learn_as_one_piece_does(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "BLOCK", 1_000)
    models = [quality.fit(docs.repartition(n, "doc_id"), labels) for n in (2, 5)]
    assert np.array_equal(models[0].weights, models[1].weights) and (models[0].threshold, models[0].slope) == (models[1].threshold, models[1].slope)
    assert np.allclose(models[0].mean, whole.mean) and np.allclose(models[0].scale, whole.scale)
    both = [quality.score(docs, m).where("held_out").orderBy("doc_id").select("doc_id", "score", "predicted").collect() for m in (whole, models[0])]
    assert np.mean([a.predicted == b.predicted for a, b in zip(*both)]) > 0.98
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in both[1] if r.doc_id in truth]) > 0.97


def test_values_of_a_rank(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 20)
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.normal(size=3_000), np.full(200, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(v),) for v in s], "s double")
    for rank in (0, 1, 1500, int((s < 0.25).sum()) + 100, len(s) - 1):
        assert quality.ranked(df, rank) == pytest.approx(np.sort(s)[rank], abs=0)
