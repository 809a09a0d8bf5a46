import zlib

import numpy as np
import pytest

from datumloom.llm import pairwise_quality as quality
from datumloom.llm import toxicity
from datumloom.llm.labelled import labelled_sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def many(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_the_sample_is_bounded_and_not_held_out(many):
    rows = labelled_sample(*many, "quality", 100).collect()
    assert 0 < len(rows) <= 100 and not any(out(r.doc_id) for r in rows)


def test_quality_on_held_out_documents(many):
    docs, labels = many
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.quality_scores(docs, labels).collect()]
    assert len(rows) == docs.count()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.99
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97


def test_quality_threshold_is_the_quantile():
    rng = np.random.default_rng(0)
    y = (rng.random(500) < 0.8).astype(int)
    x = rng.normal(size=(500, quality.N_FEATURES)) + y[:, None]
    model = quality.fit_pairs(x, y)
    scores = model.scores(model.strengths(x))
    assert (scores < 0.3).sum() == (y == 0).sum()


def test_quality_without_both_labels(many, odd, none, odd_rows):
    model = quality.fit_pairs(np.zeros((3, quality.N_FEATURES)), np.ones(3, dtype=int))
    rows = quality.score(odd, model, carry=("lang", "score")).collect()
    assert len(rows) == len(odd_rows) and {r.predicted for r in rows} == {1}
    assert quality.fit(none, many[1]).weights.any() == False  # noqa: E712
    assert quality.score(none, model).collect() == []


def test_toxicity_on_held_out_documents(many):
    docs, labels = many
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity_grades(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.expected_severity <= 3 and r.kept == (r.toxic == 0) for r in rows)
    held = [(r.toxic, truth[r.doc_id]) for r in rows if out(r.doc_id) and r.doc_id in truth]
    assert np.mean([t for t, y in held if y == 0]) < 0.01
    assert np.mean([t for t, y in held if y == 1]) > 0.9


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(1)
    n = 1500
    counts = rng.poisson(1.0, (n, 4))
    strength = counts @ np.array([2.0, -1.0, 0.0, 1.0])
    noise = rng.logistic(size=n)
    grades = np.digitize(strength + noise, [1.0, 3.0, 5.0])
    rows = [[j for j in range(4) if c[j]] for c in counts]
    values = [[float(c[j]) for j in range(4) if c[j]] for c in counts]
    w, t = toxicity.fit_ordinal(rows, values, grades, 4)
    assert np.allclose(w, [2, -1, 0, 1], atol=0.3)
    assert np.allclose(t, [1, 3, 5], atol=0.5) and (np.diff(t) > 0).all()


def test_toxicity_gradient_is_the_likelihoods():
    # Against finite differences, through the fitted optimum: no direction improves the likelihood.
    rng = np.random.default_rng(2)
    rows, values = [[0, 1]] * 200, rng.random((200, 2)).tolist()
    grades = rng.integers(0, 4, 200)
    w, t = toxicity.fit_ordinal(rows, values, grades, 2, ridge=0.0, steps=3000)

    def likelihood(w, t):
        s = np.array(values) @ w
        upper = np.hstack([np.ones((200, 1)), 1 / (1 + np.exp(t - s[:, None])), np.zeros((200, 1))])
        return np.log(upper[np.arange(200), grades] - upper[np.arange(200), grades + 1]).mean()

    best = likelihood(w, t)
    for k in range(2):
        for step in (-0.05, 0.05):
            assert likelihood(w + step * np.eye(2)[k], t) <= best + 1e-5
    for k in range(3):
        for step in (-0.05, 0.05):
            assert likelihood(w, t + step * np.eye(3)[k]) <= best + 1e-5


def test_toxicity_odd_rows(many, odd, odd_rows, none):
    model = toxicity.fit(*many, max_rows=500)
    rows = toxicity.grade(odd, model, carry=("lang", "kept")).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.kept for r in rows if r.doc_id in (2, 3, 7))
    assert toxicity.grade(none, model).collect() == []
    nothing = toxicity.fit(none, many[1])
    assert all(r.kept for r in toxicity.grade(odd, nothing).collect())


def test_an_id_with_many_rows_counts_once(spark):
    rows = [(i, f"word{i % 7} text {t}") for i in range(60) for t in ([0] if i % 3 else range(50))]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = labelled_sample(docs, marks, "quality", 1000).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in sample) == [(i, f"word{i % 7} text 0", i % 2) for i in range(60) if not out(i)]
    models = [quality.fit(docs.repartition(n), marks) for n in (1, 7)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_severity_by_hand_and_rising_with_toxic_words(spark, many):
    docs, labels = many
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    # A toxic word of a held-out document: the one of most weight among its features.
    text = next(r.text for r in docs.orderBy("doc_id").collect() if r.doc_id in toxic and out(r.doc_id))
    weight = lambda w: sum(model.weights[model.vocabulary[p]] for p in toxicity.parts(w) if p in model.vocabulary)
    words = toxicity.WORD.findall(text.lower())
    worst, plain = max(words, key=weight), [w for w in words if abs(weight(w)) < 0.01][:20]
    texts = [" ".join(plain + [worst] * n) for n in (0, 1, 3, 9)]
    rows = toxicity.grade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    severities = [r.expected_severity for r in rows]
    assert severities == sorted(severities) and severities[0] < 0.5 < severities[-1]
    for text, row in zip(texts, rows):
        found = {}
        for w in toxicity.WORD.findall(text):
            for p in toxicity.parts(w):
                if p in model.vocabulary:
                    found[p] = found.get(p, 0) + 1
        strength = sum(model.weights[model.vocabulary[p]] * (1 + np.log(n)) for p, n in found.items())
        chances = 1 / (1 + np.exp(model.thresholds - strength))
        assert np.isclose(row.expected_severity, chances.sum()) and np.isclose(row.p_toxic, chances[0]) and row.kept == (chances[0] < model.cut)


def test_one_character_changes_no_feature_much():
    text = "SOME Words in Capitals AND others. " * 30
    for extra in ("\u0130", "\u03a3", "\u1e9e", "x", "X"):
        assert quality.capitals(text + extra) - quality.capitals(text) == (extra != extra.lower())
    assert quality.capitals("\u0130A\u03a3b") == 3 and quality.capitals("") == 0
    assert np.allclose(quality.features(text + "\u0130"), quality.features(text + "X"), atol=0.2)
