import numpy as np
import pytest

from datumloom.llm import graph_search as gs

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, vector string"


def brute(rows, every, k):
    out = {}
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, x in usable:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in usable if i != q and len(x) == len(y))
            out[q] = near[:k]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 100, 10)
    got = {}
    for r in gs.nearest(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, near in want.items():
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for _, v in near})
    assert hits >= 0.9 * 10 * len(want)


def test_recall_in_one_large_shard():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    edges, entries = gs.build(x)
    found, _ = gs.beam_search(x, edges, entries, x[:100], gs.SEARCH_BEAM)
    true = np.argsort(((x[:100, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10].tolist())) / 10 for a, b in zip(true, found)]) > 0.9


def test_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], dtype=np.float32)
    kept = gs.robust_prune(points, np.array([0]), np.array([[3, 2, 1, 1, 0, -1]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def test_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 60)] + [(200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, []), (None, same), (800, [3.0, 4.0]), (900, [1.0, 2.0, 3.0]), (801, [3.0, 4.5]), (800, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = {}
    for r in gs.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 800}
    assert sorted(got[0]) == [(n, n, 0.0) for n in range(1, 11)]
    assert [v for _, v, _ in sorted(got[800])][0] == 801
    assert [v for _, v, _ in sorted(got[800])][1:] == list(range(9))
    assert gs.nearest(df.where("false")).collect() == []


def test_vectors_of_any_size_and_place(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 16))
    for size, shift in ((1e25, 0), (1e-25, 0), (1e300, 0), (1e-300, 0), (1.0, 1e6)):
        x = base * size + shift
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6000, (x[5] * 1000).tolist())]
        got = {}
        for r in gs.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        y = np.array([v for _, v in rows]) - shift
        hits = 0
        for q in got:
            d = np.sqrt((((y - y[-1 if q == 6000 else q]) / size) ** 2).sum(1))
            d[-1 if q == 6000 else q] = np.inf
            found = sorted(got[q])
            assert [r for r, _, _ in found] == list(range(1, 11))
            assert np.allclose([s / size for _, _, s in found], [d[-1 if v == 6000 else v] for _, v, _ in found], rtol=1e-6)
            hits += len({v for _, v, _ in found} & {rows[i][0] for i in np.argsort(d)[:10]})
        assert set(got) == {0, 100, 200, 300, 400, 500, 6000} and hits >= 0.95 * 70


def recall(spark, x, every=100):
    """The share of true ten nearest found, by brute force in double precision; equal scores count alike."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in gs.nearest(df, every=every).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hits, total = 0, 0
    for q in range(0, len(x), every):
        true = gs.distances_to(x, x[q])
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == true[v] and v != q for _, s, v in found)
        assert [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        limit = np.sort(np.delete(true, q))[9]
        hits += sum(s <= limit for _, s, _ in found)
        total += 10
    return hits / total


def mixed(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    if name.startswith("outlier"):
        x[77] *= float(name.split()[1])
        x[100] *= float(name.split()[1])
    elif name == "eight outliers":
        x[rng.choice(2000, 8, replace=False)] *= 1e20
    elif name == "two groups":
        x[::2] += 1e9
    elif name == "twenty tight groups":
        x = 100 * rng.normal(size=(20, 16))[rng.integers(20, size=2000)] + 1e-6 * x
    elif name == "hundred tight groups":
        x = 100 * rng.normal(size=(100, 16))[rng.integers(100, size=2000)] + 1e-6 * x
    elif name == "all sizes":
        x *= 10.0 ** rng.uniform(-300, 300, size=(2000, 1))
    elif name == "sizes nearby":
        x *= 10.0 ** rng.uniform(-8, 8, size=(2000, 1))
    return x


@pytest.mark.parametrize("name", ["outlier 1e3", "outlier 1e10", "outlier 1e20", "outlier 1e30", "outlier 1e300", "eight outliers", "two groups", "twenty tight groups", "hundred tight groups", "all sizes", "sizes nearby"])
def test_mixed_sizes_and_places(spark, name, monkeypatch):
    assert recall(spark, mixed(name)) >= 0.95
    monkeypatch.setattr(gs, "LEAST_SHARDS", 1)
    assert recall(spark, mixed(name)) >= 0.95
