"""Joins on time against loops over all pairs: ties, nulls, hot keys, intervals of any length."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from datumloom.operators import timed_joins as tj

START = dt.datetime(2024, 1, 1)


def time(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def key_of(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize(("strict", "tolerance", "stretches"), [(False, None, 1), (False, None, 9), (True, None, 9), (False, 40, 4), (True, 0.5, 6)])
def test_as_of_equals_a_loop(spark, strict, tolerance, stretches):
    rng = random.Random(stretches)
    # A hot key holds two thirds of all rows, and many times are equal.
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(0, 400, 4)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(0, 400, 5)]), rng.choice([None, *range(9)]), i % 5) for i in range(200)]
    a = spark.createDataFrame([(i, k, time(s)) for i, k, s in left], "id long, k long, t timestamp")
    b = spark.createDataFrame([(k, time(s), v, w) for k, s, v, w in right], "k long, u timestamp, v long, w long")
    got = tj.as_of(a, b, ["k"], "t", "u", ["v", "w"], strict, tolerance, stretches)
    expected = []
    for i, k, s in left:
        found = [(t, -1 if v is None else v, v, w) for q, t, v, w in right if q == k and None not in (k, s, t) and (t < s if strict else t <= s)]
        best = max(found, key=lambda f: (f[0], f[1], f[3]), default=None)
        if best and tolerance is not None and s - best[0] > tolerance:
            best = None
        expected.append((i, k, time(s), *(best[2:] if best else (None, None))))
    assert sorted(map(tuple, got.collect()), key=key_of) == sorted(expected, key=key_of)


def test_as_of_without_rows(spark):
    a = spark.createDataFrame([(1, 1, START)], "id long, k long, t timestamp")
    b = spark.createDataFrame([], "k long, u timestamp, v long")
    assert [tuple(r) for r in tj.as_of(a, b, ["k"], "t", "u", ["v"], stretches=3).collect()] == [(1, 1, START, None)]
    assert tj.as_of(a.limit(0), b, ["k"], "t", "u", ["v"]).collect() == []


def test_no_stretch_holds_a_hot_key(spark):
    a = spark.range(4000).select("id", F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"))
    bounds = tj.stretch_bounds(a.select(tj.micros(F.col("t")).alias("_t")), "_t", 8)
    assert len(bounds) == 7
    assert max(b - a for a, b in zip(bounds, bounds[1:])) < 4000 / 8 * 1.3 * 1_000_000


@pytest.mark.parametrize(("width", "salts"), [(1, 1), (60, 3), (100_000, 2)])
def test_intervals_equal_a_loop(spark, width, salts):
    rng = random.Random(width)
    spans = []
    for i in range(120):
        s = rng.randrange(5000)
        spans.append((i, rng.choice([1, 1, 1, 2, None]), s, rng.choice([None, s, s + 1, s + rng.randrange(100), s + rng.randrange(100_000), s - 5, s + 4 * width, s + 16 * width])))
    points = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, rng.randrange(6000)])) for i in range(150)]
    a = spark.createDataFrame([(i, k, time(s), time(e)) for i, k, s, e in spans], "i long, k long, s timestamp, e timestamp")
    b = spark.createDataFrame([(j, k, time(t)) for j, k, t in points], "j long, k long, t timestamp")
    got = tj.in_interval(a, b, ["k"], "s", "e", "t", width, salts)
    expected = [(i, j) for i, k, s, e in spans for j, q, t in points if k == q and None not in (k, e, t) and s <= t <= e]
    assert sorted(map(tuple, got.select("i", "j").collect())) == sorted(expected)

    c = a.select(F.col("i").alias("j"), "k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    both = tj.overlapping(a, c, ["k"], ("s", "e"), ("s2", "e2"), width, salts).select("i", "j")
    expected = [(i, j) for i, k, s, e in spans for j, q, u, f in spans if k == q and None not in (k, e, f) and s <= e and u <= f and s <= f and u <= e]
    assert sorted(map(tuple, both.collect())) == sorted(expected)


def test_the_longest_interval_has_few_bins(spark):
    a = spark.createDataFrame([(1, 1, START, START + dt.timedelta(days=40_000))], "i long, k long, s timestamp, e timestamp")
    b = spark.createDataFrame([(1, 1, START + dt.timedelta(days=7))], "j long, k long, t timestamp")
    joined = tj.in_interval(a, b, ["k"], "s", "e", "t", width=0.001)
    assert joined.count() == 1
