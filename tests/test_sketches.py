"""Sketches: merged estimates within their stated errors, and batches that are repeated."""

from pyspark.sql import functions as F

from datumloom.operators import sketches as sk


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select(F.expr("id % 30").alias("day"), F.expr("id % 7").alias("kind"), F.expr("id * 7919 % 20011").alias("who"), F.expr("cast(id * 37 % 60000 as double)").alias("x"))
    kept = sk.Sketched(distinct=["who"], sets=["who"], quantiles=["x"])
    roll_up = sk.RollUp(spark, str(tmp_path / "r"), kept, "day", "kind")
    for d in range(3):
        roll_up.add(f"d{d}", rows.where(F.col("day") % 3 == d))
    got = roll_up.read().select("n_rows", sk.distinct_count("who").alias("n"), sk.quantile("x", 0.25).alias("q"), F.theta_sketch_estimate("theta_who").alias("t")).first()
    assert got["n_rows"] == 60_000
    assert abs(got["n"] - 20_011) <= 4 * sk.HLL_ERROR * 20_011
    assert abs(got["t"] - 20_011) <= 4 * sk.THETA_ERROR * 20_011
    assert abs(got["q"] / 60_000 - 0.25) <= 2 * sk.KLL_ERROR


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.range(100).select(F.lit(1).alias("day"), F.col("id").alias("who"))
    roll_up = sk.RollUp(spark, str(tmp_path / "r"), sk.Sketched(distinct=["who"]), "day")
    for _ in range(3):
        roll_up.add("same", rows)
    roll_up.add("other", rows)
    assert roll_up.read("day").select("n_rows", sk.distinct_count("who").alias("n")).collect() == [(200, 100)]


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (1, 5, 2.0), (2, None, None)], "day int, who long, x double")
    kept = sk.Sketched(distinct=["who"], quantiles=["x"])
    got = kept.merged(kept.of(rows, "day"), "day").select("day", "n_rows", sk.distinct_count("who").alias("n"), sk.quantile("x", 0.5).alias("q"))
    assert sorted(map(tuple, got.where("day = 1").collect())) == [(1, 2, 1, 2.0)]
    assert got.where("day = 2").select("n_rows", "n").collect() == [(1, 0)]
    assert kept.of(rows.limit(0), "day").collect() == []
