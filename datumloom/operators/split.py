"""Splits into train, test and validation: random, stratified, by time; and repair of references across splits.

Rows are ordered by a seeded hash of their key, so a split is the same on any
partitioning. Cut points are floors of shares of the row count. Ranks in one order are
found by ranges of the hash, so no task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.registry import query, table

TRAIN, TEST = 0.7, 0.15


def label(rank: Column, n: Column) -> Column:
    """train up to floor(0.7 n), test up to floor(0.85 n), then validation; ranks from 1."""
    train, test = F.floor(n * TRAIN), F.floor(n * (TRAIN + TEST))
    return F.when(rank <= train, "train").when(rank <= test, "test").otherwise("validation")


_LABEL = "CASE WHEN rank <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'test' ELSE 'validation' END AS split"


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


#: Rows that a bucket should hold at most, on average.
BUCKET_ROWS = 1_000_000


def digits(n_rows: int) -> int:
    """Hex digits of a hash that name a bucket: 2 (256 buckets) to 5, so that buckets stay small as tables grow."""
    found = 2
    while found < 5 and n_rows > BUCKET_ROWS * 16**found:
        found += 1
    return found


def ranked(df: DataFrame, order: Column, bucket: Column, strata: tuple[str, ...] = ()) -> DataFrame:
    """Each row's place _rank in the order, within its stratum, and the stratum's size _n.

    ``bucket`` must rise with ``order``. A row's place is its place in its bucket plus the
    rows of earlier buckets, so each task sorts a bucket of a stratum.
    """
    rows = df.withColumn("_order", order).withColumn("_bucket", bucket)
    keys = [*strata, "_bucket"]
    stratum = Window.partitionBy(*strata)
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_c")).select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(stratum).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    return rows.join(counts, keys).withColumn("_rank", place + F.col("_before")).drop("_order", "_bucket", "_before")


def random_split(df: DataFrame, key: str, seed: int = 42, strata: tuple[str, ...] = ()) -> DataFrame:
    h = hash_key(key, seed)
    done = ranked(df, F.struct(h, F.col(key)), F.substring(h, 1, digits(df.count())), strata)
    return done.withColumn("split", label(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")


def temporal_split(df: DataFrame, time: str, key: str) -> DataFrame:
    """By time, a null time counting as the start of 1970, ties by key.

    Buckets lie between approximate quantiles of time, and between those of the key where
    one time fills several of them, so neither a busy month nor one time is a single task.
    """
    at = F.coalesce(F.col(time).cast("timestamp"), F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    n_buckets = max(1, min(512, -(-df.count() // BUCKET_ROWS)))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    if shares:
        seconds, keys = F.unix_micros(at), F.col(key).cast("long")
        cuts = df.agg(F.percentile_approx(seconds, shares, 100_000).alias("t"), F.percentile_approx(keys, shares, 100_000).alias("k")).first()
        heavy = sorted({t for t in cuts["t"] if cuts["t"].count(t) > 1})
        at_most = lambda x, bounds: F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= x)) if bounds else F.lit(0)
        part = F.when(seconds.isin(heavy), at_most(keys, sorted(set(cuts["k"])))).otherwise(0) if heavy else F.lit(0)
        bucket = F.struct(at_most(seconds, sorted({*cuts["t"], *(h + 1 for h in heavy)})), part)
    else:
        bucket = F.struct(F.lit(0), F.lit(0))
    done = ranked(df, F.struct(at, F.col(key)), bucket)
    return done.withColumn("split", label(F.col("_rank"), F.col("_n"))).drop("_rank", "_n")


_RANDOM = f"SELECT o_orderkey, {_LABEL} FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rank, count(*) OVER () AS n FROM orders) r"


@query("split_random", _RANDOM)
def split_random(spark, sf_dir):
    return random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("split_stratified", f"SELECT o_orderkey, o_orderstatus, {_LABEL} FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) r")
def split_stratified(spark, sf_dir):
    return random_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", strata=("o_orderstatus",))


@query("split_temporal", f"SELECT o_orderkey, {_LABEL} FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank, count(*) OVER () AS n FROM orders) r")
def split_temporal(spark, sf_dir):
    return temporal_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "split")


def repair(child: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose reference is null or lies in the same split; both sides have ``split``."""
    known = parents.select(F.col(key).alias(column), "split")
    return child.join(known, [column, "split"], "left_semi").unionByName(child.where(F.col(column).isNull()))


_ITEMS = "SELECT l_orderkey, l_partkey, CASE WHEN substr(md5('42|' || l_partkey), 1, 1) < 'b' THEN 'train' WHEN substr(md5('42|' || l_partkey), 1, 1) < 'e' THEN 'test' ELSE 'validation' END AS split FROM lineitem"


@query("split_fk_repair", f"SELECT i.l_orderkey, i.l_partkey, i.split FROM ({_ITEMS}) i WHERE EXISTS (SELECT 1 FROM ({_RANDOM}) o WHERE o.o_orderkey = i.l_orderkey AND o.split = i.split)")
def split_fk_repair(spark, sf_dir):
    """Items, split by part, that lie in the split of their order."""
    first = F.substring(hash_key("l_partkey", 42), 1, 1)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(first < "b", "train").when(first < "e", "test").otherwise("validation").alias("split"))
    return repair(items, "l_orderkey", split_random(spark, sf_dir), "o_orderkey").select("l_orderkey", "l_partkey", "split")
