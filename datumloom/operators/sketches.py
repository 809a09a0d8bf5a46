"""Mergeable approximate aggregates: sketches kept as rows by fine keys, and merged to coarser ones later.

Exact distinct counts, set overlaps and quantiles can't be added up over days; their
sketches can. A roll-up holds a row for each key (such as a day and a type) with a
count, HyperLogLog sketches of distinct values, theta sketches of sets and KLL sketches
of numbers. Any later question is answered from these rows alone, of bounded size each,
without reading the data again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.registry import query, table
from datumloom.sources.dumps import scratch

#: Binary logarithm of an HLL sketch's registers; its relative standard error is 1.04 / 2 ** (12 / 2).
HLL_LG = 12
HLL_ERROR = 1.04 / 2 ** (HLL_LG / 2)
#: Binary logarithm of a theta sketch's entries; its relative standard error is 1 / 2 ** (12 / 2).
THETA_LG = 12
THETA_ERROR = 1 / 2 ** (THETA_LG / 2)
#: Size of a KLL sketch; a quantile's rank is within this share of its own with 99 % confidence.
KLL_K = 400
KLL_ERROR = 0.0133


@dataclass(frozen=True)
class Sketched:
    """What a roll-up keeps beside its row count: columns for distinct counts, for sets, and for quantiles (read as doubles)."""

    distinct: Sequence[str] = ()
    sets: Sequence[str] = ()
    quantiles: Sequence[str] = ()

    def of(self, rows: DataFrame, *by: str) -> DataFrame:
        """by, n_rows, hll_<column>, theta_<column>, kll_<column>: sketches of the rows of each key, built before the shuffle and merged after it.

        Nulls count in ``n_rows`` alone; a sketch of nothing is empty, or null where there is no number.
        """
        return rows.groupBy(*by).agg(
            F.count("*").alias("n_rows"),
            *(F.hll_sketch_agg(c, HLL_LG).alias(f"hll_{c}") for c in self.distinct),
            *(F.theta_sketch_agg(c, THETA_LG).alias(f"theta_{c}") for c in self.sets),
            *(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"kll_{c}") for c in self.quantiles),
        )

    def merged(self, sketches: DataFrame, *by: str) -> DataFrame:
        """The same columns for fewer keys."""
        return sketches.groupBy(*by).agg(
            F.sum("n_rows").alias("n_rows"),
            *(F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in self.distinct),
            *(F.theta_union_agg(f"theta_{c}", THETA_LG).alias(f"theta_{c}") for c in self.sets),
            *(F.kll_merge_agg_double(f"kll_{c}", KLL_K).alias(f"kll_{c}") for c in self.quantiles),
        )


class RollUp:
    """Sketches in a folder, a sub-folder for each batch of rows.

    A batch that is added again replaces itself, so a job that fails and is repeated
    counts nothing twice. Keys may occur in any number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, sketched: Sketched, *by: str):
        self.spark, self.path, self.sketched, self.by = spark, path, sketched, by

    def add(self, batch: str, rows: DataFrame) -> None:
        self.sketched.of(rows, *self.by).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, *by: str) -> DataFrame:
        """The sketches of all batches, merged to these keys."""
        return self.sketched.merged(self.spark.read.parquet(self.path), *by)


def distinct_count(column: str) -> Column:
    return F.hll_sketch_estimate(f"hll_{column}")


def quantile(column: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(f"kll_{column}", F.lit(share))


def overlap(left: str, right: str) -> Column:
    """How many values are in both of two theta sketches' sets."""
    return F.theta_sketch_estimate(F.theta_intersection(left, right))


def within(estimate: Column, exact: Column, error: float) -> Column:
    """Whether an estimate lies within four standard errors of the exact number, or within 1 of it."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), 4 * error * exact)


def daily_events(spark: SparkSession, sf_dir: str) -> RollUp:
    """The events by day and type, added in two batches, the second of them twice."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    roll_up = RollUp(spark, scratch(spark, "roll-up"), Sketched(distinct=("user_id", "event_id"), sets=("user_id",), quantiles=("value",)), "day", "event_type")
    odd = F.col("event_id") % 2 == 1
    roll_up.add("even", events.where(~odd))
    for _ in range(2):
        roll_up.add("odd", events.where(odd))
    return roll_up


@query(
    "sketch_distinct",
    """SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, TRUE AS users_within, TRUE AS events_within FROM events GROUP BY event_type""",
)
def sketch_distinct(spark, sf_dir):
    """Distinct users and events by type, from daily sketches, beside the exact counts and whether they agree within the stated error."""
    merged = daily_events(spark, sf_dir).read("event_type").select("event_type", "n_rows", distinct_count("user_id").alias("e_users"), distinct_count("event_id").alias("e_events"))
    exact = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
    return merged.join(exact, "event_type").select(
        "event_type", "n_rows", "users", "events",
        within(F.col("e_users"), F.col("users"), HLL_ERROR).alias("users_within"),
        within(F.col("e_events"), F.col("events"), HLL_ERROR).alias("events_within"),
    )


@query(
    "sketch_overlap",
    """WITH u AS (SELECT DISTINCT event_type, user_id FROM events)
SELECT a.event_type AS left_type, b.event_type AS right_type, count(*) AS n_both, TRUE AS both_within
FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""",
)
def sketch_overlap(spark, sf_dir):
    """How many users have events of two types, for each two types, from daily sketches, beside the exact numbers."""
    types = daily_events(spark, sf_dir).read("event_type").select("event_type", "theta_user_id")
    left, right = (types.select(F.col("event_type").alias(f"{s}_type"), F.col("theta_user_id").alias(s)) for s in ("left", "right"))
    estimates = left.join(right, F.col("left_type") < F.col("right_type")).select("left_type", "right_type", overlap("left", "right").alias("estimate"))
    users = table(spark, sf_dir, "events").select("event_type", "user_id").where("user_id is not null").distinct()
    a, b = users.select(F.col("event_type").alias("left_type"), "user_id"), users.select(F.col("event_type").alias("right_type"), "user_id")
    exact = a.join(b, "user_id").where("left_type < right_type").groupBy("left_type", "right_type").agg(F.count("*").alias("n_both"))
    # An intersection's error follows the larger set's.
    return exact.join(estimates, ["left_type", "right_type"]).select("left_type", "right_type", "n_both", within(F.col("estimate"), F.col("n_both"), 2 * THETA_ERROR).alias("both_within"))


@query(
    "sketch_quantiles",
    """SELECT event_type, share::DOUBLE AS share, count(value) AS n, TRUE AS rank_within FROM events, (VALUES (0.05), (0.5), (0.95)) s(share) GROUP BY ALL""",
)
def sketch_quantiles(spark, sf_dir):
    """Quantiles of the events' values by type, from daily sketches: whether each one's true rank lies within the stated error."""
    merged = daily_events(spark, sf_dir).read("event_type")
    shares = (0.05, 0.5, 0.95)
    found = merged.select("event_type", F.explode(F.array(*(F.struct(F.lit(s).alias("share"), quantile("value", s).alias("q")) for s in shares))).alias("x")).select("event_type", "x.*")
    ranked = table(spark, sf_dir, "events").join(F.broadcast(found), "event_type").groupBy("event_type", "share").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto")
    )
    # Equal values share a stretch of ranks, which the quantile's own rank need only touch.
    good = (F.col("below") / F.col("n") <= F.col("share") + 2 * KLL_ERROR) & (F.col("upto") / F.col("n") >= F.col("share") - 2 * KLL_ERROR)
    return ranked.select("event_type", "share", "n", good.alias("rank_within"))
