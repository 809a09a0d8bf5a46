"""Joins on time: the latest earlier row of a key, rows within intervals, and intervals that overlap.

None of them lets a task hold a key. As-of joins cut each key's rows into stretches of
time and carry the last row of a stretch over those that follow. Interval joins give each
interval at most two bins, on a level that fits its length, and each point one bin a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.registry import query, table

#: Rows in a stretch of time over all keys, about.
STRETCH_ROWS = 500_000
#: A level's bins are this many times as long as those of the level before.
BASE = 4


def micros(time: Column) -> Column:
    """A time as a number, so that all kinds of time are cut alike; numbers stay."""
    return F.when(time.isNotNull(), F.unix_micros(time.cast("timestamp")))


def stretch_bounds(times: DataFrame, column: str, n: int) -> list:
    """Times that cut a table into ``n`` stretches of about as many rows."""
    if n < 2:
        return []
    found = times.agg(F.percentile_approx(column, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(10_000)).alias("b")).first()["b"]
    return sorted(set(found or []))


def as_of(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], strict: bool = False, tolerance: float | None = None, stretches: int | None = None
) -> DataFrame:
    """All rows of ``left``, each with the ``columns`` of the latest row of ``right`` with equal keys that isn't later.

    Of right rows of equal time the one with the greatest ``columns`` counts, in their
    order. ``strict`` asks for an earlier time, ``tolerance`` for one at most so many
    seconds back. Rows with a null key or time match nothing; left rows without a match
    have null columns. The two tables' columns must differ in name, but for the keys.

    Both are numbered by key and stretch of time. A window finds the last right row
    within the stretch; a row whose stretch has none before it takes the last one of an
    earlier stretch, found among one row for each key and stretch.
    """
    if stretches is None:
        stretches = max(1, -(-(left.count() + right.count()) // STRETCH_ROWS))
    spare = [f"_{i}" for i in range(len(left.columns))]
    lefts = left.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on)), micros(F.col(left_time)).alias("_t"), F.struct(*(F.col(f"`{c}`").alias(s) for c, s in zip(left.columns, spare))).alias("_row"))
    rights = right.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on)), micros(F.col(right_time)).alias("_t"), F.struct(*columns).alias("_found"))
    keys = [f"_k{i}" for i in range(len(on))]
    known = " and ".join(f"{c} is not null" for c in [*keys, "_t"])
    rights = rights.where(known)
    both = lefts.withColumn("_found", F.lit(None)).unionByName(rights.withColumn("_row", F.lit(None)))
    bounds = stretch_bounds(both.where(known), "_t", stretches)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_t"))) if bounds else F.lit(0)
    both = both.withColumn("_stretch", at)

    # At one time, right rows come before left ones, or after them if they must be earlier.
    first = F.when(F.col("_row").isNull(), 0 if not strict else 1).otherwise(1 if not strict else 0)
    dated = F.when(F.col("_found").isNotNull(), F.struct("_t", "_found"))
    here = Window.partitionBy(*keys, "_stretch").orderBy("_t", first, F.col("_found").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last(dated, ignorenulls=True).over(here)).where("_row is not null")

    # One row for each key and stretch: the last of all earlier stretches.
    ends = both.groupBy(*keys, "_stretch").agg(F.max(dated).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null") if bounds else None
    if carried is not None:
        found = found.join(carried, [*keys, "_stretch"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    fresh = F.lit(True) if tolerance is None else F.col("_t") - F.col("_last._t") <= F.lit(int(tolerance * 1_000_000))
    fits = fresh & F.expr(known)
    return found.select(*(F.col(f"_row.{s}").alias(c) for c, s in zip(left.columns, spare)), *(F.when(fits, F.col(f"_last._found.{c}")).alias(c) for c in columns))


def in_interval(intervals: DataFrame, points: DataFrame, on: Sequence[str], start: str, end: str, time: str, width: float = 60.0, salts: int = 1) -> DataFrame:
    """All pairs of an interval and a point of equal keys with start <= time <= end.

    An interval's level is the least at which a bin, ``width`` seconds at level 0 and
    ``BASE`` times as long at each further one, is at least as long as the interval, so
    it touches two bins at most, however long it is. A point has one bin at each level
    that occurs. ``salts`` deals the points of a key and bin into so many parts and
    copies the intervals to each. Intervals that end before they start, and null keys
    and times, match nothing. The two tables' columns must differ in name, but for the keys.
    """
    unit = int(width * 1_000_000)
    length = F.greatest(F.col("_e") - F.col("_s"), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(BASE), length / unit) - 1e-9)).cast("int")
    named = intervals.withColumns({"_s": micros(F.col(start)), "_e": micros(F.col(end))}).where("_s <= _e").withColumn("_level", level)
    # Rounding may leave an interval a level too low; it then touches three bins.
    size = F.expr(f"cast({unit} * power({BASE}, _level) as long)")
    binned = named.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size))))
    levels = sorted(r["_level"] for r in named.select("_level").distinct().collect())  # at most about 30: lengths are 64-bit
    placed = points.withColumn("_t", micros(F.col(time))).where("_t is not null")
    placed = placed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.floor(F.col("_t") / size))
    keys = [*on, "_level", "_bin"]
    if salts > 1:
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64("_t", *[c for c in points.columns if c not in on]), F.lit(salts)).cast("int"))
        binned = binned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    joined = binned.join(placed, keys).where("_s <= _t and _t <= _e")
    return joined.select(*intervals.columns, *(c for c in points.columns if c not in on))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float = 60.0, salts: int = 1) -> DataFrame:
    """All pairs of a left and a right interval of equal keys that have a time in common; ends count.

    Two overlap if the right one starts within the left one, or else the left one
    starts within the right one, later than it.
    """
    right = right.where(micros(F.col(right_span[0])) <= micros(F.col(right_span[1])))
    left = left.where(micros(F.col(left_span[0])) <= micros(F.col(left_span[1])))
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    one = in_interval(left, right, on, *left_span, right_span[0], width, salts).select(*columns)
    other = in_interval(right, left, on, *right_span, left_span[0], width, salts).where(F.col(left_span[0]) > F.col(right_span[0])).select(*columns)
    return one.unionByName(other)


@query(
    "as_of_purchases",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def as_of_purchases(spark, sf_dir):
    """Each purchase with the user's latest view that isn't later."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return as_of(bought, viewed, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], stretches=8).drop("ts")


@query(
    "as_of_recent_errors",
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(b.ts) <= 21600000000 THEN b.event_id END AS error_id
FROM e a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts > b.ts""",
)
def as_of_recent_errors(spark, sf_dir):
    """Each event with the user's latest error before it, if that is at most six hours back."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return as_of(events, errors, ["user_id"], "ts", "error_ts", ["error_id"], strict=True, tolerance=6 * 3600, stretches=5).select("event_id", "error_id")


@query(
    "interval_join_events",
    """WITH w AS (SELECT event_id AS window_id, user_id, ts AS from_ts, ts + INTERVAL 1 HOUR * (1 + event_id % 97) AS to_ts FROM events WHERE event_type = 'signup')
SELECT w.window_id, e.event_type, count(*) AS n, sum(e.event_id)::BIGINT AS ids FROM w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.from_ts AND w.to_ts GROUP BY ALL""",
)
def interval_join_events(spark, sf_dir):
    """A user's events within windows of 1 to 97 hours that begin at sign-ups."""
    events = table(spark, sf_dir, "events")
    hours = F.make_dt_interval(F.lit(0), (F.lit(1) + F.col("event_id") % 97).cast("int"))
    windows = events.where("event_type = 'signup'").select(F.col("event_id").alias("window_id"), "user_id", F.col("ts").alias("from_ts"), (F.col("ts") + hours).alias("to_ts"))
    met = in_interval(windows, events.select("user_id", "ts", "event_type", "event_id"), ["user_id"], "from_ts", "to_ts", "ts", width=3600, salts=4)
    return met.groupBy("window_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "overlapping_orders",
    """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate AS opened, max(l_shipdate) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT a.o_orderkey, count(*) AS n_open, sum(b.o_orderkey)::BIGINT AS others FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.opened <= a.closed AND a.opened <= b.closed
WHERE a.opened <= a.closed AND b.opened <= b.closed GROUP BY a.o_orderkey""",
)
def overlapping_orders(spark, sf_dir):
    """For each order, the same customer's other orders that are open at a time when it is."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    spans = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("opened"), "closed")
    others = spans.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("opened").alias("other_opened"), F.col("closed").alias("other_closed"))
    met = overlapping(spans, others, ["o_custkey"], ("opened", "closed"), ("other_opened", "other_closed"), width=86400 * 8)
    return met.where("o_orderkey <> other").groupBy("o_orderkey").agg(F.count("*").alias("n_open"), F.sum("other").alias("others"))
