"""What a generator should make, inferred from data: refined ranges, true shares and weights; statistics of durations; timelines."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.functions.numbers import half_up, places, places_sql, uniform, uniform_sql
from datumloom.operators.assess import frequencies, frequencies_sql
from datumloom.plans import star
from datumloom.plans.schema import growth
from datumloom.registry import query, table


def ranges(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, low, high: a fifth wider than the data, from 0 on, and at least 1 wide; null bounds without data."""
    values = [v.alias(f"{c}_{k}") for c in columns for k, v in (("lo", F.min(F.col(c).cast("double"))), ("hi", F.max(F.col(c).cast("double"))))]
    stacked = ", ".join(f"'{c}', `{c}_lo`, `{c}_hi`" for c in columns)
    found = df.agg(*values).select(F.expr(f"stack({len(columns)}, {stacked}) AS (column, lo, hi)"))
    low, high = F.floor(F.col("lo") * 0.8), F.ceil(F.col("hi") * 1.2)
    return found.select("column", F.when(F.col("lo").isNotNull(), F.greatest(F.lit(0), low)).alias("low"), F.when(F.col("hi").isNotNull(), F.greatest(high, low + 1)).alias("high"))


def _ranges_sql(source: str, columns: tuple[str, ...]) -> str:
    one = "SELECT '{0}' AS \"column\", greatest(0, floor(min({0})::DOUBLE * 0.8::DOUBLE))::BIGINT AS low, greatest(ceil(max({0})::DOUBLE * 1.2::DOUBLE), floor(min({0})::DOUBLE * 0.8::DOUBLE) + 1)::BIGINT AS high FROM {1}"
    return " UNION ALL ".join(one.format(c, source) for c in columns)


@query("refined_ranges", _ranges_sql("lineitem", star.NUMERIC["lineitem"]))
def refined_ranges(spark, sf_dir):
    return ranges(table(spark, sf_dir, "lineitem"), star.NUMERIC["lineitem"])


_FLAGS = ("o_orderstatus", "o_orderpriority")
#: A column with so few values in so many rows counts as an enumeration.
ENUM_VALUES, ENUM_ROWS = 20, 10


@query(
    "refined_enums",
    f"""SELECT "column", value, weight FROM (SELECT "column", value, {places_sql('n::DOUBLE / sum(n) OVER (PARTITION BY "column")', 2)} AS weight, count(*) OVER (PARTITION BY "column") AS d, sum(n) OVER (PARTITION BY "column") AS total
 FROM {frequencies_sql('orders', _FLAGS)} f) t WHERE d <= {ENUM_VALUES} AND total >= {ENUM_ROWS}""",
)
def refined_enums(spark, sf_dir):
    """Values and weights of the columns that look like enumerations; sizes are counted before values meet."""
    counts = frequencies(table(spark, sf_dir, "orders"), _FLAGS)
    few = counts.groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("total")).where((F.col("d") <= ENUM_VALUES) & (F.col("total") >= ENUM_ROWS))
    return counts.join(F.broadcast(few), "column").select("column", "value", places(F.col("n").cast("double") / F.col("total"), 2).alias("weight"))


@query("refined_booleans", f"SELECT event_type, {places_sql('avg((value > 50)::INT::DOUBLE)', 2)} AS true_weight FROM events WHERE value IS NOT NULL GROUP BY 1")
def refined_booleans(spark, sf_dir):
    """The share of true values by event type, as a generator's weight."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.groupBy("event_type").agg(places(F.avg((F.col("value") > 50).cast("int").cast("double")), 2).alias("true_weight"))


def durations(df: DataFrame, column: str, n_buckets: int = 5) -> DataFrame:
    """n, mean, least and most of whole durations, and the count in each of equal buckets from 0; trailing empty ones go."""
    whole = df.select(F.floor(F.col(column)).cast("long").alias("d")).where("d >= 0")
    stats = whole.agg(F.count("*").alias("n"), half_up(F.avg("d")).cast("long").alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"))
    stats = stats.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("most") + 1) / n_buckets)))
    counts = whole.crossJoin(F.broadcast(stats.select("width"))).groupBy((F.col("d") / F.col("width")).cast("int").alias("bucket")).agg(F.count("*").alias("count"))  # one row
    every = stats.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("most") / F.col("width")).cast("int"))).alias("bucket"))
    return every.join(counts, "bucket", "left").select("n", "mean", "least", "most", (F.col("bucket") * F.col("width")).alias("from_"), ((F.col("bucket") + 1) * F.col("width") - 1).alias("to_"), F.coalesce("count", F.lit(0)).alias("count"))


@query(
    "history_durations",
    """WITH d AS (SELECT floor(value)::BIGINT AS d FROM events WHERE floor(value) >= 0), s AS (SELECT count(*) AS n, floor(avg(d) + 0.5)::BIGINT AS mean, min(d) AS least, max(d) AS most, greatest(1, ceil((max(d) + 1) / 5.0))::BIGINT AS width FROM d)
 SELECT n, mean, least, most, b * width AS from_, (b + 1) * width - 1 AS to_, (SELECT count(*) FROM d WHERE d // width = b) AS count FROM s, range(5) r(b) WHERE b <= most // width""",
)
def history_durations(spark, sf_dir):
    """Statistics of a history's durations: the events' values as milliseconds."""
    return durations(table(spark, sf_dir, "events"), "value")


@query("history_slowest", "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 3")
def history_slowest(spark, sf_dir):
    """The three slowest entries of a history; a top-k report."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL").orderBy(F.col("value").desc(), "event_id").select("event_id", "value").limit(3)


def _analysis_sql() -> str:
    from datumloom.operators.profile import _ladder_sql

    one = "SELECT '{0}' AS \"table\", (SELECT count(*) FROM {0}) AS n_rows, count(*) AS n_columns, count(*) FILTER (WHERE strategy = 'enum') AS n_enums, count(*) FILTER (WHERE strategy IN ('integer', 'float')) AS n_numbers FROM ({1}) x"
    return " UNION ALL ".join(one.format(t, _ladder_sql(t, star.COLUMNS[t])) for t in ("orders", "part"))


@query("analysis_report", _analysis_sql())
def analysis_report(spark, sf_dir):
    """Rows, columns, and how many columns each kind of strategy suits, for two tables."""
    from datumloom.operators.profile import ladder

    parts = []
    for t in ("orders", "part"):
        df = table(spark, sf_dir, t)
        kinds = ladder(df, star.COLUMNS[t]).agg(F.count("*").alias("n_columns"), F.count_if(F.col("strategy") == "enum").alias("n_enums"), F.count_if(F.col("strategy").isin("integer", "float")).alias("n_numbers"))
        parts.append(df.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(kinds)).select(F.lit(t).alias("table"), "*"))  # one row each
    return parts[0].unionByName(parts[1])


# Timelines: parents and children over months, each child at a time after its parent's.
SLOTS, PARENTS, CHILDREN, SEED = 12, 600, 1800, 78


def _upto(model: str, total: int) -> list[int]:
    return list(accumulate(growth(model, SLOTS, total)))


def _placed(row: Column, upto: list[int], what: str) -> tuple[Column, Column]:
    """The month of a row number, and a time within it, as functions of the number alone."""
    slot = F.size(F.filter(F.array(*map(F.lit, upto)), lambda n: n <= row)).cast("int")
    start = F.add_months(F.lit("2024-01-01").cast("date"), slot)
    seconds = F.floor(uniform(SEED, "timeline", what, row) * F.dayofmonth(F.last_day(start)) * 86400).cast("long")
    return slot, F.timestamp_seconds(F.unix_timestamp(start.cast("timestamp")) + seconds)


def timeline_children(spark) -> DataFrame:
    """Children over months by one growth model, of parents that another has made by then.

    A child's parent is one of those made up to its month. It is created at a time in its
    month, or up to 365 days after its parent if that is later; it is shipped within 90 days.
    """
    parents, children = _upto("linear", PARENTS), _upto("exponential", CHILDREN)
    slot, at = _placed(F.col("id"), children, "child")
    known = F.element_at(F.array(*map(F.lit, parents)), F.col("slot") + 1)
    rows = spark.range(CHILDREN).withColumn("slot", slot).withColumn("at", at).withColumn("parent", F.floor(uniform(SEED, "timeline", "parent", F.col("id")) * known).cast("long"))
    rows = rows.withColumn("parent_at", _placed(F.col("parent"), parents, "parent_at")[1])
    later = F.timestamp_seconds(F.unix_timestamp("parent_at") + F.floor(uniform(SEED, "timeline", "later", F.col("id")) * 365 * 86400).cast("long"))
    rows = rows.withColumn("created_at", F.when(F.col("at") < F.col("parent_at"), later).otherwise(F.col("at")))
    shipped = F.timestamp_seconds(F.unix_timestamp("created_at") + F.floor(uniform(SEED, "timeline", "shipped", F.col("id")) * 90 * 86400).cast("long"))
    return rows.select("id", "slot", "parent", "parent_at", "created_at", shipped.alias("shipped_at"))


def _placed_sql(row: str, upto: list[int], what: str) -> tuple[str, str]:
    slot = f"len(list_filter({upto}, lambda n: n <= {row}))::INT"
    start = f"(TIMESTAMP '2024-01-01' + INTERVAL 1 MONTH * {slot})"
    return slot, f"({start} + INTERVAL 1 SECOND * floor({uniform_sql(SEED, 'timeline', what, row)} * day(last_day({start}::DATE)) * 86400)::BIGINT)"


_SLOT, _AT = _placed_sql("id", _upto("exponential", CHILDREN), "child")
_U = lambda what: uniform_sql(SEED, "timeline", what, "id")


@query(
    "timeline_dataset",
    f"""SELECT id, slot, parent, parent_at, created_at, created_at + INTERVAL 1 SECOND * floor({_U('shipped')} * 90 * 86400)::BIGINT AS shipped_at FROM
 (SELECT *, CASE WHEN placed_at < parent_at THEN parent_at + INTERVAL 1 SECOND * floor({_U('later')} * 365 * 86400)::BIGINT ELSE placed_at END AS created_at FROM
 (SELECT *, {_placed_sql('parent', _upto('linear', PARENTS), 'parent_at')[1]} AS parent_at FROM (SELECT id, {_SLOT} AS slot, {_AT} AS placed_at, floor({_U('parent')} * ({_upto('linear', PARENTS)})[{_SLOT} + 1])::BIGINT AS parent FROM range({CHILDREN}) r(id)) a) b) c""",
)
def timeline_dataset(spark, sf_dir):
    return timeline_children(spark)
