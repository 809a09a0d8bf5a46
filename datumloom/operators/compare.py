"""Comparing data: dataset differences, bags of rows, grading a result, temporal compliance and its repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import half_up, places, places_sql, uniform, uniform_sql
from datumloom.operators.assess import SHIPMENTS, ordered_items, shipments, union
from datumloom.plans.temporal_rules import pairs_of, statuses_of
from datumloom.registry import query, table
from datumloom.sources.dumps import scratch

# The second version of the orders: some left out, some with another status, none of the priorities changed.
def second_version(orders: DataFrame) -> DataFrame:
    u = lambda what: uniform(21, "orders", what, F.col("o_orderkey"))
    return orders.where(u("drop") >= 0.03).withColumn("o_orderstatus", F.when(u("status") < 0.1, "X").otherwise(F.col("o_orderstatus")))


def _u(what: str) -> str:
    return uniform_sql(21, "orders", what, "o_orderkey")


SECOND = f"(SELECT o_orderkey, o_custkey, CASE WHEN {_u('status')} < 0.1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE {_u('drop')} >= 0.03)"


def _top(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).agg(F.max_by("value", F.struct("n", F.col("value"))).alias("value"), F.sum("n").alias("n"))


def difference(before: DataFrame, after: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """For each column the most frequent value on both sides, rows on both sides and their change (%, 1 place); breaking if a column is gone."""
    rows = []
    for c in columns:
        old = _top(before, c).select(F.col("value").alias("top_before"), F.col("n").alias("rows_before"))
        new = _top(after, c).select(F.col("value").alias("top_after"), F.col("n").alias("rows_after"))
        rows.append(old.crossJoin(new).select(F.lit(c).alias("column"), "*"))  # one row each
    shift = places(100.0 * (F.col("rows_after") - F.col("rows_before")) / F.col("rows_before"), 1)
    return union(rows).select("*", shift.alias("pct"), F.when(F.col("top_before") == F.col("top_after"), "same").otherwise("shifted").alias("verdict"))


_DIFF_COLUMNS = ("o_orderstatus", "o_orderpriority")


def _diff_sql(c: str) -> str:
    side = lambda source: f"(SELECT value, total FROM (SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} x GROUP BY 1) t ORDER BY n DESC, value DESC LIMIT 1)"
    return f"SELECT '{c}' AS \"column\", a.value AS top_before, a.total::BIGINT AS rows_before, b.value AS top_after, b.total::BIGINT AS rows_after, {places_sql('100.0::DOUBLE * (b.total - a.total) / a.total', 1)} AS pct, CASE WHEN a.value = b.value THEN 'same' ELSE 'shifted' END AS verdict FROM {side('orders')} a, {side(SECOND)} b"


@query("dataset_diff", " UNION ALL ".join(map(_diff_sql, _DIFF_COLUMNS)))
def dataset_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return difference(orders, second_version(orders), _DIFF_COLUMNS)


def schema_difference(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    """Each column name of either side: added, removed (breaking) or shared."""
    a, b = before.columns, after.columns
    return [(c, "shared" if c in b else "removed") for c in a] + [(c, "added") for c in b if c not in a]


@query("schema_diff", "SELECT column_name AS \"column\", CASE column_name WHEN 'o_custkey' THEN 'removed' ELSE 'shared' END AS change FROM information_schema.columns WHERE table_name = 'orders' UNION ALL SELECT 'channel', 'added'")
def schema_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return spark.createDataFrame(schema_difference(orders, orders.drop("o_custkey").withColumn("channel", F.lit("web"))), "column string, change string")


def bags(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows matched, missing (left alone) and extra (right alone), counted with their repetitions."""
    columns = left.columns
    a = left.groupBy(*columns).agg(F.count("*").alias("_l"), F.lit(0).cast("long").alias("_r"))
    b = right.groupBy(*columns).agg(F.lit(0).cast("long").alias("_l"), F.count("*").alias("_r"))
    both = a.unionByName(b).groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))  # nulls group together, unlike in a join
    least = F.least("_l", "_r")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(zero(least).alias("matched"), zero(F.col("_l") - least).alias("missing"), zero(F.col("_r") - least).alias("extra"))


_ROW = "o_custkey, o_orderstatus, o_orderpriority"
_BAGS = f"""SELECT sum(least(l, r))::BIGINT AS matched, sum(l - least(l, r))::BIGINT AS missing, sum(r - least(l, r))::BIGINT AS extra FROM
 (SELECT sum(l) AS l, sum(r) AS r FROM (SELECT {_ROW}, 1 AS l, 0 AS r FROM orders UNION ALL SELECT {_ROW}, 0, 1 FROM {SECOND} s) u GROUP BY {_ROW}) g"""


@query("bag_diff", _BAGS)
def bag_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return bags(orders.select(*names), second_version(orders).select(*names))


def placed(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows with their place _at in the order, from 1.

    The rows are written by ranges of the order, so that the ranges are the same wherever
    they are read; a place is one in a range plus the rows of the ranges before.
    """
    path = scratch(df.sparkSession, "placed")
    df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return rows.join(F.broadcast(before), "_part").withColumn("_at", within + F.col("_before")).drop("_part", "_before")


def grade(expected: DataFrame, given: DataFrame, order_by: list[str]) -> DataFrame:
    """Points for columns (25), row count (15), matching rows (40) and order (20), and their sum.

    Order compares rows at equal places; places come from the given ordering columns.
    """
    columns = 25.0 * len({c.lower() for c in expected.columns} & {c.lower() for c in given.columns}) / max(1, len(expected.columns))
    found = bags(expected, given)
    n = F.col("matched") + F.col("missing")
    m = F.col("matched") + F.col("extra")
    points = found.select(
        F.lit(float(half(columns))).alias("columns"),
        F.when(n == m, 15.0).otherwise(half_up(15.0 * F.least(n, m) / F.greatest(n, m)).cast("double")).alias("row_count"),
        half_up(40.0 * F.col("matched") / F.greatest(n, m, F.lit(1))).cast("double").alias("matching"),
    )
    left = placed(expected, order_by)
    right = placed(given.select(*(F.col(c).alias(f"_{c}") for c in given.columns)), [f"_{c}" for c in order_by])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in expected.columns]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    order = left.join(right, "_at", "left").agg(half_up(20.0 * F.count_if(equal) / F.greatest(F.count("*"), F.lit(1))).cast("double").alias("ordering"))
    return points.crossJoin(order).withColumn("total", F.col("columns") + F.col("row_count") + F.col("matching") + F.col("ordering"))


def half(x: float) -> int:
    return int(x + 0.5)


_EXPECTED = "(SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)"
_GIVEN = f"(SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {SECOND} s GROUP BY 1, 2)"


@query(
    "grade_result",
    f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS place FROM {_EXPECTED} x), g AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS place FROM {_GIVEN} y),
 b AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM g) AS m, (SELECT count(*) FROM e JOIN g USING (o_orderpriority, o_orderstatus, n)) AS matched, (SELECT count(*) FROM e JOIN g USING (place, o_orderpriority, o_orderstatus, n)) AS placed),
 p AS (SELECT 25.0::DOUBLE AS columns, CASE WHEN n = m THEN 15 ELSE floor(15.0 * least(n, m) / greatest(n, m) + 0.5) END::DOUBLE AS row_count, floor(40.0 * matched / greatest(n, m, 1) + 0.5)::DOUBLE AS matching, floor(20.0 * placed / greatest(n, 1) + 0.5)::DOUBLE AS ordering FROM b)
 SELECT *, columns + row_count + matching + ordering AS total FROM p""",
)
def grade_result(spark, sf_dir):
    """A result over the second version, graded against the one over the first."""
    orders = table(spark, sf_dir, "orders")
    count = lambda df: df.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return grade(count(orders), count(second_version(orders)), ["o_orderpriority", "o_orderstatus"])


def within_row(df: DataFrame) -> DataFrame:
    """Rows whose later column precedes the earlier one, a row for each violated pair, from one pass."""
    parts = [F.when(F.col(b) < F.col(a), f"{a} <= {b}") for a, b in pairs_of(df.columns)]
    broken = F.filter(F.array(*parts), lambda r: r.isNotNull()) if parts else F.array().cast("array<string>")
    return df.select("*", F.explode(broken).alias("rule"))


def late(df: DataFrame) -> DataFrame:
    """Shipments with some dates moved before the order's."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return df.withColumn("shipped_at", F.when(uniform(9, "lineitem", "late", key) < 0.05, F.col("created_at") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("shipped_at")))


_LATE = f"(SELECT l_orderkey, l_linenumber, created_at, CASE WHEN {uniform_sql(9, 'lineitem', 'late', "l_orderkey || '-' || l_linenumber")} < 0.05 THEN created_at - INTERVAL 3 DAY ELSE shipped_at END AS shipped_at FROM {SHIPMENTS} s)"


@query("within_row_temporal", f"SELECT *, 'created_at <= shipped_at' AS rule FROM {_LATE} l WHERE shipped_at < created_at")
def within_row_temporal(spark, sf_dir):
    return within_row(late(shipments(spark, sf_dir)))


@query("cross_table_temporal", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 2 DAY")
def cross_table_temporal(spark, sf_dir):
    """Items shipped less than two days after their order."""
    return ordered_items(spark, sf_dir).where(F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_orderdate")


def with_closing(orders: DataFrame) -> DataFrame:
    """Orders with a closing date on all filled ones but a few, and on a few open ones."""
    u = uniform(13, "orders", "closed", F.col("o_orderkey"))
    filled = F.col("o_orderstatus") == "F"
    return orders.withColumn("closed_at", F.when((filled & (u < 0.95)) | (~filled & (u < 0.05)), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))


_CU = uniform_sql(13, "orders", "closed", "o_orderkey")
_CLOSING = f"(SELECT o_orderkey, o_orderstatus, o_orderdate, CASE WHEN (o_orderstatus = 'F' AND {_CU} < 0.95) OR (o_orderstatus <> 'F' AND {_CU} < 0.05) THEN o_orderdate + INTERVAL 30 DAY END AS closed_at FROM orders)"

#: status -> columns that must be null, columns that must not be.
LIFECYCLE_RULES = {"O": (("closed_at",), ()), "P": (("closed_at",), ()), "F": ((), ("closed_at",))}


def lifecycle(df: DataFrame, status: str, rules: dict) -> DataFrame:
    """Rows that break a rule of their status, a row for each broken rule."""
    parts = []
    for value, (nulls, present) in rules.items():
        here = F.col(status) == value
        parts += [F.when(here & F.col(c).isNotNull(), f"{value}: {c} must be null") for c in nulls]
        parts += [F.when(here & F.col(c).isNull(), f"{value}: {c} must be set") for c in present]
    return df.select("*", F.explode(F.filter(F.array(*parts), lambda r: r.isNotNull())).alias("rule"))


def status_violations(df: DataFrame) -> DataFrame:
    """Rows that break any of the 74 status rules that the table's columns bring into play, a row for each broken rule."""
    parts = [
        F.when((F.col(status) == value) & (F.col(c).isNotNull() if null else F.col(c).isNull()), f"{status}={value}: {c} must be {'null' if null else 'set'}")
        for status, value, c, null in statuses_of(df.columns)
    ]
    broken = F.filter(F.array(*parts), lambda r: r.isNotNull()) if parts else F.array().cast("array<string>")
    return df.select("*", F.explode(broken).alias("rule"))


def as_trades(orders: DataFrame) -> DataFrame:
    """Orders with the reference's column names for trades, and dates that only sometimes fit the status."""
    u = lambda what: uniform(17, "orders", what, F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "O", "cancelled").otherwise("partially_filled")
    date = lambda what, share: F.when(u(what) < share, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS"))
    return orders.select("o_orderkey", status.alias("order_status"), date("filled", 0.7).alias("filled_at"), date("settled", 0.4).alias("settlement_date"), date("delivered", 0.2).alias("delivered_at"))


_T = lambda what: uniform_sql(17, "orders", what, "o_orderkey")
_TRADES = f"""(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'cancelled' ELSE 'partially_filled' END AS order_status, {_T('filled')} < 0.7 AS filled, {_T('settled')} < 0.4 AS settled, {_T('delivered')} < 0.2 AS delivered FROM orders)"""


@query(
    "status_rules",
    f"""SELECT o_orderkey, rule FROM {_TRADES} t, (VALUES ('cancelled', 'filled_at', 'null'), ('cancelled', 'settlement_date', 'null'), ('cancelled', 'delivered_at', 'null'), ('filled', 'filled_at', 'set'), ('partially_filled', 'settlement_date', 'null')) r(s, c, must),
 LATERAL (SELECT 'order_status=' || s || ': ' || c || ' must be ' || must AS rule, CASE c WHEN 'filled_at' THEN filled WHEN 'settlement_date' THEN settled ELSE delivered END AS is_set) v WHERE order_status = s AND is_set = (must = 'null')""",
)
def status_rules(spark, sf_dir):
    """Orders whose dates don't fit their status, by the rules for the columns that they have."""
    return status_violations(as_trades(table(spark, sf_dir, "orders"))).select("o_orderkey", "rule")


_DELIVERY = f"l_shipdate + INTERVAL 1 DAY * (floor({uniform_sql(17, 'lineitem', 'delivery', "l_orderkey || '-' || l_linenumber")} * 12)::INT - 2)"


@query("within_row_pairs", f"SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, o_orderdate::TIMESTAMP AS a, l_shipdate::TIMESTAMP AS b, ({_DELIVERY})::TIMESTAMP AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x, (VALUES ('order_date <= ship_date'), ('ship_date <= delivery_date')) r(rule) WHERE CASE rule WHEN 'order_date <= ship_date' THEN b < a ELSE c < b END")
def within_row_pairs(spark, sf_dir):
    """Items shipped before their order or delivered before they were shipped: two of the 39 pairs, found by name."""
    days = (F.floor(uniform(17, "lineitem", "delivery", F.concat_ws("-", "l_orderkey", "l_linenumber")) * 12) - 2).cast("int")
    rows = ordered_items(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("o_orderdate").cast("timestamp").alias("order_date"), F.col("l_shipdate").cast("timestamp").alias("ship_date"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=days)).alias("delivery_date")
    )
    return within_row(rows).select("l_orderkey", "l_linenumber", "rule")


_BROKEN = f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'F: closed_at must be set' ELSE o_orderstatus || ': closed_at must be null' END AS rule FROM {_CLOSING} c WHERE (o_orderstatus = 'F') = (closed_at IS NULL)"


@query("lifecycle_violations", _BROKEN)
def lifecycle_violations(spark, sf_dir):
    return lifecycle(with_closing(table(spark, sf_dir, "orders")), "o_orderstatus", LIFECYCLE_RULES).select("o_orderkey", "o_orderstatus", "rule")


@query("lifecycle_fix", f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN coalesce(closed_at, o_orderdate + INTERVAL 1 DAY * (1 + floor({uniform_sql(13, 'orders', 'fix', 'o_orderkey')} * 180))::INT) END AS closed_at FROM {_CLOSING} c")
def lifecycle_fix(spark, sf_dir):
    """Open orders lose their closing date; filled ones without get one 1 to 180 days after the order."""
    days = (1 + F.floor(uniform(13, "orders", "fix", F.col("o_orderkey")) * 180)).cast("int")
    fixed = F.when(F.col("o_orderstatus") == "F", F.coalesce("closed_at", F.col("o_orderdate") + F.make_interval(days=days)))
    return with_closing(table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderstatus", fixed.alias("closed_at"))


@query("temporal_fix", f"SELECT l_orderkey, l_linenumber, created_at, CASE WHEN shipped_at < created_at THEN created_at + INTERVAL 1 DAY * (1 + floor({uniform_sql(9, 'lineitem', 'fix', "l_orderkey || '-' || l_linenumber")} * 180))::INT ELSE shipped_at END AS shipped_at FROM {_LATE} l")
def temporal_fix(spark, sf_dir):
    """Violating dates drawn anew, 1 to 180 days after the earlier one."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    days = (1 + F.floor(uniform(9, "lineitem", "fix", key) * 180)).cast("int")
    return late(shipments(spark, sf_dir)).withColumn("shipped_at", F.when(F.col("shipped_at") < F.col("created_at"), F.col("created_at") + F.make_interval(days=days)).otherwise(F.col("shipped_at")))
