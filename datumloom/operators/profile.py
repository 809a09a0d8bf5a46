"""Column profiles, sample statistics, bias shares and concentration, inference from statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import half_up, places, places_sql
from datumloom.operators.assess import frequencies, frequencies_sql, union
from datumloom.plans import star
from datumloom.registry import query, table


def shape(n: Column, distinct: Column, top: Column, cv: Column) -> Column:
    """constant, unique, skewed or uniform, from counts of values."""
    return F.when(distinct <= 1, "constant").when(distinct == n, "unique").when(top / n > 0.5, "skewed").when(cv < 0.3, "uniform").otherwise("skewed")


def profile(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, n, distinct, unique share (%, 2 places), share of the top value, and shape, from one frequency table."""
    each = frequencies(df, columns).groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.max("n").alias("top"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    n = F.col("n").cast("double")
    return each.select(
        "column", "n", "n_distinct", places(100 * F.col("n_distinct") / n, 2).alias("unique_pct"), places(100 * F.col("top") / n, 2).alias("top_pct"), shape(n, F.col("n_distinct"), F.col("top"), F.col("cv")).alias("shape")
    )


def _profile_sql(source: str, columns: tuple[str, ...]) -> str:
    return f"""SELECT "column", n, n_distinct, {places_sql('100.0::DOUBLE * n_distinct / n', 2)} AS unique_pct, {places_sql('100.0::DOUBLE * top / n', 2)} AS top_pct,
 CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct = n THEN 'unique' WHEN top::DOUBLE / n > 0.5 THEN 'skewed' WHEN cv < 0.3 THEN 'uniform' ELSE 'skewed' END AS shape
 FROM (SELECT "column", sum(n)::BIGINT AS n, count(*) AS n_distinct, max(n) AS top, stddev_pop(n) / avg(n) AS cv FROM {frequencies_sql(source, columns)} f GROUP BY 1) t"""


@query("column_profile", _profile_sql("orders", star.COLUMNS["orders"]))
def column_profile(spark, sf_dir):
    return profile(table(spark, sf_dir, "orders"), star.COLUMNS["orders"])


@query("distribution_shape", _profile_sql("part", ("p_brand", "p_type", "p_size")))
def distribution_shape(spark, sf_dir):
    return profile(table(spark, sf_dir, "part"), ("p_brand", "p_type", "p_size"))


#: The share of rows on either side of a median within which its bounds are sought.
MARGIN = 1e-5


def numeric(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, n, min, max, mean (2 places), exact median and population deviation of several columns.

    One aggregate gives all but the median, and bounds around it by approximate
    percentiles. Of the values between the bounds, a few of 100,000, only the counts are
    needed, so no task merges a column's distinct values.
    """
    kinds = ("n", "least", "most", "mean", "sd", "low", "high")
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        near = F.percentile_approx(x, [0.5 - MARGIN, 0.5 + MARGIN], round(2 / MARGIN))
        values = (F.count(x).cast("double"), F.min(x), F.max(x), F.avg(x.cast("decimal(20,6)")).cast("double"), F.stddev_pop(x), near[0], near[1])
        aggregates += [v.alias(f"{c}_{k}") for k, v in zip(kinds, values)]
    stacked = ", ".join(f"'{c}', " + ", ".join(f"`{c}_{k}`" for k in kinds) for c in columns)
    stats = df.agg(*aggregates).select(F.expr(f"stack({len(columns)}, {stacked}) AS (column, {', '.join(kinds)})"))  # a row for each column
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    cells = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, x)")).where("x IS NOT NULL").join(F.broadcast(stats.select("column", "n", "low", "high")), "column").where("x <= high")
    # All values under the lower bound count as one that lies there.
    levels = cells.groupBy("column", "n", F.when(F.col("x") >= F.col("low"), F.col("x")).alias("x")).agg(F.count("*").alias("m"))
    upto = levels.withColumn("upto", F.sum("m").over(Window.partitionBy("column").orderBy(F.col("x").asc_nulls_first())))
    middle = [F.min(F.when(F.col("upto") >= place, F.col("x"))) for place in (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)]
    medians = upto.groupBy("column").agg(((middle[0] + middle[1]) / 2).alias("median"))
    return stats.join(F.broadcast(medians), "column", "left").select("column", F.col("n").cast("long").alias("n"), "least", "most", places(F.col("mean"), 2).alias("mean"), "median", places(F.col("sd"), 4).alias("sd"))


def _numeric_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, {places_sql(f'(sum({c}::DECIMAL(20,6))::DOUBLE / count({c}))', 2)} AS mean, median({c}::DOUBLE) AS median, {places_sql(f'stddev_pop({c}::DOUBLE)', 4)} AS sd FROM {source}" for c in columns
    )


@query("numeric_stats", _numeric_sql("lineitem", star.NUMERIC["lineitem"]))
def numeric_stats(spark, sf_dir):
    return numeric(table(spark, sf_dir, "lineitem"), star.NUMERIC["lineitem"])


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@query("top_values", f"SELECT \"column\", value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM {frequencies_sql('part', star.COLUMNS['part'])} f) t WHERE place <= 5")
def top_values(spark, sf_dir):
    return top(frequencies(table(spark, sf_dir, "part"), star.COLUMNS["part"]), 5)


@query(
    "sample_stats",
    """SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, avg((event_type = 'error')::INT::DOUBLE) AS error_rate, min(ts) AS earliest, max(ts) AS latest, count(DISTINCT event_type) <= 20 AND count(*) >= 10 AS type_is_enum FROM events""",
)
def sample_stats(spark, sf_dir):
    """A table's column statistics on all its rows, which the sampled ones only estimate."""
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n"),
        F.count_distinct("user_id").alias("n_users"),
        F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"),
        F.min("ts").alias("earliest"),
        F.max("ts").alias("latest"),
        ((F.count_distinct("event_type") <= 20) & (F.count("*") >= 10)).alias("type_is_enum"),
    )


def gini(counts: DataFrame) -> DataFrame:
    """column, Gini coefficient of the value counts (3 places) and flag: concentrated over 0.6, uniform under 0.1.

    With distinct counts x and multiplicities m in rising order, the sum of i * x_i needs
    only the ranks' sums, so equal counts are combined before anything is ordered.
    """
    levels = counts.groupBy("column", F.col("n").alias("x")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("column").orderBy("x")
    ranks = levels.withColumn("upto", F.sum("m").over(w)).withColumn("ranks", F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2)
    sums = ranks.groupBy("column").agg(F.sum(F.col("ranks") * F.col("x")).alias("s"), F.sum("m").alias("n"), F.sum(F.col("m") * F.col("x")).alias("total"))
    g = F.greatest(F.lit(0.0), 2 * F.col("s") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"))
    return sums.select("column", places(g, 3).alias("gini")).withColumn("flag", F.when(F.col("gini") > 0.6, "concentrated").when(F.col("gini") < 0.1, "uniform").otherwise("moderate"))


_GINI = f"""SELECT "column", gini, CASE WHEN gini > 0.6 THEN 'concentrated' WHEN gini < 0.1 THEN 'uniform' ELSE 'moderate' END AS flag FROM (SELECT "column",
 {places_sql('greatest(0, 2.0::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*))', 3)} AS gini FROM
 (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n, value) AS i FROM {frequencies_sql('lineitem', ('l_partkey', 'l_suppkey', 'l_quantity', 'l_returnflag'))} f) r GROUP BY 1) g"""


@query("gini_skew", _GINI)
def gini_skew(spark, sf_dir):
    return gini(frequencies(table(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))


def shares(counts: DataFrame) -> DataFrame:
    """Each value's share of its column (%, 2 places), and whether it is over four fifths."""
    total = F.sum("n").over(Window.partitionBy("column"))
    return counts.select("column", "value", "n", places(100 * F.col("n").cast("double") / total, 2).alias("share")).withColumn("over_represented", F.col("share") > 80)


_SHARES = f"SELECT \"column\", value, n, share, share > 80 AS over_represented FROM (SELECT *, {places_sql('100::DOUBLE * n / sum(n) OVER (PARTITION BY \"column\")', 2)} AS share FROM {frequencies_sql('customer', star.CATEGORICAL['customer'])} f) s"


@query("demographic_shares", _SHARES)
def demographic_shares(spark, sf_dir):
    return shares(frequencies(table(spark, sf_dir, "customer"), star.CATEGORICAL["customer"]))


DECLARED_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "AEROSPACE")


@query("zero_representation", "SELECT value FROM (VALUES " + ", ".join(f"('{s}')" for s in DECLARED_SEGMENTS) + ") d(value) WHERE value NOT IN (SELECT c_mktsegment FROM customer)")
def zero_representation(spark, sf_dir):
    """Declared values that never occur."""
    declared = spark.createDataFrame([(s,) for s in DECLARED_SEGMENTS], "value string")
    return declared.join(table(spark, sf_dir, "customer"), F.col("value") == F.col("c_mktsegment"), "left_anti")


def bias_status(share: Column, g: Column) -> Column:
    return F.when(share > 80, "attention").when((share > 60) | (g > 0.6), "review").otherwise("pass")


_BIAS_COLUMNS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query(
    "bias_status",
    f"""SELECT "column", top_share, gini, CASE WHEN top_share > 80 THEN 'attention' WHEN top_share > 60 OR gini > 0.6 THEN 'review' ELSE 'pass' END AS status FROM
 (SELECT "column", {places_sql('100::DOUBLE * max(n) / sum(n)', 2)} AS top_share, {places_sql('greatest(0, 2.0::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*))', 3)} AS gini
 FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n, value) AS i FROM {frequencies_sql('orders', _BIAS_COLUMNS)} f) r GROUP BY 1) t""",
)
def bias_status_query(spark, sf_dir):
    """The share of each column's most frequent value, the concentration over all of them, and what these call for."""
    counts = frequencies(table(spark, sf_dir, "orders"), _BIAS_COLUMNS)
    found = counts.groupBy("column").agg(places(100 * F.max("n").cast("double") / F.sum("n"), 2).alias("top_share"))
    return found.join(gini(counts).select("column", "gini"), "column").withColumn("status", bias_status(F.col("top_share"), F.col("gini")))


PROXY_TOKENS = {"zip": "ethnicity or income", "postal": "ethnicity or income", "nation": "ethnicity", "name": "gender or ethnicity", "segment": "income", "age": "age"}


def proxies(names: list[str]) -> list[tuple[str, str]]:
    """Columns whose names hint at a protected attribute, by the tokens of the name."""
    return [(n, PROXY_TOKENS[t]) for n in names for t in PROXY_TOKENS if any(t in part for part in n.lower().split("_"))]


@query(
    "proxy_columns",
    f"""SELECT c AS "column", stands_for FROM (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'customer') n,
 (VALUES {", ".join(f"('{t}', '{s}')" for t, s in PROXY_TOKENS.items())}) p(token, stands_for) WHERE len(list_filter(string_split(lower(c), '_'), lambda part: contains(part, token))) > 0""",
)
def proxy_columns(spark, sf_dir):
    return spark.createDataFrame(proxies(table(spark, sf_dir, "customer").columns), "column string, stands_for string")


@query(
    "enum_inference",
    """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM c),
 k AS (SELECT * FROM t WHERE place <= 30) SELECT value, n, CAST(floor(100.0::DOUBLE * n / (SELECT sum(n) FROM k) + 0.5) AS BIGINT) AS weight FROM k WHERE (SELECT count(*) FROM k) BETWEEN 2 AND 25""",
)
def enum_inference(spark, sf_dir):
    """A text column's values as a weighted enumeration, if it has 2 to 25 of them."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(30)
    every = Window.partitionBy()  # of 30 rows at most
    return counts.select("value", "n", F.sum("n").over(every).alias("total"), F.count("*").over(every).alias("k")).where("k BETWEEN 2 AND 25").select("value", "n", half_up(100.0 * F.col("n") / F.col("total")).cast("long").alias("weight"))


_CARDINALITY = [f for f in star.FOREIGN_KEYS if f[0] in ("orders", "lineitem", "customer")]


def children(child: DataFrame, column: str) -> DataFrame:
    """Mean, least, most and deviation of the number of children of parents that have any, and the strategy they suggest."""
    each = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    stats = each.agg(places(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), places(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("sd"))
    return stats.withColumn("strategy", F.when((F.col("sd") < 0.5) | (F.col("least") == F.col("most")), "fixed").otherwise("poisson"))


def _children_sql(child: str, column: str) -> str:
    return f"SELECT '{child}' AS child_table, '{column}' AS child_column, mean, least, most, sd, CASE WHEN sd < 0.5 OR least = most THEN 'fixed' ELSE 'poisson' END AS strategy FROM (SELECT {places_sql('avg(n)', 4)} AS mean, min(n) AS least, max(n) AS most, {places_sql('coalesce(stddev_samp(n), 0)', 4)} AS sd FROM (SELECT count(*) AS n FROM {child} WHERE {column} IS NOT NULL GROUP BY {column}) c) s"


@query("cardinality_estimate", " UNION ALL ".join(_children_sql(c, cc) for c, cc, _, _ in _CARDINALITY))
def cardinality_estimate(spark, sf_dir):
    return union([children(table(spark, sf_dir, c), cc).select(F.lit(c).alias("child_table"), F.lit(cc).alias("child_column"), "*") for c, cc, _, _ in _CARDINALITY])


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
EMAIL = "^[^@ ]+@[^@ ]+[.][^@ ]+$"


def ladder(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A generation strategy for each column from its values: enum, boolean, uuid, email, timestamp, integer, float, text."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    values = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, value)")).where("value IS NOT NULL AND value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    all_are = lambda test: F.min(F.coalesce(test, F.lit(False)))
    each = values.groupBy("column").agg(
        F.sum(n).alias("n"),
        F.count("*").alias("d"),
        all_are(F.lower(v).isin("true", "false", "0", "1")).alias("boolean"),
        all_are(v.rlike(UUID)).alias("uuid"),
        all_are(v.rlike(EMAIL)).alias("email"),
        all_are(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("timestamp"),
        all_are(v.rlike("^-?[0-9]+$")).alias("integer"),
        all_are(v.rlike("^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$")).alias("float"),
    )
    unique = F.col("d") / F.col("n")
    kind = F.when((F.col("d") <= 15) & (unique < 0.5) & (F.col("n") >= 5), "enum")
    for name in ("boolean", "uuid", "email", "timestamp", "integer", "float"):
        kind = kind.when(F.col(name), name)
    return each.select("column", kind.otherwise("text").alias("strategy"))


def _ladder_sql(source: str, columns: tuple[str, ...]) -> str:
    return f"""SELECT "column", CASE WHEN d <= 15 AND d::DOUBLE / n < 0.5 AND n >= 5 THEN 'enum' WHEN b THEN 'boolean' WHEN u THEN 'uuid' WHEN e THEN 'email' WHEN t THEN 'timestamp' WHEN i THEN 'integer' WHEN f THEN 'float' ELSE 'text' END AS strategy FROM
 (SELECT "column", sum(n) AS n, count(*) AS d, bool_and(lower(value) IN ('true', 'false', '0', '1')) AS b, bool_and(regexp_matches(value, '{UUID}')) AS u, bool_and(regexp_matches(value, '{EMAIL}')) AS e,
 bool_and(regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS t, bool_and(regexp_matches(value, '^-?[0-9]+$')) AS i, bool_and(regexp_matches(value, '^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$')) AS f FROM {frequencies_sql(source, columns)} v GROUP BY 1) s"""


@query("strategy_ladder", _ladder_sql("orders", star.COLUMNS["orders"]))
def strategy_ladder(spark, sf_dir):
    return ladder(table(spark, sf_dir, "orders"), star.COLUMNS["orders"])


@query("json_fields", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS n_without FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    """Fields of a JSON column, by event type."""
    field = lambda path: F.get_json_object("props", path)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(field("$.k").cast("long")).alias("total"), F.count_if(field("$.missing").isNull()).alias("n_without"))
