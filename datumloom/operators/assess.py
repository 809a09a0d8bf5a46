"""Quality assessment: one row for each metric and table, scores by pillar and overall.

Every metric is ``passed`` of ``checked`` with score round(100 * passed / checked),
halves upwards, and 100 where nothing could be checked. A table's metrics come from
one aggregate over it wherever that is possible, so a table is scanned few times.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.functions.numbers import half_up, places, uniform, uniform_sql
from datumloom.plans import star
from datumloom.registry import TABLES, query, table


def missing(df: DataFrame, name: str) -> Column:
    """Null; for strings also empty, 'NULL' or 'null'."""
    c = F.col(name)
    return c.isNull() | c.isin("", "NULL", "null") if dict(df.dtypes)[name] == "string" else c.isNull()


def score(passed: Column, checked: Column) -> Column:
    return F.when(checked > 0, half_up(100.0 * passed / checked)).otherwise(100).cast("long")


SCORE = "CAST(CASE WHEN checked > 0 THEN floor(100.0::DOUBLE * passed / checked + 0.5) ELSE 100 END AS BIGINT)"


def metric(df: DataFrame, name: str, pillar: str) -> DataFrame:
    """metric, pillar, passed, checked, score from a frame with passed and checked."""
    return df.select(F.lit(name).alias("metric"), F.lit(pillar).alias("pillar"), F.col("passed").cast("double").alias("passed"), F.col("checked").cast("long").alias("checked"), score(F.col("passed"), F.col("checked")).alias("score"))


def metric_sql(inner: str, name: str, pillar: str) -> str:
    return f"SELECT '{name}' AS metric, '{pillar}' AS pillar, passed::DOUBLE AS passed, checked::BIGINT AS checked, {SCORE} AS score FROM ({inner}) m"


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# A table with gaps, since the given ones have none.
def with_gaps(customers: DataFrame) -> DataFrame:
    """Customers with a twentieth of balances null, some segments empty and some names 'NULL'."""
    u = lambda column: uniform(11, "customer", column, F.col("c_custkey"))
    return (
        customers.withColumn("c_acctbal", F.when(u("c_acctbal") >= 0.05, F.col("c_acctbal")))
        .withColumn("c_mktsegment", F.when(u("c_mktsegment") < 0.03, "").otherwise(F.col("c_mktsegment")))
        .withColumn("c_name", F.when(u("c_name") < 0.02, "NULL").otherwise(F.col("c_name")))
    )


def _u(column: str) -> str:
    return uniform_sql(11, "customer", column, "c_custkey")


GAPS = f"""(SELECT c_custkey, c_nationkey, CASE WHEN {_u("c_acctbal")} >= 0.05 THEN c_acctbal END AS c_acctbal,
 CASE WHEN {_u("c_mktsegment")} < 0.03 THEN '' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN {_u("c_name")} < 0.02 THEN 'NULL' ELSE c_name END AS c_name FROM customer)"""


def completeness(df: DataFrame) -> DataFrame:
    """passed (present cells) of checked (all cells), in one aggregate."""
    gaps = sum((F.coalesce(F.sum(missing(df, c).cast("long")), F.lit(0)) for c in df.columns), F.lit(0))
    cells = F.count("*") * len(df.columns)
    return df.agg((cells - gaps).alias("passed"), cells.alias("checked"))


_COMPLETE = f"""SELECT n * 5 - gaps AS passed, n * 5 AS checked FROM (SELECT count(*) AS n, sum((c_custkey IS NULL)::INT + (c_nationkey IS NULL)::INT + (c_acctbal IS NULL)::INT
 + (c_mktsegment IS NULL OR c_mktsegment IN ('', 'NULL', 'null'))::INT + (c_name IS NULL OR c_name IN ('', 'NULL', 'null'))::INT) AS gaps FROM {GAPS} g) t"""


@query("completeness", metric_sql(_COMPLETE, "completeness", "fidelity"))
def completeness_query(spark, sf_dir):
    return metric(completeness(with_gaps(table(spark, sf_dir, "customer"))), "completeness", "fidelity")


def frequencies(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, value (as text), n for non-null values of several columns: one scan, one shuffle."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, value)")).where("value IS NOT NULL AND value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))


def frequencies_sql(source: str, columns: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {source}" for c in columns)
    return f"(SELECT \"column\", value, count(*) AS n FROM ({parts}) p WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2)"


def entropy(counts: DataFrame) -> DataFrame:
    """column, n, n_distinct, entropy in bits, and normalized entropy, for categorical columns (n >= 5, at most half distinct)."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    bits = F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")
    normal = F.when(F.col("n_distinct") > 1, bits / F.log2(F.col("n_distinct").cast("double"))).otherwise(0.0)
    return totals.where("total >= 5 AND n_distinct <= 0.5 * total").select("column", F.col("total").alias("n"), "n_distinct", places(bits, 6).alias("entropy"), places(normal, 6).alias("normalized"))


def _entropy_sql(source: str, columns: tuple[str, ...]) -> str:
    bits = "(log2(total::DOUBLE) - nlogn / total)"
    return f"""SELECT "column", total::BIGINT AS n, n_distinct, floor({bits} * 1000000 + 0.5) / 1000000 AS entropy,
 floor(CASE WHEN n_distinct > 1 THEN {bits} / log2(n_distinct::DOUBLE) ELSE 0 END * 1000000 + 0.5) / 1000000 AS normalized
 FROM (SELECT "column", sum(n) AS total, count(*) AS n_distinct, sum(n * log2(n::DOUBLE)) AS nlogn FROM {frequencies_sql(source, columns)} f GROUP BY 1) t WHERE total >= 5 AND n_distinct <= 0.5 * total"""


@query("column_entropy", _entropy_sql("orders", star.COLUMNS["orders"]))
def column_entropy(spark, sf_dir):
    return entropies(table(spark, sf_dir, "orders"), star.COLUMNS["orders"])


def categorical(df: DataFrame, columns: tuple[str, ...]) -> tuple[str, ...]:
    """The columns that may have at most half as many distinct values as rows, by one aggregate of approximate counts with room for their error.

    The others, such as keys and texts, need not be counted by value.
    """
    row = df.agg(F.count("*").alias("rows"), *(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)), *(F.count(c).alias(f"n{i}") for i, c in enumerate(columns))).first()
    return tuple(c for i, c in enumerate(columns) if row[f"d{i}"] <= 0.65 * row[f"n{i}"] or row["rows"] < 1000)


def entropies(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The entropy of each categorical column."""
    return entropy(frequencies(df, categorical(df, columns) or columns[:1]))


def diversity(each: DataFrame) -> DataFrame:
    return each.agg(F.count_if(F.col("normalized") > 0.5).alias("passed"), F.count("*").alias("checked"))


_DIVERSE = " UNION ALL ".join(f"SELECT normalized FROM ({_entropy_sql(t, star.COLUMNS[t])}) x_{t}" for t in star.ASSESSED)


@query("distribution_entropy", metric_sql(f"SELECT count(*) FILTER (WHERE normalized > 0.5) AS passed, count(*) AS checked FROM ({_DIVERSE}) d", "distribution_entropy", "fidelity"))
def distribution_entropy(spark, sf_dir):
    each = union([entropies(table(spark, sf_dir, t), star.COLUMNS[t]) for t in star.ASSESSED])
    return metric(diversity(each), "distribution_entropy", "fidelity")


def correlations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """x, y and Pearson's r of every pair over rows where both are present; 0 where r is undefined."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    stacked = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    r = F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    return row.select(F.expr(f"stack({len(pairs)}, {stacked}) AS (x, y, r)")).select("x", "y", places(r, 6).alias("r"))


def _correlations_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, floor(coalesce(corr({a}::DOUBLE, {b}::DOUBLE), 0) * 1000000 + 0.5) / 1000000 AS r FROM {source}" for a, b in combinations(columns, 2))


@query("pairwise_correlation", _correlations_sql("lineitem", star.NUMERIC["lineitem"]))
def pairwise_correlation(spark, sf_dir):
    return correlations(table(spark, sf_dir, "lineitem"), star.NUMERIC["lineitem"])


_STABLE = " UNION ALL ".join(_correlations_sql(t, c) for t, c in star.NUMERIC.items())


@query("correlation_stability", metric_sql(f"SELECT count(*) FILTER (WHERE abs(r) < 0.99) AS passed, count(*) AS checked FROM ({_STABLE}) c", "correlation_stability", "fidelity"))
def correlation_stability(spark, sf_dir):
    each = union([correlations(table(spark, sf_dir, t), c) for t, c in star.NUMERIC.items()])
    return metric(each.agg(F.count_if(F.abs("r") < 0.99).alias("passed"), F.count("*").alias("checked")), "correlation_stability", "fidelity")


def references_sql(child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT count(*) FILTER (WHERE {column} IN (SELECT {key} FROM {parent})) AS passed, count(*) AS checked FROM {child} WHERE {column} IS NOT NULL"


_FK_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, checked AS total_refs, passed AS valid_refs, {SCORE} AS pct FROM ({references_sql(c, cc, p, pk)}) r" for c, cc, p, pk in star.FOREIGN_KEYS
)


def reference_rows(spark, sf_dir, keep: float = 1.0) -> DataFrame:
    """One row for each reference of the star schema; ``keep`` < 1 leaves out parents by hash, to show violations.

    Each child table is scanned once for all its references. References are counted by
    value before they meet their parents, so the join has at most one row for each
    referenced value, however often a hot parent is referenced.
    """
    numbered = list(enumerate(star.FOREIGN_KEYS))
    children, parents = [], []
    for child in dict.fromkeys(c for _, (c, *_) in numbered):
        own = [f"{i}, CAST({column} AS BIGINT)" for i, (c, column, _, _) in numbered if c == child]
        children.append(table(spark, sf_dir, child).select(F.expr(f"stack({len(own)}, {', '.join(own)}) AS (fk, k)")))
    for i, (_, _, parent, key) in numbered:
        keys = table(spark, sf_dir, parent).select(F.lit(i).alias("fk"), F.col(key).cast("long").alias("k"))
        parents.append(keys.where(uniform(5, parent, key, F.col("k")) < keep) if keep < 1 else keys)
    counts = union(children).where("k IS NOT NULL").groupBy("fk", "k").agg(F.count("*").alias("n"))
    there = union(parents).distinct().withColumn("there", F.lit(True))
    sums = counts.join(there, ["fk", "k"], "left").groupBy("fk").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("there"), F.col("n")).otherwise(0)).alias("valid"))
    named = spark.createDataFrame([(i, c, cc, p) for i, (c, cc, p, _) in numbered], "fk int, child_table string, child_column string, parent_table string")
    total, valid = F.coalesce("total", F.lit(0)), F.coalesce("valid", F.lit(0))
    return named.join(sums, "fk", "left").select("child_table", "child_column", "parent_table", total.alias("total_refs"), valid.alias("valid_refs"), score(valid, total).alias("pct"))


@query("fk_integrity", _FK_ROWS)
def fk_integrity(spark, sf_dir):
    return reference_rows(spark, sf_dir)


_FK_BROKEN = " UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, checked AS total_refs, passed AS valid_refs, {SCORE} AS pct FROM "
    f"({references_sql(c, cc, f'(SELECT * FROM {p} WHERE {uniform_sql(5, p, pk, pk)} < 0.9) k', pk)}) r"
    for c, cc, p, pk in star.FOREIGN_KEYS
)


@query("fk_integrity_violations", _FK_BROKEN)
def fk_integrity_violations(spark, sf_dir):
    return reference_rows(spark, sf_dir, keep=0.9)


@query("fk_violating_rows", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {uniform_sql(5, 'customer', 'c_custkey', 'c_custkey')} < 0.9)")
def fk_violating_rows(spark, sf_dir):
    """The orders themselves whose customer is absent."""
    kept = table(spark, sf_dir, "customer").where(uniform(5, "customer", "c_custkey", F.col("c_custkey")) < 0.9)
    orders = table(spark, sf_dir, "orders")
    return orders.join(kept, orders.o_custkey == kept.c_custkey, "left_anti").select("o_orderkey", "o_custkey")


_FK = f"SELECT sum(valid_refs) AS passed, sum(total_refs) AS checked FROM ({_FK_ROWS}) f"


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count_distinct(key) == F.count(key)).cast("int").alias("passed"), F.lit(1).alias("checked"))


_PK = "SELECT sum(p) AS passed, count(*) AS checked FROM (" + " UNION ALL ".join(f"SELECT (count(DISTINCT {k}) = count({k}))::INT AS p FROM {t}" for t, k in star.PRIMARY_KEYS.items()) + ") u"


@query("pk_uniqueness", metric_sql(_PK, "pk_uniqueness", "structure"))
def pk_uniqueness(spark, sf_dir):
    each = union([uniqueness(table(spark, sf_dir, t), k) for t, k in star.PRIMARY_KEYS.items()])
    return metric(each.agg(F.sum("passed").alias("passed"), F.sum("checked").alias("checked")), "pk_uniqueness", "structure")


#: Items of one partition of a join with orders, about.
ITEMS_EACH = 500_000


def ordered_items(spark, sf_dir) -> DataFrame:
    """Items with their orders. Partitions follow the number of items where the session's would hold more, so a task's sort doesn't grow with the tables."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = -(-items.count() // ITEMS_EACH)  # from the files' footers
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        items, orders = items.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def shipments(spark, sf_dir) -> DataFrame:
    """Items with the order's date as created_at and the shipping date as shipped_at."""
    return ordered_items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("created_at"), F.col("l_shipdate").alias("shipped_at"))


SHIPMENTS = "(SELECT l_orderkey, l_linenumber, o_orderdate AS created_at, l_shipdate AS shipped_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def in_order(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """passed and checked over pairs (earlier, later) where both are present."""
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    good = [F.coalesce(F.col(a) <= F.col(b), F.lit(False)) for a, b in pairs]
    return df.agg(sum((F.count_if(g) for g in good), F.lit(0)).alias("passed"), sum((F.count_if(b) for b in both), F.lit(0)).alias("checked"))


_TEMPORAL = f"SELECT count(*) FILTER (WHERE created_at <= shipped_at) AS passed, count(*) FILTER (WHERE created_at IS NOT NULL AND shipped_at IS NOT NULL) AS checked FROM {SHIPMENTS} s"


@query("temporal_logic", metric_sql(_TEMPORAL, "temporal_logic", "structure"))
def temporal_logic(spark, sf_dir):
    return metric(in_order(shipments(spark, sf_dir), [("created_at", "shipped_at")]), "temporal_logic", "structure")


def minimum_age(df: DataFrame, birth: str, event: str, years: float) -> DataFrame:
    age = (F.unix_timestamp(event) - F.unix_timestamp(birth)) / 31557600
    known = F.col(birth).isNotNull() & F.col(event).isNotNull()
    return df.agg(F.count_if(known & (age >= years)).alias("passed"), F.count_if(known).alias("checked"))


_AGE = f"SELECT count(*) FILTER (WHERE days * 86400 / 31557600.0::DOUBLE >= 18) AS passed, count(*) AS checked FROM (SELECT floor({uniform_sql(3, 'orders', 'birth', 'o_orderkey')} * 20000) + 5000 AS days FROM orders) a"


@query("semantic_rules", metric_sql(_AGE, "semantic_rules", "structure"))
def semantic_rules(spark, sf_dir):
    """Orders whose (made) customer was at least 18 years old."""
    days = (F.floor(uniform(3, "orders", "birth", F.col("o_orderkey")) * 20000) + 5000).cast("long")
    orders = table(spark, sf_dir, "orders").withColumn("birth", (F.unix_timestamp("o_orderdate") - days * 86400).cast("timestamp"))
    return metric(minimum_age(orders, "birth", "o_orderdate", 18), "semantic_rules", "structure")


def enum_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column and whether it holds no stand-in for a missing value, for columns of few values (n >= 5, at most 20 and half distinct)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    values = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, value)")).where("value IS NOT NULL AND value <> 'NULL'")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    bad = F.lower(F.trim("value")).isin("", "none", "n/a")
    return counts.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.max(bad).alias("bad")).where("n >= 5 AND n_distinct <= least(0.5 * n, 20)").select("column", (~F.col("bad")).alias("valid"))


def _enum_sql(source: str, columns: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {source}" for c in columns)
    return f"""SELECT "column", NOT bad AS valid FROM (SELECT "column", sum(n) AS n, count(*) AS n_distinct, bool_or(lower(trim(value)) IN ('', 'none', 'n/a')) AS bad
 FROM (SELECT "column", value, count(*) AS n FROM ({parts}) p WHERE value IS NOT NULL AND value <> 'NULL' GROUP BY 1, 2) c GROUP BY 1) t WHERE n >= 5 AND n_distinct <= least(0.5 * n, 20)"""


_ENUM = " UNION ALL ".join(f"SELECT valid FROM ({_enum_sql(GAPS + ' g' if t == 'customer' else t, star.COLUMNS[t])}) e_{t}" for t in ("customer", "orders"))


@query("enum_validity", metric_sql(f"SELECT count(*) FILTER (WHERE valid) AS passed, count(*) AS checked FROM ({_ENUM}) e", "enum_validity", "structure"))
def enum_validity(spark, sf_dir):
    each = union([enum_columns(with_gaps(table(spark, sf_dir, "customer")), star.COLUMNS["customer"]), enum_columns(table(spark, sf_dir, "orders"), star.COLUMNS["orders"])])
    return metric(each.agg(F.count_if("valid").alias("passed"), F.count("*").alias("checked")), "enum_validity", "structure")


#: Declared mean children for each parent, of a child's first reference.
DECLARED = {"orders": 10.0, "lineitem": 4.0, "customer": 60.0}


def ratio_points(ratio: Column, declared: float | None) -> Column:
    """1 within 20 % of the declared mean, 0.5 within 50 %, else 0; undeclared: 1 from 0.001 to 100."""
    if declared is None:
        return F.when(ratio.between(0.001, 100), 1.0).otherwise(0.0)
    off = F.abs(ratio - declared) / declared
    return F.when(off <= 0.2, 1.0).when(off <= 0.5, 0.5).otherwise(0.0)


def _ratio_sql(child: str, parent: str, declared: float | None) -> str:
    points = "CASE WHEN ratio BETWEEN 0.001 AND 100 THEN 1.0 ELSE 0.0 END" if declared is None else f"CASE WHEN abs(ratio - {declared}) / {declared} <= 0.2 THEN 1.0 WHEN abs(ratio - {declared}) / {declared} <= 0.5 THEN 0.5 ELSE 0.0 END"
    return f"SELECT '{child}' AS child_table, '{parent}' AS parent_table, ratio, ({points})::DOUBLE AS points FROM (SELECT (SELECT count(*) FROM {child})::DOUBLE / (SELECT count(*) FROM {parent}) AS ratio) q"


def _with_declared() -> list[tuple[str, str, float | None]]:
    first: set[str] = set()
    out = []
    for child, _, parent, _ in star.FOREIGN_KEYS:
        out.append((child, parent, DECLARED.get(child) if child not in first else None))
        first.add(child)
    return out


_RATIOS = " UNION ALL ".join(_ratio_sql(*r) for r in _with_declared())


@query("cardinality_ratio", _RATIOS)
def cardinality_ratio(spark, sf_dir):
    rows = []
    for child, parent, declared in _with_declared():
        counted = table(spark, sf_dir, child).agg(F.count("*").alias("c")).crossJoin(table(spark, sf_dir, parent).agg(F.count("*").alias("p")))  # one row each
        rows.append(counted.select(F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"), (F.col("c").cast("double") / F.col("p")).alias("ratio")).withColumn("points", ratio_points(F.col("ratio"), declared)))
    return union(rows)


_K_GROUPS = (("orders", ("o_orderpriority", "o_orderstatus")), ("customer", ("c_nationkey", "c_mktsegment")))


def k_of(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The least group over the quasi-identifiers, of tables with ten rows or more."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.min("n").alias("k"), F.sum("n").alias("rows")).where("rows >= 10").select("k")


def k_score(k: Column) -> Column:
    return F.when(k >= 10, 100).when(k >= 5, 80).when(k >= 3, 50).otherwise(20).cast("long")


_K = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", k, CAST(CASE WHEN k >= 10 THEN 100 WHEN k >= 5 THEN 80 WHEN k >= 3 THEN 50 ELSE 20 END AS BIGINT) AS score FROM (SELECT min(n) AS k, sum(n) AS r FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(c)}) g) h WHERE r >= 10" for t, c in _K_GROUPS)


@query("k_anonymity", _K)
def k_anonymity(spark, sf_dir):
    return union([k_of(table(spark, sf_dir, t), c).select(F.lit(t).alias("table"), "k", k_score(F.col("k")).alias("score")) for t, c in _K_GROUPS])


def duplicates(df: DataFrame) -> DataFrame:
    """n rows and how many repeat another row wholly; rows are combined before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


_DUPES = "SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem) x GROUP BY l_orderkey, l_linenumber, l_returnflag) g"


@query("exact_match_rate", f"SELECT n_rows, n_duplicates, CAST(CASE WHEN n_duplicates = 0 THEN 100 WHEN 100.0 * n_duplicates / n_rows < 1 THEN 80 WHEN 100.0 * n_duplicates / n_rows < 5 THEN 50 ELSE 20 END AS BIGINT) AS score FROM ({_DUPES}) d")
def exact_match_rate(spark, sf_dir):
    found = duplicates(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    rate = 100.0 * F.col("n_duplicates") / F.col("n_rows")
    return found.select("n_rows", "n_duplicates", F.when(F.col("n_duplicates") == 0, 100).when(rate < 1, 80).when(rate < 5, 50).otherwise(20).cast("long").alias("score"))


_SENSITIVE = metric_sql("SELECT sum(d)::DOUBLE AS passed, count(*) AS checked FROM (" + " UNION ALL ".join(f"SELECT (count(DISTINCT {c})::DOUBLE / count({c}) > 0.8)::INT AS d FROM {t} HAVING count({c}) >= 5" for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))) + ") s", "sensitive_uniqueness", "privacy")


@query("sensitive_uniqueness", _SENSITIVE)
def sensitive_uniqueness(spark, sf_dir):
    each = [table(spark, sf_dir, t).agg(F.count_distinct(c).alias("d"), F.count(c).alias("n")).where("n >= 5").select((F.col("d") / F.col("n") > 0.8).cast("int").alias("p")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return metric(union(each).agg(F.sum("p").alias("passed"), F.count("*").alias("checked")), "sensitive_uniqueness", "privacy")


_ROOTS = ("region", "part", "documents")
_LEVELS = "CASE WHEN n < 500 THEN 'LOW' WHEN n < 5000 THEN 'MEDIUM' WHEN n < 50000 THEN 'HIGH' ELSE 'VERY_HIGH' END"


@query("scale_confidence", "SELECT n, CAST(floor(100 / sqrt(n) + 0.5) AS BIGINT) AS margin, " + _LEVELS + " AS level FROM (SELECT min(n) AS n FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in _ROOTS) + ") r) m")
def scale_confidence(spark, sf_dir):
    """How far the smallest root table's size supports the metrics."""
    least = union([table(spark, sf_dir, t).agg(F.count("*").alias("n")) for t in _ROOTS]).agg(F.min("n").alias("n"))
    level = F.when(F.col("n") < 500, "LOW").when(F.col("n") < 5000, "MEDIUM").when(F.col("n") < 50000, "HIGH").otherwise("VERY_HIGH")
    return least.select("n", half_up(100 / F.sqrt("n")).cast("long").alias("margin"), level.alias("level"))


#: Column names that tell of personal data, by kind, in lower case; an underscore is part of a word.
PII_NAMES = {
    "SSN": (r"\bssn\b", r"\bsocial.?security"),
    "Email": (r"\bemail\b",),
    "Phone": (r"\bphone\b", r"\bmobile\b", r"\bcell\b"),
    "Credit Card": (r"\bcredit.?card\b", r"\bcard.?num", r"\bcc.?num"),
    "DOB": (r"\bdob\b", r"\bdate.?of.?birth", r"\bbirth.?date"),
    "Name": (r"\bfull.?name\b", r"\bfirst.?name\b", r"\blast.?name\b"),
    "Address": (r"\baddress\b", r"\bstreet\b"),
    "IP Address": (r"\bip.?addr", r"\bsource.?ip"),
    "Passport": (r"\bpassport",),
    "Driver License": (r"\bdriver.?lic", r"\bdl.?num"),
}


def pii_kind(column: str) -> str | None:
    """The first kind of personal data that a column's name tells of."""
    return next((kind for kind, patterns in PII_NAMES.items() if any(re.search(p, column, re.IGNORECASE) for p in patterns)), None)


def columns_of(spark, sf_dir, names: tuple[str, ...]) -> DataFrame:
    """table and column of the named tables: metadata alone, no rows are read."""
    return spark.createDataFrame([(t, c) for t in names for c in table(spark, sf_dir, t).columns], "table string, column string")


_COLUMNS = "(SELECT table_name AS \"table\", column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ({0}))"
_ANY_PII = "|".join(p for patterns in PII_NAMES.values() for p in patterns)
_PII_METRIC = f"SELECT 'pii_columns' AS metric, 'privacy' AS pillar, (n - d)::DOUBLE AS passed, n AS checked, greatest(0, 100 - 15 * d)::BIGINT AS score FROM (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(\"column\"), '{_ANY_PII}')) AS d FROM {_COLUMNS.format(', '.join(repr(t) for t in TABLES))} c) m"


@query("pii_column_metric", _PII_METRIC)
def pii_column_metric(spark, sf_dir):
    """Columns whose names don't tell of personal data; each one that does takes 15 points."""
    found = columns_of(spark, sf_dir, TABLES).agg(F.count("*").alias("n"), F.count_if(F.lower("column").rlike(_ANY_PII)).alias("d"))
    return found.select(F.lit("pii_columns").alias("metric"), F.lit("privacy").alias("pillar"), (F.col("n") - F.col("d")).cast("double").alias("passed"), F.col("n").alias("checked"), F.greatest(F.lit(0), 100 - 15 * F.col("d")).cast("long").alias("score"))


_K_METRIC = f"SELECT 'k_anonymity' AS metric, 'privacy' AS pillar, min(k)::DOUBLE AS passed, count(*) AS checked, CAST(CASE WHEN count(*) = 0 OR min(k) >= 10 THEN 100 WHEN min(k) >= 5 THEN 80 WHEN min(k) >= 3 THEN 50 ELSE 20 END AS BIGINT) AS score FROM ({_K}) k"
_DUPES_METRIC = f"SELECT 'exact_match_rate' AS metric, 'privacy' AS pillar, (n_rows - n_duplicates)::DOUBLE AS passed, n_rows AS checked, CAST(CASE WHEN n_duplicates = 0 THEN 100 WHEN 100.0 * n_duplicates / n_rows < 1 THEN 80 WHEN 100.0 * n_duplicates / n_rows < 5 THEN 50 ELSE 20 END AS BIGINT) AS score FROM ({_DUPES}) d"


def privacy_metrics(spark, sf_dir) -> DataFrame:
    """The privacy pillar's metrics; for k-anonymity ``passed`` is the least group and ``checked`` the number of tables."""
    named = lambda name: (F.lit(name).alias("metric"), F.lit("privacy").alias("pillar"))
    k = k_anonymity(spark, sf_dir).agg(F.min("k").alias("k"), F.count("*").alias("n"))
    exact = exact_match_rate(spark, sf_dir)
    return union(
        [
            k.select(*named("k_anonymity"), F.col("k").cast("double").alias("passed"), F.col("n").alias("checked"), F.coalesce(k_score(F.col("k")), F.lit(100)).cast("long").alias("score")),
            exact.select(*named("exact_match_rate"), (F.col("n_rows") - F.col("n_duplicates")).cast("double").alias("passed"), F.col("n_rows").alias("checked"), "score"),
            pii_column_metric(spark, sf_dir),
            sensitive_uniqueness(spark, sf_dir),
        ]
    )


_METRICS = " UNION ALL ".join(
    [
        metric_sql(_COMPLETE, "completeness", "fidelity"),
        metric_sql(f"SELECT count(*) FILTER (WHERE normalized > 0.5) AS passed, count(*) AS checked FROM ({_DIVERSE}) d", "distribution_entropy", "fidelity"),
        metric_sql(f"SELECT count(*) FILTER (WHERE abs(r) < 0.99) AS passed, count(*) AS checked FROM ({_STABLE}) c", "correlation_stability", "fidelity"),
        metric_sql(_FK, "fk_integrity", "structure"),
        metric_sql(_PK, "pk_uniqueness", "structure"),
        metric_sql(_TEMPORAL, "temporal_logic", "structure"),
        metric_sql(_AGE, "semantic_rules", "structure"),
        metric_sql(f"SELECT count(*) FILTER (WHERE valid) AS passed, count(*) AS checked FROM ({_ENUM}) e", "enum_validity", "structure"),
        metric_sql(f"SELECT sum(points) AS passed, count(*) AS checked FROM ({_RATIOS}) r", "cardinality_ratio", "structure"),
        _K_METRIC,
        _DUPES_METRIC,
        _PII_METRIC,
        _SENSITIVE,
    ]
)


def all_metrics(spark, sf_dir) -> DataFrame:
    fk = reference_rows(spark, sf_dir).agg(F.sum("valid_refs").alias("passed"), F.sum("total_refs").alias("checked"))
    ratios = cardinality_ratio(spark, sf_dir).agg(F.sum("points").alias("passed"), F.count("*").alias("checked"))
    return union(
        [
            completeness_query(spark, sf_dir),
            distribution_entropy(spark, sf_dir),
            correlation_stability(spark, sf_dir),
            metric(fk, "fk_integrity", "structure"),
            pk_uniqueness(spark, sf_dir),
            temporal_logic(spark, sf_dir),
            semantic_rules(spark, sf_dir),
            enum_validity(spark, sf_dir),
            metric(ratios, "cardinality_ratio", "structure"),
            privacy_metrics(spark, sf_dir),
        ]
    )


@query("assessment", _METRICS)
def assessment(spark, sf_dir):
    """All thirteen metric rows of the star schema, of three pillars."""
    return all_metrics(spark, sf_dir)


@query("pillar_scores", f"SELECT pillar, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score FROM ({_METRICS}) m GROUP BY pillar")
def pillar_scores(spark, sf_dir):
    return all_metrics(spark, sf_dir).groupBy("pillar").agg(half_up(F.avg("score")).cast("long").alias("score"))


@query("overall_score", f"SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, min(score) >= 90 AS passes FROM (SELECT pillar, floor(avg(score) + 0.5) AS score FROM ({_METRICS}) m GROUP BY pillar) p")
def overall_score(spark, sf_dir):
    """The rounded mean of the pillars, and whether each of them reaches the gate of 90."""
    return pillar_scores(spark, sf_dir).agg(half_up(F.avg("score")).cast("long").alias("score"), (F.min("score") >= 90).alias("passes"))


@query("dora_rollup", f"""SELECT article, CASE worst WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' ELSE 'fail' END AS status FROM (SELECT 'article_10' AS article, CASE WHEN fk >= 100 AND tl >= 95 THEN 0 WHEN fk >= 90 OR tl >= 90 THEN 1 ELSE 2 END AS worst
 FROM (SELECT max(score) FILTER (WHERE metric = 'fk_integrity') AS fk, max(score) FILTER (WHERE metric = 'temporal_logic') AS tl FROM ({_METRICS}) m) s UNION ALL SELECT 'article_12', 0) a""")
def dora_rollup(spark, sf_dir):
    """Article 10 from the reference and temporal scores; article 12 always passes."""
    s = all_metrics(spark, sf_dir).agg(F.max(F.when(F.col("metric") == "fk_integrity", F.col("score"))).alias("fk"), F.max(F.when(F.col("metric") == "temporal_logic", F.col("score"))).alias("tl"))
    status = F.when((F.col("fk") >= 100) & (F.col("tl") >= 95), "pass").when((F.col("fk") >= 90) | (F.col("tl") >= 90), "partial").otherwise("fail")
    return s.select(F.expr("stack(2, 'article_10', 'x', 'article_12', 'pass') AS (article, given)"), status.alias("ten")).select("article", F.when(F.col("article") == "article_10", F.col("ten")).otherwise(F.col("given")).alias("status"))


# The least that a standard asks for: completeness, references, keys and temporal order in percent, the
# least group of quasi-identifiers, and the largest share of repeated rows in percent.
STANDARDS = {"generic": (90, 100, 100, 100, 5, 0), "hipaa": (95, 100, 100, 100, 5, 0), "gdpr": (90, 100, 100, 100, 10, 0), "pci": (95, 100, 100, 100, 5, 0)}
_ASKED = ("completeness", "fk_integrity", "pk_uniqueness", "temporal_logic", "k_anonymity", "exact_match_rate")


@query(
    "standard_presets",
    f"""WITH m AS ({_METRICS}), s(standard, metric, threshold) AS (VALUES {", ".join(f"('{s}', '{m}', {t})" for s, row in STANDARDS.items() for m, t in zip(_ASKED, row))})
 SELECT standard, metric, threshold, value, CASE metric WHEN 'exact_match_rate' THEN value <= threshold ELSE value >= threshold END AS met FROM
 (SELECT standard, metric, threshold, CASE metric WHEN 'k_anonymity' THEN passed WHEN 'exact_match_rate' THEN 100.0::DOUBLE * (checked - passed) / checked ELSE score::DOUBLE END AS value FROM s JOIN m USING (metric)) v""",
)
def standard_presets(spark, sf_dir):
    """What each standard asks of six metrics, what was measured, and whether it is met."""
    wanted = spark.createDataFrame([(s, m, t) for s, row in STANDARDS.items() for m, t in zip(_ASKED, row)], "standard string, metric string, threshold int")
    rate = 100.0 * (F.col("checked") - F.col("passed")) / F.col("checked")
    value = F.when(F.col("metric") == "k_anonymity", F.col("passed")).when(F.col("metric") == "exact_match_rate", rate).otherwise(F.col("score").cast("double"))
    met = F.when(F.col("metric") == "exact_match_rate", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return wanted.join(all_metrics(spark, sf_dir), "metric").withColumn("value", value).select("standard", "metric", "threshold", "value", met.alias("met"))


LEVELS = ("LOW", "MEDIUM", "HIGH", "VERY_HIGH")


@query(
    "confidence_gate",
    f"""SELECT required, level, reached >= wanted AS passes FROM (SELECT level, CASE level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS reached FROM
 (SELECT {_LEVELS} AS level FROM (SELECT min(n) AS n FROM ({" UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in _ROOTS)}) r) m) l) a, (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2), ('VERY_HIGH', 3)) v(required, wanted)""",
)
def confidence_gate(spark, sf_dir):
    """For each level that may be required, whether the data's scale confidence reaches it."""
    order = F.array(*map(F.lit, LEVELS))
    found = scale_confidence(spark, sf_dir).select("level", F.explode(order).alias("required"))
    return found.select("required", "level", (F.array_position(order, F.col("level")) >= F.array_position(order, F.col("required"))).alias("passes"))
