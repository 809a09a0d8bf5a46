"""A part of several tables with closed references: no child without its parent, no chosen parent without its children.

Rows of a root table are chosen by a hash of their keys. Going down the references, a
child comes along if the parent it was chosen through does; going up, every parent that a
chosen row names is added. Both are semi-joins in the order of the reference graph.
"""

from __future__ import annotations

import functools
import graphlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.plans import star
from datumloom.registry import query, table
from datumloom.sources.dumps import scratch

Reference = tuple[str, str, str, str]


def parents_first(tables: Iterable[str], references: Iterable[Reference]) -> list[str]:
    """Tables in an order in which every parent comes before its children; a table's reference to itself is no cycle."""
    tables = list(tables)
    graph = {t: {p for child, _, p, _ in references if child == t and p in tables and p != t} for t in tables}
    return list(graphlib.TopologicalSorter(graph).static_order())


def captured(tables: dict[str, DataFrame], references: Iterable[Reference], root: str, chosen: DataFrame, key: str, path: str) -> dict[str, DataFrame]:
    """The rows of each table that belong to the ``chosen`` keys of the root table, written below ``path``.

    ``chosen`` has the column ``key``. A descendant of the root is taken through each of
    its references to a table that is the root or a descendant: all of them must be
    taken. Other tables give the rows that are named by rows taken, and by those in turn.
    A null reference names nothing and holds no row back that another one takes. Tables that no reference ties
    to the root stay empty.
    """
    references = [r for r in references if r[0] in tables and r[2] in tables]
    order = parents_first(tables, references)
    taken = {root: tables[root].join(chosen.select(key).distinct(), key, "left_semi")}

    def keep(name: str) -> None:
        taken[name].write.parquet(f"{path}/{name}")
        taken[name] = tables[name].sparkSession.read.schema(tables[name].schema).parquet(f"{path}/{name}")

    keep(root)
    for name in order[order.index(root) + 1 :]:
        through = [(c, p, k) for child, c, p, k in references if child == name and p in taken and p != name]
        if not through:
            continue
        rows = tables[name]
        for column, parent, parent_key in through:
            known = taken[parent].select(F.col(parent_key).alias("_k")).distinct()
            rows = rows.join(known, rows[column] == known["_k"], "left_semi") if len(through) == 1 else _held(rows, column, known)
        taken[name] = rows.where(F.coalesce(*(F.col(c).cast("string") for c, _, _ in through)).isNotNull())
        keep(name)
    down = set(taken)
    for name in reversed(order):
        if name in down:
            continue
        named: dict[str, DataFrame] = {}
        for child, c, p, k in references:
            if p == name and child in taken and child != name:
                values = taken[child].where(F.col(c).isNotNull()).select(F.col(c).alias("_k"))
                named[k] = named[k].union(values) if k in named else values
        parts = [tables[name].join(values.distinct(), tables[name][k] == F.col("_k"), "left_semi") for k, values in named.items()]
        if not parts:
            continue
        # Rows named by several keys of theirs come once.
        taken[name] = parts[0] if len(parts) == 1 else functools.reduce(DataFrame.union, parts).dropDuplicates()
        keep(name)
    return {t: taken.get(t, df.limit(0)) for t, df in tables.items()}


def _held(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose reference is known or null."""
    return rows.where(F.col(column).isNull()).unionByName(rows.join(known, rows[column] == known["_k"], "left_semi"))


def unresolved(tables: dict[str, DataFrame], references: Iterable[Reference]) -> DataFrame:
    """child, column, n_rows, n_torn for each reference: rows with a reference, and those whose parent isn't there; counted by value first."""
    out = None
    for child, column, parent, key in references:
        values = tables[child].groupBy(F.col(column).alias("v")).agg(F.count(column).alias("n"))
        known = tables[parent].select(F.col(key).alias("v"), F.lit(1).alias("there")).distinct()
        row = values.join(known, "v", "left").agg(
            F.lit(child).alias("child"), F.lit(column).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_torn")
        )
        out = row if out is None else out.unionByName(row)
    return out


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
REFERENCES = tuple(r for r in star.FOREIGN_KEYS if r[0] in TABLES)
SHARE = 0.2
_U = ("11", "capture", "customer")


def _capture(spark, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    chosen = tables["customer"].where(uniform(*_U, F.col("c_custkey")) < SHARE).select("c_custkey")
    return captured(tables, REFERENCES, "customer", chosen, "c_custkey", scratch(spark, "capture"))


_SQL = f"""WITH c AS (SELECT * FROM customer WHERE {uniform_sql(*_U, 'c_custkey')} < {SHARE}),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
e AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)),
r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""


@query("capture_tables", _SQL + " " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n, coalesce(sum({k}), 0)::BIGINT AS keys FROM {a}" for a, t, k in (("c", "customer", "c_custkey"), ("o", "orders", "o_orderkey"), ("l", "lineitem", "l_orderkey"), ("e", "events", "event_id"), ("p", "part", "p_partkey"), ("s", "supplier", "s_suppkey"), ("n", "nation", "n_nationkey"), ("r", "region", "r_regionkey"))))
def capture_tables(spark, sf_dir):
    """A fifth of the customers with all that belongs to them: rows of each table and the sum of their keys."""
    found, out = _capture(spark, sf_dir), None
    for t, k in (*star.PRIMARY_KEYS.items(), ("lineitem", "l_orderkey")):
        if t in found:
            row = found[t].agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.coalesce(F.sum(F.col(k).cast("long")), F.lit(0)).alias("keys"))
            out = row if out is None else out.unionByName(row)
    return out


_TORN = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{col}' AS \"column\", count({col}) AS n_rows, 0::BIGINT AS n_torn FROM {a}"
    for a, c, col in (("n", "nation", "n_regionkey"), ("c", "customer", "c_nationkey"), ("s", "supplier", "s_nationkey"), ("o", "orders", "o_custkey"), ("l", "lineitem", "l_orderkey"), ("l", "lineitem", "l_partkey"), ("l", "lineitem", "l_suppkey"), ("e", "events", "user_id"))
)


@query("capture_references", f"{_SQL} {_TORN}")
def capture_references(spark, sf_dir):
    """The captured rows' references, none of them torn."""
    return unresolved(_capture(spark, sf_dir), REFERENCES)
