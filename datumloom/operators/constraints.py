"""Constraints on times, found in a schema and its references, and rows settled so that none is broken.

A column of time may have to follow another one of its row (a life cycle) or the creation
of a parent. Columns and what they follow make a graph; its order says which column is
settled first, and constraints that run in a circle are left out and reported. Each
column becomes one expression over those settled before; a parent's times come by a join.
"""

from __future__ import annotations

import graphlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.operators.capture import Reference
from datumloom.plans import star
from datumloom.registry import query, table

# Parts of names of time columns; names of creation and of later events; the order of events in a life cycle; days within which each kind follows.
TIME_NAMES = (
    "created_at", "updated_at", "deleted_at", "signup_at", "registered_at", "started_at", "ended_at", "canceled_at", "cancelled_at", "ordered_at", "shipped_at", "delivered_at",
    "paid_at", "charged_at", "invoiced_at", "expires_at", "expired_at",
)
CREATION_NAMES = ("created_at", "signup_at", "registered_at", "ordered_at")
LATER_NAMES = ("deleted_at", "canceled_at", "cancelled_at", "ended_at", "updated_at", "shipped_at", "delivered_at", "expired_at")
LIFE_CYCLES = (("created_at", "updated_at", "deleted_at"), ("started_at", "canceled_at", "cancelled_at", "ended_at"), ("ordered_at", "shipped_at", "delivered_at"))
LIFE_CYCLE_DAYS, PARENT_DAYS = 90, 365
DAY = 86_400_000_000


@dataclass(frozen=True)
class Constraint:
    """``column`` follows ``after_column``, of the parent ``after_table`` if that is named, within so many days."""

    table: str
    column: str
    after_column: str
    within_days: int
    after_table: str | None = None
    reference: tuple[str, str] | None = None  # the row's column and the parent's key


@dataclass(frozen=True)
class Resolved:
    """Each table's creation column, constraints in the order of settling, and those left out since they run in a circle."""

    creation: dict[str, str]
    constraints: list[Constraint]
    circular: list[Constraint]
    order: list[tuple[str, str]]


def time_columns(schema: StructType) -> list[str]:
    """Columns that are times by type; text columns named like one can't be settled and don't count."""
    return [f.name for f in schema if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)]


def creation_column(columns: list[str]) -> str | None:
    """The column that says when a row came to be: by name, or else the first that isn't a later event."""
    for name in CREATION_NAMES:
        for c in columns:
            if c.lower() == name:
                return c
    return next((c for c in columns if c.lower() not in LATER_NAMES), None)


def life_cycle(columns: list[str]) -> list[str]:
    """The columns of the first known life cycle of which there are two or more, in its order."""
    for events in LIFE_CYCLES:
        found = [c for e in events for c in columns if c.lower() == e]
        if len(found) > 1:
            return found
    return []


def resolve(schemas: dict[str, StructType], references: Iterable[Reference]) -> Resolved:
    """All constraints of a schema, and an order in which they can be settled."""
    times = {t: time_columns(s) for t, s in schemas.items()}
    creation = {t: c for t, columns in times.items() if (c := creation_column(columns))}
    found: list[Constraint] = []
    for t, columns in times.items():
        chain = life_cycle(columns)
        found += [Constraint(t, b, a, LIFE_CYCLE_DAYS) for a, b in zip(chain, chain[1:])]
        for child, column, parent, key in references:
            if child == t and parent != t and t in creation and parent in creation:
                new = Constraint(t, creation[t], creation[parent], PARENT_DAYS, parent, (column, key))
                if not any((c.column, c.after_table, c.reference) == (new.column, parent, new.reference) for c in found):
                    found.append(new)
    nodes = {(t, c): set() for t, columns in times.items() for c in columns}
    kept, circular = [], []
    for c in found:
        before, after = (c.after_table or c.table, c.after_column), (c.table, c.column)
        if before == after or _reaches(nodes, before, after):
            circular.append(c)
        else:
            nodes[after].add(before)
            kept.append(c)
    order = list(graphlib.TopologicalSorter(nodes).static_order())
    place = {n: i for i, n in enumerate(order)}
    return Resolved(creation, sorted(kept, key=lambda c: place[c.table, c.column]), circular, order)


def _reaches(follows: dict[tuple[str, str], set[tuple[str, str]]], start: tuple[str, str], goal: tuple[str, str]) -> bool:
    """Whether ``start`` follows ``goal``, at once or through others."""
    seen, waiting = set(), [start]
    while waiting:
        node = waiting.pop()
        if node == goal:
            return True
        if node not in seen:
            seen.add(node)
            waiting += follows[node]
    return False


def settled_value(value: Column, after: list[tuple[Column, int]], u: Column) -> Column:
    """A time in microseconds that breaks no constraint: itself if it is fine, or else one between the latest time to follow and the first limit.

    Null stays null, and a null time to follow sets no bound.
    """
    low = after[0][0] if len(after) == 1 else F.greatest(*(a for a, _ in after))
    limits = [a + days * DAY for a, days in after]
    high = limits[0] if len(limits) == 1 else F.least(*limits)
    fine = low.isNull() | ((value >= low) & (value <= high))
    return F.when(value.isNull() | fine, value).otherwise(low + F.floor(u * F.greatest(high - low, F.lit(0))).cast("long"))


def settle(tables: dict[str, DataFrame], resolved: Resolved, keys: dict[str, tuple[str, ...]], seed: int = 42) -> dict[str, DataFrame]:
    """The tables with every constraint kept. New times are drawn by a row's ``keys`` (all columns where none are named).

    Columns are settled in the graph's order. A parent's settled times are joined by its
    key; of parents with equal keys the latest time counts.
    """
    out = dict(tables)
    by_column: dict[tuple[str, str], list[Constraint]] = {}
    for c in resolved.constraints:
        by_column.setdefault((c.table, c.column), []).append(c)
    for name, column in resolved.order:
        constraints = by_column.get((name, column))
        if not constraints or name not in out:
            continue
        df = out[name]
        plain, kind = df.columns, df.schema[column].dataType
        after: list[tuple[Column, int]] = []
        for i, c in enumerate(constraints):
            if c.after_table is None:
                after.append((_micros(F.col(f"`{c.after_column}`")), c.within_days))
                continue
            child_column, key = c.reference
            times = out[c.after_table].groupBy(F.col(f"`{key}`").alias(f"_k{i}")).agg(F.max(_micros(F.col(f"`{c.after_column}`"))).alias(f"_t{i}"))
            df = df.join(times, F.col(f"`{child_column}`") == F.col(f"_k{i}"), "left")
            after.append((F.col(f"_t{i}"), c.within_days))
        drawn = uniform(str(seed), name, column, F.concat_ws("|", *(F.col(f"`{k}`").cast("string") for k in keys.get(name, tuple(plain)))))
        value = settled_value(_micros(F.col(f"`{column}`")), after, drawn)
        timed = F.timestamp_micros(value)
        if isinstance(kind, DateType):
            # A date is its first moment: rounded up where the day began too early.
            timed = F.when(F.col(f"`{column}`").isNotNull(), F.date_add(F.timestamp_micros(value - 1).cast("date"), 1))
        out[name] = df.withColumn("_settled", timed.cast(kind)).select(*(F.col("_settled" if p == column else f"`{p}`").alias(p) for p in plain))
    return out


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def broken(tables: dict[str, DataFrame], resolved: Resolved) -> DataFrame:
    """table, column, after_table, after_column, n_rows with both times, n_broken, for each constraint."""
    out = None
    for c in resolved.constraints:
        df = tables[c.table]
        value = _micros(F.col(f"`{c.column}`"))
        if c.after_table is None:
            pairs = df.select(value.alias("v"), _micros(F.col(f"`{c.after_column}`")).alias("a"))
        else:
            child_column, key = c.reference
            times = tables[c.after_table].groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max(_micros(F.col(f"`{c.after_column}`"))).alias("a"))
            pairs = df.select(F.col(f"`{child_column}`").alias("_c"), value.alias("v")).join(times, F.col("_c") == F.col("_k"))
        wrong = (F.col("v") < F.col("a")) | (F.col("v") > F.col("a") + c.within_days * DAY)
        row = pairs.where("v is not null and a is not null").agg(
            F.lit(c.table).alias("table"), F.lit(c.column).alias("column"), F.lit(c.after_table or c.table).alias("after_table"), F.lit(c.after_column).alias("after_column"), F.count("*").alias("n_rows"), F.count_if(wrong).alias("n_broken")
        )
        out = row if out is None else out.unionByName(row)
    return out


ROW_KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",)}
NAMES = ("customer", "orders", "lineitem", "events")


def _given(spark, sf_dir: str) -> tuple[dict[str, DataFrame], Resolved]:
    tables = {t: table(spark, sf_dir, t) for t in NAMES}
    return tables, resolve({t: df.schema for t, df in tables.items()}, [r for r in star.FOREIGN_KEYS if r[0] in NAMES and r[2] in NAMES])


_BROKEN = f"epoch_us(l_shipdate) < epoch_us(o_orderdate) OR epoch_us(l_shipdate) > epoch_us(o_orderdate) + {PARENT_DAYS * DAY}"


@query(
    "time_constraints_broken",
    f"""SELECT 'lineitem' AS "table", 'l_shipdate' AS "column", 'orders' AS after_table, 'o_orderdate' AS after_column, count(*) AS n_rows, count(*) FILTER (WHERE {_BROKEN}) AS n_broken, 0::BIGINT AS n_left
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL AND o_orderdate IS NOT NULL""",
)
def time_constraints_broken(spark, sf_dir):
    """Rows that break each constraint of the given schema, before and after they are settled."""
    tables, found = _given(spark, sf_dir)
    left = broken(settle(tables, found, ROW_KEYS), found).select("table", "column", "after_table", "after_column", F.col("n_broken").alias("n_left"))
    return broken(tables, found).join(left, ["table", "column", "after_table", "after_column"])


@query(
    "time_constraints_settled",
    f"""SELECT l_orderkey, l_linenumber, make_timestamp(CASE WHEN {_BROKEN} THEN epoch_us(o_orderdate) + floor({uniform_sql('42', 'lineitem', 'l_shipdate', "l_orderkey || '|' || l_linenumber")} * {PARENT_DAYS * DAY})::BIGINT ELSE epoch_us(l_shipdate) END) AS l_shipdate
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def time_constraints_settled(spark, sf_dir):
    """All line items with ship dates that follow their orders within a year."""
    tables, found = _given(spark, sf_dir)
    return settle(tables, found, ROW_KEYS)["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate")
