"""All scenarios on tables of any names: what a column means is said by roles, and scenarios follow one another on what the ones before left."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.operators import perturb
from datumloom.registry import query, table

#: How strong a scenario is, as a factor of its rates.
STRENGTH = {"low": 0.5, "medium": 1.0, "high": 2.0}


@dataclass(frozen=True)
class Roles:
    """Which columns of a table play which part; a scenario needs some of them."""

    key: str
    status: str | None = None
    amount: str | None = None
    at: str | None = None
    entity: str | None = None
    texts: tuple[str, ...] = ()


def _u(roles: Roles, name: str, what: str, draw: int = 0) -> Column:
    return uniform(perturb.SEED, name, what, F.col(roles.key), draw)


def payment_failures(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """Some statuses become failures, and some of those amounts 0."""
    return perturb.payment_failures(df, roles.status, roles.amount, roles.key, intensity)


def churn_spike(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """A quarter of what isn't canceled is."""
    hit = (F.col(roles.status) != "canceled") & (_u(roles, name, "churn") < 0.25 * STRENGTH[intensity])
    return df.withColumn(roles.status, F.when(hit, "canceled").otherwise(F.col(roles.status)))


def fraud_spike(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """A twentieth of an entity's rows repeat the amount of its row before, by time and key, half of them marked."""
    before = Window.partitionBy(roles.entity).orderBy(roles.at, roles.key)
    last = F.lag(roles.amount).over(before)
    hit = (_u(roles, name, "fraud") < 0.05 * STRENGTH[intensity]) & last.isNotNull()
    rows = df.withColumns({"_hit": hit, "_last": last, "_mark": _u(roles, name, "fraud", 1) < 0.5})
    changed = {roles.amount: F.when(F.col("_hit"), F.col("_last")).otherwise(F.col(roles.amount)), roles.status: F.when(F.col("_hit") & F.col("_mark"), "fraudulent").otherwise(F.col(roles.status))}
    return rows.withColumns(changed).drop("_hit", "_last", "_mark")


def data_quality(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """Amounts that are missing, and texts in the wrong case or with spaces around them."""
    strength, changed = STRENGTH[intensity], {}
    if roles.amount:
        changed[roles.amount] = F.when(_u(roles, name, "dq_null") >= 0.03 * strength, F.col(roles.amount))
    for i, c in enumerate(roles.texts):
        u = _u(roles, name, "dq_text", i)
        changed[c] = F.when(u < 0.02 * strength, F.lower(c)).when(u < 0.04 * strength, F.concat(F.lit("  "), c, F.lit(" "))).otherwise(F.col(c))
    return df.withColumns(changed)


def seasonal_traffic(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """Fewer rows outside the season; all of November's and December's stay."""
    month = F.month(roles.at)
    share = F.when(month >= 11, 1.0).when(month.between(6, 8), 0.9).otherwise(max(0.0, 1 - 0.4 * STRENGTH[intensity]))
    return df.where(_u(roles, name, "season") < share)


def data_migration(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """Letters that were decoded wrongly."""
    changed = {}
    for i, c in enumerate(roles.texts):
        garbled = F.concat(F.substring(c, 1, 2), F.lit("Ã©"), F.substring(F.col(c), 3, 1_000_000))
        changed[c] = F.when(_u(roles, name, "mojibake", i) < 0.02 * STRENGTH[intensity], garbled).otherwise(F.col(c))
    return df.withColumns(changed)


def system_outage(df: DataFrame, roles: Roles, name: str, intensity: str) -> DataFrame:
    """A stretch of time, a fiftieth of the whole from two fifths of it on, of which a twentieth of the rows are left."""
    span = df.agg(F.min(F.unix_micros(F.col(roles.at).cast("timestamp"))).alias("_lo"), F.max(F.unix_micros(F.col(roles.at).cast("timestamp"))).alias("_hi"))
    at = F.unix_micros(F.col(roles.at).cast("timestamp"))
    start = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) * 2 / 5)
    end = start + F.floor((F.col("_hi") - F.col("_lo")) * STRENGTH[intensity] / 50)
    inside = F.coalesce((at >= start) & (at < end), F.lit(False))
    return df.crossJoin(F.broadcast(span)).where(~inside | (_u(roles, name, "outage") < 0.05)).drop("_lo", "_hi")  # one row


@dataclass(frozen=True)
class Scenario:
    change: Callable[[DataFrame, Roles, str, str], DataFrame]
    needs: tuple[str, ...] = ()


#: Every scenario by name, with the roles that it needs.
REGISTRY = {
    "payment-failures": Scenario(payment_failures, ("status", "amount")),
    "churn-spike": Scenario(churn_spike, ("status",)),
    "fraud-spike": Scenario(fraud_spike, ("status", "amount", "at", "entity")),
    "data-quality": Scenario(data_quality),
    "seasonal-traffic": Scenario(seasonal_traffic, ("at",)),
    "data-migration": Scenario(data_migration),
    "system-outage": Scenario(system_outage, ("at",)),
}


@dataclass
class Outcome:
    """The tables after all scenarios, which scenario changed which tables, those unknown, and tables that several changed."""

    tables: dict[str, DataFrame]
    applied: list[tuple[str, str]] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)

    def conflicts(self) -> list[tuple[str, tuple[str, ...]]]:
        by_table: dict[str, list[str]] = {}
        for scenario, name in self.applied:
            by_table.setdefault(name, []).append(scenario)
        return [(t, tuple(s)) for t, s in by_table.items() if len(s) > 1]


def play(tables: dict[str, DataFrame], roles: dict[str, Roles], wanted: list[tuple[str, str]]) -> Outcome:
    """Scenarios (name, intensity) in order, each on every table that has the roles it needs. An unknown name is warned of and left out."""
    out = Outcome(dict(tables))
    for name, intensity in wanted:
        scenario = REGISTRY.get(name)
        if scenario is None:
            warnings.warn(f"no scenario {name!r} among {sorted(REGISTRY)}", stacklevel=2)
            out.unknown.append(name)
            continue
        for t, r in roles.items():
            if all(getattr(r, need) for need in scenario.needs) and t in out.tables:
                out.tables[t] = scenario.change(out.tables[t], r, t, intensity)
                out.applied.append((name, t))
    return out


ORDERS = Roles("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey", ("o_orderpriority",))
CHAIN = [("payment-failures", "medium"), ("data-quality", "high"), ("churn-spike", "low"), ("data-migration", "medium"), ("seasonal-traffic", "medium"), ("system-outage", "medium")]


def _s(what: str, draw: int = 0) -> str:
    return uniform_sql(perturb.SEED, "orders", what, "o_orderkey", draw)


@query(
    "scenario_chain",
    f"""WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN f <> '' THEN f ELSE o_orderstatus END AS s, CASE WHEN f <> '' AND {perturb.usql('zero')} < 0.3 THEN 0 ELSE o_totalprice END AS a, o_orderpriority AS t FROM (SELECT *, {perturb._PF} AS f FROM orders) x),
q AS (SELECT o_orderkey, o_orderdate, CASE WHEN s <> 'canceled' AND {_s('churn')} < 0.125 THEN 'canceled' ELSE s END AS s, CASE WHEN {_s('dq_null')} >= 0.06 THEN a END AS a, CASE WHEN {_s('dq_text')} < 0.04 THEN lower(t) WHEN {_s('dq_text')} < 0.08 THEN '  ' || t || ' ' ELSE t END AS t FROM p),
r AS (SELECT o_orderkey, o_orderdate, s, a, CASE WHEN {_s('mojibake')} < 0.02 THEN substr(t, 1, 2) || 'Ã©' || substr(t, 3) ELSE t END AS t FROM q WHERE {_s('season')} < CASE WHEN month(o_orderdate) >= 11 THEN 1.0 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 0.9 ELSE 0.6 END),
b AS (SELECT min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM r),
c AS (SELECT lo + floor((hi - lo) * 2 / 5.0::DOUBLE)::BIGINT AS x, lo + floor((hi - lo) * 2 / 5.0::DOUBLE)::BIGINT + floor((hi - lo) / 50.0::DOUBLE)::BIGINT AS y FROM b)
SELECT o_orderkey, s AS o_orderstatus, a AS o_totalprice, t AS o_orderpriority FROM r, c WHERE NOT (epoch_us(o_orderdate) >= x AND epoch_us(o_orderdate) < y) OR {_s('outage')} < 0.05""",
)
def scenario_chain(spark, sf_dir):
    """Six scenarios on the orders, one after another."""
    out = play({"orders": table(spark, sf_dir, "orders")}, {"orders": ORDERS}, CHAIN)
    return out.tables["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
