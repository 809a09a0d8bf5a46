"""Simulated event streams: arrivals by traffic pattern, follow-up events, API calls, life cycles of entities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.functions.numbers import places, places_sql, uniform, uniform_sql, weighted, weighted_sql
from datumloom.registry import query, table

N, SEED, SPAN = 3000, 55, 86_400
STEPS = 100


def intensity(pattern: str) -> list[float]:
    """Relative traffic in each of a hundred equal steps of the span."""
    shapes = {
        "steady": lambda x: 1.0,
        "spike": lambda x: 5.0 if 0.6 <= x < 0.7 else 1.0,
        "ramp": lambda x: 0.2 + 1.8 * x,
        "burst": lambda x: 4.0 if int(x * STEPS) % 20 < 3 else 0.7,
        "diurnal": lambda x: 1 + 0.8 * math.sin(2 * math.pi * (x - 0.25)),
    }
    return [shapes[pattern](i / STEPS) for i in range(STEPS)]


def cumulative(pattern: str) -> list[float]:
    weights, at, out = intensity(pattern), 0.0, [0.0]
    for w in weights:
        at += w / sum(weights)
        out.append(at)
    return [*out[:-1], 1.0]


def arrival(pattern: str, p: Column) -> Column:
    """The time in [0, 1) by which a share p of all events has come: the inverse of the cumulative intensity."""
    steps = F.array(*map(F.lit, cumulative(pattern)))
    step = F.size(F.filter(steps, lambda c: c <= p))  # 1 to 100
    low, high = F.element_at(steps, step), F.element_at(steps, step + 1)
    return (step - 1 + (p - low) / (high - low)) / STEPS


TYPES = {"view": 5, "click": 3, "purchase": 1, "payment_failed": 1}


def events(spark, pattern: str = "diurnal", n: int = N) -> DataFrame:
    """id, seconds from the start, type, actor and session: each event from its own number, so in any order and on any partitioning."""
    u = lambda what: uniform(SEED, "stream", what, F.col("id"))
    p = (F.col("id") + u("jitter")) / n
    return spark.range(n).select(
        "id",
        places(arrival(pattern, p) * SPAN, 3).alias("at"),
        weighted(u("type"), TYPES).alias("type"),
        F.floor(u("actor") * max(10, n // 20)).alias("actor"),
        F.floor(u("session") * int(max(10, n // 20) * 1.5)).alias("session"),
    )


def _u(what: str) -> str:
    return uniform_sql(SEED, "stream", what, "id")


def events_sql(pattern: str = "diurnal", n: int = N) -> str:
    steps = "[" + ", ".join(f"{c!r}::DOUBLE" for c in cumulative(pattern)) + "]"
    return f"""(SELECT id, {places_sql(f'(step - 1 + (p - cs[step]) / (cs[step + 1] - cs[step])) / {STEPS}.0::DOUBLE * {SPAN}', 3)} AS "at", type, actor, session FROM (SELECT *, len(list_filter(cs, lambda c: c <= p)) AS step FROM
 (SELECT id, (id + {_u('jitter')}) / {n} AS p, {steps} AS cs, {weighted_sql(_u('type'), TYPES)} AS type, floor({_u('actor')} * {max(10, n // 20)})::BIGINT AS actor, floor({_u('session')} * {int(max(10, n // 20) * 1.5)})::BIGINT AS session FROM range({n}) r(id)) a) b)"""


@query("event_stream", f"SELECT * FROM {events_sql()} e")
def event_stream(spark, sf_dir):
    return events(spark)


@query("traffic_pattern", " UNION ALL ".join(f"SELECT '{p}' AS pattern, floor(\"at\" / 3600)::INT AS hour, count(*) AS n FROM {events_sql(p)} e_{p} GROUP BY 2" for p in ("steady", "spike", "ramp", "burst", "diurnal")))
def traffic_pattern(spark, sf_dir):
    """Events by hour under each pattern."""
    out = None
    for p in ("steady", "spike", "ramp", "burst", "diurnal"):
        counts = events(spark, p).groupBy(F.floor(F.col("at") / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n")).select(F.lit(p).alias("pattern"), "hour", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


#: type -> (follow-up type, delay in seconds after the one before)
FOLLOW_UPS = {"payment_failed": [("retry", 60), ("email_sent", 300), ("support_ticket", 3600)], "purchase": [("receipt", 5)]}


def with_follow_ups(df: DataFrame) -> DataFrame:
    """Events and their chains; each follow-up comes its delay after the one before it."""
    parts = []
    for kind, chain in FOLLOW_UPS.items():
        total, steps = 0, []
        for i, (name, delay) in enumerate(chain, 1):
            total += delay
            steps.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("type"), F.lit(total).alias("delay")))
        more = df.where(F.col("type") == kind).select("id", "at", F.explode(F.array(*steps)).alias("s"))
        parts.append(more.select("id", F.col("s.step").alias("step"), places(F.col("at") + F.col("s.delay"), 3).alias("at"), F.col("s.type").alias("type")))
    out = df.select("id", F.lit(0).alias("step"), "at", "type")
    for part in parts:
        out = out.unionByName(part)
    return out


def _follow_sql() -> str:
    parts = [f"SELECT id, 0 AS step, \"at\", type FROM {events_sql()} e"]
    for kind, chain in FOLLOW_UPS.items():
        total = 0
        for i, (name, delay) in enumerate(chain, 1):
            total += delay
            parts.append(f"SELECT id, {i}, {places_sql(f'\"at\" + {total}', 3)}, '{name}' FROM {events_sql()} e WHERE type = '{kind}'")
    return " UNION ALL ".join(parts)


@query("correlated_events", _follow_sql())
def correlated_events(spark, sf_dir):
    return with_follow_ups(events(spark))


@query("simulation_report", f"SELECT type, count(*) AS n, count(DISTINCT actor) AS actors, count(DISTINCT session) AS sessions, min(\"at\") AS first_at, max(\"at\") AS last_at FROM {events_sql()} e GROUP BY type")
def simulation_report(spark, sf_dir):
    return events(spark).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"), F.count_distinct("session").alias("sessions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


ENDPOINTS = {"GET /items": 40, "GET /items/:id": 30, "POST /orders": 10, "GET /orders": 15, "DELETE /orders/:id": 5}


@query(
    "api_traffic",
    f"SELECT id, endpoint, status, {places_sql(f'100 * (0.5 + 1.5 * {_u("latency")}) * CASE WHEN status >= 500 THEN 2.5 ELSE 1 END', 2)} AS latency_ms FROM (SELECT id, {weighted_sql(_u('endpoint'), ENDPOINTS)} AS endpoint, CASE WHEN {_u('status')} < 0.02 THEN 500 WHEN {_u('status')} < 0.07 THEN 404 ELSE 200 END AS status FROM range({N}) r(id)) t",
)
def api_traffic(spark, sf_dir):
    """Calls with status and latency; errors of the server take two and a half times as long."""
    u = lambda what: uniform(SEED, "stream", what, F.col("id"))
    status = F.when(u("status") < 0.02, 500).when(u("status") < 0.07, 404).otherwise(200)
    rows = spark.range(N).select("id", weighted(u("endpoint"), ENDPOINTS).alias("endpoint"), status.alias("status"))
    return rows.withColumn("latency_ms", places(100 * (0.5 + 1.5 * u("latency")) * F.when(F.col("status") >= 500, 2.5).otherwise(1.0), 2))


@query("webhooks", f"SELECT id, 'evt_' || substr(md5(id::VARCHAR), 1, 12) AS event_id, type, '{{\"id\":' || id || ',\"type\":\"' || type || '\",\"actor\":' || actor || '}}' AS body FROM {events_sql()} e WHERE type IN ('purchase', 'payment_failed')")
def webhooks(spark, sf_dir):
    body = F.to_json(F.struct("id", "type", "actor"))
    return events(spark).where(F.col("type").isin("purchase", "payment_failed")).select("id", F.concat(F.lit("evt_"), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("event_id"), "type", body.alias("body"))


#: state -> the states that lead to it; a path goes back to the first one.
STATES = {"trial": [], "active": ["trial"], "past_due": ["active"], "canceled": ["past_due", "active"]}
FINAL = {"trial": 2, "active": 5, "past_due": 1, "canceled": 2}


def path_to(state: str) -> list[str]:
    """From the start to a state, by the first parent that is not on the path yet."""
    path = [state]
    while parents := [p for p in STATES[path[0]] if p not in path]:
        path.insert(0, parents[0])
    return path


@query("lifecycle_states", f"SELECT state, count(*) AS n FROM (SELECT {weighted_sql(_u('state'), FINAL)} AS state FROM range({N}) r(id)) t GROUP BY state")
def lifecycle_states(spark, sf_dir):
    return spark.range(N).select(weighted(uniform(SEED, "stream", "state", F.col("id")), FINAL).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


_PATHS = "CASE state " + " ".join(f"WHEN '{s}' THEN {path_to(s)!r}" for s in STATES) + " END"


@query("lifecycle_rows", f"SELECT id, (i + 1)::INT AS step, ({_PATHS})[i + 1] AS state FROM (SELECT id, {weighted_sql(_u('state'), FINAL)} AS state FROM range({N}) r(id)) t, range(4) s(i) WHERE i < len({_PATHS})")
def lifecycle_rows(spark, sf_dir):
    """Each entity's states from the start to its final one, a row for each."""
    paths = F.create_map(*(x for s in STATES for x in (F.lit(s), F.array(*map(F.lit, path_to(s))))))
    rows = spark.range(N).withColumn("final", weighted(uniform(SEED, "stream", "state", F.col("id")), FINAL))
    return rows.select("id", F.posexplode(paths[F.col("final")]).alias("i", "state")).select("id", (F.col("i") + 1).alias("step"), "state")


@query(
    "cross_table_correlation",
    "SELECT o_orderkey, i::INT AS copy, CASE WHEN c_mktsegment = 'BUILDING' THEN 'priority' ELSE o_orderstatus END AS o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey, range(3) r(i) WHERE i = 0 OR (c_mktsegment = 'BUILDING' AND i <= 2)",
)
def cross_table_correlation(spark, sf_dir):
    """Orders of one segment's customers come three times and with another status."""
    orders = table(spark, sf_dir, "orders")
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("chosen"))
    rows = orders.join(chosen, "o_custkey", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("chosen"), 2).otherwise(0))).alias("copy")
    return rows.select("o_orderkey", copies, F.when(F.col("chosen"), "priority").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


