"""Scenarios and anomalies: changes to a table that depend on a seeded hash of each row's key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import uniform, uniform_sql, weighted, weighted_sql
from datumloom.registry import query, table

SEED = 31


def u(what: str, key: Column | None = None, draw: int = 0) -> Column:
    return uniform(SEED, "orders", what, F.col("o_orderkey") if key is None else key, draw)


def usql(what: str, draw: int = 0) -> str:
    return uniform_sql(SEED, "orders", what, "o_orderkey", draw)


#: Cumulative rates of failed, declined, error and timeout, by intensity.
FAILURES = {"low": {"failed": 0.05}, "medium": {"failed": 0.10, "declined": 0.05}, "high": {"failed": 0.15, "declined": 0.08, "error": 0.04, "timeout": 0.03}}


def payment_failures(df: DataFrame, status: str, amount: str, key: str, intensity: str = "medium") -> DataFrame:
    """Some statuses become failures; three tenths of those amounts become 0."""
    rates = FAILURES[intensity]
    rows = df.withColumn("_new", weighted(u("failure", F.col(key)), rates | {"": 1 - sum(rates.values())}))
    failed = F.col("_new") != ""
    price = F.when(failed & (u("zero", F.col(key)) < 0.3), 0.0).otherwise(F.col(amount))
    return rows.withColumn(amount, price).withColumn(status, F.when(failed, F.col("_new")).otherwise(F.col(status))).drop("_new")


_PF = weighted_sql(usql("failure"), FAILURES["medium"] | {"": 0.85})


@query("payment_failures", f"SELECT o_orderkey, o_custkey, CASE WHEN f <> '' THEN f ELSE o_orderstatus END AS o_orderstatus, CASE WHEN f <> '' AND {usql('zero')} < 0.3 THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM (SELECT *, {_PF} AS f FROM orders) t")
def payment_failures_query(spark, sf_dir):
    return payment_failures(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderkey")


@query("churn_spike", f"SELECT o_orderkey, CASE WHEN churned THEN 'canceled' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN churned THEN o_orderdate + INTERVAL 1 DAY * (1 + floor({usql('churn', 1)} * 90))::INT END AS canceled_at FROM (SELECT *, o_orderstatus <> 'canceled' AND {usql('churn')} < 0.25 AS churned FROM orders) t")
def churn_spike(spark, sf_dir):
    """A quarter of what isn't canceled is, 1 to 90 days after the start."""
    churned = (F.col("o_orderstatus") != "canceled") & (u("churn") < 0.25)
    days = (1 + F.floor(u("churn", draw=1) * 90)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(churned, "canceled").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(churned, F.col("o_orderdate") + F.make_interval(days=days)).alias("canceled_at"))


_HIT = f"({usql('fraud')} < 0.05)"


@query(
    "fraud_spike",
    f"""WITH h AS (SELECT *, {_HIT} AND lag(o_orderkey) OVER w IS NOT NULL AS hit, CASE WHEN {usql('fraud', 2)} < 0.5 THEN 'fraudulent' END AS mark, 1 + floor({usql('fraud', 1)} * 30)::INT AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM h)
 SELECT o_orderkey, o_custkey, first_value(o_totalprice) OVER i AS o_totalprice, first_value(o_orderdate) OVER i + INTERVAL 1 SECOND * sum(CASE WHEN hit THEN gap ELSE 0 END) OVER i::INT AS o_orderdate, CASE WHEN hit THEN coalesce(mark, o_orderstatus) ELSE o_orderstatus END AS o_orderstatus
 FROM g WINDOW i AS (PARTITION BY o_custkey, island ORDER BY o_orderkey)""",
)
def fraud_spike(spark, sf_dir):
    """A twentieth of orders repeat the customer's previous one, which may be a repeat itself: price of the last genuine order, seconds after it."""
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hit = (u("fraud") < 0.05) & F.lag("o_orderkey").over(by_customer).isNotNull()
    rows = table(spark, sf_dir, "orders").withColumn("hit", hit).withColumn("gap", (1 + F.floor(u("fraud", draw=1) * 30)).cast("int"))
    rows = rows.withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(by_customer))
    in_island = Window.partitionBy("o_custkey", "island").orderBy("o_orderkey")
    seconds = F.sum(F.when(F.col("hit"), F.col("gap")).otherwise(0)).over(in_island)
    status = F.when(F.col("hit") & (u("fraud", draw=2) < 0.5), "fraudulent").otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", "o_custkey", F.first("o_totalprice").over(in_island).alias("o_totalprice"), (F.first("o_orderdate").over(in_island) + F.make_interval(secs=seconds)).alias("o_orderdate"), status.alias("o_orderstatus"))


@query("data_quality", f"SELECT o_orderkey, CASE WHEN {usql('dq_null')} >= 0.03 THEN o_totalprice END AS o_totalprice, CASE WHEN {usql('dq_case')} < 0.005 THEN lower(o_orderpriority) WHEN {usql('dq_pad')} < 0.005 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def data_quality(spark, sf_dir):
    """Nulls, changed case and padding."""
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(u("dq_null") >= 0.03, F.col("o_totalprice")).alias("o_totalprice"), F.when(u("dq_case") < 0.005, F.lower(p)).when(u("dq_pad") < 0.005, F.concat(F.lit("  "), p, F.lit(" "))).otherwise(p).alias("o_orderpriority")
    )


_KEEP = "least(1, CASE WHEN month(o_orderdate) >= 11 THEN 1 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 0.9 ELSE 0.6 END * CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1.2 ELSE 1 END)"


@query(
    "seasonal_traffic",
    f"""WITH k AS (SELECT o_orderkey, o_orderdate FROM orders WHERE {usql('season')} < {_KEEP}),
 c AS (SELECT *, unnest(range(CASE WHEN month(o_orderdate) >= 11 THEN 2 ELSE 1 END)) AS copy FROM k)
 SELECT o_orderkey, copy::INT AS copy, CASE WHEN copy > 0 THEN o_orderdate + INTERVAL 1 MINUTE * (floor({usql('jitter')} * 241) - 120)::INT ELSE o_orderdate END AS o_orderdate FROM c""",
)
def seasonal_traffic(spark, sf_dir):
    """Fewer orders outside the season, more at weekends; November and December twice, the copies moved by up to two hours."""
    month, weekend = F.month("o_orderdate"), F.dayofweek("o_orderdate").isin(1, 7)
    keep = F.least(F.lit(1.0), F.when(month >= 11, 1.0).when(month.between(6, 8), 0.9).otherwise(0.6) * F.when(weekend, 1.2).otherwise(1.0))
    kept = table(spark, sf_dir, "orders").where(u("season") < keep)
    copies = kept.select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(0), F.when(month >= 11, 1).otherwise(0))).alias("copy"))
    moved = F.col("o_orderdate") + F.make_interval(mins=(F.floor(u("jitter") * 241) - 120).cast("int"))
    return copies.select("o_orderkey", "copy", F.when(F.col("copy") > 0, moved).otherwise(F.col("o_orderdate")).alias("o_orderdate"))


@query("data_migration", f"SELECT o_orderkey, CASE WHEN {usql('mig')} < 0.1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN {usql('mig')} < 0.2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN {usql('mig')} < 0.3 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS legacy_date, CASE WHEN {usql('mojibake')} < 0.02 THEN substr(o_orderpriority, 1, 2) || 'Ã©' || substr(o_orderpriority, 3) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def data_migration(spark, sf_dir):
    """Dates in old formats and wrongly decoded letters."""
    d, m, p = F.col("o_orderdate"), u("mig"), F.col("o_orderpriority")
    legacy = F.when(m < 0.1, F.date_format(d, "MM/dd/yyyy")).when(m < 0.2, F.date_format(d, "dd.MM.yyyy")).when(m < 0.3, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    garbled = F.when(u("mojibake") < 0.02, F.concat(F.substring(p, 1, 2), F.lit("Ã©"), F.substring(p, 3, 100))).otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", legacy.alias("legacy_date"), garbled.alias("o_orderpriority"))


@query(
    "system_outage",
    f"""WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), w AS (SELECT make_timestamp(epoch_us(lo) + floor((epoch_us(hi) - epoch_us(lo)) * 2 / 5.0::DOUBLE)::BIGINT) AS a FROM b), o AS (SELECT a, a + INTERVAL 8 HOUR AS z FROM w),
 e AS (SELECT event_id, ts, event_type, CASE WHEN ts >= a AND ts < z THEN 'gap' WHEN ts >= z AND ts < z + INTERVAL 4 HOUR THEN 'recovery' ELSE 'normal' END AS phase FROM events, o)
 SELECT event_id, ts, CASE WHEN phase = 'gap' THEN 'error' ELSE event_type END AS event_type, phase, unnest(range(CASE WHEN phase = 'recovery' THEN 2 ELSE 1 END))::INT AS copy FROM e WHERE phase <> 'gap' OR {uniform_sql(SEED, 'events', 'outage', 'event_id')} < 0.05""",
)
def system_outage(spark, sf_dir):
    """Eight hours from two fifths of the span of which a twentieth survive as errors; the next four hours come twice."""
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = F.unix_micros(F.col("lo").cast("timestamp")), F.unix_micros(F.col("hi").cast("timestamp"))
    start = F.timestamp_micros(lo + F.floor((hi - lo) * 2 / 5))
    window = span.select(start.alias("a"), (start + F.expr("INTERVAL 8 HOURS")).alias("z"))
    at = F.col("ts").cast("timestamp")
    phase = F.when((at >= F.col("a")) & (at < F.col("z")), "gap").when((at >= F.col("z")) & (at < F.col("z") + F.expr("INTERVAL 4 HOURS")), "recovery").otherwise("normal")
    rows = events.crossJoin(F.broadcast(window)).withColumn("phase", phase)  # one row
    kept = rows.where((F.col("phase") != "gap") | (uniform(SEED, "events", "outage", F.col("event_id")) < 0.05))
    return kept.select("event_id", "ts", F.when(F.col("phase") == "gap", "error").otherwise(F.col("event_type")).alias("event_type"), "phase", F.explode(F.sequence(F.lit(0), F.when(F.col("phase") == "recovery", 1).otherwise(0))).alias("copy"))


@query("scheduled_window", "WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo FROM orders) SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate >= lo + INTERVAL 2 MONTH AND o_orderdate < lo + INTERVAL 4 MONTH THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders, b")
def scheduled_window(spark, sf_dir):
    """A change that holds in months 3 and 4 of the data only: outside and changed inside, put together again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    start = orders.agg(F.date_trunc("month", F.min("o_orderdate")).alias("lo"))
    rows = orders.crossJoin(F.broadcast(start))  # one row
    date, lo = F.col("o_orderdate").cast("timestamp"), F.col("lo")
    inside = (date >= lo + F.expr("INTERVAL 2 MONTHS")) & (date < lo + F.expr("INTERVAL 4 MONTHS"))
    return rows.where(~inside).unionByName(rows.where(inside).withColumn("o_totalprice", F.col("o_totalprice") * 2)).drop("lo")


TARGETS = {"payment_failures": {"orders"}, "churn_spike": {"orders", "customer"}, "fraud_spike": {"orders"}, "system_outage": {"events"}, "data_quality": {"customer", "part"}}


def conflicts(targets: dict[str, set[str]]) -> list[tuple[str, str, str]]:
    """Pairs of scenarios that change the same table."""
    names = sorted(targets)
    return [(a, b, t) for i, a in enumerate(names) for b in names[i + 1 :] for t in sorted(targets[a] & targets[b])]


_TARGETS = "(VALUES " + ", ".join(f"('{s}', '{t}')" for s, tables in TARGETS.items() for t in sorted(tables)) + ")"


@query("compose_conflicts", f"SELECT a.s AS one, b.s AS other, a.t AS \"table\" FROM {_TARGETS} a(s, t) JOIN {_TARGETS} b(s, t) ON a.t = b.t AND a.s < b.s")
def compose_conflicts(spark, sf_dir):
    return spark.createDataFrame(conflicts(TARGETS), "one string, other string, table string")


def apply_rules(df: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """User rules in order: set_null, set_value, inject_error or duplicate_row on rows that a condition holds for, at a rate."""
    for i, rule in enumerate(rules):
        c = rule.get("condition")
        holds = condition(c) if c else F.lit(True)
        hit = holds & (uniform(SEED, "rules", rule["action"], F.col(key), i) < rule.get("rate", {"set_null": 0.02, "set_value": 0.05, "inject_error": 0.1, "duplicate_row": 0.02}[rule["action"]]))
        if rule["action"] == "duplicate_row":
            df = df.withColumn("_copies", F.when(hit, 2).otherwise(1)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
        else:
            value = {"set_null": F.lit(None), "set_value": F.lit(rule.get("value")), "inject_error": F.lit("ERROR")}[rule["action"]]
            df = df.withColumn(rule["column"], F.when(hit, value).otherwise(F.col(rule["column"])))
    return df


def condition(c: dict) -> Column:
    """eq, neq, gt, lt, gte, lte or in."""
    x, v = F.col(c["column"]), c["value"]
    return {"eq": lambda: x == v, "neq": lambda: x != v, "gt": lambda: x > v, "lt": lambda: x < v, "gte": lambda: x >= v, "lte": lambda: x <= v, "in": lambda: x.isin(*v)}[c["op"]]()


RULES = [
    {"action": "set_null", "column": "o_orderpriority", "condition": {"column": "o_totalprice", "op": "gt", "value": 100000}, "rate": 0.5},
    {"action": "set_value", "column": "o_orderstatus", "value": "H", "condition": {"column": "o_orderstatus", "op": "in", "value": ["O", "P"]}},
    {"action": "duplicate_row"},
]


@query(
    "custom_rules",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND {uniform_sql(SEED, 'rules', 'set_null', 'o_orderkey', 0)} < 0.5 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderstatus IN ('O', 'P') AND {uniform_sql(SEED, 'rules', 'set_value', 'o_orderkey', 1)} < 0.05 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders, range(2) r(i) WHERE i = 0 OR {uniform_sql(SEED, 'rules', 'duplicate_row', 'o_orderkey', 2)} < 0.02""",
)
def custom_rules(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "orders"), RULES, "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderstatus")


SCENARIOS = {
    "payment_failures": lambda df, intensity: payment_failures(df, "o_orderstatus", "o_totalprice", "o_orderkey", intensity),
    "custom_rules": lambda df, intensity: apply_rules(df, RULES, "o_orderkey"),
}


def apply_scenarios(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Registered scenarios (name, intensity) on a table one after another, each on what the one before made."""
    unknown = [n for n, _ in names if n not in SCENARIOS]
    if unknown:
        raise ValueError(f"no scenario {unknown[0]!r} among {sorted(SCENARIOS)}")
    for name, intensity in names:
        df = SCENARIOS[name](df, intensity)
    return df


_FAILED = f"(SELECT o_orderkey, CASE WHEN f <> '' THEN f ELSE o_orderstatus END AS o_orderstatus, CASE WHEN f <> '' AND {usql('zero')} < 0.3 THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM (SELECT *, {_PF} AS f FROM orders) t)"


@query("scenarios_in_order", f"""SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 100000 AND {uniform_sql(SEED, 'rules', 'set_null', 'o_orderkey', 0)} < 0.5 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderstatus IN ('O', 'P') AND {uniform_sql(SEED, 'rules', 'set_value', 'o_orderkey', 1)} < 0.05 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM {_FAILED} p, range(2) r(i) WHERE i = 0 OR {uniform_sql(SEED, 'rules', 'duplicate_row', 'o_orderkey', 2)} < 0.02""")
def scenarios_in_order(spark, sf_dir):
    """Failed payments, then the user's rules on top of them."""
    return apply_scenarios(table(spark, sf_dir, "orders"), [("payment_failures", "medium"), ("custom_rules", "medium")]).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


# Anomalies: each changes a tenth of the rows, labels them and says what it did.
ANOMALIES = {
    "extreme_value": ("o_totalprice", lambda: F.col("o_totalprice") * 20, "o_totalprice * 20"),
    "null_injection": ("o_orderpriority", lambda: F.lit(None).cast("string"), "NULL"),
    "duplicate_record": ("o_orderpriority", lambda: F.concat("o_orderpriority", F.lit(" ")), "o_orderpriority || ' '"),
    "timestamp": ("o_orderdate", lambda: F.col("o_orderdate") + F.expr("INTERVAL 730 DAYS"), "o_orderdate + INTERVAL 730 DAY"),
    "enum_violation": ("o_orderstatus", lambda: F.concat(F.lit("__INVALID_"), F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4))), "'__INVALID_' || upper(substr(md5(o_orderkey::VARCHAR), 1, 4))"),
    "negative_value": ("o_totalprice", lambda: -F.abs("o_totalprice"), "-abs(o_totalprice)"),
    "string_overflow": ("o_orderpriority", lambda: F.repeat(F.lit("A"), 1000), "repeat('A', 1000)"),
    "type_mismatch": ("total_text", lambda: F.lit("NOT_A_NUMBER"), "'NOT_A_NUMBER'"),
}


def anomaly(df: DataFrame, kind: str, rate: float = 0.1) -> DataFrame:
    column, change, _ = ANOMALIES[kind]
    hit = u(f"anomaly_{kind}") < rate
    return df.select("o_orderkey", F.when(hit, change()).otherwise(F.col(column)).alias(column), hit.alias("is_anomaly"), F.when(hit, F.lit(f"{kind}: {column}")).alias("details"))


def _register(kind: str) -> None:
    column, _, change = ANOMALIES[kind]
    hit = f"{usql(f'anomaly_{kind}')} < 0.1"
    source = "(SELECT *, o_orderstatus AS total_text FROM orders)"

    @query(f"anomaly_{kind}", f"SELECT o_orderkey, CASE WHEN {hit} THEN {change} ELSE {column} END AS {column}, {hit} AS is_anomaly, CASE WHEN {hit} THEN '{kind}: {column}' END AS details FROM {source} o")
    def run(spark, sf_dir):
        return anomaly(table(spark, sf_dir, "orders").withColumn("total_text", F.col("o_orderstatus")), kind)


for _kind in ANOMALIES:
    _register(_kind)

#: Scenarios of the command line: what becomes of rows with a hash below the rate.
CLI = {
    "fraud_spike": (0.05, "o_totalprice * 5", "'fraud'"),
    "churn_wave": (0.20, "0.0", "'churned'"),
    "holiday_rush": (0.30, "o_totalprice * 1.5", "'rush'"),
    "data_breach": (0.15, "o_totalprice", "'exposed'"),
    "seasonal_enrollment": (0.25, "o_totalprice * 3", "'enrolled'"),
    "payment_failures": (0.10, "0.0", "'failed'"),
}


def _register_cli(name: str) -> None:
    rate, price, status = CLI[name]
    hit = f"{usql(f'cli_{name}')} < {rate}"

    @query(f"cli_scenario_{name}", f"SELECT o_orderkey, CASE WHEN {hit} THEN {price} ELSE o_totalprice END::DOUBLE AS o_totalprice, CASE WHEN {hit} THEN {status} ELSE o_orderstatus END AS o_orderstatus FROM orders")
    def run(spark, sf_dir):
        h = u(f"cli_{name}") < rate
        return table(spark, sf_dir, "orders").select("o_orderkey", F.when(h, F.expr(price).cast("double")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(h, F.expr(status)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


for _name in CLI:
    _register_cli(_name)


@query("scenario_report", f"SELECT scenario, n FROM (SELECT 'payment_failures' AS scenario, count(*) FILTER (WHERE {_PF} <> '') AS n FROM orders UNION ALL SELECT 'churn_spike', count(*) FILTER (WHERE {usql('churn')} < 0.25) FROM orders) t")
def scenario_report(spark, sf_dir):
    rates = FAILURES["medium"]
    row = table(spark, sf_dir, "orders").agg(F.count_if(weighted(u("failure"), rates | {"": 0.85}) != "").alias("a"), F.count_if(u("churn") < 0.25).alias("b"))
    return row.select(F.expr("stack(2, 'payment_failures', a, 'churn_spike', b) AS (scenario, n)"))
