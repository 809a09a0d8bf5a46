"""Masking several tables together, so that what was equal stays equal.

Columns are judged by their names, and text columns that look safe by all of their
values. A masked value depends on the value alone: wherever it occurs, in whatever table,
it becomes the same. Keys can be masked as well, by a permutation of all whole numbers of
their type, so that keys stay unique and references still lead to their parents, without
a join and without a map. Masked cells are counted while the tables are written.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NumericType, StringType

from datumloom.functions.numbers import uniform_sql
from datumloom.operators import privacy
from datumloom.plans import star
from datumloom.registry import query, table
from datumloom.sources.dumps import scratch

# How values that a scanner finds are masked, where that isn't what a column named so would get.
FOUND_STRATEGIES = {
    "bank_routing": "replace_ssn",
    "drivers_license": "replace_ssn",
    "passport": "replace_ssn",
    "student_id": "replace_ssn",
    "case_number": "redact",
    "vin": "redact",
}
# Names of columns of free text, in which a scanner counts from half its threshold.
FREE_TEXT_NAMES = ("notes", "bio", "biography", "description", "comments", "remarks", "narrative", "summary", "details", "message", "body", "content", "text", "memo", "reason", "observation", "feedback", "review")
ROUNDS = 4


@dataclass(frozen=True)
class Decision:
    """What is done with a column, and why."""

    table: str
    column: str
    category: str
    strategy: str
    confidence: str
    reason: str


def scanned(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple[str, float]]:
    """For each text column the category that most of its non-empty values show, if these are enough, and their share; all columns in one pass."""
    columns = list(columns)
    if not columns:
        return {}
    counts = [F.count_if(F.length(c) > 0).alias(f"n{i}") for i, c in enumerate(columns)]
    hits = [F.count_if(privacy.has(F.col(c), patterns)).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, (patterns, _, _) in privacy.VALUES.items()]
    row = df.agg(*counts, *hits).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"]:
            shares = {kind: row[f"{kind}{i}"] / row[f"n{i}"] for kind in privacy.VALUES}
            factor = 0.5 if c.lower() in FREE_TEXT_NAMES else 1.0
            enough = {k: s for k, s in shares.items() if s >= privacy.VALUES[k][1] * factor}
            if enough:
                out[c] = max(enough.items(), key=lambda x: x[1])
    return out


def decide(tables: dict[str, DataFrame], mode: str = "strict", keys: bool = False, deep: bool = True) -> list[Decision]:
    """A decision for each column of each table, in order.

    With ``keys``, keys and references that are whole numbers are permuted and texts among
    them replaced by a hash; otherwise they are left alone. With ``deep``, text columns
    that their names call safe are judged by their values.
    """
    out = []
    for name, df in tables.items():
        known = privacy.KEYS.get(name, frozenset())
        kinds = {f.name: privacy.category(f.name, known, mode, name, isinstance(f.dataType, StringType)) for f in df.schema}
        safe = [f.name for f in df.schema if kinds[f.name] == "safe" and f.name not in known and isinstance(f.dataType, StringType)]
        seen = scanned(df, safe) if deep else {}
        for f in df.schema:
            if f.name in known:
                kind = "key" if keys else "safe"
                how = "preserve" if not keys else "permute" if isinstance(f.dataType, IntegerType | LongType) else "hash"
                out.append(Decision(name, f.name, kind, how, "high", "key or reference"))
            elif f.name in seen:
                kind, share = seen[f.name]
                confidence = "high" if share >= 0.7 else "medium" if share >= 0.3 else "low"
                out.append(Decision(name, f.name, kind, FOUND_STRATEGIES.get(kind) or privacy.strategy(kind, mode), confidence, f"{int(share * 100 + 0.5)} % of values hold this"))
            else:
                kind = kinds[f.name]
                out.append(Decision(name, f.name, kind, fitting(f.dataType, privacy.strategy(kind, mode)), "high" if kind != "safe" else "low", "name" if kind != "safe" else "nothing found"))
    return out


def fitting(kind, strategy: str) -> str:
    """The strategy, or redaction where a column's type doesn't allow it."""
    dated = kind.typeName() in ("date", "timestamp", "timestamp_ntz")
    if (strategy == "shift_date" and not dated) or (strategy == "generalize_numeric" and not isinstance(kind, NumericType)):
        return "redact"
    return strategy


def permuted(value: Column, bits: int, seed: int) -> Column:
    """A permutation of whole numbers of ``bits`` bits: the lower bits but two go through a Feistel network whose rounds are keyed by the upper ones.

    Each number of the type is the image of exactly one.
    """
    half = bits // 2 - 1
    size = 1 << half
    top = F.shiftright(value, 2 * half)
    left, right = F.shiftright(value, half) % size, value % size
    left, right = F.when(left < 0, left + size).otherwise(left), F.when(right < 0, right + size).otherwise(right)
    for i in range(ROUNDS):
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("key"), F.lit(str(i)), top.cast("string"), right.cast("string"))), 1, 8), 16, 10).cast("long")
        left, right = right, left.cast("long").bitwiseXOR(digest % size)
    return F.shiftleft(top.cast("long"), 2 * half) + left.cast("long") * size + right.cast("long")


def masked(value: Column, kind, strategy: str, seed: int) -> Column:
    """A value masked by a strategy; it depends on the value alone, null stays null."""
    if strategy == "permute":
        return permuted(value, 32 if isinstance(kind, IntegerType) else 64, seed).cast(kind)
    if strategy == "hash":
        return F.when(value.isNotNull(), F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), value.cast("string")), 256), 1, 32))
    return privacy.mask(value, strategy, value.cast("string"), seed)


@dataclass(frozen=True)
class Report:
    """Masked cells of a column."""

    table: str
    column: str
    strategy: str
    rows_masked: int


def mask_tables(tables: dict[str, DataFrame], decisions: list[Decision], path: str, seed: int = 17) -> list[Report]:
    """Write all tables masked, a folder for each below ``path``; the cells that were masked are counted as they are written."""
    out = []
    for name, df in tables.items():
        how = {d.column: d.strategy for d in decisions if d.table == name}
        count = Observation()
        changed = [c for c in df.columns if how.get(c, "preserve") != "preserve"]
        rows = df.select(*(masked(F.col(f"`{f.name}`"), f.dataType, how.get(f.name, "preserve"), seed).alias(f.name) for f in df.schema))
        if changed:
            rows = rows.observe(count, *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(changed)))
        rows.write.parquet(f"{path}/{name}")
        found = count.get if changed else {}
        out += [Report(name, c, how[c], found[f"n{i}"]) for i, c in enumerate(changed)]
    return out


MASKED = ("customer", "orders", "supplier", "conversations")


def _tables(spark, sf_dir: str, names: Iterable[str] = MASKED) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in names}


def _decisions_sql() -> str:
    """Category and strategy of each column from the catalogue's names and, for text columns that seem safe, from all values."""
    texts = {"orders": ("o_orderstatus", "o_orderpriority"), "customer": ("c_mktsegment",), "conversations": ("role", "text"), "supplier": ("s_name",)}
    scans = []
    for t, columns in texts.items():
        for c in columns:
            factor = 0.5 if c in FREE_TEXT_NAMES else 1.0
            for rank, (kind, (patterns, limit, _)) in enumerate(privacy.VALUES.items()):
                how = FOUND_STRATEGIES.get(kind) or privacy.STRATEGIES[kind]
                scans.append(
                    f"SELECT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, '{how}' AS how, {rank} AS rank, {limit * factor} AS enough, "
                    f"count(*) FILTER (WHERE regexp_matches({c}, {privacy.for_sql(patterns)}))::DOUBLE / nullif(count(*) FILTER (WHERE length({c}) > 0), 0) AS share FROM {t}"
                )
    by_name = f"SELECT * FROM ({privacy._CATEGORIES}) n WHERE \"table\" IN ({', '.join(repr(t) for t in MASKED)})"
    strategies = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in privacy.STRATEGIES.items())
    return f"""WITH seen AS (SELECT t, c, arg_max(kind, (share, -rank)) AS kind, arg_max(how, (share, -rank)) AS how FROM ({' UNION ALL '.join(scans)}) s WHERE share >= enough GROUP BY t, c)
SELECT n."table", n."column", coalesce(s.kind, n.category) AS category, coalesce(s.how, CASE n.category {strategies} END) AS strategy FROM ({by_name}) n LEFT JOIN seen s ON s.t = n."table" AND s.c = n."column" AND n.category = 'safe'"""


@query("mask_decisions", _decisions_sql())
def mask_decisions(spark, sf_dir):
    """What names and values together say of each column, and how it is masked."""
    rows = [(d.table, d.column, d.category, d.strategy) for d in decide(_tables(spark, sf_dir))]
    return spark.createDataFrame(rows, "table string, column string, category string, strategy string")


def permuted_sql(column: str, bits: int, seed: int) -> str:
    """A subquery's columns for the permutation of ``column``: DuckDB evaluates the rounds as nested lists, one element a round."""
    half = bits // 2 - 1
    size = 1 << half
    step = f"('0x' || substr(md5('{seed}|key|' || i || '|' || ({column} >> {2 * half}) || '|' || s[2]), 1, 8))::BIGINT % {size}"
    start = f"[({column} >> {half}) & {size - 1}, {column} & {size - 1}]::BIGINT[]"
    rounds = start
    for i in range(ROUNDS):
        rounds = f"list_transform([{rounds}], lambda s: [s[2], xor(s[1], {step.replace('|| i ||', f'|| {i} ||')})])[1]"
    return f"(SELECT (({column} >> {2 * half})::BIGINT << {2 * half}) + r[1] * {size} + r[2] FROM (SELECT {rounds} AS r))"

_NAME_BY_VALUE = f"{privacy._LIST(privacy.FIRST)}[floor({uniform_sql(17, 'mask', 'replace_name', 'c_name', 0)} * 16)::INT + 1] || ' ' || {privacy._LIST(privacy.LAST)}[floor({uniform_sql(17, 'mask', 'replace_name', 'c_name', 1)} * 16)::INT + 1]"


@query(
    "mask_references",
    f"""SELECT {permuted_sql('o_orderkey', 64, 17)} AS o_orderkey, {permuted_sql('c_custkey', 64, 17)} AS c_custkey, {_NAME_BY_VALUE} AS c_name, {permuted_sql('c_nationkey', 32, 17)}::INT AS c_nationkey, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def mask_references(spark, sf_dir):
    """Orders and customers, keys and all, masked apart and joined after that: every order still finds its customer."""
    tables, path = _tables(spark, sf_dir, ("customer", "orders")), scratch(spark, "masked")
    mask_tables(tables, decide(tables, keys=True, deep=False), path)
    orders, customers = (spark.read.parquet(f"{path}/{t}") for t in ("orders", "customer"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "c_custkey", "c_name", "c_nationkey", "o_totalprice")


@query(
    "mask_counts",
    """SELECT 'customer' AS "table", 'c_name' AS "column", count(c_name) AS rows_masked FROM customer UNION ALL SELECT 'customer', 'c_custkey', count(c_custkey) FROM customer UNION ALL SELECT 'customer', 'c_nationkey', count(c_nationkey) FROM customer
UNION ALL SELECT 'orders', 'o_orderkey', count(o_orderkey) FROM orders UNION ALL SELECT 'orders', 'o_custkey', count(o_custkey) FROM orders""",
)
def mask_counts(spark, sf_dir):
    """Masked cells of each column, counted while the masked tables were written."""
    tables = _tables(spark, sf_dir, ("customer", "orders"))
    found = mask_tables(tables, decide(tables, keys=True), scratch(spark, "masked"))
    return spark.createDataFrame([(r.table, r.column, r.rows_masked) for r in found], "table string, column string, rows_masked long")


@query(
    "mask_linked_rows",
    " UNION ALL ".join(
        f"SELECT '{c}' AS child, '{col}' AS \"column\", count({col}) AS n, count({col}) FILTER (WHERE {col} IN (SELECT {key} FROM {p})) AS found FROM {c}"
        for c, col, p, key in star.FOREIGN_KEYS
        if c in ("customer", "supplier", "orders", "events", "labels")
    ),
)
def mask_linked_rows(spark, sf_dir):
    """References that find a parent after all tables with whole-number keys have been masked: as many as before."""
    wanted = [f for f in star.FOREIGN_KEYS if f[0] in ("customer", "supplier", "orders", "events", "labels")]
    names = sorted({x for f in wanted for x in (f[0], f[2])})
    only = {t: sorted({f[1] for f in wanted if f[0] == t} | {f[3] for f in wanted if f[2] == t}) for t in names}
    tables, path = {t: table(spark, sf_dir, t).select(*only[t]) for t in names}, scratch(spark, "masked")
    # A reference and the key that it names may differ in type; as one type they are permuted alike.
    tables = {t: df.select(*(F.col(c).cast("long").alias(c) for c in df.columns)) for t, df in tables.items()}
    mask_tables(tables, decide(tables, keys=True, deep=False), path)
    out = None
    for child, column, parent, key in wanted:
        values = spark.read.parquet(f"{path}/{child}").groupBy(F.col(column).alias("v")).agg(F.count(column).alias("n"))
        known = spark.read.parquet(f"{path}/{parent}").select(F.col(key).alias("v"), F.lit(True).alias("there")).distinct()
        row = values.join(known, "v", "left").agg(F.lit(child).alias("child"), F.lit(column).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("there"), F.col("n"))), F.lit(0)).alias("found"))
        out = row if out is None else out.unionByName(row)
    return out
