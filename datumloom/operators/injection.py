"""Anomalies in any table: each kind finds the columns that it fits by their types, and labels every cell that it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.operators import privacy
from datumloom.registry import query, table

SEED, RATE = 53, 0.05
OVERFLOW = 1000


def _number(t: DataType) -> bool:
    return isinstance(t, NumericType)


def _text(t: DataType) -> bool:
    return isinstance(t, StringType)


def _time(t: DataType) -> bool:
    return isinstance(t, DateType | TimestampType | TimestampNTZType)


#: kind -> (the types that it fits, what becomes of a value of that type)
KINDS = {
    "extreme_value": (_number, lambda v, t: (v * 20).cast(t)),
    "negative_value": (_number, lambda v, t: (-F.abs(v)).cast(t)),
    "null_injection": (lambda t: True, lambda v, t: F.lit(None).cast(t)),
    "timestamp": (_time, lambda v, t: (v + F.expr("INTERVAL 730 DAYS")).cast(t)),
    "enum_violation": (_text, lambda v, t: F.concat(F.lit("__INVALID_"), F.upper(F.substring(F.md5(v), 1, 4)))),
    "string_overflow": (_text, lambda v, t: F.repeat(F.lit("A"), OVERFLOW)),
    "type_mismatch": (_text, lambda v, t: F.lit("NOT_A_NUMBER")),
}


def fitting(df: DataFrame, kind: str, keys: frozenset[str]) -> list[str]:
    """The columns of a table that a kind of anomaly can hit; keys and references never are."""
    fits = KINDS[kind][0]
    return [f.name for f in df.schema if f.name not in keys and fits(f.dataType)]


def inject(df: DataFrame, name: str, key: str, kinds: list[str], keys: frozenset[str] = frozenset(), rate: float = RATE, seed: int = SEED) -> DataFrame:
    """The table with anomalies, and ``anomalies``: an array of (kind, column) for the cells of each row that were changed.

    A row is hit by each kind at the rate, and then one of the fitting columns is, all by
    hashes of its key. Kinds follow one another, so a later one may hit the same cell. A
    null cell isn't changed and gets no label. ``duplicate_record`` gives a hit row twice,
    and the second one the label (duplicate_record, null).
    """
    keys = keys | {key}
    rows, labels = df.withColumn("_dup", F.lit(0)), []
    for kind in kinds:
        hit = uniform(seed, name, kind, F.col(key)) < rate
        if kind == "duplicate_record":
            rows = rows.drop("_dup").withColumn("_dup", F.explode(F.sequence(F.lit(0), F.when(hit, 1).otherwise(0))))
            labels.append(F.when(F.col("_dup") == 1, _label(kind, F.lit(None).cast("string"))))
            continue
        columns = fitting(df, kind, keys)
        if not columns:
            continue
        chosen = F.floor(uniform(seed, name, kind, F.col(key), 1) * len(columns))
        marks = {}
        for i, c in enumerate(columns):
            touched = hit & (chosen == i) & F.col(c).isNotNull()
            marks[f"_{kind}_{i}"] = touched
            labels.append(F.when(F.col(f"_{kind}_{i}"), _label(kind, F.lit(c))))
        change = KINDS[kind][1]
        rows = rows.withColumns(marks)
        rows = rows.withColumns({c: F.when(F.col(f"_{kind}_{i}"), change(F.col(c), df.schema[c].dataType)).otherwise(F.col(c)) for i, c in enumerate(columns)})
    found = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<struct<kind:string,column:string>>")
    return rows.select(*df.columns, found.alias("anomalies"))


def _label(kind: str, column: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), column.alias("column"))


EVERY = [*KINDS, "duplicate_record"]
_TEXTS, _NUMBERS, _TIMES = ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), ("o_orderdate",)
_FITTING = {
    "extreme_value": _NUMBERS,
    "negative_value": _NUMBERS,
    "null_injection": ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "timestamp": _TIMES,
    "enum_violation": _TEXTS,
    "string_overflow": _TEXTS,
    "type_mismatch": _TEXTS,
}


def _h(kind: str, draw: int = 0) -> str:
    return uniform_sql(SEED, "orders", kind, "o_orderkey", draw)


def _labels_sql() -> str:
    """How often each cell kind is hit: a cell that nulls have reached before counts no more."""
    parts = []
    for i, (kind, columns) in enumerate(_FITTING.items()):
        for j, c in enumerate(columns):
            nulled = list(_FITTING).index("null_injection") < i
            place = _FITTING["null_injection"].index(c)
            gone = f" AND NOT ({_h('null_injection')} < {RATE} AND floor({_h('null_injection', 1)} * 4) = {place})" if nulled else ""
            parts.append(f"SELECT '{kind}' AS kind, '{c}' AS \"column\", count(*) FILTER (WHERE {_h(kind)} < {RATE} AND floor({_h(kind, 1)} * {len(columns)}) = {j} AND {c} IS NOT NULL{gone}) * 1 + count(*) FILTER (WHERE {_h('duplicate_record')} < {RATE} AND {_h(kind)} < {RATE} AND floor({_h(kind, 1)} * {len(columns)}) = {j} AND {c} IS NOT NULL{gone}) AS n FROM orders")
    parts.append(f"SELECT 'duplicate_record', NULL, count(*) FILTER (WHERE {_h('duplicate_record')} < {RATE}) FROM orders")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) x WHERE n > 0"


@query("anomaly_labels", _labels_sql())
def anomaly_labels(spark, sf_dir):
    """Cells of the orders that all eight kinds of anomaly changed, by kind and column."""
    rows = inject(table(spark, sf_dir, "orders"), "orders", "o_orderkey", EVERY, privacy.KEYS["orders"])
    return rows.select(F.inline("anomalies")).groupBy("kind", "column").agg(F.count("*").alias("n"))
