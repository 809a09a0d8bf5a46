"""What changed between two datasets: tables, columns, references, row counts and most frequent values, breaking or cosmetic."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from datumloom.functions.numbers import places_sql
from datumloom.operators.capture import Reference
from datumloom.operators.compare import SECOND, second_version
from datumloom.plans import star
from datumloom.registry import query, table

#: Which changes break those who read the data.
BREAKING = ("table_removed", "column_removed", "reference_removed")
#: A column is compared by its most frequent value if at most this share of its rows has distinct values on both sides, and each side has so many rows.
CATEGORICAL, LEAST_ROWS = 0.5, 3
#: How far an approximate number of distinct values may be off (it is within 5 % two times in three).
SLACK = 1.3


@dataclass(frozen=True)
class Dataset:
    """Tables by name and the references among them."""

    tables: dict[str, DataFrame]
    references: tuple[Reference, ...] = ()


@dataclass(frozen=True)
class Change:
    kind: str
    table: str
    item: str | None
    before: str | None
    after: str | None

    @property
    def breaking(self) -> bool:
        return self.kind in BREAKING


def tops(df: DataFrame, columns: Iterable[str]) -> tuple[int, dict[str, tuple[str, int, int]]]:
    """The number of rows; and for each column with few enough distinct values its most frequent one (the greatest of equals), how often that occurs, and how many there are.

    One aggregate counts rows and roughly the distinct values; only columns that may
    have few are then counted by value, in one shuffle.
    """
    columns = list(columns)
    row = df.agg(F.count("*").alias("rows"), *(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns))).first()
    few = [c for i, c in enumerate(columns) if row[f"d{i}"] <= SLACK * CATEGORICAL * row["rows"]]
    if not few or row["rows"] < LEAST_ROWS:
        return row["rows"], {}
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in few))).alias("x")
    counts = df.select(pairs).select("x.*").where("v is not null and v <> ''").groupBy("c", "v").agg(F.count("*").alias("n"))
    found = counts.groupBy("c").agg(F.max(F.struct("n", "v")).alias("top"), F.count("*").alias("d")).collect()  # a row a column
    return row["rows"], {r["c"]: (r["top"]["v"], r["top"]["n"], r["d"]) for r in found}


def changes(before: Dataset, after: Dataset) -> list[Change]:
    """All changes, tables in the order of ``before`` and then those added."""
    old, new = before.tables, after.tables
    out = [Change("table_removed", t, None, None, None) for t in old if t not in new]
    out += [Change("table_added", t, None, None, None) for t in new if t not in old]
    for t in (t for t in old if t in new):
        a, b = old[t], new[t]
        out += [Change("column_removed", t, c, None, None) for c in a.columns if c not in b.columns]
        out += [Change("column_added", t, c, None, None) for c in b.columns if c not in a.columns]
        named = [{(c, p) for child, c, p, _ in d.references if child == t} for d in (before, after)]
        out += [Change("reference_removed", t, c, p, None) for c, p in sorted(named[0] - named[1])]
        out += [Change("reference_added", t, c, None, p) for c, p in sorted(named[1] - named[0])]
        shared = [f.name for f in a.schema if f.name in b.columns and not isinstance(f.dataType, ArrayType)]
        (n, ours), (m, theirs) = tops(a, shared), tops(b, shared)
        if n != m:
            out.append(Change("rows", t, None, str(n), str(m)))
        for c in shared:
            if c not in ours or c not in theirs:
                continue  # too many distinct values on one side to tell its most frequent one from any other
            (u, x, d), (v, y, e) = ours[c], theirs[c]
            one, other = f"{u} ({_percent(x, n)} %)", f"{v} ({_percent(y, m)} %)"
            if one != other and d <= CATEGORICAL * n and e <= CATEGORICAL * m:
                out.append(Change("top_value", t, c, one, other))
    return out


def _percent(part: int, whole: int) -> int:
    return int(100 * part / whole + 0.5)


_NAMES = ("customer", "orders", "part", "supplier", "nation")


def _two(spark, sf_dir: str) -> tuple[Dataset, Dataset]:
    """Five tables; and a version with other orders, without parts, with line items, and with changed columns and references of the suppliers."""
    tables = {t: table(spark, sf_dir, t) for t in _NAMES}
    references = tuple(r for r in star.FOREIGN_KEYS if r[0] in _NAMES and r[2] in _NAMES)
    later = {t: df for t, df in tables.items() if t != "part"} | {"lineitem": table(spark, sf_dir, "lineitem")}
    later["orders"] = second_version(tables["orders"])
    later["supplier"] = tables["supplier"].drop("s_acctbal").withColumn("s_rank", F.lit(1))
    kept = tuple(r for r in references if r[0] != "supplier") + (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey"))
    return Dataset(tables, references), Dataset(later, kept)


def _top_sql(t: str, c: str, other: str) -> str:
    """The change of one column's most frequent value, if there is any."""
    side = lambda source: f"""(SELECT v, n, d, total, v || ' (' || {places_sql('100.0::DOUBLE * n / total', 0)}::INT || ' %)' AS said FROM (SELECT {c}::VARCHAR AS v, count(*) AS n, count(*) OVER () AS d, (SELECT count(*) FROM {source} y) AS total FROM {source} x WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '' GROUP BY 1) g ORDER BY n DESC, v DESC LIMIT 1)"""
    return f"SELECT 'top_value' AS kind, '{t}' AS \"table\", '{c}' AS item, a.said AS before, b.said AS after FROM {side(t)} a, {side(other)} b WHERE a.said <> b.said AND a.d <= {CATEGORICAL} * a.total AND b.d <= {CATEGORICAL} * b.total"


_FIXED = [
    ("table_removed", "part", None, None, None),
    ("table_added", "lineitem", None, None, None),
    ("column_removed", "supplier", "s_acctbal", None, None),
    ("column_added", "supplier", "s_rank", None, None),
    ("reference_removed", "supplier", "s_nationkey", "nation", None),
    ("reference_added", "nation", "n_regionkey", None, "region"),
]


def _changes_sql() -> str:
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    parts = [f"SELECT {', '.join(map(quote, row))}" for row in _FIXED]
    parts[0] = "SELECT 'table_removed' AS kind, 'part' AS \"table\", NULL AS item, NULL AS before, NULL AS after"
    parts.append(f"SELECT 'rows', 'orders', NULL, (SELECT count(*) FROM orders)::VARCHAR, (SELECT count(*) FROM {SECOND} s)::VARCHAR WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM {SECOND} s)")
    parts += [_top_sql("orders", c, SECOND) for c in star.COLUMNS["orders"]]
    return f"SELECT *, kind IN {BREAKING!r} AS breaking FROM ({' UNION ALL '.join(parts)}) c"


@query("dataset_changes", _changes_sql())
def dataset_changes(spark, sf_dir):
    """All changes between two datasets of several tables."""
    found = changes(*_two(spark, sf_dir))
    return spark.createDataFrame([(c.kind, c.table, c.item, c.before, c.after, c.breaking) for c in found], "kind string, table string, item string, before string, after string, breaking boolean")
