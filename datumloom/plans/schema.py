"""Schemas of packs: DDL text, dependency order, row counts. All of it is small and lives on the driver."""

from __future__ import annotations

import graphlib
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# SQL type names and what they are in Spark.
TYPES = {
    "smallint": T.ShortType(), "int2": T.ShortType(), "smallserial": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "int4": T.IntegerType(), "serial": T.IntegerType(),
    "bigint": T.LongType(), "int8": T.LongType(), "bigserial": T.LongType(), "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(), "float8": T.DoubleType(), "double": T.DoubleType(),
    "money": T.DecimalType(12, 2), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "uuid": T.StringType(), "text": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(),
}


@dataclass
class Column:
    name: str
    type: T.DataType
    nullable: bool = True
    primary: bool = False
    references: tuple[str, str] | None = None
    #: The only values that a check or an enumerated type allows.
    values: tuple[str, ...] = ()


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)

    def struct(self) -> T.StructType:
        """The Spark schema; keys are in the fields' metadata, since Spark doesn't enforce them."""
        return T.StructType([T.StructField(c.name, c.type, c.nullable, {"primary": c.primary} | ({"references": list(c.references)} if c.references else {})) for c in self.columns])


def spark_type(text: str) -> T.DataType:
    """The type of a column by its SQL text, arrays included; unknown types are strings."""
    low = " ".join(text.lower().split())
    if low.endswith("[]"):
        return T.ArrayType(spark_type(low[:-2]))
    if m := re.fullmatch(r"(?:numeric|decimal)\s*(?:\((\d+)\s*(?:,\s*(\d+))?\))?", low):
        return T.DecimalType(int(m[1] or 38), int(m[2] or (0 if m[1] else 18)))
    return TYPES.get(re.sub(r"\s*\(.*\)", "", low), T.StringType())


def _parts(body: str) -> list[str]:
    """A table body's definitions, cut at commas outside parentheses."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(body[last:i].strip())
            last = i + 1
    return [*out, body[last:].strip()]


def _texts(items: str) -> tuple[str, ...]:
    """The quoted texts of a list."""
    return tuple(t.replace("''", "'") for t in re.findall(r"'((?:[^']|'')*)'", items))


def tables_of(ddl: str) -> list[Table]:
    """Tables of CREATE TABLE statements, with inline, table-level and ALTER TABLE references, and the values that checks and enumerated types allow."""
    ddl = re.sub(r"--[^\n]*", "", ddl)
    found: dict[str, Table] = {}
    name = r'"?(\w+)"?'
    listed = {m[1].lower(): _texts(m[2]) for m in re.finditer(rf"CREATE\s+TYPE\s+(?:\w+\.)?{name}\s+AS\s+ENUM\s*\((.*?)\)\s*;", ddl, re.I | re.S)}
    check = rf"CHECK\s*\(\s*\(?\s*{name}(?:::\w+)?\s*(?:IN\s*\(|=\s*ANY\s*\()(.*)"
    for m in re.finditer(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\w+\.)?{name}\s*\((.*?)\)\s*;", ddl, re.I | re.S):
        t = found[m[1]] = Table(m[1])
        for part in _parts(m[2]):
            if f := re.match(rf"(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY\s*\({name}\)\s*REFERENCES\s+{name}\s*\({name}\)", part, re.I):
                next(c for c in t.columns if c.name == f[1]).references = (f[2], f[3])
            elif p := re.match(r"(?:CONSTRAINT\s+\w+\s+)?PRIMARY\s+KEY\s*\((.*?)\)", part, re.I):
                for c in t.columns:
                    c.primary |= c.name in [x.strip(' "') for x in p[1].split(",")]
            elif k := re.match(rf"(?:CONSTRAINT\s+\w+\s+)?{check}", part, re.I | re.S):
                for c in t.columns:
                    c.values = _texts(k[2]) if c.name == k[1] else c.values
            elif not re.match(r"(CONSTRAINT|UNIQUE|CHECK)\b", part, re.I):
                c = re.match(rf"{name}\s+((?:double\s+precision|timestamp\s+with(?:out)?\s+time\s+zone|\w+)(?:\s*\([^)]*\))?(?:\[\])?)\s*(.*)", part, re.I | re.S)
                rest = c[3]
                ref = re.search(rf"REFERENCES\s+{name}\s*\({name}\)", rest, re.I)
                primary = bool(re.search(r"PRIMARY\s+KEY", rest, re.I))
                allowed = re.search(check, rest, re.I | re.S)
                values = _texts(c[2]) if c[2].lower().startswith("enum") else _texts(allowed[2]) if allowed else listed.get(c[2].lower(), ())
                t.columns.append(Column(c[1], spark_type(c[2]), not (primary or re.search(r"NOT\s+NULL", rest, re.I)), primary, (ref[1], ref[2]) if ref else None, values))
    for m in re.finditer(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?(?:\w+\.)?{name}\s+ADD\s+(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY\s*\({name}\)\s*REFERENCES\s+(?:\w+\.)?{name}\s*\({name}\)", ddl, re.I):
        next(c for c in found[m[1]].columns if c.name == m[2]).references = (m[3], m[4])
    return list(found.values())


def ddl_of(tables: list[Table]) -> str:
    """CREATE TABLE statements, parents first."""
    words = {"ShortType": "SMALLINT", "IntegerType": "INTEGER", "LongType": "BIGINT", "FloatType": "REAL", "DoubleType": "DOUBLE PRECISION", "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMPTZ", "StringType": "TEXT"}
    by_name = {t.name: t for t in tables}
    out = []
    for name in order(tables)[0]:
        lines = []
        for c in by_name[name].columns:
            kind = f"NUMERIC({c.type.precision},{c.type.scale})" if isinstance(c.type, T.DecimalType) else words[type(c.type).__name__]
            lines.append(f"  {c.name} {kind}" + " PRIMARY KEY" * c.primary + " NOT NULL" * (not c.nullable and not c.primary) + (f" REFERENCES {c.references[0]}({c.references[1]})" if c.references else ""))
        out.append(f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n);")
    return "\n".join(out)


def order(tables: list[Table]) -> tuple[list[str], list[str]]:
    """Names with parents first, ties by name; and the names on cycles, which come last. A table's reference to itself is no cycle."""
    names = {t.name for t in tables}
    graph = {t.name: {c.references[0] for c in t.columns if c.references and c.references[0] in names and c.references[0] != t.name} for t in tables}
    out: list[str] = []
    sorter = graphlib.TopologicalSorter(graph)
    try:
        sorter.prepare()
    except graphlib.CycleError:
        left = dict(graph)
        while ready := sorted(n for n, parents in left.items() if not parents & left.keys()):
            out += ready
            left = {n: p for n, p in left.items() if n not in ready}
        return out + sorted(left), sorted(left)
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out, []


def problems(tables: list[Table]) -> list[str]:
    """Repeated tables, tables without columns or key, references that lead nowhere."""
    names = [t.name for t in tables]
    columns = {t.name: {c.name for c in t.columns} for t in tables}
    out = [f"{n}: defined twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for t in tables:
        out += [f"{t.name}: no columns"] * (not t.columns) + [f"{t.name}: no primary key"] * (not any(c.primary for c in t.columns))
        out += [f"{t.name}.{c.name}: no {c.references[0]}.{c.references[1]}" for c in t.columns if c.references and c.references[1] not in columns.get(c.references[0], ())]
    return out


def row_counts(tables: list[Table], total: int, means: dict[str, float] | None = None) -> dict[str, int]:
    """Rows for each table out of a total: roots weigh 2 and children 1, or children follow their parent's rows times a mean (20 at most)."""
    names, _ = order(tables)
    parents = {t.name: next((c.references[0] for c in t.columns if c.references and c.references[0] != t.name), None) for t in tables}
    if not means:
        weight = {n: 1 if parents[n] else 2 for n in names}
        return {n: max(1, math.floor(total * weight[n] / sum(weight.values()))) for n in names}
    counts: dict[str, float] = {}
    for n in names:
        counts[n] = counts[parents[n]] * min(means.get(n, 1), 20) if parents[n] in counts else max(10, math.ceil(total / (2 * len(names))))
    scale = total / sum(counts.values())
    return {n: max(1, round(c * scale)) for n, c in counts.items()}


def growth(model: str, n: int, total: int) -> list[int]:
    """``total`` rows over ``n`` slots by a growth model, rounded by largest remainders (ties to the earlier slot)."""
    weight = {"flat": lambda i: 1.0, "linear": lambda i: 1.0 + i, "exponential": lambda i: math.exp(3 * i / max(1, n - 1)), "s_curve": lambda i: 1 / (1 + math.exp(6 - 12 * i / max(1, n - 1)))}[model]
    exact = [total * weight(i) / sum(map(weight, range(n))) for i in range(n)]
    counts = [math.floor(x) for x in exact]
    for i in sorted(range(n), key=lambda i: (counts[i] - exact[i], i))[: total - sum(counts)]:
        counts[i] += 1
    return counts
