"""From a pack (tables, columns, strategies, references) to tables, every cell a function of its row number.

A cell is an expression of its row number alone, and so is the row number of its parent.
A reference, a value copied from a parent, or from the parent's parent, is therefore that
other cell's expression at the other row number: no table is joined, collected or kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.functions import checks, numbers
from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.operators.privacy import FIRST, LAST
from datumloom.plans import schema
from datumloom.registry import query


def normalize(pack: dict) -> list[dict]:
    """Tables as {name, columns: {name: definition}, cascade}, from any of three layouts.

    Tables may be a list with ids (references name table and column ids), a plain list
    (columns a list or a mapping) or a mapping by name; they may lie under schema,
    config or database.
    """
    tables = pack.get("tables")
    if not tables:
        return next((found for key in ("schema", "config", "database") if isinstance(pack.get(key), dict) and (found := normalize(pack[key]))), [])
    if isinstance(tables, dict):
        tables = [{"name": name, **definition} for name, definition in tables.items()]
    names = {t["id"]: t["name"] for t in tables if "id" in t}
    column_names = {c["id"]: c["name"] for t in tables if isinstance(t.get("columns"), list) for c in t["columns"] if "id" in c}
    out = []
    for t in tables:
        columns = t.get("columns") or t.get("schema") or {}
        if isinstance(columns, list):
            columns = {c["name"]: dict(c) for c in columns if c.get("name")}
        for c in columns.values():
            if c.get("isFK") and c.get("fkTarget"):
                c["foreignKey"] = {"table": names.get(c["fkTarget"]["tableId"]), "column": column_names.get(c["fkTarget"]["columnId"])}
        out.append({"name": t.get("name") or t.get("table_name") or "unknown", "columns": columns, "cascade": t.get("cascade_columns")})
    return out


@dataclass
class Generator:
    """A pack with row counts and a seed."""

    tables: list[dict]
    rows: dict[str, int]
    seed: int

    @cached_property
    def by_name(self) -> dict[str, dict]:
        return {t["name"]: t for t in self.tables}

    def u(self, table: str, column: str, row: Column, draw: int = 0) -> Column:
        return uniform(self.seed, table, column, row, draw)

    def parent_row(self, table: str, column: str, row: Column) -> Column:
        """The parent's row number. A table that refers to itself refers to an earlier row."""
        parent = self.by_name[table]["columns"][column]["foreignKey"]["table"]
        n = row if parent == table else F.lit(self.rows[parent])
        return F.floor(self.u(table, column, row) * n).cast("long")

    def cell(self, table: str, column: str, row: Column) -> Column:
        definition = self.by_name[table]["columns"][column]
        value = self.value(table, column, definition, row)
        for name, other in self.by_name[table]["columns"].items():
            for rule in (other.get("options") or {}).get("lifecycleRules", []):
                if column in rule.get("nullFields", []):
                    value = F.when(self.cell(table, name, row) != rule["value"], value)
        return value

    def value(self, table: str, column: str, definition: dict, row: Column) -> Column:
        options, strategy = definition.get("options") or {}, definition.get("strategy", "text")
        cascade = self.by_name[table]["cascade"]
        if cascade and column in cascade["columns"]:
            return self.cell(cascade["from"], column, self.parent_row(table, cascade["via"], row))
        key = definition.get("foreignKey")
        if key and key["table"] in self.by_name:
            parent = self.cell(key["table"], key["column"], self.parent_row(table, column, row))
            # The first three tenths of a tree are roots.
            return F.when(row >= int(self.rows[table] * 0.3), parent) if key["table"] == table else parent
        if options.get("dependsOn") and options.get("dependencyRule") == "after":
            low, high = options.get("minDays", 1), options.get("maxDays", 30)
            return F.date_add(self.cell(table, options["dependsOn"], row), F.floor(low + self.u(table, column, row) * (high - low)).cast("int"))
        if strategy == "dependent_enum":
            sibling, pools = self.cell(table, options["dependsOn"], row), options["mapping"]
            default = pools.get("default", ["unknown"])
            out = None
            for value, pool in pools.items():
                chosen = numbers.choice(self.u(table, column, row), pool)
                out = F.when(sibling == value, chosen) if out is None else out.when(sibling == value, chosen)
            return out.otherwise(numbers.choice(self.u(table, column, row), default))
        return self.plain(table, column, strategy, options, row)

    def plain(self, table: str, column: str, strategy: str, options: dict, row: Column) -> Column:
        u = lambda draw=0: self.u(table, column, row, draw)
        digits = lambda n, draw=0: F.lpad(F.floor(u(draw) * 10**n).cast("long").cast("string"), n, "0")
        if strategy == "enum":
            values = options.get("values") or ["option_a"]
            return numbers.weighted(u(), dict(zip(values, options["weights"]))) if options.get("weights") else numbers.choice(u(), values)
        if strategy in ("integer", "int"):
            return numbers.integer(u(), options.get("min", 1), options.get("max", 1000))
        if strategy in ("float", "decimal", "money"):
            low, high = options.get("min", 1), options.get("max", 999.99)
            kind = options.get("distribution", "uniform")
            if kind == "normal":
                x = numbers.normal(u(0), u(1), options.get("mean", (low + high) / 2), options.get("stddev", (high - low) / 6))
            elif kind == "weibull":
                x = numbers.weibull(u(), options.get("k", 1.5), options.get("lambda", (high - low) / 2))
            else:
                x = low + u() * (high - low)
            return numbers.places(numbers.bounded(x, low, high), 2)
        hexed = F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(table), F.lit(column), row.cast("string")))
        first, last = numbers.choice(u(0), list(FIRST)), numbers.choice(u(1), list(LAST))
        made = {
            "uuid": lambda: F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
            "boolean": lambda: u() > 0.5,
            "name": lambda: F.concat_ws(" ", first, last),
            "full_name": lambda: F.concat_ws(" ", first, last),
            "name_first": lambda: first,
            "name_last": lambda: last,
            "email": lambda: F.concat(F.lower(first), row.cast("string"), F.lit("@example.com")),
            "phone": lambda: F.concat(F.lit("+1555"), digits(7)),
            "ssn_token": lambda: F.concat_ws("-", digits(3, 0), digits(2, 1), digits(4, 2)),
            "digit_string": lambda: digits(min(options.get("length", 10), 15)),
            "aba_routing": lambda: F.concat(digits(8), checks.aba_check_digit(digits(8))),
            "iban": lambda: F.concat(F.lit("DE"), checks.iban_check_digits(F.lit("DE"), F.concat(digits(9, 0), digits(9, 1))), digits(9, 0), digits(9, 1)),
            "company_name": lambda: F.concat_ws(" ", last, numbers.choice(u(2), ["Group", "Labs", "Partners", "Works"])),
            "address": lambda: F.concat((100 + F.floor(u(0) * 9900)).cast("string"), F.lit(" "), last, F.lit(" St")),
            "timestamp": lambda: F.timestamp_seconds(1704067200 + F.floor(u() * 31536000)),
            "past_date": lambda: F.date_sub(F.lit("2024-01-01").cast("date"), F.floor(u() * 365 * options.get("maxYearsAgo", 3)).cast("int")),
            "future_date": lambda: F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u() * 365).cast("int")),
            "random_string": lambda: F.substring(hexed, 1, 12),
            "sku": lambda: F.concat(F.lit("SKU-"), F.upper(F.substring(hexed, 1, 6))),
            "sequential": lambda: row + 1,
        }
        return made[strategy]() if strategy in made else F.concat(F.lit("item_"), F.floor(u() * 10000).cast("string"))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        row = F.col("_row")
        return spark.range(self.rows[name]).withColumnRenamed("id", "_row").select(*(self.cell(name, c, row).alias(c) for c in self.by_name[name]["columns"]))

    def all(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t["name"]: self.table(spark, t["name"]) for t in self.tables}


def generator(pack: dict, total: int, seed: int) -> Generator:
    """A pack's tables with ``total`` rows dealt to them: roots weigh two, children one, or by declared means."""
    tables = normalize(pack)
    shapes = []
    for t in tables:
        references = {c: d["foreignKey"] for c, d in t["columns"].items() if d.get("foreignKey")}
        shapes.append(schema.Table(t["name"], [schema.Column(c, schema.TYPES["text"], references=(references[c]["table"], references[c]["column"]) if c in references else None) for c in t["columns"]]))
    means = {t: m for t, m in (pack.get("cardinality") or {}).items()}
    return Generator(tables, schema.row_counts(shapes, total, means or None), seed)


def _id() -> dict:
    return {"strategy": "uuid"}


def _ref(table: str) -> dict:
    return {"strategy": "uuid", "foreignKey": {"table": table, "column": "id"}}


#: A bank: nine tables, with cascades over two levels and nulls by status.
BANK = {
    "tables": {
        "branches": {"columns": {"id": _id(), "country": {"strategy": "enum", "options": {"values": ["DE", "FR", "IT"], "weights": [5, 3, 2]}}}},
        "customers": {"columns": {"id": _id(), "branch_id": _ref("branches"), "country": {}, "name": {"strategy": "full_name"}, "email": {"strategy": "email"}, "city": {"strategy": "dependent_enum", "options": {"dependsOn": "country", "mapping": {"DE": ["Berlin", "Hamburg"], "FR": ["Paris", "Lyon"], "default": ["Other"]}}}}, "cascade_columns": {"from": "branches", "via": "branch_id", "columns": ["country"]}},
        "accounts": {"columns": {"id": _id(), "customer_id": _ref("customers"), "country": {}, "iban": {"strategy": "iban"}, "status": {"strategy": "enum", "options": {"values": ["open", "closed"], "weights": [9, 1], "lifecycleRules": [{"value": "open", "nullFields": ["closed_on"]}]}}, "opened_on": {"strategy": "past_date"}, "closed_on": {"options": {"dependsOn": "opened_on", "dependencyRule": "after", "minDays": 5, "maxDays": 400}}}, "cascade_columns": {"from": "customers", "via": "customer_id", "columns": ["country"]}},
        "merchants": {"columns": {"id": _id(), "name": {"strategy": "company_name"}}},
        "transactions": {"columns": {"id": _id(), "account_id": _ref("accounts"), "merchant_id": _ref("merchants"), "amount": {"strategy": "money", "options": {"min": 1, "max": 5000, "distribution": "weibull"}}, "at": {"strategy": "timestamp"}}},
        "cards": {"columns": {"id": _id(), "account_id": _ref("accounts"), "number": {"strategy": "digit_string", "options": {"length": 12}}}},
        "loans": {"columns": {"id": _id(), "customer_id": _ref("customers"), "amount": {"strategy": "money", "options": {"min": 1000, "max": 90000, "distribution": "normal"}}}},
        "alerts": {"columns": {"id": _id(), "transaction_id": _ref("transactions"), "kind": {"strategy": "enum", "options": {"values": ["velocity", "amount", "country"]}}}},
        "teams": {"columns": {"id": _id(), "parent_id": _ref("teams"), "name": {"strategy": "name"}}},
    }
}


def bank(total: int, seed: int = 42) -> Generator:
    return generator(BANK, total, seed)


@query("pack_references", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {n}::BIGINT AS n, 0::BIGINT AS dangling" for t, c, n in (("customers", "branch_id", 181), ("accounts", "customer_id", 181), ("transactions", "account_id", 181), ("alerts", "transaction_id", 181))))
def pack_references(spark, sf_dir):
    """Generated references and how many of them have no parent: none."""
    tables = bank(2180).all(spark)
    out = None
    for child, column, parent in (("customers", "branch_id", "branches"), ("accounts", "customer_id", "customers"), ("transactions", "account_id", "accounts"), ("alerts", "transaction_id", "transactions")):
        known = tables[parent].select(F.col("id").alias(column), F.lit(1).alias("there"))
        row = tables[child].join(known, column, "left").agg(F.lit(child).alias("table"), F.lit(column).alias("column"), F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("dangling"))
        out = row if out is None else out.unionByName(row)
    return out




def _accounts_sql(total: int) -> str:
    rows = bank(total).rows
    weights = {"DE": 5, "FR": 3, "IT": 2}
    day = f"(DATE '2024-01-01' - floor({uniform_sql(42, 'accounts', 'opened_on', 'r')} * 1095)::INT)"
    return f"""SELECT r, {numbers.weighted_sql(uniform_sql(42, 'branches', 'country', 'b'), weights)} AS country, status, {day} AS opened_on,
 CASE WHEN status <> 'open' THEN {day} + floor(5 + {uniform_sql(42, 'accounts', 'closed_on', 'r')} * 395)::INT END AS closed_on FROM
 (SELECT r, floor({uniform_sql(42, 'customers', 'branch_id', 'c')} * {rows['branches']})::BIGINT AS b, {numbers.weighted_sql(uniform_sql(42, 'accounts', 'status', 'r'), {'open': 9, 'closed': 1})} AS status FROM
 (SELECT r, floor({uniform_sql(42, 'accounts', 'customer_id', 'r')} * {rows['customers']})::BIGINT AS c FROM range({rows['accounts']}) t(r)) x) y"""


@query("pack_accounts", _accounts_sql(20_000))
def pack_accounts(spark, sf_dir):
    """A generated table with a value cascaded over two levels, a date after another and nulls by status."""
    g = bank(20_000)
    r = F.col("r")
    return spark.range(g.rows["accounts"]).withColumnRenamed("id", "r").select("r", *(g.cell("accounts", c, r).alias(c) for c in ("country", "status", "opened_on", "closed_on")))
