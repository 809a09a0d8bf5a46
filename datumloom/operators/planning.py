"""Plans for the given tables: inferred from their schema, their rows and a template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.operators import detect
from datumloom.plans import packs, schema, star
from datumloom.registry import TABLES, query, table


def schemas_of(tables: dict[str, DataFrame]) -> list[schema.Table]:
    """Tables as parsed ones, with the keys and references that the star schema has among them."""
    out = []
    for name, df in tables.items():
        parents = {c: (p, k) for child, c, p, k in star.FOREIGN_KEYS if child == name and p in tables}
        out.append(schema.Table(name, [schema.Column(f.name, f.dataType, f.nullable, f.name == star.PRIMARY_KEYS.get(name), parents.get(f.name)) for f in df.schema]))
    return out


def weighed_values(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """For each column its distinct values and their shares, most frequent first and ties by value; the columns are known to have few."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("x")
    counts = df.select(pairs).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n")).collect()  # few, by the facts
    out: dict[str, dict[str, float]] = {}
    for c in columns:
        found = sorted(((r["v"], r["n"]) for r in counts if r["c"] == c), key=lambda x: (-x[1], x[0]))
        total = sum(n for _, n in found)
        out[c] = {v: n / total for v, n in found}
    return out


def observed(tables: dict[str, DataFrame]) -> tuple[dict[str, dict[str, detect.Facts]], dict[tuple[str, str], dict[str, float]]]:
    """Facts of all columns, and the weighed values of those that hold lists of values."""
    facts = {t: detect.facts(df) for t, df in tables.items()}
    kinds = {(d.table, d.column): d.kind for d in detect.detect(tables, facts)}
    values = {}
    for t, df in tables.items():
        listed = [c for c in df.columns if packs.STRATEGY_OF[kinds[t, c]] == "enum" and 0 < facts[t][c].distinct <= detect.LISTED]
        values.update({(t, c): v for c, v in weighed_values(df, listed).items()})
    return facts, values


#: A template for the star schema: some tables at other sizes, and some columns as a person wants them.
SHOP = packs.Template(
    "shop",
    (
        packs.TableTemplate(("customer", "supplier"), (packs.Override(("*_name",), "full_name"), packs.Override(("*acctbal",), "money", {"min": -1000, "max": 10_000})), rows=0.5),
        packs.TableTemplate(("orders",), (packs.Override(("o_orderstatus",), "enum", {"values": ["O", "F", "P"], "weights": [5, 4, 1]}), packs.Override(("*priority",), "enum", {"values": ["default"]})), rows=2),
        packs.TableTemplate(("line*",), (packs.Override(("l_shipdate",), "timestamp", {"dependsOn": "l_commitdate", "dependencyRule": "after"}), packs.Override(("*",), "integer")), rows=2.5),
        packs.TableTemplate(("*",), (), rows=1),
    ),
    frozenset({"region", "nation", "customer", "orders", "lineitem", "part", "events"}),
)


def given_plan(spark: SparkSession, sf_dir: str) -> list[packs.TablePlan]:
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    facts, values = observed(tables)
    counts = {t: max((f.rows for f in facts[t].values()), default=0) for t in tables}
    return packs.plan(schemas_of(tables), SHOP, counts, facts, values)


_COUNTS = {"customer": 0.5, "supplier": 0.5, "orders": 2, "lineitem": 2.5}


@query(
    "plan_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", greatest(1, floor(count(*) * {_COUNTS.get(t, 1)} + 0.5))::BIGINT AS \"rows\", {'TRUE' if t in SHOP.targets else 'FALSE'} AS enabled FROM {t}" for t in TABLES
    ),
)
def plan_tables(spark, sf_dir):
    """How many rows of each given table the template asks for, by their real numbers, and which tables are made."""
    return spark.createDataFrame([(p.table, p.rows, p.enabled) for p in given_plan(spark, sf_dir)], "table string, rows long, enabled boolean")


def _columns_sql() -> str:
    """Reference, template or inference, decided in this order from names and from what the values show."""
    kinds = " UNION ALL ".join(detect._sql(t, c, k) for t, columns in detect.GIVEN.items() for c, k in columns.items())
    references = " OR ".join(f"(\"table\" = '{t}' AND \"column\" = '{c}')" for t, c, p, _ in star.FOREIGN_KEYS if p in SHOP.targets)
    dangling = " OR ".join(f"(\"table\" = '{t}' AND \"column\" = '{c}')" for t, c, p, _ in star.FOREIGN_KEYS if p not in SHOP.targets)
    template = """CASE WHEN "table" IN ('customer', 'supplier') AND "column" LIKE '%\\_name' ESCAPE '\\' THEN 'full_name' WHEN "table" IN ('customer', 'supplier') AND "column" LIKE '%acctbal' THEN 'money'
 WHEN "table" = 'orders' AND "column" = 'o_orderstatus' THEN 'enum' WHEN "table" LIKE 'line%' AND "column" = 'l_shipdate' THEN 'timestamp' WHEN "table" LIKE 'line%' THEN 'integer' END"""
    strategies = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in packs.STRATEGY_OF.items() if k != "foreign_key")
    return f"""SELECT "table", "column", CASE WHEN {references} THEN 'foreign_key' WHEN template IS NOT NULL THEN template WHEN {dangling} THEN 'integer' ELSE CASE kind {strategies} END END AS strategy,
 CASE WHEN {references} THEN 'reference' WHEN template IS NOT NULL THEN 'template' ELSE 'inferred' END AS source FROM (SELECT *, {template} AS template FROM ({kinds}) k) t"""


@query("plan_columns", _columns_sql())
def plan_columns(spark, sf_dir):
    """The strategy of every column and where it is from: a reference, the template, or names and values."""
    return spark.createDataFrame([(p.table, c.column, c.strategy, c.source) for p in given_plan(spark, sf_dir) for c in p.columns], "table string, column string, strategy string, source string")


_LISTED = (("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("events", "event_type"), ("documents", "lang"), ("lineitem", "l_returnflag"), ("conversations", "role"))


@query(
    "pack_values",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {c} AS value, count(*)::DOUBLE / (SELECT count({c}) FROM {t}) AS weight FROM {t} WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) <= {detect.LISTED} AND count({c}) >= {detect.EACH} * count(DISTINCT {c}) FROM {t}) GROUP BY {c}"""
        for t, c in _LISTED
    ),
)
def pack_values(spark, sf_dir):
    """Lists of values with weights that the inferred pack has for six columns, from all rows."""
    tables = {t: table(spark, sf_dir, t).select(*(c for u, c in _LISTED if u == t)) for t in dict(_LISTED)}
    facts, values = observed(tables)
    made = packs.infer(schemas_of(tables), facts, values).pack["tables"]
    rows = []
    for t, c in _LISTED:
        options = made[t]["columns"][c].get("options", {})
        if (t, c) in values:
            rows += [(t, c, v, w) for v, w in zip(options["values"], options["weights"])]
    return spark.createDataFrame(rows, "table string, column string, value string, weight double")
