"""What a column holds: evidence from keys, names, types and values, weighed to a kind, a confidence and a reason.

Names are tried in a fixed order, as are types. Values are looked at in one aggregate for
each table: how many of a text column's look like an e-mail address, a link and so on, how
many distinct ones there are, and their range. They confirm what a name says, overrule it
where hardly any value agrees, and decide where names say nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType

from datumloom.plans import star
from datumloom.registry import TABLES, query, table


@dataclass(frozen=True)
class NameRule:
    """A kind that names tell of: whole names, parts of names, how sure that is, and what it says."""

    kind: str
    names: tuple[str, ...]
    parts: tuple[str, ...]
    confidence: str
    reason: str


# Names by kind, in the order in which they are tried.
NAME_RULES = (
    NameRule("email", ("email", "email_address", "e_mail", "user_email", "contact_email"), ("email",), "high", "Column name matches email pattern"),
    NameRule("first_name", ("first_name", "fname", "given_name", "forename"), (), "high", "Column name matches first_name pattern"),
    NameRule("last_name", ("last_name", "lname", "surname", "family_name"), (), "high", "Column name matches last_name pattern"),
    NameRule("phone", ("phone", "phone_number", "mobile", "mobile_number", "cell", "telephone", "fax"), ("phone", "mobile", "tel_"), "high", "Column name matches phone pattern"),
    NameRule("address", ("address", "street", "street_address", "mailing_address", "billing_address", "shipping_address"), ("address", "street"), "high", "Column name matches address pattern"),
    NameRule("company_name", ("company", "company_name", "organization", "org_name", "employer", "business_name"), ("company", "organization"), "high", "Column name matches company_name pattern"),
    NameRule("full_name", ("full_name", "display_name"), (), "high", "Name column on person-like table"),
    NameRule("url", ("url", "website", "homepage", "link", "href", "uri", "website_url", "profile_url", "avatar_url", "image_url", "photo_url", "callback_url"), ("_url", "url_", "website", "homepage"), "high", "URL/website column"),
    NameRule("ip", ("ip", "ip_address", "ipv4", "ipv6", "remote_ip", "client_ip", "source_ip", "server_ip"), ("_ip", "ip_"), "high", "IP address column"),
    NameRule("slug", ("slug", "url_slug", "permalink", "handle", "alias"), (), "high", "Slug/permalink column"),
    NameRule("username", ("username", "user_name", "login", "screen_name", "handle", "nick", "nickname"), (), "high", "Username column"),
    NameRule("country", ("country", "country_code", "country_name", "nation", "locale"), (), "high", "Country column"),
    NameRule("currency", ("currency", "currency_code", "currency_symbol"), (), "high", "Currency column"),
    NameRule("money", ("amount", "price", "cost", "total", "subtotal", "tax", "fee", "balance", "revenue", "salary", "wage", "budget", "payment_amount", "refund_amount"), ("amount", "price", "cost", "total", "_fee", "salary", "wage"), "high", "Monetary amount column"),
    NameRule("percentage", ("percentage", "percent", "rate", "tax_rate", "discount_rate", "interest_rate", "completion_rate"), ("_rate", "_percent", "pct"), "high", "Percentage/rate column"),
    NameRule("rating", ("rating", "score", "stars", "review_score", "satisfaction"), ("rating", "score"), "high", "Rating/score column"),
    NameRule("status", ("status", "state", "stage", "phase", "lifecycle_state"), ("status", "_state"), "medium", "Status column"),
    NameRule("enum", ("type", "category", "kind", "role", "tier", "level", "plan", "priority", "severity", "gender", "size"), ("_type", "_kind", "_role", "_tier", "_level", "_category"), "low", "Likely enum column"),
)
# Tables of persons, where a column "name" is a full name.
PERSON_LIKE = ("users", "user", "people", "person", "contacts", "contact", "members", "member", "employees", "employee", "customers", "customer", "profiles", "profile", "authors", "author", "staff", "agents", "agent")

#: What values of a text column may look like, and from which share of its non-empty values that decides alone; of equal shares the first counts.
SHAPES = {
    "email": (r"^[^@\x{20}]+@[^@\x{20}]+\.[A-Za-z]{2,}$", 0.8),
    "url": (r"^https?://[^\x{20}]+$", 0.8),
    "ip": (r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", 0.8),
    "uuid": (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", 0.95),
    "date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.95),
    "json": (r"^[{\[].*[}\]]$", 0.95),
    "number": (r"^-?[0-9]+(\.[0-9]+)?$", 0.95),
    "phone": (r"^[+(]?[0-9][0-9 ().-]{6,}[0-9]$", 0.8),
}
#: Kinds for which a column's values have a shape to agree with.
SHAPED = ("email", "url", "ip", "phone")
NUMERIC_KINDS = ("money", "percentage", "rating")
LISTED_KINDS = ("status", "enum", "country", "currency")
#: A list of values has so many distinct ones at most, each ten times on average; so many values are enough to overrule a name.
LISTED, EACH, ENOUGH = 25, 10, 20


@dataclass(frozen=True)
class Facts:
    """What all values of a column show: rows, non-empty values, distinct ones up to a bound, and the share of each shape."""

    rows: int
    n: int
    distinct: int
    shares: dict[str, float]


@dataclass(frozen=True)
class Detection:
    table: str
    column: str
    kind: str
    confidence: str
    reason: str


def facts(df: DataFrame, columns: list[str] | None = None) -> dict[str, Facts]:
    """Facts of each column from one aggregate over all rows, and a second one for the exact numbers of distinct values where these are few."""
    kinds = {f.name: f.dataType for f in df.schema if columns is None or f.name in columns}
    plain = {c: t for c, t in kinds.items() if not isinstance(t, ArrayType)}
    out = [F.count("*").alias("rows")]
    for i, (c, t) in enumerate(kinds.items()):
        value = F.col(f"`{c}`")
        text = isinstance(t, StringType)
        out.append(F.count_if((F.length(value) > 0) if text else value.isNotNull()).alias(f"n{i}"))
        if c in plain:
            out.append(F.approx_count_distinct(value).alias(f"d{i}"))
        if text:
            out += [F.count_if(value.rlike(shape)).alias(f"{name}{i}") for name, (shape, _) in SHAPES.items()]
    row = df.agg(*out).first()
    few = [(i, c) for i, c in enumerate(kinds) if c in plain and row[f"d{i}"] <= 4 * LISTED]
    # The sets hold few values each, by the first aggregate.
    exact = df.agg(*(F.size(F.collect_set(F.col(f"`{c}`"))).alias(f"d{i}") for i, c in few)).first() if few else {}
    counted = {i: exact[f"d{i}"] for i, _ in few}
    return {
        c: Facts(row["rows"], row[f"n{i}"], counted.get(i, 4 * LISTED + 1), {s: row[f"{s}{i}"] / row[f"n{i}"] for s in SHAPES} if isinstance(t, StringType) and row[f"n{i}"] else {})
        for i, (c, t) in enumerate(kinds.items())
    }


def named(column: str, table_name: str) -> NameRule | None:
    """The first rule that a name fits."""
    low = column.lower()
    for rule in NAME_RULES:
        if low in rule.names or any(p in low for p in rule.parts):
            return rule
        if rule.kind == "full_name" and low == "name" and table_name.lower() in PERSON_LIKE:
            return rule
    return None


def by_type(kind: DataType) -> tuple[str, str, str]:
    """Kind, confidence and reason from a type alone."""
    if isinstance(kind, BooleanType):
        return "boolean", "high", "Boolean data type"
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return "timestamp", "high", "Timestamp data type"
    if isinstance(kind, IntegralType):
        return "integer", "medium", "Integer data type"
    if isinstance(kind, NumericType):
        return "float", "medium", "Float data type"
    if isinstance(kind, ArrayType):
        return "vector" if isinstance(kind.elementType, NumericType) else "list", "medium", "Array data type"
    return "text", "low", "Text column"


def weigh(column: str, kind: DataType, table_name: str, seen: Facts, key: bool = False, parent: tuple[str, str] | None = None) -> Detection:
    """One column's detection. Keys and references come first, then names with their values, then values, then the type."""
    make = lambda *found: Detection(table_name, column, *found)
    best, share = max(seen.shares.items(), key=lambda x: x[1]) if seen.shares else ("", 0.0)
    if parent:
        return make("foreign_key", "high", f"FK to {parent[0]}.{parent[1]}")
    if key:
        return make("uuid" if best == "uuid" and share >= SHAPES["uuid"][1] else "key", "high", "Primary key")
    listed = 0 < seen.distinct <= LISTED and seen.n >= EACH * seen.distinct
    rule = named(column, table_name)
    if rule and rule.kind in NUMERIC_KINDS and not isinstance(kind, NumericType) and (not seen.n or seen.shares.get("number", 0) < 0.5):
        rule = None  # amounts that aren't numbers
    if rule and rule.kind in LISTED_KINDS:
        if listed:
            return make(rule.kind, "high", f"{rule.reason}; {seen.distinct} distinct values")
        if seen.n >= ENOUGH and seen.distinct > LISTED and rule.confidence != "high":
            rule = None  # a list of values would have few
    if rule and rule.kind in SHAPED and seen.n >= ENOUGH:
        agree = seen.shares.get(rule.kind, 0.0)
        if agree < 0.05:
            return make(best, "medium", f"{percent(share)} % of values look like {best}, against the name") if best and share >= SHAPES[best][1] else make(rule.kind, "low", f"{rule.reason}; values don't agree")
        return make(rule.kind, rule.confidence, f"{rule.reason}; {percent(agree)} % of values agree")
    if rule:
        return make(rule.kind, rule.confidence, rule.reason)
    if best and share >= SHAPES[best][1] and seen.n >= ENOUGH:
        return make(best, "high" if share == 1 else "medium", f"{percent(share)} % of values look like {best}")
    if isinstance(kind, StringType) and listed:
        return make("enum", "medium", f"{seen.distinct} distinct values")
    if isinstance(kind, IntegralType) and listed and seen.distinct <= 2:
        return make("flag", "medium", f"{seen.distinct} distinct values")
    return make(*by_type(kind))


def percent(share: float) -> int:
    return int(100 * share + 0.5)


def detect(tables: dict[str, DataFrame], known: dict[str, dict[str, Facts]] | None = None) -> list[Detection]:
    """A detection for each column of each table; facts that are known already aren't counted again."""
    out = []
    for name, df in tables.items():
        seen = known[name] if known else facts(df)
        parents = {c: (p, k) for child, c, p, k in star.FOREIGN_KEYS if child == name}
        out += [weigh(f.name, f.dataType, name, seen[f.name], f.name == star.PRIMARY_KEYS.get(name), parents.get(f.name)) for f in df.schema]
    return out


def _sql(t: str, c: str, type_: str) -> str:
    """One column's detection in SQL: a cascade of cases over the same facts, counted by the database."""
    low = c.lower()
    parent = next(((p, k) for child, col, p, k in star.FOREIGN_KEYS if child == t and col == c), None)
    text, number = type_ == "VARCHAR", type_ in ("BIGINT", "INTEGER", "DOUBLE", "FLOAT")
    quoted = f'"{c}"'
    shapes = ", ".join(f"count(*) FILTER (WHERE regexp_matches({quoted}, '{s}'))::DOUBLE / nullif(count(*) FILTER (WHERE length({quoted}) > 0), 0) AS {k}" for k, (s, _) in SHAPES.items()) if text else ", ".join(f"0::DOUBLE AS {k}" for k in SHAPES)
    n = f"count(*) FILTER (WHERE length({quoted}) > 0)" if text else f"count({quoted})"
    distinct = "NULL" if type_.endswith("]") else f"count(DISTINCT {quoted})"
    counted = f"SELECT {n} AS n, {distinct} AS d, {shapes} FROM {t}"
    top = "greatest(" + ", ".join(SHAPES) + ")"
    best = "CASE " + " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in SHAPES) + " END"
    limit = "CASE " + " ".join(f"WHEN {k} = {top} THEN {v}" for k, (_, v) in SHAPES.items()) + " END"
    listed = f"(d BETWEEN 1 AND {LISTED} AND n >= {EACH} * d)"
    pct = lambda x: f"floor(100 * {x} + 0.5)::INT"
    cases: list[tuple[str, str, str, str]] = []
    if parent:
        cases.append(("TRUE", "'foreign_key'", "'high'", f"'FK to {parent[0]}.{parent[1]}'"))
    if star.PRIMARY_KEYS.get(t) == c:
        cases.append(("TRUE", f"CASE WHEN uuid = {top} AND uuid >= 0.95 THEN 'uuid' ELSE 'key' END", "'high'", "'Primary key'"))
    for rule in NAME_RULES:
        fits = low in rule.names or any(p in low for p in rule.parts) or (rule.kind == "full_name" and low == "name" and t in PERSON_LIKE)
        if not fits:
            continue
        kind, sure, why = f"'{rule.kind}'", f"'{rule.confidence}'", f"'{rule.reason}'"
        if rule.kind in NUMERIC_KINDS and not number:
            cases.append(("n > 0 AND number >= 0.5", kind, sure, why))
        elif rule.kind in LISTED_KINDS:
            cases.append((listed, kind, "'high'", f"{why} || '; ' || d || ' distinct values'"))
            cases.append(("TRUE" if rule.confidence == "high" else f"NOT (n >= {ENOUGH} AND (d IS NULL OR d > {LISTED}))", kind, sure, why))
        elif rule.kind in SHAPED:
            cases.append((f"n >= {ENOUGH} AND {rule.kind} < 0.05 AND {top} >= {limit}", best, "'medium'", f"{pct(top)} || ' % of values look like ' || {best} || ', against the name'"))
            cases.append((f"n >= {ENOUGH} AND {rule.kind} < 0.05", kind, "'low'", f"{why} || '; values don''t agree'"))
            cases.append((f"n >= {ENOUGH}", kind, sure, f"{why} || '; ' || {pct(rule.kind)} || ' % of values agree'"))
            cases.append(("TRUE", kind, sure, why))
        else:
            cases.append(("TRUE", kind, sure, why))
        break
    if text:
        cases.append((f"n >= {ENOUGH} AND {top} >= {limit}", best, f"CASE WHEN {top} = 1 THEN 'high' ELSE 'medium' END", f"{pct(top)} || ' % of values look like ' || {best}"))
        cases.append((listed, "'enum'", "'medium'", "d || ' distinct values'"))
    if type_ in ("BIGINT", "INTEGER"):
        cases.append((f"{listed} AND d <= 2", "'flag'", "'medium'", "d || ' distinct values'"))
    last = {"VARCHAR": ("text", "low", "Text column"), "BIGINT": ("integer", "medium", "Integer data type"), "INTEGER": ("integer", "medium", "Integer data type"), "TIMESTAMP": ("timestamp", "high", "Timestamp data type")}
    last |= {"DOUBLE": ("float", "medium", "Float data type"), "FLOAT[]": ("vector", "medium", "Array data type")}
    cases.append(("TRUE", *(f"'{x}'" for x in last[type_])))
    pick = lambda i: "CASE " + " ".join(f"WHEN {case[0]} THEN {case[i]}" for case in cases) + " END"
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {pick(1)} AS kind, {pick(2)} AS confidence, {pick(3)} AS reason FROM ({counted}) f"


#: The given tables' columns and what DuckDB calls their types.
GIVEN = {
    "region": {"r_regionkey": "INTEGER", "r_name": "VARCHAR"},
    "nation": {"n_nationkey": "INTEGER", "n_name": "VARCHAR", "n_regionkey": "INTEGER"},
    "customer": {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INTEGER", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR"},
    "supplier": {"s_suppkey": "BIGINT", "s_name": "VARCHAR", "s_nationkey": "INTEGER", "s_acctbal": "DOUBLE"},
    "part": {"p_partkey": "BIGINT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR", "p_size": "INTEGER", "p_retailprice": "DOUBLE"},
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"},
    "lineitem": {
        "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INTEGER", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE",
        "l_returnflag": "VARCHAR", "l_linestatus": "VARCHAR", "l_shipdate": "TIMESTAMP",
    },
    "events": {"event_id": "BIGINT", "ts": "TIMESTAMP", "user_id": "BIGINT", "event_type": "VARCHAR", "value": "DOUBLE", "props": "VARCHAR"},
    "documents": {"doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR", "n_chars": "BIGINT"},
    "embeddings": {"vec_id": "BIGINT", "embedding": "FLOAT[]", "label": "INTEGER"},
    "pages": {"page_id": "BIGINT", "url": "VARCHAR", "html": "VARCHAR"},
    "benchmark": {"item_id": "BIGINT", "text": "VARCHAR"},
    "labels": {"doc_id": "BIGINT", "quality": "INTEGER", "toxic": "INTEGER"},
    "conversations": {"conv_id": "BIGINT", "turn": "BIGINT", "role": "VARCHAR", "text": "VARCHAR"},
}


@query("column_kinds", " UNION ALL ".join(_sql(t, c, k) for t, columns in GIVEN.items() for c, k in columns.items()))
def column_kinds(spark, sf_dir):
    """Kind, confidence and reason of every column of all given tables."""
    found = detect({t: table(spark, sf_dir, t) for t in TABLES})
    return spark.createDataFrame([(d.table, d.column, d.kind, d.confidence, d.reason) for d in found], "table string, column string, kind string, confidence string, reason string")
