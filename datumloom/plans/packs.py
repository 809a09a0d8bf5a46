"""From a schema to a generator's plan: strategies for columns, rules on states and times, templates, and what a person should review.

All of this is metadata and lives on the driver; rows come in where facts about values refine it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from datumloom.operators import detect
from datumloom.plans import schema, temporal_rules

#: The generator's strategy for each kind of column.
STRATEGY_OF = {
    "key": "sequential",
    "uuid": "uuid",
    "foreign_key": "foreign_key",
    "email": "email",
    "first_name": "name_first",
    "last_name": "name_last",
    "full_name": "full_name",
    "phone": "phone",
    "address": "address",
    "company_name": "company_name",
    "username": "random_string",
    "slug": "random_string",
    "url": "text",
    "ip": "text",
    "json": "text",
    "date": "past_date",
    "timestamp": "timestamp",
    "country": "enum",
    "currency": "enum",
    "status": "enum",
    "enum": "enum",
    "flag": "boolean",
    "boolean": "boolean",
    "money": "money",
    "percentage": "float",
    "rating": "float",
    "number": "float",
    "integer": "integer",
    "float": "float",
    "vector": "text",
    "list": "text",
    "text": "text",
}
# Lists of values that names suggest, with weights.
SUGGESTED = {
    "status": {"active": 70, "inactive": 20, "suspended": 10},
    "priority": {"low": 30, "medium": 40, "high": 20, "critical": 10},
    "severity": {"low": 40, "medium": 30, "high": 20, "critical": 10},
    "gender": {"male": 45, "female": 45, "non_binary": 5, "prefer_not_to_say": 5},
    "role": {"admin": 5, "user": 70, "editor": 15, "viewer": 10},
    "tier": {"basic": 50, "standard": 35, "premium": 15},
    "channel": {"web": 40, "mobile": 35, "api": 15, "other": 10},
    "region": {"north": 25, "south": 25, "east": 25, "west": 25},
    "currency": {"USD": 50, "EUR": 25, "GBP": 15, "JPY": 10},
    "payment_method": {"credit_card": 40, "debit_card": 25, "bank_transfer": 20, "paypal": 15},
}
# Columns that are null while a row's status has this value.
OPEN_WHILE = {
    "closed_at": "active", "cancelled_at": "active", "deleted_at": "active", "archived_at": "active", "resolved_at": "open",
    "completed_at": "pending", "defaulted_at": "current", "suspended_at": "active", "deactivated_at": "active", "terminated_at": "active",
}
# Columns that follow created_at, by so many days at least and at most; and the same for start_date and end_date.
DAYS_AFTER_CREATION = {
    "updated_at": (0, 30), "modified_at": (0, 30), "settled_at": (1, 30), "processed_at": (0, 7), "approved_at": (0, 14), "completed_at": (1, 60), "resolved_at": (1, 90), "closed_at": (1, 180),
    "cancelled_at": (0, 30), "deleted_at": (1, 365), "shipped_at": (1, 7), "delivered_at": (2, 14), "paid_at": (0, 30), "expired_at": (30, 365), "verified_at": (0, 7),
}
START_NAMES, END_NAMES, DAYS_AFTER_START = ("start_date", "effective_from"), ("end_date", "effective_to"), (7, 365)
#: A reference to a table gives this share of the base row count for each table on the longest way to a root, and three times as much.
CHILD_RATIO = 3.0


def plain(name: str) -> str:
    """A name in lower case with single underscores, so that createdAt and created_at are one."""
    return re.sub(r"[\s_-]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower()


@dataclass(frozen=True)
class Review:
    """Something inferred that a person should look at; tier 2 is worth a look, tier 3 needs a decision."""

    tier: int
    table: str
    column: str | None
    said: str


@dataclass
class Inferred:
    """A pack of tables in the generator's form, and the manifest of what to review."""

    pack: dict
    order: list[str]
    reviews: list[Review] = field(default_factory=list)


def infer(tables: list[schema.Table], facts: dict[str, dict[str, detect.Facts]] | None = None, values: dict[tuple[str, str], dict[str, float]] | None = None) -> Inferred:
    """A pack for parsed tables: each column's strategy and options, status rules, time pairs, and row ratios by depth.

    ``facts`` and ``values`` are what the tables' rows show, where there are any: facts
    decide as in ``detect``, and values with weights replace suggested lists.
    """
    order, cycle = schema.order(tables)
    by_name = {t.name: t for t in tables}
    depth: dict[str, int] = {}
    for name in order:
        parents = [c.references[0] for c in by_name[name].columns if c.references and c.references[0] in depth]
        depth[name] = 1 + max((depth[p] for p in parents), default=-1)
    out = Inferred({"tables": {}}, order)
    for name in cycle:
        out.reviews.append(Review(3, name, None, "references run in a circle"))
    for t in tables:
        if not any(c.primary for c in t.columns):
            out.reviews.append(Review(2, t.name, None, "no primary key"))
        columns = {c.name: _column(t, c, by_name, out.reviews, (facts or {}).get(t.name, {}).get(c.name), (values or {}).get((t.name, c.name))) for c in t.columns}
        _times(t, columns)
        _states(t, columns, out.reviews)
        out.pack["tables"][t.name] = {"columns": columns, "rowMultiplier": CHILD_RATIO ** depth[t.name]}
    return out


def _column(t: schema.Table, c: schema.Column, tables: dict[str, schema.Table], reviews: list[Review], seen: detect.Facts | None, values: dict[str, float] | None) -> dict:
    parent = c.references
    if parent and parent[0] not in tables:
        reviews.append(Review(3, t.name, c.name, f"no table {parent[0]}"))
        parent = None
    found = detect.weigh(c.name, c.type, t.name, seen or detect.Facts(0, 0, 0, {}), c.primary, parent)
    kind = "uuid" if found.kind == "key" and isinstance(c.type, T.StringType) else found.kind
    strategy, options = STRATEGY_OF[kind], {}
    if parent:
        return {"strategy": "uuid" if isinstance(c.type, T.StringType) else "integer", "foreignKey": {"table": parent[0], "column": parent[1]}}
    allowed = values or dict.fromkeys(c.values, 1.0)
    if allowed and not c.primary:
        strategy = "enum"
    if strategy == "enum":
        suggested = allowed or SUGGESTED.get(plain(c.name)) or next((v for k, v in SUGGESTED.items() if plain(c.name).endswith(f"_{k}")), None)
        if not suggested:
            reviews.append(Review(3, t.name, c.name, "a list of values, but which is not known"))
            suggested = {"option_a": 1.0}
        elif not allowed:
            reviews.append(Review(2, t.name, c.name, "values are suggested by the name"))
        options = {"values": list(suggested), "weights": list(suggested.values())}
    elif strategy == "float" and isinstance(c.type, T.IntegralType):
        strategy = "integer"
    if strategy in ("integer", "float") and kind == "percentage":
        options = {"min": 0, "max": 100}
    if kind == "rating":
        options = {"min": 1 if strategy == "integer" else 0, "max": 5}
    if kind == "money":
        options = {"min": 100, "max": 100_000}
    if isinstance(c.type, T.DecimalType) and strategy == "float":
        options = {"min": 0, "max": 10 ** (c.type.precision - c.type.scale) - 10**-c.type.scale}
    if found.confidence == "low" and strategy != "enum":
        reviews.append(Review(2, t.name, c.name, f"{found.reason}: {strategy} is a guess"))
    return {"strategy": strategy, **({"options": options} if options else {})}


def _times(t: schema.Table, columns: dict[str, dict]) -> None:
    """Columns that follow others in time, unless they follow a reference or are no times."""
    timed = {plain(c.name): c.name for c in t.columns if isinstance(c.type, T.DateType | T.TimestampType | T.TimestampNTZType)}
    pairs = [(timed["created_at"], timed[n], days) for n, days in DAYS_AFTER_CREATION.items() if "created_at" in timed and n in timed]
    start, end = (next((timed[n] for n in names if n in timed), None) for names in (START_NAMES, END_NAMES))
    if start and end:
        pairs.append((start, end, DAYS_AFTER_START))
    known = {later for _, later, _ in pairs}
    pairs += [(a, b, (0, 90)) for a, b in temporal_rules.pairs_of(list(timed.values())) if b not in known]
    for earlier, later, (least, most) in pairs:
        columns[later] = {"strategy": columns[later]["strategy"], "options": {"dependsOn": earlier, "dependencyRule": "after", "minDays": least, "maxDays": most}}


def _states(t: schema.Table, columns: dict[str, dict], reviews: list[Review]) -> None:
    """Columns that are null for some value of a status column, by the fixed rules and by names."""
    names = {plain(c.name): c for c in t.columns}
    rules: dict[str, dict[str, list[str]]] = {}
    for status, value, other, null in temporal_rules.statuses_of([c.name for c in t.columns]):
        if null:
            rules.setdefault(status, {}).setdefault(value, []).append(other)
    if "status" in names:
        for other, value in OPEN_WHILE.items():
            if other in names and names[other].nullable:
                fields = rules.setdefault(names["status"].name, {}).setdefault(value, [])
                if names[other].name not in fields:
                    fields.append(names[other].name)
    for status, by_value in rules.items():
        options = columns[status].get("options", {})
        known = options.get("values", [])
        kept = [{"value": v, "nullFields": f} for v, f in by_value.items() if v in known]
        unknown = sorted(v for v in by_value if v not in known)
        if unknown:
            reviews.append(Review(2, t.name, status, f"rules for {', '.join(unknown)}, which aren't among its values"))
        if kept:
            columns[status] = {**columns[status], "options": {**options, "lifecycleRules": kept}}


@dataclass(frozen=True)
class Override:
    """A strategy for the columns whose names fit one of these patterns (``*`` stands for anything)."""

    columns: tuple[str, ...]
    strategy: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TableTemplate:
    """Overrides for the tables whose names fit, and how many rows they have for each of the base count."""

    tables: tuple[str, ...]
    overrides: tuple[Override, ...] = ()
    rows: float = 1.0


@dataclass(frozen=True)
class Template:
    """A domain's tables. Only ``targets``, if there are any, are made; others are left out even where a pattern fits."""

    name: str
    tables: tuple[TableTemplate, ...]
    targets: frozenset[str] = frozenset()

    def table(self, name: str) -> TableTemplate | None:
        """The first that names the table itself, or else the first with a pattern that fits it."""
        exact = (t for t in self.tables if any(p.lower() == name.lower() for p in t.tables))
        return next(exact, next((t for t in self.tables if fits(t.tables, name)), None))

    def override(self, table_name: str, column: str) -> Override | None:
        found = self.table(table_name)
        return next((o for o in found.overrides if fits(o.columns, column)), None) if found else None


def fits(patterns: tuple[str, ...], name: str) -> bool:
    """Whether a name is one of these, or fits one with ``*``; case doesn't count."""
    return any(re.fullmatch(".*".join(map(re.escape, p.lower().split("*"))), name.lower(), re.S) for p in patterns)


@dataclass(frozen=True)
class ColumnPlan:
    column: str
    strategy: str
    #: Where the strategy is from: reference, template or inferred.
    source: str
    options: dict
    follows: str | None = None
    follows_days: tuple[int, int] | None = None


@dataclass(frozen=True)
class TablePlan:
    table: str
    rows: int
    enabled: bool
    depends: tuple[str, ...]
    columns: tuple[ColumnPlan, ...]


def plan(tables: list[schema.Table], template: Template | None = None, base_rows: int | dict[str, int] = 1000, facts: dict | None = None, values: dict | None = None) -> list[TablePlan]:
    """What to generate, parents first. A reference decides first, then the template, then inference.

    ``base_rows`` may differ by table, as where they are real counts. A template's list of
    values with the single value "default" is a placeholder and doesn't count; one for a
    column that allows other values alone is cut to those. A reference to a table that
    isn't among the template's targets is none.
    """
    inferred = infer(tables, facts, values)
    by_name = {t.name: t for t in tables}
    out = []
    for name in inferred.order:
        t, made = by_name[name], inferred.pack["tables"][name]["columns"]
        matched = template.table(name) if template else None
        targets = template.targets if template else frozenset()
        enabled = template is None or (matched is not None and (not targets or name in targets))
        count = base_rows[name] if isinstance(base_rows, dict) else base_rows
        columns = []
        for c in t.columns:
            if c.references and (not targets or c.references[0] in targets):
                columns.append(ColumnPlan(c.name, "foreign_key", "reference", {"table": c.references[0], "column": c.references[1]}))
                continue
            override = template.override(name, c.name) if template else None
            if override and override.strategy == "enum" and list(override.options.get("values", [])) == ["default"]:
                override = None
            if override:
                strategy, options, source = override.strategy, dict(override.options), "template"
            else:
                strategy, options, source = made[c.name]["strategy"], dict(made[c.name].get("options", {})), "inferred"
            if strategy == "enum" and c.values:
                options = allowed_only(options, c.values)
            if strategy == "float" and isinstance(c.type, T.IntegralType):
                strategy = "integer"
            follows = options.get("dependsOn")
            days = (options.get("minDays", 0), options.get("maxDays", 90)) if follows else None
            columns.append(ColumnPlan(c.name, strategy, source, options, follows, days))
        depends = tuple(dict.fromkeys(c.options["table"] for c in columns if c.source == "reference" and c.options["table"] != name))
        rows = max(1, int(count * (matched.rows if matched else 1.0) + 0.5))
        out.append(TablePlan(name, rows, enabled, depends, tuple(columns)))
    return out


def allowed_only(options: dict, values: tuple[str, ...]) -> dict:
    """A list of values cut to those that a column allows, with weights that add up to 1; if none is left, all that it allows."""
    given = list(options.get("values", []))
    weights = dict(zip(given, options.get("weights") or [1.0] * len(given)))
    kept = [v for v in given if v in values]
    if not kept:
        return {**{k: v for k, v in options.items() if k != "weights"}, "values": list(values)}
    total = sum(weights[v] for v in kept)
    return {**options, "values": kept, "weights": [weights[v] / total for v in kept]}


def pack_of(plans: list[TablePlan]) -> dict:
    """The plan as a pack for the generator: the tables that are made, with their columns."""
    tables = {}
    for p in plans:
        if p.enabled:
            columns = {}
            for c in p.columns:
                columns[c.column] = {"strategy": "uuid", "foreignKey": c.options} if c.source == "reference" else {"strategy": c.strategy, **({"options": c.options} if c.options else {})}
            tables[p.table] = {"columns": columns}
    return {"tables": tables}
