"""Packs inferred from DDL, templates with precedence, plans that a generator runs."""

import pytest

from datumloom.operators import pack as generators
from datumloom.operators import planning
from datumloom.plans import packs, schema

DDL = """
CREATE TYPE mood AS ENUM ('calm', 'it''s loud');
CREATE TABLE users (
  id UUID PRIMARY KEY,
  email VARCHAR(80) NOT NULL,
  full_name TEXT,
  status VARCHAR(20) CHECK (status IN ('active', 'closed')),
  mood mood,
  rating SMALLINT,
  tax_rate NUMERIC(5,2),
  misc JSONB,
  created_at TIMESTAMP NOT NULL,
  updated_at TIMESTAMP,
  closed_at TIMESTAMP
);
CREATE TABLE orders (
  id BIGINT PRIMARY KEY,
  user_id UUID REFERENCES users(id),
  vendor_id UUID REFERENCES vendors(id),
  order_status TEXT,
  kind TEXT,
  total_price INTEGER,
  start_date DATE,
  end_date DATE,
  order_date DATE, ship_date DATE,
  completion_date DATE,
  CONSTRAINT k CHECK (order_status IN ('open', 'cancelled')),
  CHECK (total_price > 0)
);
CREATE TABLE lines (order_id BIGINT REFERENCES orders(id), parent_id BIGINT, note TEXT);
CREATE TABLE loop_a (id INT PRIMARY KEY, b INT REFERENCES loop_b(id));
CREATE TABLE loop_b (id INT PRIMARY KEY, a INT REFERENCES loop_a(id));
"""


@pytest.fixture(scope="module")
def inferred():
    return packs.infer(schema.tables_of(DDL))


def columns(inferred, t):
    return inferred.pack["tables"][t]["columns"]


def test_values_of_checks_and_types():
    users, orders = schema.tables_of(DDL)[:2]
    found = {c.name: c.values for c in users.columns + orders.columns if c.values}
    assert found == {"status": ("active", "closed"), "mood": ("calm", "it's loud"), "order_status": ("open", "cancelled")}


def test_strategies(inferred):
    users, orders = columns(inferred, "users"), columns(inferred, "orders")
    assert {c: d["strategy"] for c, d in users.items()} == {
        "id": "uuid", "email": "email", "full_name": "full_name", "status": "enum", "mood": "enum", "rating": "integer", "tax_rate": "float", "misc": "text", "created_at": "timestamp", "updated_at": "timestamp", "closed_at": "timestamp",
    }
    assert users["mood"]["options"]["values"] == ["calm", "it's loud"] and users["rating"]["options"] == {"min": 1, "max": 5} and users["tax_rate"]["options"]["max"] == pytest.approx(999.99)
    assert orders["user_id"] == {"strategy": "uuid", "foreignKey": {"table": "users", "column": "id"}} and "foreignKey" not in orders["vendor_id"]
    assert orders["total_price"]["strategy"] == "money" and orders["id"]["strategy"] == "sequential"


def test_states_and_times(inferred):
    users, orders = columns(inferred, "users"), columns(inferred, "orders")
    assert users["status"]["options"]["lifecycleRules"] == [{"value": "active", "nullFields": ["closed_at"]}]
    assert orders["order_status"]["options"]["lifecycleRules"] == [{"value": "cancelled", "nullFields": ["completion_date"]}]
    after = lambda d: (d["options"]["dependsOn"], d["options"]["minDays"], d["options"]["maxDays"])
    assert after(users["updated_at"]) == ("created_at", 0, 30) and after(users["closed_at"]) == ("created_at", 1, 180)
    assert after(orders["end_date"]) == ("start_date", 7, 365) and after(orders["ship_date"]) == ("order_date", 0, 90)


def test_order_ratios_and_reviews(inferred):
    assert inferred.order == ["lines", "orders", "users"][::-1] + ["loop_a", "loop_b"]
    assert {t: d["rowMultiplier"] for t, d in inferred.pack["tables"].items()} == {"users": 1, "orders": 3, "lines": 9, "loop_a": 1, "loop_b": 3}
    said = {(r.tier, r.table, r.column) for r in inferred.reviews}
    assert {(3, "orders", "vendor_id"), (2, "lines", None), (3, "loop_a", None), (3, "loop_b", None), (3, "orders", "kind"), (2, "lines", "note"), (2, "users", "misc")} <= said
    assert not any(r.column in ("email", "status", "mood", "user_id") for r in inferred.reviews if r.tier == 3)


def test_names_in_either_style():
    assert [packs.plain(n) for n in ("createdAt", "Created At", "created_at", "HTTPStatus")] == ["created_at", "created_at", "created_at", "httpstatus"]
    made = packs.infer(schema.tables_of("CREATE TABLE t (id INT PRIMARY KEY, createdAt TIMESTAMP, shippedAt TIMESTAMP);")).pack["tables"]["t"]["columns"]
    assert made["shippedAt"]["options"]["dependsOn"] == "createdAt"


def test_patterns():
    assert packs.fits(("*_name",), "Full_Name") and packs.fits(("a.c",), "A.C") and not packs.fits(("a.c",), "abc") and not packs.fits((), "x")
    assert packs.fits(("*pay*",), "claim_payments") and not packs.fits(("pay*",), "claim_payments") and packs.fits(("what?*",), "what?now")


def test_a_template_overrides_and_references_win():
    template = packs.Template(
        "t",
        (
            packs.TableTemplate(("*",), (packs.Override(("*",), "text"),), rows=9),
            packs.TableTemplate(("users",), (packs.Override(("user_*", "full_*"), "name_first"), packs.Override(("status",), "enum", {"values": ["closed", "gone"], "weights": [3, 1]}), packs.Override(("mood",), "enum", {"values": ["default"]}), packs.Override(("rating",), "float", {"max": 9})), rows=0.25),
        ),
        frozenset({"users", "lines"}),
    )
    plans = {p.table: p for p in packs.plan(schema.tables_of(DDL), template, 10)}
    assert {t: (p.rows, p.enabled) for t, p in plans.items()} == {"users": (3, True), "orders": (90, False), "lines": (90, True), "loop_a": (90, False), "loop_b": (90, False)}
    users = {c.column: c for c in plans["users"].columns}
    assert (users["full_name"].strategy, users["full_name"].source) == ("name_first", "template")
    assert users["status"].options["values"] == ["closed"] and users["status"].options["weights"] == [1.0]
    assert (users["mood"].source, users["mood"].options["values"]) == ("inferred", ["calm", "it's loud"])
    assert users["rating"].strategy == "integer" and users["email"].source == "inferred"
    assert users["closed_at"].follows == "created_at" and users["closed_at"].follows_days == (1, 180)
    orders, lines = ({c.column: c for c in plans[t].columns} for t in ("orders", "lines"))
    assert orders["user_id"].source == "reference" and lines["order_id"].source == "template" and plans["orders"].depends == ("users",) and plans["lines"].depends == ()
    assert packs.allowed_only({"values": ["x"]}, ("a", "b")) == {"values": ["a", "b"]}


def test_a_plan_runs_and_runs_alike(spark):
    tables = [t for t in schema.tables_of(DDL) if not t.name.startswith("loop")]
    made = packs.pack_of(packs.plan(tables))
    one, two = (generators.generator(made, 300, 7).all(spark) for _ in range(2))
    assert set(one) == {"users", "orders", "lines"}
    for t in one:
        assert one[t].exceptAll(two[t]).count() == 0 and one[t].columns == [c.name for c in next(x for x in tables if x.name == t).columns]
    assert one["orders"].join(one["users"], one["orders"].user_id == one["users"].id, "left_anti").count() == 0
    rows = one["users"].collect()
    assert {r.status for r in rows} == {"active", "closed"} and all(r.closed_at is None for r in rows if r.status == "active")


def test_rows_replace_suggestions(spark):
    rows = spark.createDataFrame([(i, ["admin", "guest"][i % 3 == 0], "x" * i) for i in range(90)], "id long, role string, text string")
    tables = {"people": rows}
    facts, values = planning.observed(tables)
    made = packs.infer(planning.schemas_of(tables), facts, values).pack["tables"]["people"]["columns"]
    assert made["role"]["options"]["values"] == ["admin", "guest"] and made["role"]["options"]["weights"] == pytest.approx([2 / 3, 1 / 3])
    assert planning.weighed_values(rows, []) == {}
