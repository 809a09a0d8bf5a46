"""Constraints on times: found in schemas, ordered, circles left out, and rows settled by them."""

import datetime as dt

from pyspark.sql import types as T

from datumloom.operators import constraints as ct

TIME, LONG, DATE = T.TimestampNTZType(), T.LongType(), T.DateType()


def schema(**columns):
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


def test_constraints_of_a_schema():
    schemas = {
        "users": schema(id=LONG, signup_at=TIME, updated_at=TIME),
        "orders": schema(id=LONG, user_id=LONG, Ordered_At=TIME, shipped_at=TIME, delivered_at=TIME),
        "notes": schema(id=LONG, order_id=LONG, parent_id=LONG, created_at=TIME, updated_at=TIME, deleted_at=DATE),
        "plain": schema(id=LONG, created_at=T.StringType()),
    }
    references = [("orders", "user_id", "users", "id"), ("notes", "order_id", "orders", "id"), ("notes", "parent_id", "notes", "id"), ("plain", "id", "users", "id")]
    found = ct.resolve(schemas, references)
    assert found.creation == {"users": "signup_at", "orders": "Ordered_At", "notes": "created_at"} and found.circular == []
    assert {(c.table, c.column, c.after_table, c.after_column, c.within_days) for c in found.constraints} == {
        ("orders", "Ordered_At", "users", "signup_at", 365),
        ("orders", "shipped_at", None, "Ordered_At", 90),
        ("orders", "delivered_at", None, "shipped_at", 90),
        ("notes", "created_at", "orders", "Ordered_At", 365),
        ("notes", "updated_at", None, "created_at", 90),
        ("notes", "deleted_at", None, "updated_at", 90),
    }
    place = {n: i for i, n in enumerate(found.order)}
    assert place["users", "signup_at"] < place["orders", "Ordered_At"] < place["orders", "shipped_at"] < place["orders", "delivered_at"]


def test_circles_are_left_out_and_reported():
    schemas = {t: schema(id=LONG, other=LONG, created_at=TIME) for t in "abc"}
    found = ct.resolve(schemas, [("a", "other", "b", "id"), ("b", "other", "c", "id"), ("c", "other", "a", "id")])
    assert len(found.constraints) == 2 and [(c.table, c.after_table) for c in found.circular] == [("c", "a")]


def test_settled_rows_break_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    at = lambda n: None if n is None else day + dt.timedelta(days=n)
    users = spark.createDataFrame([(1, at(0)), (2, at(50)), (3, None)], schema(id=LONG, created_at=TIME))
    rows = [(i, 1 + i % 4, at([None, -9, 3, 500, 51][i % 5]), at([None, 1, 60, 700][i % 4]), None if i % 3 == 0 else (at(i % 90)).date()) for i in range(200)]
    orders = spark.createDataFrame(rows, schema(id=LONG, user_id=LONG, created_at=TIME, updated_at=TIME, deleted_at=DATE))
    tables = {"users": users, "orders": orders}
    found = ct.resolve({t: d.schema for t, d in tables.items()}, [("orders", "user_id", "users", "id")])
    assert sum(r.n_broken for r in ct.broken(tables, found).collect()) > 0
    settled = ct.settle(tables, found, {"orders": ("id",)})
    assert all(r.n_broken == 0 for r in ct.broken(settled, found).collect())
    assert settled["orders"].schema == orders.schema and settled["orders"].count() == 200
    again = ct.settle(settled, found, {"orders": ("id",)})
    assert settled["orders"].exceptAll(again["orders"]).count() == 0
    changed = orders.alias("a").join(settled["orders"].alias("b"), "id")
    assert changed.where("(a.created_at is null) <> (b.created_at is null) or (a.updated_at is null) <> (b.updated_at is null) or (a.deleted_at is null) <> (b.deleted_at is null)").count() == 0
    # Without a parent nothing binds the creation.
    assert changed.where("a.user_id > 3 and not (a.created_at <=> b.created_at)").count() == 0
