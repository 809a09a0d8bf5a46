"""Masking of several tables: permuted keys, equal values, values that overrule names, counted cells."""

from pyspark.sql import functions as F

from datumloom.operators import mask_tables as mt
from datumloom.operators import privacy


def test_permutations_have_no_collisions(spark):
    edges = [0, 1, -1, 2**31 - 1, -(2**31), 2**30, -(2**30)]
    small = spark.range(-20_000, 20_000).select(F.col("id").cast("int").alias("v")).union(spark.createDataFrame([(e,) for e in edges if abs(e) > 20_000], "v int"))
    rows = small.select("v", mt.permuted(F.col("v"), 32, 5).alias("p"))
    assert rows.where("p < -2147483648 or p > 2147483647").count() == 0
    assert rows.select("p").distinct().count() == rows.count() == 40_004
    assert rows.where("v = p").count() < 10
    longs = spark.createDataFrame([(e,) for e in [*edges, 2**62, -(2**62), 2**63 - 1, -(2**63)]], "v long")
    assert longs.select(mt.permuted(F.col("v"), 64, 5).alias("p")).distinct().count() == 11
    assert spark.createDataFrame([(None,)], "v long").select(mt.permuted(F.col("v"), 64, 5)).first()[0] is None


def test_equal_values_stay_equal_and_nulls_null(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ann Lee", "ann@x.org"), (2, "Ann Lee", None), (3, None, "bo@y.org")], "id long, full_name string, email string")
    visits = spark.createDataFrame([(7, "Ann Lee", "ann@x.org"), (8, "Cy Day", "bo@y.org")], "visit long, display_name string, contact_email string")
    tables = {"people": people, "visits": visits}
    plan = mt.decide(tables, deep=False)
    assert {(d.column, d.strategy) for d in plan if d.strategy != "preserve"} == {("full_name", "replace_name"), ("email", "replace_email"), ("display_name", "replace_name"), ("contact_email", "replace_email")}
    report = mt.mask_tables(tables, plan, str(tmp_path / "m"))
    assert {(r.table, r.column, r.rows_masked) for r in report} == {("people", "full_name", 2), ("people", "email", 2), ("visits", "display_name", 2), ("visits", "contact_email", 2)}
    a = {r.id: r for r in spark.read.parquet(str(tmp_path / "m" / "people")).collect()}
    b = {r.visit: r for r in spark.read.parquet(str(tmp_path / "m" / "visits")).collect()}
    assert a[1].full_name == a[2].full_name == b[7].display_name != "Ann Lee" and a[3].full_name is None
    assert a[1].email == b[7].contact_email and a[3].email == b[8].contact_email and a[2].email is None
    assert a[1].email.endswith("@x.org") and a[1].email != "ann@x.org"


def test_values_overrule_names(spark):
    rows = [(i, f"user{i}@mail.org" if i % 2 else "none", "12-3456", f"call 212-555-01{i:02d} please" if i % 8 == 0 else "nothing here") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, extra string, code string, memo string")
    plan = {d.column: d for d in mt.decide({"t": df})}
    assert (plan["extra"].category, plan["extra"].strategy, plan["extra"].confidence) == ("email", "replace_email", "medium")
    # An eighth of the memos is enough, since in free text half the threshold counts.
    assert plan["memo"].category == "phone" and plan["memo"].confidence == "low"
    assert plan["code"].strategy == plan["k"].strategy == "preserve"
    assert {d.category for d in mt.decide({"t": df}, deep=False)} == {"safe"}
    assert mt.scanned(df.limit(0), ["extra"]) == {} and mt.scanned(df, []) == {}


def test_text_keys_are_hashed_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(privacy.KEYS, "a", frozenset({"id"}))
    monkeypatch.setitem(privacy.KEYS, "b", frozenset({"a_id"}))
    tables = {"a": spark.createDataFrame([("x",), ("y",)], "id string"), "b": spark.createDataFrame([("y",), (None,)], "a_id string")}
    mt.mask_tables(tables, mt.decide(tables, keys=True), str(tmp_path / "m"))
    a, b = (spark.read.parquet(str(tmp_path / "m" / t)) for t in "ab")
    assert a.join(b, a.id == b.a_id).count() == 1 and not {r.id for r in a.collect()} & {"x", "y"}
