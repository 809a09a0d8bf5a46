"""Name rules by hand, and operators that take buckets or ranges, with buckets so small that there are many."""

import statistics

import pytest
from pyspark.sql import functions as F

from datumloom.functions import checks
from datumloom.operators import assess, compare, comply, privacy, profile, split
from datumloom.plans import temporal_rules
from datumloom.registry import table


@pytest.mark.parametrize(
    "column,table_name,mode,want",
    [
        ("c_name", "customer", "strict", "name"),
        ("name", "staff", "strict", "name"),
        ("name", "products", "strict", "safe"),
        ("product_name", "products", "strict", "safe"),
        ("last_name", "anything", "strict", "name"),
        ("work_email", "t", "strict", "email"),
        ("home_phone", "t", "hipaa", "phone"),
        ("diagnosis_code", "t", "hipaa", "medical"),
        ("diagnosis_code", "t", "gdpr", "safe"),
        ("salary", "t", "gdpr", "quasi"),
        ("client_ip", "t", "strict", "ip_address"),
        ("user_id", "users", "strict", "safe"),
    ],
)
def test_categories_by_name_and_table(column, table_name, mode, want):
    assert privacy.category(column, frozenset(), mode, table_name) == want


def test_keys_are_safe_and_modes_choose_strategies():
    assert privacy.category("email", frozenset(["email"])) == "safe"
    assert privacy.category("order_note", long_text=True) == "free_text" and privacy.category("order_note", mode="hipaa", long_text=True) == "safe"
    assert privacy.strategy("url", "hipaa") == "preserve" and privacy.strategy("url") == "replace_url"
    assert privacy.strategy("quasi", "gdpr") == "preserve" and privacy.strategy("quasi") == "generalize_numeric"


def test_a_table_is_masked_by_its_names(spark):
    rows = [(1, "Ann", "a@b.org", 50000.0, "1990-01-01", "keep"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, first_name string, email string, salary double, dob string, color string")
    one, two = privacy.mask_table(df, "people", "id").orderBy("id").collect()
    assert one.id == 1 and one.color == "keep" and one.first_name not in ("Ann", None) and one.email.endswith("@b.org") and one.email != "a@b.org"
    assert one.salary != 50000.0 and 45000 <= one.salary <= 55000 and one.dob == "[REDACTED]"
    assert tuple(two)[1:] == (None,) * 5


def test_personal_kinds_of_assessment_and_compliance(spark):
    assert [assess.pii_kind(c) for c in ("ssn", "email", "user_email", "mobile", "date_of_birth", "color")] == ["SSN", "Email", None, "Phone", "DOB", None]
    found = {r.column: r.family for r in comply.findings(spark).collect()}
    assert found["mrn"] == "MRN" and found["fax"] == "Phone" and "ward" not in found and "email_address" not in found


def test_rules_by_column_names():
    assert temporal_rules.pairs_of(["order_date", "ship_date", "x"]) == [("order_date", "ship_date")]
    assert ("diagnosis_date", "treatment_start_date") in temporal_rules.pairs_of(["diagnosis_date", "treatment_start_date"])
    assert temporal_rules.pairs_of(["a", "b"]) == []
    assert temporal_rules.statuses_of(["kyc_status", "verified_date", "rejection_date"]) == [
        ("kyc_status", "verified", "verified_date", False),
        ("kyc_status", "rejected", "verified_date", True),
        ("kyc_status", "rejected", "rejection_date", False),
        ("kyc_status", "pending", "verified_date", True),
        ("kyc_status", "pending", "rejection_date", True),
    ]


def test_status_rules_on_rows(spark):
    df = spark.createDataFrame([(1, "active", None, None), (2, "active", "2024-01-01", None), (3, "cancelled", None, None), (4, None, None, None)], "id long, card_status string, blocked_date string, cancelled_date string")
    assert {(r.id, r.rule) for r in compare.status_violations(df).collect()} == {(2, "card_status=active: blocked_date must be null"), (3, "card_status=cancelled: cancelled_date must be set")}
    assert compare.status_violations(df.select("id")).collect() == []


def test_temporal_split_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "BUCKET_ROWS", 20)
    # One time holds two thirds of the rows, some times are null, keys repeat.
    df = spark.range(600).select(F.expr("id div 2").alias("key"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 > 0, F.lit("2024-03-01")).otherwise(F.concat(F.lit("2023-01-"), (F.col("id") % 28 + 1).cast("string"))).cast("timestamp").alias("at"))
    rows = split.temporal_split(df, "at", "key").collect()
    ordered = sorted(rows, key=lambda r: (r.at is not None, r.at or 0, r.key) if r.at is None else (True, r.at, r.key))
    order = {"train": 0, "test": 1, "validation": 2}
    assert [order[r.split] for r in ordered] == sorted(order[r.split] for r in rows)
    assert sum(r.split == "train" for r in rows) == 420 and sum(r.split == "test" for r in rows) == 90


def test_random_split_in_many_buckets(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "key")
    want = {r.key: r.split for r in split.random_split(df, "key").collect()}
    monkeypatch.setattr(split, "BUCKET_ROWS", 1)
    assert split.digits(500) == 3
    assert {r.key: r.split for r in split.random_split(df, "key").collect()} == want


def test_medians_are_exact(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 5.0, 5.0], [float(i * i % 101) for i in range(1000)], [float(i) for i in range(999)]):
        df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "x double, y double")
        row = {r.column: r for r in profile.numeric(df, ("x", "y")).collect()}
        assert row["x"]["median"] == statistics.median(values) and row["x"].n == len(values)
        assert row["y"].n == 0 and row["y"]["median"] is None


def test_places_over_ranges(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("a"), F.lit("x").alias("b"))
    assert sorted((r.a, r._at) for r in compare.placed(df, ["a"]).collect()) == [(i, i + 1) for i in range(300)]
    graded = compare.grade(df, df, ["a"]).first()
    assert graded.total == 100.0


def test_italian_vat(spark):
    row = spark.createDataFrame([("1234567890",)], "t string").select(checks.vat_check_it(F.col("t")).alias("d")).first()
    assert row.d == "3"  # 1+4+3+8+5+3+7+7+9+0 = 47


def test_whole_assessment_has_three_pillars(spark, sf):
    rows = assess.assessment(spark, sf).collect()
    assert len(rows) == 13 and {r.pillar for r in rows} == {"fidelity", "structure", "privacy"}
    assert table(spark, sf, "customer").count() > 0
