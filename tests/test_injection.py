"""Anomalies in a table of any columns: labels agree with what changed, keys never change."""

import datetime as dt

from pyspark.sql import functions as F

from datumloom.operators import injection as inj


def test_labels_say_what_changed(spark):
    rows = [(i, i % 3, f"name {i}", float(i + 1), None if i % 4 == 0 else i, dt.date(2024, 1, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, ref long, name string, cost double, size int, day date")
    out = inj.inject(df, "t", "id", inj.EVERY, frozenset({"ref"}), rate=0.2)
    assert out.columns == [*df.columns, "anomalies"]
    old = {r.id: r for r in df.collect()}
    twice = 0
    for r in out.collect():
        labels = [tuple(x) for x in r.anomalies]
        assert r.ref == old[r.id].ref
        twice += ("duplicate_record", None) in labels
        touched = {c for _, c in labels}
        for c in ("name", "cost", "size", "day"):
            changed = r[c] != old[r.id][c]
            assert not changed or c in touched
            if c in touched and old[r.id][c] is not None:
                last = [k for k, x in labels if x == c][-1]
                value = r[c]
                assert {"null_injection": value is None, "string_overflow": value == "A" * 1000, "type_mismatch": value == "NOT_A_NUMBER", "negative_value": value is not None and not isinstance(value, str | dt.date) and value < 0}.get(last, changed)
    assert out.count() == 2000 + twice and 300 < twice < 500
    kinds = {(r.kind, r.column) for r in out.select(F.inline("anomalies")).distinct().collect()}
    assert {c for k, c in kinds if k == "extreme_value"} == {"cost", "size"} and {c for k, c in kinds if k == "timestamp"} == {"day"}


def test_nothing_fits(spark):
    df = spark.range(10).select(F.col("id"))
    out = inj.inject(df, "t", "id", ["extreme_value", "timestamp"], rate=1.0)
    assert out.select("id").exceptAll(df).count() == 0 and all(r.anomalies == [] for r in out.collect())
