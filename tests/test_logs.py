from datetime import datetime

import duckdb

from datumloom import catalog


def test_the_last_entries_of_one_second_and_of_one_time(spark, tmp_path):
    """Sixty errors of one second: forty of one time, and twenty that differ in microseconds; ids in no order of time."""
    at = lambda us: datetime(2024, 2, 1, 12, 0, 0, us)
    rows = [(i * 7 % 60, at(500_000 if i < 40 else 999_960 - 3 * i), "error") for i in range(50)] + [(i * 7 % 60, at(100 + i), "error") for i in range(50, 60)]
    rows += [(100, at(999_999), "view"), (101, datetime(2024, 1, 9, 23, 59, 59, 999_999), "error"), (102, None, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalog.QUERIES["log_scan"](spark, str(tmp_path)).collect()]
    expected = duckdb.sql(catalog.ORACLES["log_scan"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert got == expected and len(got) == 20
    assert [r[0] for r in got] == [i * 7 % 60 for i in range(40, 50)] + sorted(i * 7 % 60 for i in range(40))[:10]


def test_no_entries(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["log_scan"](spark, str(tmp_path)).collect() == []
