"""Streams that fail and are started again, batches in any cut, state that expires."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datumloom.streaming import machines, windows


@pytest.fixture
def events(spark, sf, tmp_path):
    """The events in seven files, in no order within a file, and with times a little out of order between files."""
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").toPandas()
    folder = tmp_path / "tables" / "events.parquet"
    folder.mkdir(parents=True)
    size = -(-len(rows) // 7)
    for i in range(7):
        part = rows.iloc[i * size : (i + 1) * size].sample(frac=1, random_state=i)
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        file.rename(folder / f"{i}.parquet")
    return str(tmp_path / "tables")


def expected(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(repr(tuple(dict(zip(names, r))[n] for n in sorted(names))) for r in result.fetchall())


def found(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


class Stop(Exception):
    pass


def failing(df, mode, path, at, keys=()):
    def stop(number):
        if number == at:
            raise Stop

    with pytest.raises(Exception, match="Stop"):
        windows.run(df, mode, path, keys, after=stop)
    return windows.run(df, mode, path, keys)


def test_a_machine_goes_on_after_a_failure(spark, events, tmp_path):
    stream = windows.stream(spark, events, files_at_once=1).select("event_id", "ts", "user_id", "event_type")
    got = failing(machines.walked(stream, machines.CUSTOMER), "append", str(tmp_path / "run"), at=3)
    assert found(got.withColumn("at", windows.plain("at"))) == expected(machines.machine_sql(machines.CUSTOMER), events)


def test_windows_go_on_after_a_failure(spark, events, tmp_path):
    counts = windows.stream(spark, events, files_at_once=1).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    got = failing(counts, "update", str(tmp_path / "run"), at=2, keys=["window", "event_type"])
    got = got.select(windows.plain("window.start").alias("start"), "event_type", "n", "most")
    sql = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2"
    assert found(got) == expected(sql, events)


def test_idle_entities_are_forgotten(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, 1, "go", 0.0), (2, base + dt.timedelta(hours=1), 2, "go", 0.0), (3, base + dt.timedelta(days=9), 3, "other", 0.0)]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    machine = machines.Machine(start="a", moves={("a", "go"): "b"}, timeouts={"b": (2 * machines.HOUR, "end")}, effects={("a", "b"): "rows:create"}, final=frozenset({"end"}), forget_after=24 * machines.HOUR)
    stream = windows.stream(spark, str(folder)).select("event_id", "ts", "user_id", "event_type")
    got = windows.run(machines.walked(stream, machine), "append", str(tmp_path / "run"))
    moves = sorted((r["entity"], r["step"], r["from_state"], r["to_state"], r["event"], r["effect"]) for r in got.collect())
    assert moves == [(e, *m) for e in (1, 2) for m in ((1, "a", "b", "go", "rows:create"), (2, "b", "end", None, None))]
    left = spark.read.format("statestore").option("stateVarName", "at").load(str(tmp_path / "run" / "state"))
    assert left.count() == 0


class Calls:
    """A handle and its states, which keep the names of the calls alone."""

    def __init__(self):
        self.made = []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def __getattr__(self, name):
        def call(*values):
            self.made.append(name)

        return call


def test_calls_and_frames_do_not_grow_with_the_events_of_a_batch(spark):
    def made(n):
        handle, walk = Calls(), machines.Walk(machines.CUSTOMER)
        walk.init(handle)
        times = [1_704_067_200_000 + i for i in range(n)]
        frame = pd.DataFrame({"entity": 1, "ms": times, "event_id": range(n), "event_type": "view", "what": [f'{{"ms":{t},"id":{i},"event":"view"}}' for i, t in enumerate(times)]})
        frames = list(walk.handleInputRows((1,), iter([frame]), None))
        return handle.made, len(frames)

    assert made(1) == made(500) == (["appendValue", "registerTimer"], 0)


def test_a_batch_is_one_row_of_waiting_events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=i % 30), i % 3, "view", 0.0) for i in range(90)]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    stream = windows.stream(spark, str(folder)).select("event_id", "ts", "user_id", "event_type")
    windows.run(machines.walked(stream, machines.CUSTOMER), "append", str(tmp_path / "run"))
    left = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "run" / "state"))
    assert sorted(r.entity for r in left.select("key.entity").collect()) == [0, 1, 2]


def test_events_without_an_id_or_a_type(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [
        (5, base, 1, "signup", 0.0), (None, base, 1, "view", 0.0), (9, base, 1, None, 0.0), (6, base + dt.timedelta(hours=1), 1, "purchase", 0.0),
        (2**53 + 1, base, 2, "view", 0.0), (2**53, base, 2, "signup", 0.0), (7, base + dt.timedelta(hours=3), 1, 'a "quoted" one', 0.0), (8, base + dt.timedelta(days=3), 3, "view", 0.0),
    ]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    stream = windows.stream(spark, str(folder)).select("event_id", "ts", "user_id", "event_type")
    got = windows.run(machines.walked(stream, machines.CUSTOMER), "append", str(tmp_path / "run"))
    assert found(got.withColumn("at", windows.plain("at"))) == expected(machines.machine_sql(machines.CUSTOMER), str(folder))
