"""Scenarios by roles: all seven run on tables of other names, keep the columns, and follow one another."""

import datetime as dt

import pytest

from datumloom.operators import scenarios as sc

ROLES = sc.Roles("id", "state", "cost", "at", "who", ("note",))


@pytest.fixture(scope="module")
def things(spark):
    rows = [(i, ["open", "paid"][i % 2], float(i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 7, f"Note {i}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, state string, cost double, at timestamp, who long, note string")


@pytest.mark.parametrize("name", sorted(sc.REGISTRY))
def test_each_scenario_changes_some_rows(things, name):
    out = sc.play({"things": things}, {"things": ROLES}, [(name, "high")])
    changed = out.tables["things"]
    assert changed.columns == things.columns and out.applied == [(name, "things")]
    kept = changed.intersect(things).count()
    assert 0 < kept < 3000 and changed.select("id").distinct().count() == changed.count()


def test_strength_unknown_names_and_missing_roles(things):
    low, high = (sc.play({"t": things}, {"t": ROLES}, [("churn-spike", s)]).tables["t"].where("state = 'canceled'").count() for s in ("low", "high"))
    assert 250 < low < 500 < 1300 < high
    with pytest.warns(UserWarning, match="no scenario 'flood'"):
        out = sc.play({"t": things}, {"t": sc.Roles("id", texts=("note",))}, [("flood", "low"), ("fraud-spike", "low"), ("data-quality", "low"), ("data-migration", "low")])
    assert out.unknown == ["flood"] and out.applied == [("data-quality", "t"), ("data-migration", "t")]
    assert out.conflicts() == [("t", ("data-quality", "data-migration"))]
    assert out.tables["t"].select("state", "cost").exceptAll(things.select("state", "cost")).count() == 0
