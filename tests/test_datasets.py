"""Changes of datasets, articles of resilience, sniffed types and charts on small tables made by hand."""

from datumloom.operators import assess, comply, datasets, discover
from datumloom.sources import tables


def test_changes_by_hand(spark):
    rows = [(i, ["a", "b", "b"][i % 3], float(i), None) for i in range(30)]
    old = spark.createDataFrame(rows, "id long, kind string, x double, empty string")
    new = spark.createDataFrame([(i, ["a", "a", "b"][i % 3], 1) for i in range(33)], "id long, kind string, extra int")
    gone = spark.range(2)
    before = datasets.Dataset({"t": old, "gone": gone, "same": gone}, (("t", "kind", "kinds", "k"), ("t", "id", "ids", "i")))
    after = datasets.Dataset({"t": new, "same": gone, "fresh": gone}, (("t", "id", "ids", "i"), ("t", "extra", "more", "m")))
    found = [(c.kind, c.table, c.item, c.before, c.after, c.breaking) for c in datasets.changes(before, after)]
    assert found == [
        ("table_removed", "gone", None, None, None, True),
        ("table_added", "fresh", None, None, None, False),
        ("column_removed", "t", "x", None, None, True),
        ("column_removed", "t", "empty", None, None, True),
        ("column_added", "t", "extra", None, None, False),
        ("reference_removed", "t", "kind", "kinds", None, True),
        ("reference_added", "t", "extra", None, "more", False),
        ("rows", "t", None, "30", "33", False),
        ("top_value", "t", "kind", "b (67 %)", "a (67 %)", False),
    ]
    assert datasets.changes(before, before) == []


def test_categorical_columns_are_found_roughly_and_never_missed(spark):
    df = spark.range(4000).selectExpr("id", "id % 2000 as half", "id % 7 as few", "cast(id as string) as text")
    found = assess.categorical(df, ("id", "half", "few", "text"))
    assert {"half", "few"} <= set(found) and not {"id", "text"} & set(found)


def test_articles():
    everything = comply.dora_articles(100, 95, {"version": "1", "seed": 0})
    assert set(everything.values()) == {"pass"}
    nothing = comply.dora_articles(89, 89, None)
    assert nothing == {"article_6": "fail", "article_9": "partial", "article_10": "fail", "article_11": "fail", "article_12": "pass", "article_16": "partial", "overall": "fail"}
    assert comply.dora_articles(100, 94, {"seed": "N/A", "version": "2"})["article_10"] == "partial" and comply.dora_articles(100, 100, {"seed": "N/A"})["article_11"] == "fail"


def test_sniffed_types_and_charts(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "2024-01-01", "x", ""), ("-2", "7", "FALSE", "2024-01-01 10:00", None, None)], "i string, n string, b string, t string, s string, e string")
    assert tables.sniffed(df) == {"i": "INTEGER", "n": "NUMERIC", "b": "BOOLEAN", "t": "TIMESTAMP", "s": "TEXT", "e": "TEXT"}
    kinds = [([("n", "bigint")], 1), ([("d", "date"), ("n", "double")], 9), ([("c", "string"), ("n", "int")], 6), ([("c", "string"), ("n", "int")], 7), ([("x", "double"), ("y", "double")], 9), ([("c", "string")], 3)]
    assert [discover.chart_kind(*k) for k in kinds] == ["kpi", "line", "pie", "bar", "scatter", "table"]
