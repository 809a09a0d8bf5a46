"""Column kinds by values against names, captures without torn references, drawn children, trees of hashes."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datumloom.operators import audit, capture, cardinality, detect


def kinds(spark, rows, schema, table_name="things"):
    return {d.column: d for d in detect.detect({table_name: spark.createDataFrame(rows, schema)})}


def test_values_confirm_and_overrule_names(spark):
    rows = [(f"a{i}@x.org", f"10.0.0.{i}", "not a link", f"b{i}@y.org", f"word {i}", ["new", "old"][i % 2], f"free text {i}", i % 2, f"2024-01-{i % 28 + 1:02d}") for i in range(100)]
    found = kinds(spark, rows, "contact_email string, note string, homepage string, phone string, street string, mood string, job_type string, active long, day string")
    assert (found["contact_email"].kind, found["contact_email"].confidence) == ("email", "high") and "100 % of values agree" in found["contact_email"].reason
    assert (found["note"].kind, found["note"].confidence) == ("ip", "high")
    assert (found["homepage"].kind, found["homepage"].confidence) == ("url", "low")
    assert (found["phone"].kind, found["phone"].confidence) == ("email", "medium") and "against the name" in found["phone"].reason
    assert (found["street"].kind, found["street"].confidence) == ("address", "high")
    assert (found["mood"].kind, found["job_type"].kind, found["active"].kind, found["day"].kind) == ("enum", "text", "flag", "date")


def test_names_and_types_alone(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("tax_rate", T.DoubleType()), ("total_cost", T.DecimalType(10, 2)), ("is_new", T.BooleanType()), ("at", T.DateType()), ("tags", T.ArrayType(T.StringType())), ("x", T.ShortType()), ("amount", T.StringType()))])
    found = {c: (d.kind, d.confidence) for c, d in kinds(spark, [], schema, "Customers").items()}
    assert found == {"name": ("full_name", "high"), "tax_rate": ("percentage", "high"), "total_cost": ("money", "high"), "is_new": ("boolean", "high"), "at": ("timestamp", "high"), "tags": ("list", "medium"), "x": ("integer", "medium"), "amount": ("text", "low")}
    assert kinds(spark, [], "name string")["name"].kind == "text"


def test_captures_are_closed(spark, tmp_path):
    tables = {
        "a": spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, zone long"),
        "b": spark.createDataFrame([(i, i % 30 if i % 7 else None, i % 5) for i in range(200)], "id long, a_id long, kind long"),
        "c": spark.createDataFrame([(i, i % 200, i % 30 if i % 4 else None) for i in range(500)], "id long, b_id long, a_id long"),
        "zones": spark.createDataFrame([(i,) for i in range(5)], "id long"),
        "kinds": spark.createDataFrame([(i,) for i in range(9)], "id long"),
        "alone": spark.createDataFrame([(1,)], "id long"),
    }
    references = [("a", "zone", "zones", "id"), ("b", "a_id", "a", "id"), ("b", "kind", "kinds", "id"), ("c", "b_id", "b", "id"), ("c", "a_id", "a", "id")]
    got = capture.captured(tables, references, "a", tables["a"].where("id < 8").select("id"), "id", str(tmp_path / "cap"))
    assert all(r.n_torn == 0 for r in capture.unresolved(got, references).collect())
    a = set(range(8))
    b = {i for i in range(200) if i % 7 and i % 30 in a}
    c = {i for i in range(500) if i % 200 in b and (i % 4 == 0 or i % 30 in a)}
    ids = lambda t: sorted(r.id for r in got[t].select("id").collect())
    assert (ids("a"), ids("b"), ids("c")) == (sorted(a), sorted(b), sorted(c))
    assert ids("zones") == [0, 1, 2] and ids("kinds") == sorted({i % 5 for i in b}) and ids("alone") == []


@pytest.mark.parametrize("buckets", [1, 7])
def test_children_are_numbered_without_gaps(spark, monkeypatch, buckets):
    monkeypatch.setattr(cardinality, "BUCKET_ROWS", 3000 // buckets)
    parents = spark.range(3000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")).alias("id"))
    rows = cardinality.with_children(parents, "id", cardinality.Children("poisson", 3), "t").collect()
    assert sorted(r.row_no for r in rows) == list(range(len(rows)))
    each = Counter(r.id for r in rows)
    assert None not in each and 2.8 < len(rows) / 2970 < 3.2
    assert all(sorted(r.child_no for r in rows if r.id == k) == list(range(n)) for k, n in list(each.items())[:20])
    assert all(max(rs) - min(rs) + 1 == len(rs) for rs in ([r.row_no for r in rows if r.id == k] for k in list(each)[:20]))


def test_distributions():
    for c in (cardinality.Children("fixed", 3), cardinality.Children("uniform", least=2, most=5), cardinality.Children("poisson", 2.5), cardinality.Children("poisson", 2.5, least=1)):
        assert abs(sum(c.weights()) - 1) < 1e-9 and len(c.bounds()) == c.most
    assert cardinality.Children("uniform", least=2, most=5).weights()[:2] == [0.0, 0.0]
    with pytest.raises(ValueError, match="no distribution"):
        cardinality.Children("zipf").weights()


def test_trees_find_what_changed(spark):
    rows = [(i, f"v{i}", None if i % 5 else i) for i in range(500)] + [(7, "twice", 1), (7, "twice", 1), (None, "", 3)]
    old = spark.createDataFrame(rows, "k long, v string, n long")
    same = old.select("n", "k", "v").repartition(9)
    assert audit.root(old, "k", 2) == audit.root(same, "k", 2) != audit.root(old.limit(3), "k", 2)
    assert audit.changes(old, same, "k", 2).collect() == []
    new = old.where("k <> 9 or k is null").withColumn("v", F.when(F.col("k") == 11, F.lit(None)).otherwise(F.col("v"))).union(spark.createDataFrame([(7, "twice", 1), (900, "x", 1)], old.schema))
    assert sorted(map(tuple, audit.changes(old, new, "k", 2).collect())) == [("11", "changed"), ("7", "changed"), ("9", "removed"), ("900", "added")]
    assert audit.differing(audit.tree(old, "k", 2), audit.tree(new, "k", 2), 2).count() <= 4
    assert audit.root(old.limit(0), "k", 2) == "" and [audit.digits_for(n) for n in (0, 5000, 10**6, 10**12)] == [1, 2, 3, 6]
    # An empty text isn't a null, and values don't run into one another.
    pairs = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "", None), (4, None, "")], "k int, a string, b string")
    assert pairs.drop("k").select(audit.row_hash(pairs.drop("k"))).distinct().count() == 4
