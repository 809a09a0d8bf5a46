from datumloom import catalog
from datumloom.operators import assess


def test_partitions_of_the_join_follow_the_items(spark, sf, monkeypatch):
    plain = sorted(map(tuple, assess.shipments(spark, sf).collect()))
    monkeypatch.setattr(assess, "ITEMS_EACH", 250)
    items = assess.ordered_items(spark, sf)
    assert items.rdd.getNumPartitions() == -(-len(plain) // 250) > 4
    assert max(len(p) for p in items.select("l_orderkey").rdd.glom().collect()) < 4 * 250
    assert sorted(map(tuple, assess.shipments(spark, sf).collect())) == plain


def test_pairs_of_a_row_take_one_join(spark, sf):
    plan = catalog.QUERIES["within_row_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
