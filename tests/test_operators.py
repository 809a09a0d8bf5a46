"""Properties that no SQL states: determinism, round trips, hand-computed cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datumloom.functions import checks, numbers
from datumloom.operators import compare, perturb, privacy, split
from datumloom.plans import schema
from datumloom.registry import table
from datumloom.sources import dumps
from datumloom.streaming import simulate


def mulberry(seed, n):
    state, out = seed & 0xFFFFFFFF, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def test_mulberry_draws_are_direct(spark):
    got = [r.x for r in spark.range(1, 200).select("id", numbers.mulberry(1234567, F.col("id")).alias("x")).orderBy("id").collect()]
    assert got == mulberry(1234567, 199)


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_scenarios_do_not_depend_on_partitions(spark, sf, parts):
    orders = table(spark, sf, "orders")
    one = perturb.payment_failures(orders, "o_orderstatus", "o_totalprice", "o_orderkey")
    other = perturb.payment_failures(orders.repartition(parts), "o_orderstatus", "o_totalprice", "o_orderkey")
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_splits_are_disjoint_and_whole(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    done = split.random_split(orders, "o_orderkey").collect()
    n = orders.count()
    assert sorted(r.o_orderkey for r in done) == sorted(r.o_orderkey for r in orders.collect())
    assert sum(r.split == "train" for r in done) == int(n * 0.7)


def test_identifiers(spark):
    row = spark.range(1).select(
        checks.iban_valid(F.lit("DE89 3704 0044 0532 0130 00")).alias("a"),
        checks.iban_valid(F.lit("DE88370400440532013000")).alias("b"),
        checks.iban_valid(F.lit(None).cast("string")).alias("c"),
        checks.aba_valid(F.lit("021000021")).alias("d"),
        checks.aba_valid(F.lit("021000022")).alias("e"),
        checks.luhn_valid(F.lit("4111 1111 1111 1111")).alias("f"),
        checks.luhn_valid(F.lit("4111 1111 1111 1112")).alias("g"),
        checks.vat_key_fr(F.lit("732829320")).alias("h"),
        checks.plain_ascii(F.lit("Łódź SStraße")).alias("i"),
        checks.normalize_gender(F.lit(" Female ")).alias("j"),
    ).first()
    assert list(row) == [True, False, False, True, False, True, False, "44", "lodzsstrasse", "F"]


def test_summer_time(spark):
    times = ["2024-03-31 00:59:59", "2024-03-31 01:00:00", "2024-10-27 00:59:59", "2024-10-27 01:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(checks.european_offset(F.col("t").cast("timestamp"), 1).alias("o"))
    assert [r.o for r in df.collect()] == [1, 2, 2, 1]


DDL = """
CREATE TABLE users (id uuid PRIMARY KEY, email varchar(255) NOT NULL, score numeric(5,2), tags text[], at timestamp with time zone);
CREATE TABLE payments (id serial, user_id uuid REFERENCES users(id), amount double precision, PRIMARY KEY (id));
CREATE TABLE notes (id int PRIMARY KEY, payment_id int, parent_id int REFERENCES notes(id), FOREIGN KEY (payment_id) REFERENCES payments(id));
ALTER TABLE users ADD CONSTRAINT f FOREIGN KEY (email) REFERENCES missing(x);
"""


def test_ddl():
    tables = schema.tables_of(DDL)
    assert [t.name for t in tables] == ["users", "payments", "notes"]
    users = tables[0].struct()
    assert isinstance(users["tags"].dataType, T.ArrayType) and users["score"].dataType == T.DecimalType(5, 2)
    assert users["at"].dataType == T.TimestampType() and not users["email"].nullable
    assert tables[1].columns[1].references == ("users", "id") and tables[1].columns[0].primary
    assert schema.order(tables) == (["users", "payments", "notes"], [])
    assert schema.problems(tables) == ["users.email: no missing.x"]
    again = schema.tables_of(schema.ddl_of(tables[1:]))
    assert [c.name for t in again for c in t.columns] == [c.name for t in tables[1:] for c in t.columns]


def test_cycles_come_last():
    a = schema.Table("a", [schema.Column("x", T.IntegerType(), references=("b", "y"))])
    b = schema.Table("b", [schema.Column("y", T.IntegerType(), references=("a", "x"))])
    c = schema.Table("c", [schema.Column("z", T.IntegerType())])
    assert schema.order([a, b, c]) == (["c", "a", "b"], ["a", "b"])


@pytest.mark.parametrize("model", ["linear", "exponential", "s_curve", "flat"])
def test_growth_sums_to_the_total(model):
    counts = schema.growth(model, 7, 1001)
    assert sum(counts) == 1001 and (model == "flat" or counts == sorted(counts))


def test_tokens_and_encryption(spark, sf):
    customers = table(spark, sf, "customer").limit(20)
    sealed = customers.select("c_name", privacy.encrypt(F.col("c_name"), "secret").alias("e"))
    assert all(r.c_name == r.d != r.e for r in sealed.withColumn("d", privacy.decrypt(F.col("e"), "secret")).collect())
    chain = privacy.audit_chain([{"table": "a", "n": 1}, {"table": "b", "n": 2}])
    assert privacy.audit_verified(chain)
    chain[0]["n"] = 3
    assert not privacy.audit_verified(chain)


@pytest.mark.parametrize("strategy", ["replace_name", "replace_email", "replace_phone", "replace_address", "replace_username", "replace_ip", "replace_url", "replace_ssn", "replace_text", "redact", "preserve"])
def test_masks_keep_nulls(spark, strategy):
    df = spark.createDataFrame([(1, "joe@corp.com"), (2, None)], "id long, v string")
    a, b = df.orderBy("id").select(privacy.mask(F.col("v"), strategy, F.col("id")).alias("m")).collect()
    assert b.m is None and a.m is not None and (strategy == "preserve") == (a.m == "joe@corp.com")


def test_bags_count_repetitions_and_nulls(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    right = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (3, None)], "k int, v string")
    assert tuple(compare.bags(left, right).first()) == (2, 1, 2)


def test_grade_of_the_same_result_is_full(spark, sf):
    nations = table(spark, sf, "nation")
    assert compare.grade(nations, nations, ["n_nationkey"]).first().total == 100


def test_dump_tuples():
    text = "(1, 'it''s', NULL, 'a),(b'), (2,'',null, now())"
    assert list(dumps.tuples(text)) == [["1", "it's", None, "a),(b"], ["2", "", None, "now()"]]


def test_paths():
    assert simulate.path_to("canceled") == ["trial", "active", "past_due", "canceled"]
    assert simulate.path_to("trial") == ["trial"]


def test_the_entry_module_without_the_optional_package():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'fk_integrity' in e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_pack_layouts_say_the_same():
    from datumloom.operators import pack

    named = pack.normalize({"tables": {"a": {"columns": {"id": {"strategy": "uuid"}}}, "b": {"columns": {"a_id": {"foreignKey": {"table": "a", "column": "id"}}}}}})
    listed = pack.normalize({"schema": {"tables": [{"name": "a", "columns": [{"name": "id", "strategy": "uuid"}]}, {"name": "b", "columns": [{"name": "a_id", "foreignKey": {"table": "a", "column": "id"}}]}]}})
    studio = pack.normalize({"tables": [{"id": "1", "name": "a", "columns": [{"id": "c1", "name": "id", "strategy": "uuid"}]}, {"id": "2", "name": "b", "columns": [{"id": "c2", "name": "a_id", "isFK": True, "fkTarget": {"tableId": "1", "columnId": "c1"}}]}]})
    for tables in (named, listed, studio):
        assert [t["name"] for t in tables] == ["a", "b"]
        assert tables[1]["columns"]["a_id"]["foreignKey"] == {"table": "a", "column": "id"}


def test_pack_tables_agree_with_their_parents(spark):
    from datumloom.operators import pack

    tables = pack.bank(900).all(spark)
    customers = {r.id: r for r in tables["customers"].collect()}
    assert len(customers) == tables["customers"].count()
    for r in tables["accounts"].collect():
        assert r.country == customers[r.customer_id].country
        assert (r.closed_on is None) == (r.status == "open") and (r.closed_on is None or r.closed_on > r.opened_on)
    teams = [r.asDict() for r in tables["teams"].collect()]
    ids = [t["id"] for t in teams]
    assert all(t["parent_id"] is None or ids.index(t["parent_id"]) < i for i, t in enumerate(teams))
    assert tables["accounts"].select(checks.iban_valid(F.col("iban")).alias("ok")).where("not ok").isEmpty()
