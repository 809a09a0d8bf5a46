import random

import duckdb
import pytest

from datumloom import catalog
from datumloom.operators import privacy

# By hand, from the reference's scanners: a text for each pattern, its category, action and threshold.
PLANTED = [
    ("write to ann.lee@mail.example.org now", "email", "tokenize", 0.3),
    ("number 123-45-6789 on file", "ssn", "block", 0.1),
    ("call (212)\u00a0555-0147 today", "phone", "tokenize", 0.2),
    ("from 192.168.10.254 at noon", "ip_address", "mask", 0.2),
    ("seen by Dr. Okafor at noon", "name", "tokenize", 0.3),
    ("signed by Maria Lopez\u00e9 and others", "name", "tokenize", 0.3),
    ("lives at 12 old mill rd since then", "address", "tokenize", 0.2),
    ("lives at 4500 Park View Blvd since then", "address", "tokenize", 0.2),
    ("card 4111 1111\n1111-1111 was used", "financial", "block", 0.1),
    ("paid to GB82WEST12345698765432 in full", "financial", "block", 0.1),
    ("routing 021000021 was given", "bank_routing", "mask", 0.1),
    ("routing 121000358 was given", "bank_routing", "mask", 0.1),
    ("routing 322271627 was given", "bank_routing", "mask", 0.1),
    ("born 07/04/1985 in town", "date_of_birth", "mask", 0.15),
    ("born 1985-07-04 in town", "date_of_birth", "mask", 0.15),
    ("licence D123-456-789-012 shown", "drivers_license", "block", 0.1),
    ("passport C01234567 shown", "passport", "block", 0.1),
    ("see https://example.org/a now", "url", "tokenize", 0.3),
    ("patient mrn-00123456 waits", "medical", "tokenize", 0.1),
    ("provider NPI:1234567893 waits", "medical", "tokenize", 0.1),
    ("pupil stu 20231 waits", "student_id", "tokenize", 0.15),
    ("matter 24-cv-01234 is open", "case_number", "tokenize", 0.1),
    ("car 1HGCM82633A004352 is sold", "vin", "block", 0.1),
    ("nothing of that kind is here", None, None, None),
]


def test_a_planted_value_of_each_category(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLANTED)], "i int, text string")
    got = {r.i: r for r in df.select("i", *(privacy.has(df.text, p).alias(k) for k, (p, _, _) in privacy.VALUES.items())).collect()}
    for i, (text, category, *_) in enumerate(PLANTED):
        found = [k for k in privacy.VALUES if got[i][k]]
        assert category in found if category else not found, (text, found)
    assert {p[1] for p in PLANTED} - {None} == set(privacy.VALUES) and len(privacy.VALUES) == 16


@pytest.mark.parametrize("category,action,threshold", sorted({p[1:2] + p[2:] for p in PLANTED if p[1]}))
def test_actions_and_thresholds(category, action, threshold):
    assert privacy.VALUES[category][1:] == (threshold, action)


def test_every_covering_category_has_a_scanner_and_counts(spark):
    assert set(privacy.COVERS) <= set(privacy.VALUES)
    df = spark.createDataFrame([("seen by Dr. Okafor",), ("lives at 12 old mill rd",)], "text string")
    assert {r.category for r in privacy.scan(df, "text").where("found").collect()} == {"name", "address"}


def test_long_texts_without_marks(spark):
    words = "word " * 50_000
    df = spark.createDataFrame([(0, f"7 {words}"), (1, f"7 {words}hwy")], "i int, text string")
    assert [r.found for r in df.orderBy("i").select(privacy.has(df.text, privacy.VALUES["address"][0]).alias("found")).collect()] == [False, True]


def test_seventeen_capitals_without_a_digit(spark, tmp_path):
    text = "car WDBUFGHJKLMNPRSTV is sold"
    spark.createDataFrame([(1, text), (2, "car is sold"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.ORACLES["contains_pii"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["contains_pii"](spark, str(tmp_path)).collect()}
    assert got == set(duckdb.sql(sql).fetchall()) == {(1, "vin,"), (2, ""), (3, "")}


def test_a_scan_counts_values_in_texts_without_digits(spark):
    df = spark.createDataFrame([("car WDBUFGHJKLMNPRSTV is sold",), ("car 1HGCM82633A004352 is sold",), ("no car",), (None,)], "text string")
    got = {r.category: (r.hits, r.share, r.found) for r in privacy.scan(df, "text").collect()}
    assert got["vin"] == (2, 0.6667, True) and all(v == (0, 0.0, False) for k, v in got.items() if k != "vin")


PIECES = (
    "a.b", "@", "x.com", "123-45-6789", "555-123-4567", "+15551234567", "10.0.0.255", "256.", "Mr", "Smith", "John", "12", "Oak", "elm", "St", "hwy", "DE89", "370400440532013000", "1234-5678",
    "021000021", "01/31/1999", "2001-12-30", "D123", "456", "C12345678", "https://", "MRN", "npi", "1234567890", "SID", "stu:", "AB-", "WDBUFGHJKLMNPRSTV", "1HGCM82633A004352", "Q", "-", "/", "é", "ß", "_", ".", "'", "\n",
)


def test_a_scan_counts_what_its_sql_counts_in_any_mixture(spark, tmp_path):
    r = random.Random(3)
    texts = [("".join(r.choice((piece, " ", piece + " ")) for piece in r.choices(PIECES, k=r.randint(1, 9))),) for _ in range(20_000)]
    spark.createDataFrame([*texts, (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.ORACLES["pii_value_scan"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.QUERIES["pii_value_scan"](spark, str(tmp_path)).select("category", "hits", "share", "found", "action").collect()}
    want = duckdb.sql(sql)
    assert got == set(want.fetchall()) and all(n for _, n, *_ in got)


def test_letters_without_case_fold_as_in_the_sql(spark, tmp_path):
    long_s, kelvin = "\u017f", "\u212a"
    found = [
        (f"lives at 12 old {long_s}t now", "address"),
        (f"lives at 12 {long_s}alt old {kelvin}ent Pi{kelvin}e now", "address"),
        (f"lives at 12 oak {long_s}mall St{long_s} on", "address"),
        (f"pupil x{long_s}tu 20231 waits", "student_id"),
        (f"matter 24-{long_s}{kelvin}-01234 is open", "case_number"),
    ]
    # Before a long s there is a boundary after a word character only; dotted and dotless letters don't fold, nor do letters with case.
    none = [f"pupil {long_s}tu 20231 waits", "matter 24-\u0130\u0131-01234 is open", f"car 1HGCM82633A00435{kelvin} is sold"]
    texts = found + [(t, "") for t in none]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in (("contains_pii", ("doc_id", "categories")), ("pii_value_scan", ("category", "hits", "share", "found", "action"))):
        sql = catalog.ORACLES[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
        got = {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()}
        assert got == set(duckdb.sql(sql).fetchall())
        if name == "contains_pii":
            assert got == {(i, k and f"{k},") for i, (_, k) in enumerate(texts)}
