"""Compliance reports: families of personal columns, the identifiers that they cover, and metrics with their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.functions.numbers import half_up
from datumloom.operators import assess
from datumloom.operators.assess import _METRICS, _RATIOS, all_metrics, cardinality_ratio, metric_sql
from datumloom.registry import query, table
from datumloom.sources import dumps

# Families of personal columns, the identifier each stands for ("" for none), and patterns of lower-case names.
FAMILIES = (
    ("SSN", "SSN", (r"\bssn\b", r"\bsocial.?security")),
    ("Email", "Email", (r"\bemail\b",)),
    ("Phone", "Phone/Fax", (r"\bphone\b", r"\bmobile\b", r"\bcell\b", r"\bfax\b")),
    ("Credit Card", "Credit Card", (r"\bcredit.?card\b", r"\bcard.?num")),
    ("DOB", "Date of Birth", (r"\bdob\b", r"\bdate.?of.?birth", r"\bbirth.?date")),
    ("Name", "Name", (r"\bfull.?name\b", r"\bfirst.?name\b", r"\blast.?name\b", r"\bsurname\b")),
    ("Address", "Address", (r"\baddress\b", r"\bstreet\b")),
    ("IP Address", "IP Address", (r"\bip.?addr", r"\bsource.?ip")),
    ("Passport", "Passport", (r"\bpassport",)),
    ("Driver License", "Driver License", (r"\bdriver.?lic", r"\bdl.?num")),
    ("MRN", "Medical Record", (r"\bmrn\b", r"\bmedical.?record", r"\bpatient.?id")),
    ("Health Insurance", "Health Insurance ID", (r"\binsurance.?id", r"\bpolicy.?num", r"\bmember.?id")),
    ("Bank Account", "Bank Account", (r"\baccount.?num", r"\biban\b", r"\brouting")),
    ("VIN", "Vehicle ID", (r"\bvin\b", r"\bvehicle.?id")),
    ("License Plate", "License Plate", (r"\blicense.?plate",)),
    ("Biometric", "Biometric", (r"\bbiometric", r"\bfingerprint")),
    ("Photo", "Photo", (r"\bphoto\b", r"\bavatar\b", r"\bprofile.?pic")),
    ("National ID", "National ID", (r"\bnational.?id", r"\bcitizen.?id")),
    ("Gender", "", (r"\bgender\b", r"\bsex\b")),
    ("Race/Ethnicity", "", (r"\brace\b", r"\bethnicity\b")),
    ("ZIP Code", "", (r"\bzip\b", r"\bpostal.?code")),
    ("Salary", "", (r"\bsalary\b", r"\bincome\b", r"\bwage\b")),
    ("Password", "", (r"\bpassword\b", r"\bpasswd\b", r"\bsecret\b", r"\bapi.?key")),
)
# The distinct identifiers of the safe-harbour list.
IDENTIFIERS = ("Name", "Address", "Date of Birth", "Phone/Fax", "Email", "SSN", "Medical Record", "Health Insurance ID", "Bank Account", "Credit Card", "Driver License", "Vehicle ID", "License Plate", "Photo", "Biometric", "IP Address", "National ID")

#: Column names of an imagined clinic, to show the families on; an underscore is part of a word.
CLINIC = ("ssn", "email", "email_address", "fax", "credit_card", "dob", "birth_date", "last_name", "surname", "street", "ip_addr", "passport_no", "driver_license", "mrn", "patient_id", "member_id", "iban", "vin", "license_plate", "avatar", "gender", "zip", "zip_code", "wage", "api_key", "visit_date", "ward", "notes")


def family(name: Column) -> Column:
    """The first family whose patterns fit a column's name; null if none does."""
    out = F.when(F.lit(False), "")
    for kind, _, patterns in FAMILIES:
        out = out.when(F.lower(name).rlike("|".join(patterns)), kind)
    return out


_NAMES = "(VALUES " + ", ".join(f"('{n}')" for n in CLINIC) + ') n("column")'
_FAMILY = "CASE " + " ".join(f"""WHEN regexp_matches(lower("column"), '{"|".join(p)}') THEN '{k}'""" for k, _, p in FAMILIES) + " END"


def findings(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in CLINIC], "column string").withColumn("family", family(F.col("column"))).where("family IS NOT NULL")


@query("compliance_families", f'SELECT "column", family FROM (SELECT "column", {_FAMILY} AS family FROM {_NAMES}) f WHERE family IS NOT NULL')
def compliance_families(spark, sf_dir):
    """Which columns of the clinic are personal, and of which family."""
    return findings(spark)


@query(
    "compliance_identifiers",
    f"""SELECT identifier, found, CAST(floor(100.0::DOUBLE * sum(found::INT) OVER () / count(*) OVER () + 0.5) AS BIGINT) AS coverage FROM (SELECT identifier, identifier IN (SELECT i FROM (SELECT {_FAMILY} AS family FROM {_NAMES}) f
 JOIN (VALUES {", ".join(f"('{k}', '{i}')" for k, i, _ in FAMILIES if i)}) m(family, i) USING (family)) AS found FROM (VALUES {", ".join(f"('{i}')" for i in IDENTIFIERS)}) x(identifier)) y""",
)
def compliance_identifiers(spark, sf_dir):
    """Each safe-harbour identifier, whether a column stands for it, and the share of those found."""
    stands = F.create_map(*(F.lit(x) for k, i, _ in FAMILIES if i for x in (k, i)))
    found = findings(spark).select(stands[F.col("family")].alias("identifier")).where("identifier IS NOT NULL").distinct().withColumn("found", F.lit(True))
    every = spark.createDataFrame([(i,) for i in IDENTIFIERS], "identifier string").join(found, "identifier", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    share = every.agg(half_up(100.0 * F.count_if("found") / F.count("*")).cast("long").alias("coverage"))
    return every.crossJoin(F.broadcast(share))  # one row


# The least score of each metric that passes.
PASSING = {"completeness": 90, "fk_integrity": 100, "pk_uniqueness": 100, "temporal_logic": 100, "exact_match_rate": 100, "distribution_entropy": 70, "enum_validity": 95, "cardinality_ratio": 90}


@query(
    "compliance_metrics",
    f"""WITH m AS ({_METRICS}), h AS (SELECT CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE ratio BETWEEN 0.1 AND 100) / count(*) + 0.5) AS DOUBLE) AS healthy FROM ({_RATIOS}) r)
 SELECT metric, value, CASE WHEN value >= least_score THEN 'pass' ELSE 'warn' END AS status FROM (SELECT metric, least_score, CASE metric WHEN 'exact_match_rate' THEN greatest(0, 100 - 20 * 100.0::DOUBLE * (checked - passed) / checked)
 WHEN 'cardinality_ratio' THEN (SELECT healthy FROM h) ELSE score::DOUBLE END AS value FROM m JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in PASSING.items())}) p(metric, least_score) USING (metric)) v""",
)
def compliance_metrics(spark, sf_dir):
    """The eight metrics of a compliance report: repeated rows cost 20 points a percent, and ratios of 0.1 to 100 are healthy."""
    healthy = cardinality_ratio(spark, sf_dir).agg(half_up(100.0 * F.count_if(F.col("ratio").between(0.1, 100)) / F.count("*")).cast("double").alias("healthy"))
    wanted = spark.createDataFrame(list(PASSING.items()), "metric string, least_score int")
    rows = all_metrics(spark, sf_dir).join(wanted, "metric").crossJoin(F.broadcast(healthy))  # one row
    repeated = F.greatest(F.lit(0.0), 100 - 20 * (100.0 * (F.col("checked") - F.col("passed")) / F.col("checked")))
    value = F.when(F.col("metric") == "exact_match_rate", repeated).when(F.col("metric") == "cardinality_ratio", F.col("healthy")).otherwise(F.col("score").cast("double"))
    return rows.withColumn("value", value).select("metric", "value", F.when(F.col("value") >= F.col("least_score"), "pass").otherwise("warn").alias("status"))


#: Statuses of an article, best first.
STATUSES = ("pass", "partial", "fail")


def dora_articles(fk: float, temporal: float, about: dict | None) -> dict[str, str]:
    """The six articles of digital operational resilience from two scores and what a dataset says of its making (version, seed), and the worst of them."""
    version, seed = bool(about and about.get("version")), bool(about and about.get("seed") not in (None, "", "N/A"))
    out = {
        "article_6": "pass" if version else "partial" if about else "fail",
        "article_9": "pass" if about else "partial",
        "article_10": "pass" if fk >= 100 and temporal >= 95 else "partial" if fk >= 90 or temporal >= 90 else "fail",
        "article_11": "pass" if seed else "fail",
        "article_12": "pass",
        "article_16": "pass" if version else "partial",
    }
    return out | {"overall": max(out.values(), key=STATUSES.index)}


_DORA_TEN = "CASE WHEN fk >= 100 AND tl >= 95 THEN 'pass' WHEN fk >= 90 OR tl >= 90 THEN 'partial' ELSE 'fail' END"
_DORA = f"""WITH s AS (SELECT max(score) FILTER (WHERE metric = 'fk_integrity') AS fk, max(score) FILTER (WHERE metric = 'temporal_logic') AS tl FROM ({metric_sql(assess._FK, 'fk_integrity', 'structure')} UNION ALL {metric_sql(assess._TEMPORAL, 'temporal_logic', 'structure')}) m),
a AS (SELECT * FROM (VALUES ('none', 'article_6', 'fail'), ('none', 'article_9', 'partial'), ('none', 'article_11', 'fail'), ('none', 'article_12', 'pass'), ('none', 'article_16', 'partial'),
 ('pack', 'article_6', 'pass'), ('pack', 'article_9', 'pass'), ('pack', 'article_11', 'pass'), ('pack', 'article_12', 'pass'), ('pack', 'article_16', 'pass'), ('seed', 'article_6', 'partial'), ('seed', 'article_9', 'pass'), ('seed', 'article_11', 'pass'), ('seed', 'article_12', 'pass'), ('seed', 'article_16', 'partial')) v(provenance, article, status)
 UNION ALL SELECT p, 'article_10', {_DORA_TEN} FROM s, (VALUES ('none'), ('pack'), ('seed')) v(p))
SELECT * FROM a UNION ALL SELECT provenance, 'overall', CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'pass' END FROM a GROUP BY provenance"""


@query("dora_articles", _DORA)
def dora_articles_query(spark, sf_dir):
    """All six articles for the given tables, without word of how they were made, as a saved pack with version and seed, and with a seed alone."""
    fk = assess.reference_rows(spark, sf_dir).agg(F.sum("valid_refs").alias("passed"), F.sum("total_refs").alias("checked"))
    scores = [assess.metric(fk, "fk_integrity", "structure").first()["score"], assess.temporal_logic(spark, sf_dir).first()["score"]]
    path = dumps.scratch(spark, "pack")
    dumps.save_pack({"region": table(spark, sf_dir, "region")}, path, version="1", seed=42)
    known = {"none": None, "pack": dumps.load_pack(spark, path)[1], "seed": {"seed": 7}}
    return spark.createDataFrame([(p, a, s) for p, about in known.items() for a, s in dora_articles(*scores, about).items()], "provenance string, article string, status string")
