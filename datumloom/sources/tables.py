"""Tables of databases, text files with sniffed types, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.operators.profile import UUID
from datumloom.plans import star
from datumloom.registry import query, table
from datumloom.sources.dumps import scratch


#: What a column's values have to look like, the first that all of them do decides.
SNIFFED = {"UUID": UUID, "INTEGER": "^-?[0-9]+$", "NUMERIC": "^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$", "BOOLEAN": "^(?i:true|false)$", "TIMESTAMP": "^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+Z?)?$"}


def read_jdbc(spark: SparkSession, url: str, name: str, columns: list[str] | None = None, limit: int | None = None, key: str | None = None, parts: int = 16, **options) -> DataFrame:
    """A database's table; columns and limits are pushed to it. With a numeric key it is read in parts by ranges of the key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}", **options).load().first()
        if bounds["lo"] is not None:
            reader = reader.options(partitionColumn=key, lowerBound=bounds["lo"], upperBound=bounds["hi"], numPartitions=parts)
    df = reader.load()
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def write_jdbc(df: DataFrame, url: str, name: str, replace: bool = False, batch: int = 1000, **options) -> None:
    """Batched inserts; replacing truncates the table, so its definition and references stay."""
    df.write.format("jdbc").options(url=url, dbtable=name, truncate=replace, cascadeTruncate=replace, batchsize=batch, **options).mode("overwrite" if replace else "append").save()


def sniffed(df: DataFrame) -> dict[str, str]:
    """The type that all non-empty values of each text column have: UUID, INTEGER, NUMERIC, BOOLEAN, TIMESTAMP, else TEXT."""
    checks = [F.coalesce(F.min(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c).rlike(p))), F.lit(False)).alias(f"{c}|{kind}") for c in df.columns for kind, p in SNIFFED.items()]
    row = df.agg(*checks).first()
    return {c: next((kind for kind in SNIFFED if row[f"{c}|{kind}"]), "TEXT") for c in df.columns}


def read_log(spark: SparkSession, path: str, since: str | None = None, command: str | None = None, last: int | None = None, key: str | None = None, schema: str | None = None) -> DataFrame:
    """A log of JSON lines, from a time on, of one command, the last so many entries.

    Times are texts of one form, at the log's full precision. Of entries of one time those
    with the smallest ``key`` come first. With a ``schema`` the log is read once.
    """
    df = spark.read.json(path, schema=schema)
    df = df.where(F.col("at") >= since) if since else df
    df = df.where(F.col("command") == command) if command else df
    return df.orderBy(F.col("at").desc(), *([F.col(key).asc_nulls_last()] if key else [])).limit(last) if last else df


_SNIFFED = " ".join(f"WHEN bool_and(regexp_matches(v, '{p}')) THEN '{k}'" for k, p in SNIFFED.items())


def _csv_sql() -> str:
    as_text = {"o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"}
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE {_SNIFFED} ELSE 'TEXT' END AS type FROM (SELECT {as_text.get(c, f'{c}::VARCHAR')} AS v FROM orders) t WHERE v <> ''" for c in star.COLUMNS["orders"])


@query("csv_types", _csv_sql())
def csv_types(spark, sf_dir):
    """Types of a CSV file's columns, from all of its values."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).write.csv(path, header=True)
    return spark.createDataFrame(sorted(sniffed(spark.read.csv(path, header=True)).items()), "column string, type string")


@query("log_scan", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS command FROM events WHERE event_type = 'error' AND strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-10' ORDER BY ts DESC, event_id LIMIT 20")
def log_scan(spark, sf_dir):
    """The last twenty errors since a day, from a log of JSON lines."""
    path = scratch(spark, "log")
    table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("event_type").alias("command")).write.json(path)
    found = read_log(spark, path, since="2024-01-10", command="error", last=20, key="event_id", schema="event_id long, at string, command string")
    return found.select("event_id", F.substring("at", 1, 19).alias("at"), "command")
