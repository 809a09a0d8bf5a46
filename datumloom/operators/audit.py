"""An audit of a table's rows: a tree of hashes whose root stands for all of them.

A row's hash covers its columns' names and values. Rows are dealt into buckets by a hash
of their key; a bucket's digest covers its rows' hashes in order, and each node of the
levels above covers sixteen below. Equal tables have equal roots, whatever their files.
Two trees show from the root down which buckets differ, and only their rows are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.registry import query, table

#: Rows of a bucket, about; hexadecimal digits of bucket numbers at most.
BUCKET_ROWS, MOST_DIGITS = 256, 6
FAN_OUT = 16


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of all columns: names in order, and values as text with their lengths, nulls apart from empty texts."""
    parts = []
    for c in sorted(df.columns):
        value = F.col(f"`{c}`").cast("string")
        parts += [F.lit(f"{c}="), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")), F.lit("|")]
    return F.sha2(F.concat(*parts), 256)


def digits_for(rows: int) -> int:
    """Hexadecimal digits of bucket numbers for a table of so many rows."""
    digits = 1
    while digits < MOST_DIGITS and rows > BUCKET_ROWS * FAN_OUT**digits:
        digits += 1
    return digits


def hashed(df: DataFrame, key: str, digits: int) -> DataFrame:
    """key, bucket and row_hash of each row."""
    return df.select(F.col(key).cast("string").alias("key"), F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits).alias("bucket"), row_hash(df).alias("row_hash"))


def tree(df: DataFrame, key: str, digits: int) -> DataFrame:
    """level, node, n_rows, digest: buckets at level ``digits``, the root at level 0 with the empty node.

    Rows of a bucket are counted and their hashes added up as numbers before they are
    shuffled, so that rows of one key, however many, are no burden: a bucket's digest
    covers its number of rows and, for each of their hash's four parts, the sum.
    """
    rows = hashed(df, key, digits)
    parts = [F.conv(F.substring("row_hash", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)))
    level = sums.select(F.lit(digits).alias("level"), F.col("bucket").alias("node"), "n_rows", F.sha2(F.concat_ws("|", "n_rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))
    out = level
    for d in range(digits - 1, -1, -1):
        # Sixteen children at most.
        joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit(":"), x["digest"])))
        level = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(joined, 256).alias("digest")).select(F.lit(d).alias("level"), "node", "n_rows", "digest")
        out = out.unionByName(level)
    return out


def root(df: DataFrame, key: str, digits: int) -> str:
    """The one digest that stands for a table; that of nothing for an empty one."""
    found = tree(df, key, digits).where("level = 0").select("digest").first()
    return found["digest"] if found else ""


def differing(before: DataFrame, after: DataFrame, digits: int) -> DataFrame:
    """Buckets whose digests differ between two trees, or that only one has."""
    a, b = (t.where(F.col("level") == digits).select(F.col("node").alias("bucket"), F.col("digest").alias(d)) for t, d in ((before, "d1"), (after, "d2")))
    return a.join(b, "bucket", "full").where(~F.col("d1").eqNullSafe(F.col("d2"))).select("bucket")


def changes(old: DataFrame, new: DataFrame, key: str, digits: int) -> DataFrame:
    """key and change (added, removed, changed) of rows that differ, found in the buckets that differ.

    Rows with equal keys are compared as a bag: a key is changed if its rows' hashes aren't the same ones as often.
    """
    buckets = differing(tree(old, key, digits), tree(new, key, digits), digits)

    def some(df: DataFrame, side: str) -> DataFrame:
        rows = hashed(df, key, digits).join(buckets, "bucket", "left_semi")
        parts = [F.sum(F.conv(F.substring("row_hash", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
        return rows.groupBy("key").agg(F.struct(F.count("*"), *parts).alias(side))

    both = some(old, "old").join(some(new, "new"), "key", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", change.alias("change"))


def _plain(df: DataFrame) -> DataFrame:
    """Orders with columns that both engines write alike as text."""
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


def _altered(df: DataFrame) -> DataFrame:
    """Some rows removed, some changed, some added."""
    rest = df.where("o_orderkey % 101 <> 7").withColumn("o_orderstatus", F.when(F.expr("o_orderkey % 97 = 5"), F.lit("X")).otherwise(F.col("o_orderstatus")))
    return rest.unionByName(df.where("o_orderkey % 211 = 3").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


_ROWS = """SELECT o_orderkey::VARCHAR AS key, sha256('o_custkey=' || coalesce(length(o_custkey::VARCHAR) || ':' || o_custkey, '-') || '|o_orderdate=' || coalesce('10:' || strftime(o_orderdate, '%Y-%m-%d'), '-')
 || '|o_orderkey=' || coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey, '-') || '|o_orderpriority=' || coalesce(length(o_orderpriority) || ':' || o_orderpriority, '-')
 || '|o_orderstatus=' || coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-') || '|') AS h FROM orders"""
_SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 15))::HUGEINT)::HUGEINT AS s{i}" for i in range(4))


def _tree_sql(digits: int) -> str:
    levels = f"l{digits} AS (SELECT {digits} AS level, node, n_rows, sha256(n_rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest FROM (SELECT substr(md5(key), 1, {digits}) AS node, count(*) AS n_rows, {_SUMS} FROM rows GROUP BY 1) b)"
    for d in range(digits - 1, -1, -1):
        levels += f", l{d} AS (SELECT {d} AS level, substr(node, 1, {d}) AS node, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM l{d + 1} GROUP BY 2)"
    return f"WITH rows AS ({_ROWS}), {levels} " + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(digits + 1))


@query("audit_tree", _tree_sql(2))
def audit_tree(spark, sf_dir):
    """The tree of hashes of the orders, over 256 buckets."""
    return tree(_plain(table(spark, sf_dir, "orders")), "o_orderkey", 2)


@query(
    "audit_changes",
    """SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 101 = 7 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 101 = 7 OR (o_orderkey % 97 = 5 AND o_orderstatus <> 'X')
UNION ALL SELECT (-o_orderkey - 1)::VARCHAR, 'added' FROM orders WHERE o_orderkey % 211 = 3""",
)
def audit_changes(spark, sf_dir):
    """Orders removed, changed and added in an altered copy, found by the two trees."""
    orders = _plain(table(spark, sf_dir, "orders"))
    return changes(orders, _altered(orders), "o_orderkey", 2)
