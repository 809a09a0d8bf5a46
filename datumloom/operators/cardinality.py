"""Children drawn for given parents: how many each one has, and where each child row lies.

The number of a parent's children is drawn from a distribution by a hash of its key. A
child's row number counts the children of all parents before it, in the order of a hash;
it is the sum over earlier buckets of parents plus that within the bucket, so the numbers
have no gaps and no task orders all parents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import uniform, uniform_sql
from datumloom.registry import query, table

#: Parents of a bucket, about, and buckets at most (their sums are one window's).
BUCKET_ROWS, MOST_BUCKETS = 100_000, 65_536
#: Fixed value: no parent has more children.
MOST_CHILDREN = 20


@dataclass(frozen=True)
class Children:
    """How many children a parent has: ``fixed`` (mean), ``uniform`` (least to most) or ``poisson`` (mean)."""

    kind: str
    mean: float = 1.0
    least: int = 0
    most: int = MOST_CHILDREN

    def weights(self) -> list[float]:
        """The chance of 0, 1, ... ``most`` children; a Poisson tail goes to the most."""
        if self.kind == "fixed":
            return [float(k == min(round(self.mean), self.most)) for k in range(self.most + 1)]
        if self.kind == "uniform":
            return [float(self.least <= k <= self.most) / (self.most - self.least + 1) for k in range(self.most + 1)]
        if self.kind != "poisson":
            raise ValueError(f"no distribution {self.kind!r}")
        chance, out = 2.718281828459045**-self.mean, []
        for k in range(self.most):
            out.append(chance if k >= self.least else 0.0)
            chance *= self.mean / (k + 1)
        return [*out, max(0.0, 1 - sum(out))] if self.least == 0 else [x / max(sum(out), 1e-12) for x in [*out, 0.0]]

    def bounds(self) -> list[float]:
        """Cumulated chances: a draw u gives as many children as there are bounds at or below it."""
        total, out = 0.0, []
        for w in self.weights()[:-1]:
            total += w
            out.append(round(total, 12))
        return out

    def drawn(self, u: Column) -> Column:
        return sum((F.when(u >= b, 1).otherwise(0) for b in self.bounds()), F.lit(0))

    def drawn_sql(self, u: str) -> str:
        return "(" + " + ".join(f"({u} >= {b!r}::DOUBLE)::INT" for b in self.bounds()) + ")"


def with_children(parents: DataFrame, key: str, children: Children, name: str, seed: int = 42, rows: int | None = None) -> DataFrame:
    """key, child_no (from 0 for each parent) and row_no (from 0 over all children, without gaps) of each child.

    Parents with a null key have no children; of parents with equal keys each has its own.
    """
    rows = parents.count() if rows is None else rows
    n_buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col(key).cast("string")))
    drawn = parents.where(F.col(key).isNotNull()).select(key, digest.alias("_h"), children.drawn(uniform(str(seed), name, "children", F.col(key))).alias("_n"))
    drawn = drawn.where("_n > 0").withColumn("_bucket", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * n_buckets / 2**32).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most so many rows as there are buckets.
    sums = drawn.groupBy("_bucket").agg(F.sum("_n").alias("_total")).select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.join(F.broadcast(sums), "_bucket").withColumn("_first", F.sum("_n").over(within) - F.col("_n") + F.col("_before"))
    return placed.select(key, F.posexplode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("child_no", "row_no"))


ACCOUNTS = Children("poisson", mean=2.5)


def _children_sql(children: Children, name: str, source: str, key: str) -> str:
    drawn = f"SELECT {key}, md5('42|{name}|' || {key}) AS h, {children.drawn_sql(uniform_sql('42', name, 'children', key))} AS n FROM {source} WHERE {key} IS NOT NULL"
    return f"SELECT {key}, h, n, sum(n) OVER (ORDER BY h, {key} ROWS UNBOUNDED PRECEDING) - n AS first FROM ({drawn}) d WHERE n > 0"


@query("children_by_parent", f"SELECT c_custkey, i::INT AS child_no, (first + i)::BIGINT AS row_no FROM ({_children_sql(ACCOUNTS, 'accounts', 'customer', 'c_custkey')}) p, range({MOST_CHILDREN}) r(i) WHERE i < n")
def children_by_parent(spark, sf_dir):
    """Accounts for each customer: their number drawn by key, their rows numbered over all customers."""
    return with_children(table(spark, sf_dir, "customer"), "c_custkey", ACCOUNTS, "accounts")


@query(
    "children_spread",
    "WITH "
    + ", ".join(f"{k} AS (SELECT n FROM (SELECT {c.drawn_sql(uniform_sql('42', k, 'children', 'o_orderkey'))} AS n FROM orders) d WHERE n > 0)" for k, c in (("poisson", Children("poisson", 4)), ("uniform", Children("uniform", least=1, most=6)), ("fixed", Children("fixed", 3))))
    + " "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS parents, sum(n)::BIGINT AS children, max(n)::INT AS most FROM {k}" for k in ("poisson", "uniform", "fixed")),
)
def children_spread(spark, sf_dir):
    """Parents with children, children, and the most of one parent, for three distributions over the orders."""
    orders, out = table(spark, sf_dir, "orders"), None
    for kind, children in (("poisson", Children("poisson", 4)), ("uniform", Children("uniform", least=1, most=6)), ("fixed", Children("fixed", 3))):
        each = with_children(orders, "o_orderkey", children, kind).groupBy("o_orderkey").agg(F.count("*").alias("n"))
        row = each.agg(F.lit(kind).alias("kind"), F.count("*").alias("parents"), F.sum("n").alias("children"), F.max("n").cast("int").alias("most"))
        out = row if out is None else out.unionByName(row)
    return out
