"""Connected components of a large graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage


#: Parts that a node's edges are dealt into, 63 at most.
SALTS = 32


def _least(edges: DataFrame, of: str, to: str) -> DataFrame:
    """Each edge with the least of its node ``of`` and that node's neighbours ``to``.

    The minimum is combined before the shuffle, so a node with many neighbours is no
    burden there. For the join its edges are dealt into parts by a salt, and the least
    goes to each part that there is (bits of one number), so such a node is many keys.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(to), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(of).agg(F.least(F.min(to), F.first(of)).alias("least"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts"))
    there = F.filter(F.array(*map(F.lit, range(SALTS))), lambda i: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return salted.join(least.select(of, "least", F.explode(there).alias("salt")), [of, "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) for every node with an edge to another node.

    Each round links a node's larger neighbours to the least node around it (large
    star), then its smaller neighbours and itself (small star), until nothing
    changes: a number of rounds that grows with the logarithm of the longest path.
    Rounds are written to the shared folder. Loops, repeated edges and nulls are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    current = cut_lineage(pairs, "edges")
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        held = _least(large, "u", "v")
        small = held.select(F.col("v").alias("u"), F.col("least").alias("v")).union(held.select("u", F.col("least").alias("v"))).where("u > v").distinct()
        current = cut_lineage(small, "edges")
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
