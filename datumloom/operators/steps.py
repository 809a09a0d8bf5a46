"""A query in steps: what each clause adds, as prefix queries that Spark runs one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from datumloom.operators.assess import union
from datumloom.registry import query, views

ORDER = ("from", "where", "group by", "having", "select", "order by", "limit")


def steps(clauses: dict[str, str]) -> list[tuple[str, str]]:
    """(clause, statement up to it) in the order in which a query is evaluated.

    Until SELECT is reached all columns are shown, or the grouping columns with their
    row counts once rows are grouped.
    """
    out, have = [], {}
    for clause in ORDER:
        if clause in clauses:
            have[clause] = clauses[clause]
            shown = have.get("select") or (f"{have['group by']}, count(*) AS n_rows" if "group by" in have else "*")
            text = " ".join(f"{c.upper()} {have[c]}" for c in ("from", "where", "group by", "having", "order by", "limit") if c in have)
            out.append((clause, f"SELECT {shown} {text}"))
    return out


CLAUSES = {
    "from": "orders JOIN customer ON o_custkey = c_custkey",
    "where": "o_totalprice > 50000",
    "group by": "c_mktsegment",
    "having": "count(*) > 10",
    "select": "c_mktsegment, count(*) AS n",
    "order by": "n DESC, c_mktsegment",
    "limit": "3",
}


@query("step_queries", " UNION ALL ".join(f"SELECT {i} AS step, '{c}' AS clause, count(*) AS n FROM ({s}) q{i}" for i, (c, s) in enumerate(steps(CLAUSES), 1)))
def step_queries(spark, sf_dir):
    """Rows after each clause."""
    views(spark, sf_dir, "orders", "customer")
    return union([spark.sql(s).agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(c).alias("clause"), "n") for i, (c, s) in enumerate(steps(CLAUSES), 1)])
