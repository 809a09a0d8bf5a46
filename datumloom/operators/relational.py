"""Relational queries: joins, aggregates, windows, sorts and set operations over the star schema.

Each is a statement that Spark and DuckDB both run, so it is its own oracle.
"""

from __future__ import annotations

from datumloom.registry import query, views

#: name -> (tables, statement)
STATEMENTS: dict[str, tuple[str, str]] = {
    "inner_join": ("customer nation", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000"),
    "multi_join": (
        "lineitem orders customer nation region",
        """SELECT r_name, n_name, count(*) AS n_items, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    ),
    "left_join_zero_counts": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "anti_join": ("customer orders", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL"),
    "self_join": ("supplier", "SELECT a.s_suppkey AS suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "in_semi_join": ("customer orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)"),
    "exists_or": (
        "customer orders",
        """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""",
    ),
    "not_in_exclusion": ("part lineitem", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)"),
    "full_outer_join": (
        "customer supplier",
        """SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
        FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) c
        FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k""",
    ),
    "conditional_agg": (
        "orders",
        """SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_filled,
        count(*) FILTER (WHERE o_totalprice > 150000) AS n_large, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority""",
    ),
    "having_filter": ("lineitem", "SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND avg(l_quantity) > 20"),
    "count_distinct_funnel": (
        "events",
        """SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewed, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicked,
        count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS bought, count(DISTINCT user_id) AS users FROM events""",
    ),
    "running_total": (
        "orders",
        """SELECT day, total, sum(total) OVER (ORDER BY day) AS running FROM
        (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total FROM orders GROUP BY CAST(o_orderdate AS DATE)) t""",
    ),
    "partitioned_running_total": (
        "orders",
        """SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS balance FROM orders""",
    ),
    "rank_within_group": (
        "orders customer nation",
        """SELECT n_name, c_mktsegment, n_orders, rank() OVER (PARTITION BY n_name ORDER BY n_orders DESC) AS place FROM
        (SELECT n_name, c_mktsegment, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment) t""",
    ),
    "lag_growth": (
        "orders",
        """SELECT month, n, n - lag(n, 1) OVER (ORDER BY month) AS growth FROM
        (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) t""",
    ),
    "window_frames": (
        "events",
        """SELECT event_id, row_number() OVER w AS nth, ntile(4) OVER w AS quarter, first_value(event_type) OVER w AS first_type,
        max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    # Places are numbered after the limit, so that no task sees the whole table.
    "case_order": (
        "orders",
        """SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY state, o_totalprice DESC, o_orderkey) AS place FROM
        (SELECT o_orderkey, o_orderpriority, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS state FROM orders ORDER BY state, o_totalprice DESC, o_orderkey LIMIT 100) t""",
    ),
    "nulls_last": (
        "customer",
        """SELECT c_custkey, balance, row_number() OVER (ORDER BY balance DESC NULLS LAST, c_custkey) AS place FROM
        (SELECT c_custkey, CASE WHEN c_acctbal < 9000 THEN NULL ELSE c_acctbal END AS balance FROM customer ORDER BY balance DESC NULLS LAST, c_custkey LIMIT 500) t""",
    ),
    "topk_offset": ("part", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10"),
    "histogram10": (
        "orders",
        """SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor((o_totalprice - lo) / CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1 END), 9) AS INT) AS bin
        FROM orders CROSS JOIN (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) b) t GROUP BY bin""",
    ),
    "duration_buckets": (
        "events",
        """SELECT bucket, count(*) AS n, min(value) AS least, max(value) AS most FROM (SELECT value, CAST(least(floor((value - lo) * 5 / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 4) AS INT) AS bucket
        FROM events CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events) b) t GROUP BY bucket""",
    ),
    "predicates": (
        "part",
        """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS size_class, greatest(p_size, 10) AS at_least, coalesce(nullif(p_size, 1), 0) AS size_or_zero
        FROM part WHERE p_brand LIKE 'Brand#1%' AND p_retailprice BETWEEN 900 AND 2000 AND p_size NOT IN (3, 5)""",
    ),
    "set_operations": (
        "customer supplier",
        """(SELECT c_nationkey AS k, 'intersect' AS op FROM customer INTERSECT SELECT s_nationkey, 'intersect' FROM supplier)
        UNION ALL (SELECT c_nationkey, 'except' FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey, 'except' FROM supplier WHERE s_acctbal > 5000)
        UNION ALL (SELECT n, 'union' FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier) u)""",
    ),
    "distinct_rows": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "grouping_sets": (
        "orders",
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g_status, CAST(grouping(o_orderpriority) AS INT) AS g_priority
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
    ),
    "right_outer_join": (
        "nation supplier",
        "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    ),
    "cross_join_small": (
        "region nation",  # a fixed 5 by 25 rows
        "SELECT r_name, n_name, r_regionkey = n_regionkey AS belongs FROM region CROSS JOIN nation",
    ),
    "rollup_totals": (
        "orders",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "cube_counts": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g_flag, CAST(grouping(l_linestatus) AS INT) AS g_status FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "parent_lookup": (
        "customer nation",  # a parent by reference, or else the one at the row number modulo the number of parents
        """SELECT c_custkey, coalesce(a.n_name, b.n_name) AS n_name, a.n_name IS NULL AS by_place
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 1000 ELSE c_nationkey END AS k, c_custkey % (SELECT count(*) FROM nation) AS place FROM customer) c
        LEFT JOIN nation a ON a.n_nationkey = c.k
        LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation) b ON b.place = c.place""",
    ),
    "credibility_counts": (
        "customer orders lineitem",
        """SELECT c.c_custkey, coalesce(o.n_orders, 0) AS n_orders, coalesce(o.n_urgent, 0) AS n_urgent, coalesce(l.n_items, 0) AS n_items, coalesce(l.n_returned, 0) AS n_returned FROM customer c
        LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_items, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON l.o_custkey = c.c_custkey""",
    ),
    "telemetry_active_users": (
        "events",
        """SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS daily_users, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM events GROUP BY CAST(ts AS DATE)""",
    ),
    "facet_counts": ("part", "SELECT brand_part AS facet, count(*) AS n FROM (SELECT split_part(p_brand, '#', 2) AS brand_part FROM part) t GROUP BY brand_part"),
    "reconciliation": (
        "lineitem orders",
        """SELECT o_orderkey, o_totalprice, computed, CASE WHEN abs(o_totalprice - computed) < 0.01 THEN 'match' ELSE 'differs' END AS verdict FROM orders JOIN
        (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS computed FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
    ),
}


def _register(name: str, tables: str, statement: str) -> None:
    @query(name, statement)
    def run(spark, sf_dir):
        views(spark, sf_dir, *tables.split())
        return spark.sql(statement)


for _name, (_tables, _statement) in STATEMENTS.items():
    _register(_name, _tables, _statement)


@query(
    "gap_fill_months",
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE month(o_orderdate) % 2 = 0 GROUP BY 1),
    b AS (SELECT min(month) AS lo, max(month) AS hi FROM m)
    SELECT g.month::DATE AS month, coalesce(m.n, 0) AS n FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM b) g LEFT JOIN m ON m.month = g.month::DATE""",
)
def gap_fill_months(spark, sf_dir):
    """Orders of even months, with every month between the first and the last."""
    views(spark, sf_dir, "orders")
    return spark.sql(
        """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE month(o_orderdate) % 2 = 0 GROUP BY 1),
        g AS (SELECT explode(sequence(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m)
        SELECT g.month, coalesce(m.n, 0) AS n FROM g LEFT JOIN m ON m.month = g.month"""
    )
