"""Search and recommendation over the corpus and the events: BM25, ranking, related items, usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datumloom.functions.numbers import places, places_sql
from datumloom.registry import query, table

TERMS = ("the", "worthless", "ention")


def bm25(docs: DataFrame, terms: tuple[str, ...], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id and score of documents that hold a term. Term counts come from one scan; only matching words are exploded."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    lengths = docs.select("doc_id", F.size(words).alias("len"), F.filter(words, lambda w: w.isin(*terms)).alias("hits"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = lengths.select("doc_id", "len", F.explode("hits").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    # df has a row for each query term, totals one row.
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals)).groupBy("doc_id").agg(places(F.sum(idf * weight), 6).alias("score"))


_IN = ", ".join(f"'{t}'" for t in TERMS)


@query(
    "bm25_search",
    f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents), l AS (SELECT doc_id, len(ws) AS n, list_filter(ws, lambda w: w IN ({_IN})) AS hits FROM d),
 a AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(hits) AS term FROM l) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
 SELECT doc_id, {places_sql('sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)))', 6)} AS score FROM tf JOIN df USING (term), a GROUP BY doc_id""",
)
def bm25_search(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), TERMS)


@query(
    "discover_rank",
    """SELECT p_partkey, n_sold, n_returned, row_number() OVER (ORDER BY n_sold - 3 * n_returned DESC, p_partkey) AS place FROM (SELECT p_partkey, count(l_orderkey) AS n_sold, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
 FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey) t ORDER BY place LIMIT 50""",
)
def discover_rank(spark, sf_dir):
    """The fifty parts of the best signal: sales less three times the returns."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_sold"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    joined = parts.join(counts, parts.p_partkey == counts.l_partkey, "left").select("p_partkey", F.coalesce("n_sold", F.lit(0)).alias("n_sold"), F.coalesce("n_returned", F.lit(0)).alias("n_returned"))
    signal = F.col("n_sold") - 3 * F.col("n_returned")
    best = joined.orderBy(signal.desc(), "p_partkey").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(signal.desc(), "p_partkey")))  # of fifty rows


@query(
    "related_items",
    """WITH me AS (SELECT * FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)) SELECT o.p_partkey, (o.p_brand = me.p_brand)::INT + 3 * (o.p_type = me.p_type)::INT + (abs(o.p_size - me.p_size) <= 2)::INT AS score
 FROM part o, me WHERE o.p_partkey <> me.p_partkey ORDER BY score DESC, o.p_partkey LIMIT 6""",
)
def related_items(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    me = parts.orderBy("p_partkey").limit(1).select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))
    score = (F.col("p_brand") == F.col("b")).cast("int") + 3 * (F.col("p_type") == F.col("t")).cast("int") + (F.abs(F.col("p_size") - F.col("s")) <= 2).cast("int")
    return parts.crossJoin(F.broadcast(me)).where("p_partkey <> k").select("p_partkey", score.alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(6)  # me is one row


@query(
    "recommend",
    """WITH h AS (SELECT o_custkey, p_brand, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_brand) AS place FROM h) SELECT o_custkey, p_brand, n, place FROM t WHERE place <= 3""",
)
def recommend(spark, sf_dir):
    """Each customer's three favourite brands."""
    orders, items, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    bought = orders.join(items, orders.o_orderkey == items.l_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    counts = bought.groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), "p_brand"))
    return counts.withColumn("place", place).where("place <= 3")


_AS_OF = "(SELECT max(ts) AS as_of FROM events)"


@query(
    "usage_stats",
    f"SELECT count(DISTINCT user_id) FILTER (WHERE ts > as_of - INTERVAL 1 DAY) AS dau, count(DISTINCT user_id) FILTER (WHERE ts > as_of - INTERVAL 14 DAY) AS two_weeks, count(DISTINCT user_id) FILTER (WHERE ts > as_of - INTERVAL 30 DAY) AS mau, count(*) AS n FROM events, {_AS_OF} a",
)
def usage_stats(spark, sf_dir):
    """Users of the last day, fortnight and month before the last event."""
    events = table(spark, sf_dir, "events")
    rows = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("as_of"))))  # one row
    within = lambda days: F.count_distinct(F.when(F.col("ts") > F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"), F.col("user_id")))
    return rows.agg(within(1).alias("dau"), within(14).alias("two_weeks"), within(30).alias("mau"), F.count("*").alias("n"))


@query("text_search", "SELECT doc_id, source FROM documents WHERE text LIKE '%thing%' ORDER BY doc_id DESC LIMIT 50")
def text_search(spark, sf_dir):
    """The newest fifty documents that contain a string."""
    return table(spark, sf_dir, "documents").where(F.col("text").contains("thing")).select("doc_id", "source").orderBy(F.col("doc_id").desc()).limit(50)


def chart_kind(types: list[tuple[str, str]], n_rows: int) -> str:
    """The chart that suits a result, from its columns' types."""
    numbers = [n for n, t in types if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")]
    times = [n for n, t in types if t.startswith(("date", "timestamp"))]
    if n_rows == 1 and len(numbers) == len(types) == 1:
        return "kpi"
    if times and numbers:
        return "line"
    if len(types) == 2 and len(numbers) == 1:
        return "pie" if n_rows <= 6 else "bar"
    return "scatter" if len(numbers) == len(types) >= 2 else "table"


_PLOTTED = {"status counts": ("SELECT o_orderstatus AS a, count(*) AS b FROM orders GROUP BY 1", 2), "daily orders": ("SELECT o_orderdate::DATE AS a, count(*) AS b FROM orders GROUP BY 1", 2), "customers' orders": ("SELECT o_custkey::VARCHAR AS a, count(*) AS b FROM orders GROUP BY 1", 2), "total": ("SELECT count(*) AS a FROM orders", 1)}


def _chart_sql(name: str, result: str, n_columns: int) -> str:
    """The chart from what the database says of the result's types and rows."""
    kinds = ", ".join(f"any_value(typeof({c})) AS t{c}" for c in "ab"[:n_columns])
    times = " OR ".join(f"t{c} IN ('DATE', 'TIMESTAMP')" for c in "ab"[:n_columns])
    numbers = " + ".join(f"(t{c} IN ('BIGINT', 'INTEGER', 'DOUBLE'))::INT" for c in "ab"[:n_columns])
    cases = f"WHEN n = 1 AND {n_columns} = 1 AND {numbers} = 1 THEN 'kpi' WHEN ({times}) AND {numbers} > 0 THEN 'line' WHEN {n_columns} = 2 AND {numbers} = 1 THEN CASE WHEN n <= 6 THEN 'pie' ELSE 'bar' END WHEN {n_columns} >= 2 AND {numbers} = {n_columns} THEN 'scatter' ELSE 'table' END"
    return "SELECT '" + name.replace("'", "''") + f"' AS result, CASE {cases} AS chart FROM (SELECT count(*) AS n, {kinds} FROM ({result}) r) k"


@query("chart_inference", " UNION ALL ".join(_chart_sql(n, r, k) for n, (r, k) in _PLOTTED.items()))
def chart_inference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    results = {"status counts": orders.groupBy("o_orderstatus").count(), "daily orders": orders.groupBy(F.to_date("o_orderdate").alias("d")).count(), "customers' orders": orders.groupBy(F.col("o_custkey").cast("string").alias("c")).count(), "total": orders.agg(F.count("*").alias("n"))}
    return spark.createDataFrame([(name, chart_kind(df.dtypes, df.limit(7).count())) for name, df in results.items()], "result string, chart string")
