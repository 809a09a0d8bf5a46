"""Structured Streaming over the events: windows, sessions and duplicates, run until all input is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.registry import query, table
from datumloom.sources.dumps import scratch


#: State that may outgrow an executor's memory, and that has timers, needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark, sf_dir: str, files_at_once: int | None = None) -> DataFrame:
    """The events as a stream of files, with a watermark of an hour."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def run(df: DataFrame, mode: str, path: str | None = None, keys: Sequence[str] = (), after: Callable[[int], None] | None = None) -> DataFrame:
    """All results of a stream once its input is used up, read from the shared folder.

    Each batch is written under its own number, so one that is repeated after a failure
    replaces itself. With a ``path``, state, progress and results lie there and a run that
    is started again goes on where the last one was. In update mode a batch holds the rows
    that changed, and the last version of each of the ``keys`` is read. ``after`` is called
    with the number of each batch that is written.
    """
    spark = df.sparkSession
    path = path or scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if after:
            after(number)

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        done = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    rows = spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode != "update":
        return rows.drop("batch")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *(F.col(f"_last.{c}") for c in rest))


def plain(column: str):
    return F.col(column).cast("timestamp_ntz")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Windows of an hour by type; the state of one is dropped when the watermark has passed it."""
    counts = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return run(counts, "update", keys=["window", "event_type"]).select(plain("window.start").alias("start"), "event_type", "n", "most")


@query("stream_sliding", "SELECT b + INTERVAL 1 HOUR * i::INT - INTERVAL 1 HOUR AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events) e, range(2) r(i) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    """Windows of two hours, one beginning each hour."""
    counts = stream(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return run(counts, "update", keys=["window"]).select(plain("window.start").alias("start"), "n")


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session
 HAVING epoch_us(max(ts)) + 7200000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)""",
)
def stream_session(spark, sf_dir):
    """A user's events with gaps under two hours: the sessions that have ended, by the watermark, when the input is used up."""
    counts = stream(spark, sf_dir).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return run(counts, "append").select("user_id", plain("session_window.start").alias("start"), plain("session_window.end").alias("end"), "n")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The stream beside itself, each event kept once."""
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "append")
