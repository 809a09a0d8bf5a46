"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional
rank says how far through its source it lies. Sorted by fractional rank, every
stretch of the corpus holds the sources in their overall proportions, so cutting
the order into equal stretches gives shards that all match the mixture.

No stage sorts the corpus or a source in one task. A rank is a row's place within
a (source, hash prefix) bucket plus the number of rows in the source's earlier
buckets, and a position is found the same way from ranges of the fractional rank.
Both bucket counts are small tables. All of it is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datumloom.llm.common import pick, uniform

#: Rows that a bucket should hold at most, on average, once there are 256 buckets.
BUCKET_ROWS = 1_000_000


def hash_digits(n_rows: int) -> int:
    """Hex digits of the hash that name a bucket: 2 (256 buckets) to 4 (65,536)."""
    digits = 2
    while digits < 4 and n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def interleave(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards whose row counts differ by one at most.

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, the columns in
    ``carry``, position (in the whole order), shard and slot (from 0, gapless in
    the shard).

    - A null text counts as empty: size 1 and checksum 0.
    - A null source is a source of its own. A null id hashes like an empty one.
    - Rows with the same id are ordered by size and checksum; rows that tie there
      too are interchangeable. Every row keeps its own slot.
    - An empty table gives an empty result. With fewer rows than shards some
      shards stay empty.
    - Carried columns named like an output are dropped in favour of the output.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    made = {"size", "text_crc32", "position", "shard", "slot"}
    carry = tuple(c for c in carry if c not in made | {id_col})
    digits = hash_digits(docs.count())
    rows = pick(docs, id_col, text_col, source_col, carry=carry).select(
        F.col(id_col),
        *(F.col(c) for c in carry if c not in (text_col, source_col)),
        *(F.col(c) for c in (text_col, source_col) if c in carry),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_source"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_hash"),
    )
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
    ties = [F.col("_hash"), F.col(id_col), F.col("size"), F.col("text_crc32")]

    in_source = Window.partitionBy("_source")
    earlier = in_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n")).select(
        "_source",
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(in_source).alias("_total"),
    )
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy(*ties)) + F.col("_before")
    # One offset for each source, so that sources of a single row don't all meet at one fraction.
    offset = uniform(F.lit(str(seed)), F.col("_source"))
    n_ranges = 16**digits
    placed = (
        rows.join(buckets, ["_source", "_bucket"])
        .withColumn("_fraction", (rank - offset) / F.col("_total"))
        .withColumn("_range", F.least(F.floor(F.col("_fraction") * n_ranges), F.lit(n_ranges - 1)).cast("int"))
    )

    everything = Window.partitionBy()
    lower = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range",
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"),
        F.sum("_n").over(everything).alias("_all"),
    )
    within = Window.partitionBy("_range").orderBy("_fraction", "_source", *ties)
    # ranges has n_ranges rows at most, 65,536 whatever the input.
    return (
        placed.join(F.broadcast(ranges), "_range")
        .withColumn("position", (F.row_number().over(within) - 1 + F.col("_lower")).cast("long"))
        .withColumn("shard", F.expr(f"position * {n_shards} div _all").cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * _all + {n_shards - 1}) div {n_shards}").cast("long"))
        .select(id_col, "size", "text_crc32", *carry, "position", "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write what ``interleave`` gave, one folder for each shard, each in slot order.

    A shard is split into files by ranges of slots, so no task holds a whole shard.
    """
    files = max(1, sharded.sparkSession.sparkContext.defaultParallelism // n_shards) * n_shards
    (
        sharded.repartitionByRange(files, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )
