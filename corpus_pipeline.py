"""The corpus pipeline: toxicity, quality, near duplicates, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``,
all but the last, which returns the packed pieces. ``run`` writes each stage's rows to
the shared folder and reads them for the next, so a stage runs once and a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.llm import near_dedup, packing, pairwise_quality, toxicity
from datumloom.llm.common import cut_lineage, pick

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, doesn't find toxic.

    Null and empty texts have no toxic word and stay. Without labels all stay.
    """
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.grade(docs, model, carry=COLUMNS).where("kept").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise quality score reaches the threshold; without labels all stay."""
    model = pairwise_quality.fit(docs, _labels(spark, sf_dir))
    return pairwise_quality.score(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of at least 0.8.

    The document with the group's least id stays. Rows that repeat a kept id and its text
    stay once; different texts of one kept id all stay, since an id is one document.
    Documents with a null id can't be grouped and stay.
    """
    docs = pick(docs, *COLUMNS)
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    dropped = cut_lineage(found.where("not kept").select("doc_id").distinct(), "dropped")
    left = docs.join(_small(dropped), "doc_id", "left_anti")
    # Only ids that occur twice can have repeated rows; the other texts aren't shuffled.
    twice = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    named = left.join(_small(twice), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return named.select("doc_id", "text", "row.*").unionByName(left.join(_small(twice), "doc_id", "left_anti")).select(*COLUMNS)


def _small(ids: DataFrame) -> DataFrame:
    """Ids, broadcast up to a number of them (16 bytes each), else joined by shuffling."""
    return F.broadcast(ids) if ids.count() <= near_dedup.BROADCAST_IDS else ids


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents' pieces in windows of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("packing", pack_windows),
]

#: Learned models and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs, name.replace(" ", "-"))
    return docs
