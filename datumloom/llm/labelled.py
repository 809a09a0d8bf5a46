"""Labelled rows, all or a bounded sample, for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import pick

#: So many labelled ids are sent to all tasks at most.
BROADCAST_IDS = 1_000_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``max_rows`` labelled texts at most (None: all), none of them held out: id, text, label (0 or 1).

    Of more, the rows with the least hash of (id, label) are taken, so the sample depends on
    the data alone. An id that is labelled more than once counts once, with its
    largest label; other labels than 0 and 1 don't count. A document that occurs more
    than once counts once, with its least text. A null text counts as empty.
    """
    ids = (
        pick(labels, id_col, label_col)
        .where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    if max_rows is not None:
        ids = ids.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_rows)
    texts = pick(docs, id_col, text_col).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    # About 12 bytes an id; more of them go through a shuffled join.
    few = max_rows is not None and max_rows <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS
    # Combined before the shuffle, so that an id with any number of rows sends one text a task.
    return texts.join(F.broadcast(ids) if few else ids, id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))
