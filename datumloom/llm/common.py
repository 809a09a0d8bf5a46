"""What the operators of this package share: safe column picking, words, hashing, shared folders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The named columns and those to carry, found by exact name and position.

    Extra columns never get in the way, not even those that repeat a name or
    differ only in case: the first column of exactly that name counts.
    """
    columns = df.columns
    wanted = [*names, *(c for c in carry if c not in names)]
    missing = [n for n in wanted if n not in columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r} among {columns}")
    if len({c.lower() for c in columns}) == len(columns):
        return df.select(*(F.col(f"`{n}`") for n in wanted))
    plain = df.toDF(*(f"_{i}" for i in range(len(columns))))
    return plain.select(*(F.col(f"_{columns.index(n)}").alias(n) for n in wanted))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the parts alone: 32 bits of their MD5."""
    key = F.concat_ws("|", *parts)
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, the folder
    lies in the warehouse in local mode, and elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again.

    Later jobs start from the written rows, which outlive any executor.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few rows' Python objects exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def taken(data: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie in ``data`` one after another, those numbered ``which`` in that order, and their bounds in the result."""
    kind = np.int32 if max(len(data), len(which)) < 1 << 31 else np.int64
    counts = lengths.astype(kind)[which]
    upto = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=upto[1:])
    some = counts > 0
    counts = counts[some]
    first = (np.cumsum(lengths) - lengths).astype(kind)[which[some]]
    # Steps of 1 within a run; from its last element to the first of the next at each border.
    step = np.ones(int(upto[-1]), dtype=kind)
    step[upto[:-1][some]] = first
    step[upto[:-1][some][1:]] -= first[:-1] + counts[:-1] - 1
    return data[np.cumsum(step, dtype=kind)], upto


def id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of 32-bit ids as a binary column."""
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds), pa.py_buffer(np.ascontiguousarray(ids))])
    return data.cast(pa.binary())


K = TypeVar("K", bound=Hashable)
V = TypeVar("V")


class Memory(Generic[K, V]):
    """What ``learn`` gives for keys, remembered for about the ``size`` keys used last.

    Keys are kept in two generations. When the younger is full it becomes the older,
    whose keys are forgotten unless they are asked for again; so frequent keys stay.
    """

    def __init__(self, learn: Callable[[list[K]], list[V]], size: int):
        self.learn, self.size = learn, size
        self.young: dict[K, V] = {}
        self.old: dict[K, V] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def values(self, keys: list[K]) -> list[V]:
        """The value of each of these distinct keys, in order; all new ones are learned in one call. A value is never None."""
        found = list(map(self.young.get, keys))
        at = [i for i, v in enumerate(found) if v is None]
        if not at:
            return found
        missing = [keys[i] for i in at]
        values = list(map(self.old.get, missing))
        new = [k for k, v in zip(missing, values) if v is None]
        learned = iter(self.learn(new))
        values = [next(learned) if v is None else v for v in values]
        for i, v in zip(at, values):
            found[i] = v
        if len(self.young) + len(missing) > self.size // 2:
            self.old, self.young = self.young, {}
        self.young.update(zip(missing, values))
        return found
