"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits, each the majority of that bit over the hashes of
its shingles. Documents link if their fingerprints differ in few bits.

1. Documents of equal fingerprints form a class; only distinct fingerprints go on.
2. Counts over all of them give the correlations of bits and, for eight groups of eight
   correlated bits, how often each value occurs. Parts are made of whole groups.
3. If the parts' thresholds, each -1 or more, plus 1 each add up to the distance plus 1,
   then two fingerprints within the distance are within the threshold in some part. For
   each fingerprint a dynamic program deals these units to the parts so that the probes
   and the candidates that they are estimated to meet are fewest. The estimate takes
   the groups of a part as independent. The number of parts is that of the least total.
4. Each fingerprint is a member of one bucket for each part, and probes the buckets of
   all values within its threshold there. A probe and a member that meet are verified.
5. A bucket with many members or probes is settled otherwise, without any pairs: whoever
   is a member of such a bucket or probes one goes to all fingerprints within half the
   distance. Two within the distance meet at one between them, and whoever meets at one is
   within the distance; at most 65 meet, and a star links them.
6. The links' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage, pick, slices
from datumloom.llm.components import components

BITS, GROUP = 64, 8
#: Members, and probes, that are compared in one bucket at most.
BUCKET = 64
SALTS = 32
#: Numbers of parts that are considered.
PARTS = (2, 3, 4)
#: Large buckets' keys are broadcast up to this number (12 bytes each), else joined by shuffling in salted parts.
BROADCAST_KEYS = 500_000


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The bits set in over half of the XXH64 values of a text's k-word shingles, repeats included.

    ASCII letters are lower-cased, words are joined by single spaces. With fewer than k
    words the whole sequence is one shingle; without words the fingerprint is zero.
    """
    words = (text or "").encode().lower().split()  # for bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(k, len(words))
    starts = np.r_[0, ends[:-1]][: len(words) - size + 1].tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += bits_of(hashes[at : at + 65536]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def bits_of(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value's bits, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t, k, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fp long")


def summed(values: DataFrame, count) -> np.ndarray:
    """The sum over all fingerprints of ``count`` (of an array of them, always as many whole numbers): a row for each task, added up by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(iter([batch]), 10_000):
                found = count(part.column(0).to_numpy().view(np.uint64))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    parts = values.select("fp").mapInArrow(add, "n array<long>")
    rows = parts.select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return np.array([r["n"] for r in sorted(rows, key=lambda r: r["pos"])], dtype=np.int64)


def correlations(pairs_set: np.ndarray, n: int) -> np.ndarray:
    """|correlation| of each two bits, from how often both are set in n fingerprints; 0 for constant bits."""
    both = pairs_set.reshape(BITS, BITS) / max(n, 1)
    mean = np.diag(both)
    deviation = np.sqrt(np.maximum(mean * (1 - mean), 0))
    scale = np.outer(deviation, deviation)
    return np.where(scale > 0, np.abs(both - np.outer(mean, mean)) / np.where(scale > 0, scale, 1), 0.0)


def grouped(likeness: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Items dealt into groups of these sizes: each group begins with the most alike two that are left and takes whichever is most alike on the whole."""
    left, out = list(range(len(likeness))), []
    for size in sizes:
        if size == 1 or len(left) == 1:
            group = [left[0]]
        else:
            among = np.triu(likeness[np.ix_(left, left)] + 1, 1)
            i, j = np.unravel_index(np.argmax(among), among.shape)
            group = [left[i], left[j]]
        while len(group) < size:
            rest = [x for x in left if x not in group]
            group.append(rest[int(np.argmax(likeness[np.ix_(rest, group)].sum(axis=1)))])
        left = [x for x in left if x not in group]
        out.append(sorted(group))
    return out


class Plan(NamedTuple):
    """Groups of bits, which groups make up each part, and for each group and value how many fingerprints lie 0, 1, ... bits away."""

    groups: list[list[int]]
    parts: list[list[int]]
    near: np.ndarray
    n: int
    distance: int

    def bits(self, part: int) -> list[int]:
        return [b for g in self.parts[part] for b in self.groups[g]]

    def mask(self, part: int) -> np.uint64:
        return np.uint64(sum(1 << b for b in self.bits(part)))

    def flips(self, part: int) -> list[np.ndarray]:
        """For 0, 1, ... bits: all ways to flip so many of a part's bits."""
        bits = self.bits(part)
        return [np.array([sum(1 << b for b in c) for c in combinations(bits, e)], dtype=np.uint64) for e in range(self.distance + 1)]

    def costs(self, values: np.ndarray) -> np.ndarray:
        """For each value, part and number of units: the probes and the candidates that they may meet."""
        out = np.zeros((len(values), len(self.parts), self.distance + 2))
        group_values = values_of(values, self.groups)
        for p, members in enumerate(self.parts):
            likely = np.zeros((len(values), self.distance + 1))
            likely[:, 0] = 1
            for g in members:
                near = self.near[g][group_values[:, g]] / max(self.n, 1)
                # A polynomial product: distances in independent groups add up.
                likely = np.stack([sum(likely[:, i] * near[:, e - i] for i in range(e + 1)) for e in range(self.distance + 1)], axis=1)
            width = GROUP * len(members)
            probes = np.cumsum([comb(width, e) for e in range(self.distance + 1)])
            out[:, p, 1:] = probes + self.n * np.cumsum(likely, axis=1)
        return out


def values_of(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The bits of each group as a number of 8 bits, for each value and group."""
    bits = bits_of(values)
    return np.stack([np.packbits(bits[:, g], axis=1, bitorder="little")[:, 0] for g in groups], axis=1)


def allocated(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units that each part gets, for each value, and the cost of that: all units of the last axis are dealt, at least cost."""
    n, m, units = costs.shape
    best = np.full((n, units), np.inf)
    best[:, 0] = 0
    taken = np.zeros((m, n, units), dtype=np.int8)
    for p in range(m):
        options = np.full((n, units, units), np.inf)
        for k in range(units):
            options[:, k:, k] = best[:, : units - k] + costs[:, p, k, None]
        taken[p] = np.argmin(options, axis=2)
        best = options.min(axis=2)
    out, left = np.zeros((n, m), dtype=np.int8), np.full(n, units - 1)
    for p in range(m - 1, -1, -1):
        out[:, p] = taken[p][np.arange(n), left]
        left = left - out[:, p]
    return out, best[:, -1]


def fit(values: DataFrame, n: int, distance: int = 2) -> Plan:
    """Parts and estimates from all distinct fingerprints (fp)."""

    def pairs_set(fps: np.ndarray) -> np.ndarray:
        bits = bits_of(fps).astype(np.float32)
        return (bits.T @ bits).astype(np.int64).ravel()

    likeness = correlations(summed(values, pairs_set), n)
    groups = grouped(likeness, [GROUP] * (BITS // GROUP))

    def occurrences(fps: np.ndarray) -> np.ndarray:
        at = values_of(fps, groups).astype(np.int64) + 256 * np.arange(len(groups))
        return np.bincount(at.ravel(), minlength=256 * len(groups))

    counts = summed(values, occurrences).reshape(len(groups), 256)
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256))
    near = np.stack([counts @ (apart == e) for e in range(distance + 1)], axis=2)
    between = np.array([[likeness[np.ix_(g, h)].mean() for h in groups] for g in groups])
    sizes = {m: [len(groups) // m + (i < len(groups) % m) for i in range(m)] for m in PARTS}
    plans = [Plan(groups, grouped(between, sizes[m]), near, n, distance) for m in PARTS]
    total = summed(values, lambda fps: np.array([int(allocated(p.costs(fps))[1].sum()) for p in plans], dtype=np.int64))
    return plans[int(np.argmin(total))]


def entries(values: DataFrame, plan: Plan) -> DataFrame:
    """part, value, fp, node, probe: a fingerprint's membership of a bucket for each part, and its probes."""
    masks = [plan.mask(p) for p in range(len(plan.parts))]
    flips = [plan.flips(p) for p in range(len(plan.parts))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            fps = batch.column(0).to_numpy().view(np.uint64)
            nodes = batch.column(1).to_numpy()
            units, _ = allocated(plan.costs(fps))
            for p, mask in enumerate(masks):
                who, keys = [np.arange(len(fps))], [fps & mask]
                for e, flip in enumerate(flips[p]):
                    some = np.flatnonzero(units[:, p] > e)
                    who.append(np.repeat(some, len(flip)))
                    keys.append(((fps[some] & mask)[:, None] ^ flip).ravel())
                at, value = np.concatenate(who), np.concatenate(keys)
                columns = [np.full(len(at), p, dtype=np.int32), value.view(np.int64), fps[at].view(np.int64), nodes[at], np.arange(len(at)) >= len(fps)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["part", "value", "fp", "node", "probe"])

    return values.select("fp", "node").mapInArrow(make, "part int, value long, fp long, node long, probe boolean")


def large_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """part and value of the buckets in which probes meet members, and either are more than ``limit``; counted before they are shuffled."""
    loads = rows.groupBy("part", "value").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("members"))
    return loads.where("probes > 0 and members > 0").where(F.greatest("probes", "members") > limit).select("part", "value")


def met(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints meet in a bucket and are within the distance."""
    members = rows.where("not probe").select("part", "value", F.col("fp").alias("x"), F.col("node").alias("a"))
    probes = rows.where("probe").select("part", "value", F.col("fp").alias("y"), F.col("node").alias("b"))
    close = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    joined = members.join(probes, (members["part"] == probes["part"]) & (members["value"] == probes["value"]) & close)
    return joined.select("a", "b").where("a <> b")


def met_between(values: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) of stars over whoever meets at a fingerprint half the (even) distance from each: all these are within the distance, and no others are."""
    if distance % 2:
        raise ValueError("large buckets need an even distance")
    flips = np.concatenate([np.array([sum(1 << b for b in c) for c in combinations(range(BITS), e)], dtype=np.uint64) for e in range(distance // 2 + 1)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            fps = batch.column(0).to_numpy().view(np.uint64)
            between = (fps[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(between), pa.array(np.repeat(batch.column(1).to_numpy(), len(flips)))], names=["between", "node"])

    reached = values.select("fp", "node").mapInArrow(make, "between long, node long")
    # At most as many as there are flips meet at one.
    groups = reached.groupBy("between").agg(F.min("node").alias("a"), F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    return groups.select("a", F.explode("nodes").alias("b")).where("a <> b").distinct()


def links(values: DataFrame, distance: int = 2, limit: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct fingerprints (fp, node)."""
    n = values.count()
    if n < 2:
        return values.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    plan = fit(values, n, distance)
    rows = entries(values, plan)
    large = cut_lineage(large_buckets(rows, limit), "large-buckets")
    n_large = large.count()
    if not n_large:
        return met(rows, distance).distinct()
    if n_large <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), ["part", "value"], "left")
    else:
        copies = large.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(copies, ["part", "value", "salt"], "left").drop("salt")
    ordinary = met(marked.where("large is null"), distance)
    crowded = marked.where("large").select("fp", "node").distinct()
    return ordinary.union(met_between(crowded, distance)).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (least id reachable over links) of every row.

    Documents link if their fingerprints differ in ``distance`` bits (an even number) or fewer.

    - Texts that are null, empty or without words have the fingerprint zero and link like any other.
    - A row with a null id has a fingerprint, links nothing, and its component_id is null.
    - Rows with one id are one document: it is linked if any of its texts is.
    - A text's shingles all count, however long. Extra columns are ignored.
    - An empty table gives an empty result.
    """
    every = cut_lineage(fingerprints(docs, k), "fingerprints")
    # Classes of equal fingerprints, joined to their rows in parts by a salt, so a large one is many keys.
    members = every.where("doc_id is not null").select("doc_id", "fp", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = members.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    values = cut_lineage(parts.groupBy("fp").agg(F.min("least").alias("node")), "values")
    parts = cut_lineage(parts.join(values, "fp").select("fp", "salt", "node"), "classes")
    # An id with several texts ties their classes together.
    several = members.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    tied = members.join(several, "doc_id").distinct().join(parts, ["fp", "salt"]).select("doc_id", "node").distinct()
    ties = tied.join(tied.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a < b")

    found = components(links(values, distance).union(ties))
    ends = parts.join(found, "node", "left").select("fp", "salt", F.coalesce("component", "node").alias("component_id"))
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(ends, ["fp", "salt"], "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
