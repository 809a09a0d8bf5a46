"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Each document becomes a set of hashed word shingles, a MinHash signature of 200
   values, 40 band keys of 5 values each, and a sketch of a byte for each value.
   Documents with equal sets form a class; only its least id goes on.
2. Documents that share a band key are candidates. In buckets of ordinary size all
   pairs are compared in batches of 32 sketch bytes: after each batch, a pair is
   pruned if the posterior chance that its similarity reaches the threshold is below
   the chosen miss probability. A spanning forest of the surviving pairs is kept, not
   all of them. A larger bucket gives a star of pairs with its least document, and
   these are pruned in step 4. Either way the pairs are linear in the bucket.
3. The pairs' connected components are clusters: whatever pair may be similar lies
   within one cluster.
4. The pairs are pruned by sketches, those left are verified on full sets, and the links'
   components are found. A node in many pairs, such as a star's centre, sends its set once
   to each salted part of them, and they stream past it.
5. A cluster that still has several components may hide links among pairs that were
   never tried. There, every pair across components is compared by sketches, and the
   documents that have a surviving partner are compared on full sets. A large cluster
   is split into blocks and each pair of blocks is a group of its own, so no task
   holds the cluster; full sets go only to the groups where they may matter.
6. All links' components are the result.

A pair of similarity 0.8 shares no band key with a chance of (1 - 0.8^5)^40 = 1.2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage, pick, slices
from datumloom.llm.components import components

BANDS, ROWS = 40, 5
BATCH = 32
#: Buckets of more members give a star instead of comparing all pairs.
STAR_FROM = 128
#: Shingles in a block of a cluster, about, and its documents until their square root is more.
BLOCK_SHINGLES, BLOCK_DOCS = 100_000, 256
SALTS = 32
#: Ids of documents with candidates are broadcast up to this number (16 bytes each), else joined by shuffling.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * PRIME
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles, ASCII letters in lower case.

    With fewer than k words the whole sequence is one shingle; without words the set is empty.
    """
    words = (text or "").encode().lower().split()  # for bytes: ASCII letters and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    size = min(k, len(words))
    joined = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        joined = mixed(joined + h[i : len(words) - size + 1 + i])
    return np.unique(joined)


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each of 200 hash functions the least value over the set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint64)
    for start in range(0, len(hashes), 1024):
        values = (hashes[start : start + 1024, None] * MULTIPLIERS + ADDENDS) >> np.uint64(32)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME, parts.shape[:2])
    for i in range(ROWS):
        keys = mixed(keys + parts[:, :, i])
    return keys.view(np.int64)


def least_agreement(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n sketch bytes, a pair with fewer than m equal ones is pruned.

    With a uniform prior over similarity J, a byte agrees with chance J + (1 - J) / 256;
    m is the least count for which the posterior chance of J >= threshold is ``miss`` or more.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 256
    high = grid >= threshold
    out = []
    for n in sorted({*range(BATCH, BANDS * ROWS, BATCH), BANDS * ROWS}):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(agree) + (n - m) * np.log1p(-agree + 1e-15)
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior = weight[:, high].sum(axis=1) / weight.sum(axis=1)
        out.append((n, int(np.argmax(posterior >= miss))))
    return out


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a[left[i]], b[right[i]] of sketches, which survive all batches, and how many bytes agree."""
    alive, count, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, m in bounds:
        if not len(alive):
            break
        equal = a[left[alive], done:n] == b[right[alive], done:n]
        count[alive] += equal.sum(axis=1, dtype=np.int32)
        alive, done = alive[count[alive] >= m], n
    return alive, count[alive]


class Forest:
    """Union-find over any hashable nodes."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null if empty), bands and sketch of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            signatures = np.array([signature(s) for s in sets], dtype=np.uint64).reshape(-1, BANDS * ROWS)
            keys = band_keys(signatures)
            sketches = (signatures & np.uint64(0xFF)).astype(np.uint8)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if y else None for s, y in zip(sets, some)], pa.binary()),
                    pa.array([key if y else None for key, y in zip(keys, some)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if y else None for x, y in zip(sketches, some)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return docs.mapInArrow(make, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def plausible_pairs(members: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """A spanning forest (a, b) of the pairs that survive pruning in buckets of ordinary size.

    ``members`` has key, node, sketch. Rows arrive sorted by key, so a bucket's rows are
    neighbours; pairs at distance 1, 2, ... are compared for all buckets of a batch together.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None else pa.concat_batches([rest, batch])
                if rest.num_rows < 20_000:
                    continue
            if rest is None or not rest.num_rows:
                continue
            keys = rest.column(0).to_numpy()
            # The last bucket may go on in the next batch.
            n = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            keys, nodes, sketch = keys[:n], rest.column(1).to_numpy()[:n], sketches_of(rest.column(2).slice(0, n)) if n else None
            rest = rest.slice(n)
            found = []
            for d in range(1, STAR_FROM):
                left = np.flatnonzero(keys[: n - d] == keys[d:]) if d < n else np.zeros(0, dtype=np.int64)
                if not len(left):
                    break
                left = left[nodes[left] != nodes[left + d]]
                alive, agree = surviving(sketch, sketch, left, left + d, bounds)
                found.append(np.stack([agree, nodes[left[alive]], nodes[left[alive] + d]], axis=1))
            forest, out = Forest(), []
            if found:
                pairs = np.concatenate(found)
                for _, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
                    if forest.join(x, y):
                        out.append((min(x, y), max(x, y)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return members.select("key", "node", "sketch").mapInArrow(compare, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def is_similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in integers."""
    return 100 * common >= percent * (a + b - common)


def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (node, ...) of each pair's node ``a``, as (a, salt, ...): once for each salted part of its pairs that there is.

    ``pairs`` has a, b and salt, which follows b. So a node in many pairs is many keys.
    """
    there = pairs.select("a", "salt").distinct()
    return there.join(rows.withColumnRenamed("node", "a"), "a")


def salted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))


def plausible(pairs: DataFrame, sets: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            alive, _ = surviving(sketches_of(batch.column("x")), sketches_of(batch.column("y")), every, every, bounds)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    parts = salted(pairs)
    right = parts.join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    left = beside(parts, sets.select("node", F.col("sketch").alias("x")))
    return right.join(left, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(prune, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, bounds: list[tuple[int, int]], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pruned by sketches before any set is sent.

    A part's sets arrive with those of its node ``a`` first, and the others pass by.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, firsts = None, []
        for batch in batches:
            good = []
            for i, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")))):
                hashes = np.frombuffer(batch.column("hashes")[i].as_py(), dtype=np.uint64)
                if (a, salt) != part:
                    part, firsts = (a, salt), []
                if b is None:
                    firsts.append(hashes)
                elif any(is_similar(len(np.intersect1d(x, hashes, assume_unique=True)), len(x), len(hashes), percent) for x in firsts):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    left = salted(cut_lineage(plausible(pairs, sets, bounds), "plausible"))
    firsts = beside(left, sets.select("node", "hashes")).select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")
    others = left.join(sets.select(F.col("node").alias("b"), "hashes"), "b").select("a", "salt", "b", "hashes")
    ordered = firsts.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(check, "a long, b long")


def promising(rows: DataFrame, bounds: list[tuple[int, int]], percent: int) -> DataFrame:
    """Of each pair of blocks, the documents with a partner in another component that sketches don't rule out.

    ``rows`` has cluster, i, j (a pair of its blocks), block, node, component, sketch,
    size; the result has all but the last two, each document once for a pair of blocks.
    """
    names = ["cluster", "i", "j", "block", "node", "component"]

    def filter_(group: pa.Table) -> pa.Table:
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        parts, sizes = group.column("component").to_numpy(), group.column("size").to_numpy()
        sketch = sketches_of(group.column("sketch"))
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        hopeful = np.zeros(len(block), dtype=bool)
        for x in first.tolist():
            others = second[second > x] if i[0] == j[0] else second
            fit = (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])) & (parts[others] != parts[x])
            others = others[fit]
            alive, _ = surviving(sketch, sketch, np.full(len(others), x), others, bounds)
            hopeful[others[alive]] = True
            hopeful[x] |= len(alive) > 0
        nodes = group.column("node").to_numpy()[hopeful]
        _, once = np.unique(nodes, return_index=True)  # a document may have several sets
        return group.select(names).take(pa.array(np.flatnonzero(hopeful)[once]))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.groupBy("cluster", "i", "j").applyInArrow(filter_, fields)


def links_across(rows: DataFrame, bounds: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links (a, b) between different components of each cluster, enough to connect whatever is linked.

    ``rows`` has cluster, i, j (a pair of its blocks), block, node, component, sketch, hashes.
    """

    def search(group: pa.Table) -> pa.Table:
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        nodes, parts = group.column("node").to_numpy(), group.column("component").to_numpy()
        sketch = sketches_of(group.column("sketch"))
        sets = [np.frombuffer(h, dtype=np.uint64) for h in group.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        forest, out = Forest(), []
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # The smaller components' documents seek partners; sizes too different can't be similar.
        for x in first.tolist():
            others = second[second > x] if i[0] == j[0] else second
            fit = (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])) & (parts[others] != parts[x])
            others = others[fit]
            alive, _ = surviving(sketch, sketch, np.full(len(others), x), others, bounds)
            others = [y for y in others[alive].tolist() if forest.root(parts[y]) != forest.root(parts[x])]
            if not others:
                continue
            every = np.concatenate([sets[y] for y in others])
            at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
            common = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes[others])[:-1]])
            for y in np.array(others)[is_similar(common, sizes[x], sizes[others], percent)].tolist():
                if forest.join(parts[x].item(), parts[y].item()):
                    out.append((nodes[x].item(), nodes[y].item()))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(search, "a long, b long")


def in_blocks(clusters: DataFrame) -> DataFrame:
    """Each document of an unsettled cluster once for every pair of blocks that its block is in.

    ``clusters`` has cluster, node, component, n_shingles. A cluster's figures are joined
    to its documents in ``SALTS`` parts, so one large cluster doesn't meet in one task.
    """
    stats = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("docs"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    n_blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.least(F.col("docs") / BLOCK_DOCS, F.sqrt("docs")))).cast("int")
    figures = stats.select("cluster", n_blocks.alias("n_blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    rows = salted.join(figures, ["cluster", "salt"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    return rows.select("*", other).select("cluster", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links) and kept, for every row.

    Two documents are linked if their sets of k-word shingles have at least
    ``percent`` % of their union in common. ``kept`` marks the least id of a component.

    - Texts that are null, empty or without words have an empty set and no links.
    - A row with a null id takes no part: component_id is null and it is kept.
    - Rows with one id are one document: it is linked if any of its texts is. Each row
      keeps its own n_shingles.
    - A text's whole set counts, however long. Extra columns are ignored.
    - An empty table gives an empty result.
    """
    bounds = least_agreement(percent / 100, miss)
    rows = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = cut_lineage(profile(rows, k), "profiles")

    # 1. Classes of equal sets. A class is joined to its rows in parts by a salt, here and at the end, so a large one is many keys.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    some = every.where("n_shingles > 0 and doc_id is not null")
    members = some.select("doc_id", "set_key", salt)
    parts = members.groupBy("set_key", "salt").agg(F.min("doc_id").alias("least"))
    classes = parts.groupBy("set_key").agg(F.min("least").alias("node"))
    parts = cut_lineage(parts.join(classes, "set_key").select("set_key", "salt", "least", "node"), "classes")
    firsts = parts.where("least = node").select("set_key", F.col("node").alias("doc_id"))
    first_rows = some.join(firsts, ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    nodes = cut_lineage(first_rows.select(F.col("doc_id").alias("node"), "bands", "sketch"), "nodes")
    # An id with several texts ties their classes together.
    several = members.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select("doc_id")
    tied = cut_lineage(members.join(several, "doc_id").distinct().join(parts, ["set_key", "salt"]).select("doc_id", "node").distinct(), "tied")
    ties = tied.join(tied.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a < b")

    # 2. Candidates.
    banded = nodes.select("node", F.explode("bands").alias("key"))
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a large bucket.
    buckets = cut_lineage(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"), "bucket-sizes")
    shared = cut_lineage(banded.join(buckets, "key").select("key", "node", "n", "leader"), "buckets")
    sketched = shared.where(F.col("n") <= STAR_FROM).select("key", "node").join(nodes.select("node", "sketch"), "node")
    forest = plausible_pairs(sketched.repartition("key").sortWithinPartitions("key", "node"), bounds)
    stars = shared.where(F.col("n") > STAR_FROM).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = cut_lineage(forest.union(stars).distinct(), "pairs")

    # 3. Clusters, and the full sets of the documents in them.
    clusters = cut_lineage(components(pairs), "clusters").withColumnRenamed("component", "cluster")
    ids = clusters.select(F.col("node").alias("doc_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            signatures = np.array([signature(s) for s in sets], dtype=np.uint64).reshape(-1, BANDS * ROWS)
            sketches = (signatures & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "n_shingles", "sketch", "hashes"],
            )

    texts = rows.join(ids, "doc_id", "left_semi").select("doc_id", "text")
    sets = cut_lineage(texts.mapInArrow(sets_of, "node long, n_shingles long, sketch binary, hashes binary").where("n_shingles > 0").dropDuplicates(["node", "hashes"]), "sets")

    # 4. Links among the pairs.
    links = cut_lineage(verified(pairs, sets, bounds, percent).union(ties).distinct(), "links")
    settled = components(links)

    # 5. Links that no pair has shown yet.
    placed = clusters.join(settled, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
    sized = placed.join(sets.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    sketches = sets.select("node", "sketch", F.col("n_shingles").alias("size"))
    hopeful = cut_lineage(promising(in_blocks(sized).join(sketches, "node"), bounds, percent), "hopeful")
    late = cut_lineage(links_across(hopeful.join(sets, "node"), bounds, percent), "late-links")

    # 6. The result.
    final = components(links.union(late))
    ends = parts.join(final, "node", "left").select("set_key", "salt", F.coalesce("component", "node").alias("component"))
    reached = members.join(ends, ["set_key", "salt"]).groupBy("doc_id").agg(F.min("component").alias("reached"))
    return every.select("doc_id", "n_shingles").join(reached, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("reached", "doc_id").alias("component_id"),
        (F.coalesce("reached", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


