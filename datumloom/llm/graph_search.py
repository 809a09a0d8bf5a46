"""Nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors.

Vectors are dealt into shards by their magnitude, in wide bands, and by a hash. In each
shard a graph is grown in batches: a greedy beam search proposes neighbours for each new
vector, and robust pruning keeps a diverse few: going from near to far, a candidate is
dropped if ``alpha`` times its distance from a kept one is at most its distance from the
new vector. Reverse edges are added and pruned alike. A query runs a beam search in every
shard, the found vectors are ranked by exact distances, and the shards' results are merged.

All comparisons are of differences in double precision, and vectors of one band are
scaled by one power of two, so neither distant groups nor sizes apart blur one another.
A search begins at the nearest of many entry points, the farthest apart and a random
few of a shard, so it needs no edges between distant groups.

Equal vectors are one node with their least ids, so thousands of copies neither fill
a neighbourhood nor a shard. A shard's queries stream past its one graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage, pick

DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM = 32, 1.2, 64, 96
#: Rows of a shard: a part of the table within these bounds, so neither graphs nor their number grow alone.
SHARD_ROWS, MOST_SHARD_ROWS, LEAST_SHARDS, SHARDS = 8192, 65_536, 8, 64
#: Entry points of a shard: so many that are farthest apart, and one of so many others, up to a number; a search begins at the nearest few.
FAR_ENTRIES, ENTRY_SHARE, MOST_ENTRIES, BEGIN = 64, 16, 512, 24
#: Powers of two in a band of magnitudes: squares of scaled vectors, and of their differences, stay within doubles.
BAND = 256
#: Beyond this many times a band's largest component, a query is equally far from all of its vectors in double precision.
BEYOND = 2.0**60


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, and not all of them zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def scaled(exact: np.ndarray, band: int) -> np.ndarray:
    """Vectors times a power of two that brings those of the band to components of 1 at most, exactly."""
    with np.errstate(over="ignore"):
        return np.ldexp(exact, -BAND * (band + 1))


def distances_to(exact: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of vectors scaled for that."""
    with np.errstate(over="ignore"):
        found = squared(exact, point)
        odd = ~np.isfinite(found) | (found < 1e-290)
        out = np.sqrt(found)
        if odd.any():
            halves = exact[odd] / 2 - point / 2
            size = np.abs(halves).max(axis=1)
            size[size == 0] = 1
            out[odd] = 2 * size * np.sqrt(squared(halves / size[:, None], 0))
        return out


def robust_prune(vectors: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of ``at`` the neighbours (B, degree) kept of its candidates (B, C); -1 fills up."""
    count = len(at)
    out = np.full((count, degree), -1, dtype=np.int32)
    # Sorting makes repeated candidates neighbours, where they are easily dropped.
    candidates = np.sort(candidates, axis=1)
    again = np.zeros(candidates.shape, dtype=bool)
    again[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    alive = (candidates >= 0) & (candidates != at[:, None]) & ~again
    points = vectors[np.maximum(candidates, 0)] - vectors[at][:, None, :]
    to_node = np.einsum("bci,bci->bc", points, points)
    # Seen from the node, candidates that lie near it lose no digits; far ones that lie close together are dropped anyway.
    between = to_node[:, :, None] + to_node[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    rows = np.arange(count)
    for slot in range(degree):
        distance = np.where(alive, to_node, np.inf)
        best = distance.argmin(axis=1)
        some = np.isfinite(distance[rows, best])
        if not some.any():
            break
        out[some, slot] = candidates[rows, best][some]
        alive &= alpha * alpha * between[rows, best] > to_node
        alive[rows, best] = False
    return out


def beam_search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (Q, beam) of the nearest nodes found, nearest first; -1 and inf fill up.

    Each begins at its nearest entries. All queries advance together; each step opens the
    ``wide`` nearest unopened nodes of each beam.
    """
    count = len(queries)
    seen = np.zeros((count, len(vectors)), dtype=bool)
    ids = np.full((count, beam), -1, dtype=np.int32)
    distances = np.full((count, beam), np.inf, dtype=vectors.dtype)
    opened = np.ones((count, beam), dtype=bool)
    begin, doors = min(BEGIN, beam, len(entries)), vectors[entries]
    for i in range(count):
        apart = squared(doors, queries[i])
        best = np.argpartition(apart, begin - 1)[:begin]
        ids[i, :begin], distances[i, :begin] = entries[best], apart[best]
        seen[i, entries[best]] = True
    opened[:, :begin] = False
    while True:
        waiting = np.where(opened, np.inf, distances)
        active = np.flatnonzero(np.isfinite(waiting).any(axis=1))
        if not len(active):
            break
        waiting = waiting[active]
        best = np.argpartition(waiting, min(wide, beam) - 1, axis=1)[:, :wide] if beam > wide else np.tile(np.arange(beam), (len(active), 1))
        real = np.isfinite(np.take_along_axis(waiting, best, axis=1))
        opened[active[:, None], best] = True
        found = np.where(real[:, :, None], edges[np.maximum(ids[active[:, None], best], 0)], -1).reshape(len(active), -1)
        # One node may be found from two opened ones at once.
        found = np.sort(found, axis=1)
        fresh = (found >= 0) & ~seen[active[:, None], np.maximum(found, 0)]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        q, c = np.nonzero(fresh)
        seen[active[q], found[q, c]] = True
        new = np.full(found.shape, np.inf, dtype=vectors.dtype)
        new[q, c] = squared(vectors[found[q, c]], queries[active[q]])
        all_ids = np.hstack([ids[active], found])
        all_distances = np.hstack([distances[active], new])
        all_opened = np.hstack([opened[active], np.zeros(found.shape, dtype=bool)])
        order = np.argsort(all_distances, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, axis=1)
        distances[active] = np.take_along_axis(all_distances, order, axis=1)
        opened[active] = np.take_along_axis(all_opened, order, axis=1) | ~np.isfinite(distances[active])
    return np.where(np.isfinite(distances), ids, -1), distances


def entry_points(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """The vector nearest to the mean, then always the one farthest from those before, then random ones."""
    n = len(vectors)
    chosen = [int(squared(vectors, vectors.mean(axis=0)).argmin())]
    apart = squared(vectors, vectors[chosen[0]])
    while len(chosen) < min(FAR_ENTRIES, n):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, squared(vectors, vectors[chosen[-1]]))
    others = np.random.default_rng(seed).permutation(n)[: min(MOST_ENTRIES, n // ENTRY_SHARE)]
    return np.r_[chosen, others[~np.isin(others, chosen)]].astype(np.int32)


def build(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each vector, -1 where there is none, and the entry points."""
    n = len(vectors)
    room = degree + degree // 2  # lists are pruned to the degree when they outgrow this
    edges = np.full((n, room), -1, dtype=np.int32)
    entries = entry_points(vectors, seed)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entries, order[~np.isin(order, entries)]].astype(np.int32)
    done = 1
    while done < n:
        batch = order[done : done + min(done, 128, n - done)]
        found, _ = beam_search(vectors, edges, entries[:done], vectors[batch], beam)
        edges[batch, :degree] = robust_prune(vectors, batch, np.hstack([found, np.tile(batch, (len(batch), 1))]), degree, alpha)
        # Reverse edges: every chosen neighbour gets an edge back.
        row, column = np.nonzero(edges[batch] >= 0)
        targets, sources = edges[batch][row, column], batch[row]
        by_target = np.argsort(targets, kind="stable")
        targets, sources = targets[by_target], sources[by_target]
        unique, first, count = np.unique(targets, return_index=True, return_counts=True)
        nth = np.arange(len(targets)) - np.repeat(first, count)
        held = (edges[unique] >= 0).sum(axis=1)
        fits = held + count <= room
        simple = np.repeat(fits, count)
        edges[targets[simple], (np.repeat(held, count) + nth)[simple]] = sources[simple]
        # The fuller lists, those with most new edges last, so that few columns are needed for most.
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full], kind="stable")]
        for start in range(0, len(full), 128):
            some = full[start : start + 128]
            offered = np.full((len(some), int(count[some].max())), -1, dtype=np.int32)
            for i, t in enumerate(some.tolist()):
                offered[i, : count[t]] = sources[first[t] : first[t] + count[t]]
            kept = robust_prune(vectors, unique[some], np.hstack([edges[unique[some]], offered]), degree, alpha)
            edges[unique[some]] = np.hstack([kept, np.full((len(some), room - degree), -1, dtype=np.int32)])
        done += len(batch)
    return edges, entries


KEYS = ("dim", "band", "shard")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = pa.concat_arrays(column.chunks).flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def graphs(vectors: DataFrame) -> DataFrame:
    """The stored graphs of rows (dim, band, shard, vec_id, vector): a row for each distinct vector."""

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids = rows.column("vec_id").to_numpy()
        dim, band, shard = (rows.column(c)[0].as_py() for c in KEYS)
        exact = matrix(rows.column("vector"), dim)
        distinct, first, inverse = np.unique(exact + 0.0, axis=0, return_index=True, return_inverse=True)
        members = [[] for _ in distinct]
        for i, node in enumerate(inverse.ravel().tolist()):
            members[node].append(ids[i].item())
        edges, entries = build(scaled(distinct, band))
        count = len(distinct)
        return pa.table(
            {
                "dim": pa.array(np.full(count, dim, dtype=np.int32)),
                "band": pa.array(np.full(count, band, dtype=np.int32)),
                "shard": pa.array(np.full(count, shard, dtype=np.int32)),
                "node": pa.array(np.arange(count, dtype=np.int32)),
                "entry": pa.array(np.isin(np.arange(count), entries)),
                "vec_ids": pa.array([sorted(set(m)) for m in members], pa.list_(pa.int64())),
                "vector": pa.array(list(exact[first]), pa.list_(pa.float64())),
                "edges": pa.array(list(edges), pa.list_(pa.int32())),
            }
        )

    schema = "dim int, band int, shard int, node int, entry boolean, vec_ids array<long>, vector array<double>, edges array<int>"
    return vectors.groupBy(*KEYS).applyInArrow(grow, schema)


class Graph:
    """A shard's graph, ready for queries."""

    def __init__(self, nodes: pa.Table, k: int, beam: int):
        self.dim, self.band = nodes.column("dim")[0].as_py(), nodes.column("band")[0].as_py()
        self.exact = matrix(nodes.column("vector"), self.dim)
        self.vectors = scaled(self.exact, self.band)
        self.edges = matrix(nodes.column("edges"), DEGREE + DEGREE // 2, np.int32)
        self.members = nodes.column("vec_ids").to_pylist()
        self.entries = np.flatnonzero(nodes.column("entry").to_numpy(zero_copy_only=False)).astype(np.int32)
        self.k, self.beam = k, beam
        # The nodes with the least ids, which come first where all are equally far.
        self.least = np.argsort([m[0] for m in self.members], kind="stable")[: k + 1]

    def nearest(self, queries: list[int], points: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each query its nearest (score, id), the query itself left out."""
        moved = scaled(points, self.band)
        beyond = np.abs(moved).max(axis=1) > BEYOND
        found = np.full((len(points), max(self.beam, self.k + 1)), -1, dtype=np.int32)
        found[beyond, : len(self.least)] = self.least
        near = np.flatnonzero(~beyond)
        for start in range(0, len(near), 256):
            some = near[start : start + 256]
            found[some, : self.beam] = beam_search(self.vectors, self.edges, self.entries, moved[some], self.beam)[0]
        out = []
        for query, point, nodes in zip(queries, points, found):
            nodes = nodes[nodes >= 0]
            scores = distances_to(self.exact[nodes], point)
            out.append(sorted((s, v) for s, node in zip(scores.tolist(), nodes.tolist()) for v in self.members[node] if v != query)[: self.k])
        return out


def search(graph: DataFrame, queries: DataFrame, shards: list[tuple[int, int]], k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, query_key, vec_id and score of the ``k`` nearest that each (band, shard) finds for each query.

    A shard's graph comes first in its partition, then its queries, a batch at a time.
    """
    everywhere = F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(s).alias("shard")) for b, s in shards)))
    asked = queries.select("dim", "vector", "query_id", "query_key", everywhere)
    rows = graph.unionByName(asked, allowMissingColumns=True).repartition(len(shards), *KEYS).sortWithinPartitions(*KEYS, F.col("node").asc_nulls_last())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, ready = None, [], None
        for batch in batches:
            at, place = [batch.column(c).to_numpy() for c in KEYS], batch.column("node").to_numpy(zero_copy_only=False)
            # Stretches of one shard and of one kind of row.
            is_node = ~np.isnan(place.astype(np.float64))
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*at, is_node)], axis=0)) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if start == end:
                    continue
                part, this = batch.slice(start, end - start), tuple(int(c[start]) for c in at)
                if this != key:
                    key, nodes, ready = this, [], None
                if is_node[start]:
                    nodes.append(part)
                    continue
                if ready is None and nodes:
                    ready, nodes = Graph(pa.Table.from_batches(nodes), k, beam), []
                if ready:
                    ids, tags = part.column("query_id").to_pylist(), part.column("query_key").to_pylist()
                    found = ready.nearest(ids, matrix(part.column("vector"), this[0]))
                    out = [(q, tag, v, s) for q, tag, near in zip(ids, tags, found) for s, v in near]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["query_id", "query_key", "vec_id", "score"])

    return rows.mapInArrow(look, "query_id long, query_key long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    All rows but the query's own are candidates. Nearness is Euclidean distance in
    double precision, ties go to the smaller id; with fewer candidates all are given.

    - Rows with a null id, and vectors that are null, empty, zero or not finite take no part.
    - Vectors of different lengths never meet: each length is searched by itself.
    - Repeated rows count once. Rows that share an id are one another's own: none is a
      candidate for the other. An id with several vectors asks once with each of them.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    rows = pick(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # A vector's k + 1 least ids are all that any query can need of its copies; counted before the shuffle.
    least = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("_n", F.dense_rank().over(least)).where(F.col("_n") <= k + 1).select("vec_id", "vector").distinct()
    kept = cut_lineage(kept.select("vec_id", "vector", F.size("vector").alias("dim")), "vectors")
    # The band of the largest component; there are nine at most.
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    kept = kept.withColumn("band", F.floor(F.log2(largest) / BAND).cast("int"))
    sizes = {r["band"]: r["n"] for r in kept.groupBy("band").agg(F.count("*").alias("n")).collect()}
    shards = []
    for band, n in sorted(sizes.items()):
        rows_of_one = min(MOST_SHARD_ROWS, max(SHARD_ROWS, n // SHARDS))
        shards += [(band, i) for i in range(max(min(LEAST_SHARDS, -(-n // 64)), -(-n // rows_of_one)))]
    numbers = F.create_map(*(F.lit(x) for band in sizes for x in (band, sum(b == band for b, _ in shards)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    of_band = numbers[F.col("band")]
    graph = cut_lineage(graphs(kept.withColumn("shard", F.pmod(F.xxhash64("vector"), of_band).cast("int"))), "graph")

    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), "vector", F.size("vector").alias("dim"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return search(graph, asked, shards or [(0, 0)], k, beam).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
