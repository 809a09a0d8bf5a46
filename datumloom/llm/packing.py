"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces: full windows stand alone, and what is left of a
document is cut into uneven pieces of a quarter window at most, so that several
pieces share each window, and of many sizes even where all documents are equally long. Pieces are dealt by a hash into blocks of about a hundred
windows. In each block, differencing starts from one partial partition for each piece
(the piece in one window, nothing in the others) and keeps merging the two partial
partitions with the largest imbalances, the fullest window of one with the emptiest
of the other. The windows come out near-equal; if the fullest exceeds the capacity,
the window count rises by what is too much and the block is solved again.

Blocks bound what a task holds, whatever the corpus size: the hash, of a piece and its
number among equal ones, spreads even equal rows, and the number of blocks follows the
number of tokens. Neither depends on how the rows lie in files.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage, pick, slices
from datumloom.llm.tokens import ENCODE_ROWS, WordEncoder, tokenizer_path

#: Windows in a block, about, and rows in it at most, about.
BLOCK_WINDOWS = 128
BLOCK_ROWS = 4096
#: Sequence numbers set aside for each block; a block has fewer windows than rows.
STRIDE = 1 << 20


def cut_lengths(n: int, capacity: int, seed: int = 0) -> list[int]:
    """Full windows, then uneven pieces of a quarter window at most: two or more, unless a thirty-second of a window holds all.

    Cuts lie up to a quarter of a piece from even ones, by a hash of ``seed``.
    """
    full, rest = divmod(n, capacity)
    longest = max(1, capacity // 4)
    short = min(longest, max(capacity // 32, 16))
    # Pieces of three fifths of the longest on average, so that none outgrows it.
    k = max(2, -(-rest * 5 // (longest * 3))) if rest > short else 1
    cuts = [0]
    for i in range(1, k):
        seed = (seed * 1_103_515_245 + 12_345) & 0x7FFFFFFF
        cuts.append((2 * i * rest + (seed % 1001 - 500) * rest // 1000) // (2 * k))
    cuts.append(rest)
    return [capacity] * full + [b - a for a, b in zip(cuts, cuts[1:]) if b > a]


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window (0 to m - 1) of each piece, by Karmarkar-Karp differencing over m windows.

    A partial partition is a list of its windows that hold anything, as (minus the sum,
    root of the binary tree of pieces in it), fullest first. Inner nodes are numbered
    after the pieces. Of equal imbalances the partition made first is merged first.
    """
    n = len(sizes)
    left: list[int] = []
    right: list[int] = []

    def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The fullest window of one with the emptiest of the other; windows that hold nothing come first."""
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - m
        if shared <= 0:
            for window in b:
                insort(a, window)
            return a
        both = []
        for (x, i), (y, j) in zip(a[len(a) - shared :], reversed(b)):
            left.append(i)
            right.append(j)
            both.append((x + y, n + len(left) - 1))
        return sorted(a[: len(a) - shared] + both + b[: len(b) - shared])

    heap = [(-int(sizes[i]) if m > 1 else 0, made, [(-int(sizes[i]), int(i))]) for made, i in enumerate(np.argsort(-sizes, kind="stable"))]
    heapq.heapify(heap)
    for made in range(n, 2 * n - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        windows = merged(a, b)
        heapq.heappush(heap, (windows[0][0] - (windows[-1][0] if len(windows) == m else 0), made, windows))
    window = np.zeros(n + len(left), dtype=np.int64)
    for number, (_, root) in enumerate(heap[0][2]):
        window[root] = number
    for i in range(len(left) - 1, -1, -1):  # a node is made after its parts
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n]


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows for pieces that fit, as few as differencing reaches from the least count on."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, m)
        excess = int(np.maximum(np.bincount(window, weights=sizes) - capacity, 0).sum())
        if not excess:
            return window
        m += max(1, excess // capacity)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for.

    Null texts are empty documents of the end id alone. Each row is a document of its own.
    """
    path = path or tokenizer_path()
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in slices(batches, ENCODE_ROWS):
            ids, bounds = encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()], end_id)
            out = []
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                at = first
                for length in cut_lengths(last - first, capacity, zlib.crc32(ids[first:last])):
                    piece = ids[at : at + length]
                    out.append((doc_id, at - first, length, zlib.crc32(piece), last - first, piece.tobytes() if with_ids else None))
                    at += length
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types))[: 5 + with_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])
        encoder.forget()

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Put pieces into windows: all columns of ``cut`` plus sequence_id and offset.

    ``cut`` is read twice (sums, then rows), so it should be written rows. Offsets
    count from 0 without gaps in each sequence; a sequence's pieces lie in the order
    of doc_id and start. Sequence ids are unique, not dense. An empty table gives an
    empty result; lengths outside 1 to ``capacity`` raise an error.
    """
    total = cut.agg(
        F.coalesce(F.sum(F.when(F.col("length") < capacity, F.col("length"))), F.lit(0)).alias("tokens"),
        F.count("*").alias("n"),
        F.min("length").alias("least"),
        F.max("length").alias("most"),
    ).first()
    if total["n"] and not 1 <= total["least"] <= total["most"] <= capacity:
        raise ValueError("a piece doesn't fit into a window")
    n_blocks = max(1, -(-total["tokens"] // (BLOCK_WINDOWS * capacity)), -(-total["n"] // BLOCK_ROWS))
    # Equal rows are counted and numbered, so any number of them is spread evenly too.
    numbered = cut.groupBy(*cut.columns).agg(F.count("*").alias("_n")).select(*cut.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_n"))
    dealt = numbered.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_n"), F.lit(n_blocks))).drop("_n")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    def solve(block: pa.Table) -> pa.Table:
        block = block.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = block.column("length").to_numpy()
        window = np.zeros(len(sizes), dtype=np.int64)
        open_ = sizes < capacity
        n_open = 0
        if open_.any():
            window[open_] = windows_for(sizes[open_], capacity)
            n_open = int(window[open_].max()) + 1
        window[~open_] = n_open + np.arange(int((~open_).sum()))
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        offset = np.empty_like(sizes)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        out = block.append_column("sequence_id", pa.array(block.column("_block").to_numpy() * STRIDE + window)).append_column("offset", pa.array(offset))
        return out.drop_columns(["_block"])

    return dealt.groupBy("_block").applyInArrow(solve, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack all documents; the pieces are written in between, so texts are encoded once.

    - A null text is an empty document: one piece with the end id.
    - A null doc_id stays null. Repeated rows are packed as often as they occur.
    - A very long text gives many full windows and a rest. Extra columns are ignored.
    - An empty table gives an empty result.
    """
    return pack(cut_lineage(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves: sequence_id and ids, ``capacity`` of them, from pieces packed with their ids."""
    fields = "sequence_id long, ids array<long>"

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), dtype="<u4").astype(np.int64)
        padded = np.full(capacity, pad_id, dtype=np.int64)
        padded[: len(ids)] = ids
        return pa.table({"sequence_id": rows.column("sequence_id").slice(0, 1), "ids": pa.array([padded], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, fields)
