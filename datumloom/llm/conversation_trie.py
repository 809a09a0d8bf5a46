"""The prefix trie of conversations, with what each node's shared turns save.

A node is a distinct sequence of a conversation's first turns. It is owned by its
smallest member. Along a conversation's path the smallest member can only grow until
it is the conversation itself, so each conversation owns a suffix of its path, and
every node has one owner.

1. Turns become 128-bit keys and word counts where they are read; texts aren't shuffled.
2. A conversation's turns run through one stream in order, which chains their keys into
   path keys: one row for each conversation and depth. Such a stream holds one batch.
3. Windows mark the owned nodes: smallest members are found for parts of a node by a
   salt, then over its parts, so a node that all conversations share is many keys.
4. A window along each path, from its end, sums the tokens of nodes that the
   conversation doesn't own. These are its occurrences' tokens minus its owned tokens.
5. One group-by of path keys sums these, the owned children and the owned leaves: every
   subtree figure of a node is a sum over its members alone.
6. The ids that end at a node are ordered over all tasks, joined in bounded stretches,
   and each node's stretches run through one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datumloom.llm.common import cut_lineage, pick

#: Parts of a node by conversation.
SALTS = 32
#: Ids in a stretch of a node's ends, at most.
STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """The MD5 of a turn's role and text as hexadecimal digits."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key and tokens of every turn; rows without a conversation are left out.

    Turns of equal number follow their keys.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    thin = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key"))
    return thin.select("conv_id", place.cast("long").alias("place"), "key", "tokens")


def as_they_are(turns: DataFrame) -> DataFrame:
    """Every conversation's turns, and a row of place 0 for the conversation itself."""
    return turns.unionByName(_roots(turns)).withColumn("part", F.lit(1))


def _roots(turns: DataFrame) -> DataFrame:
    return turns.where("place = 1").select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("tokens"))


def with_shared_heads(turns: DataFrame, every: int = 20, head: int = 4) -> DataFrame:
    """Conversations rebuilt on the first turns of another: the first h turns of conversation c - c % ``every``, then c's own after its first h.

    h is the CRC-32 of c's decimal digits modulo ``head``. A first conversation that is
    absent gives no turns, a shorter one all it has. Its turns are joined to fewer than
    ``every`` conversations.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < head)).select(F.col("conv_id").alias("base"), "place", "key", "tokens")
    guests = turns.where((F.col("place") == 1) & (F.col("conv_id") % every != 0)).select("conv_id", h, base).where("h > 0")
    heads = guests.join(first, "base").where("place <= h").select("conv_id", "place", "key", "tokens", F.lit(0).alias("part"))
    own = turns.select("*", h).where((F.col("place") > F.col("h")) | (F.col("conv_id") % every == 0)).drop("h").withColumn("part", F.lit(1))
    return heads.unionByName(own).unionByName(_roots(turns).withColumn("part", F.lit(-1)))


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, node (the path's key), tokens, last: a row for each conversation and depth, 0 included.

    ``rows`` has conv_id, part, place, key, tokens; turns follow part and place.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, node, depth = None, None, ROOT, -1
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            nodes, depths = [], []
            for c, key in zip(ids, keys):
                if c != conv:
                    conv, node, depth = c, ROOT, -1
                depth += 1
                if key is not None:
                    node = hashlib.blake2b(node + bytes.fromhex(key), digest_size=16).digest()
                nodes.append(node)
                depths.append(depth)
            made = pa.table({"conv_id": batch.column(0), "depth": pa.array(depths, pa.int64()), "node": pa.array(nodes, pa.binary()), "tokens": batch.column(2)})
            held = made if held is None else pa.concat_tables([held, made])
            if held.num_rows > 1:
                yield from ended(held.slice(0, held.num_rows - 1), held.column("conv_id").to_numpy()).to_batches()
                held = held.slice(held.num_rows - 1)
        if held is not None:
            yield from ended(held, np.r_[held.column("conv_id").to_numpy(), 0], whole=True).to_batches()

    def ended(table: pa.Table, ids: np.ndarray, whole: bool = False) -> pa.Table:
        """With ``last``: whether the next row, which the ids reach to, is of another conversation."""
        last = np.ones(table.num_rows, dtype=bool) if whole else ids[:-1] != ids[1:]
        return table.append_column("last", pa.array(last)).combine_chunks()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "key", "tokens")
    return ordered.mapInArrow(chain, "conv_id long, depth long, node binary, tokens long, last boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256, the SHA-256 of its conv_ids in ascending order, in decimal, joined by commas.

    Ids are ordered by range over all tasks, so a node with many is not one task's; its
    stretches of joined ids then run through one digest, a batch at a time.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(nodes)) if i == 0 or nodes[i] != nodes[i - 1]]
            out = []
            for a, b in zip(starts, [*starts[1:], len(nodes)]):
                out += [(nodes[a], ids[i], ",".join(map(str, ids[i : min(i + STRETCH, b)]))) for i in range(a, b, STRETCH)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, _, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _named(out)
        if state:
            yield _named([(node, state.hexdigest())])

    def _named(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["node", "ends_sha256"])

    ordered = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ordered.mapInArrow(stretches, "node binary, least long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "least").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """Every node of the prefix trie of conversations.

    ``rows`` has conv_id, part, place, key, tokens (from ``as_they_are`` or
    ``with_shared_heads``). The result has conv_id (the smallest member), depth,
    parent_conv_id (the parent's conv_id; null at the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, tokens of a node times its members but
    one) and ends_sha256.

    - Null roles and texts are empty; turns with a null number come first; repeated rows
      are repeated turns, and turns of equal number follow their MD5.
    - Rows with a null conv_id are left out. Extra columns are ignored.
    - A conversation without turns is a member of the root alone.
    - An empty table has no root and gives an empty result.
    """
    visits = cut_lineage(paths(rows), "paths")
    salted = visits.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))

    # A node's smallest member, and whether any member goes on: first for its parts, then over them.
    parts = salted.groupBy("node", "salt").agg(F.min("conv_id").alias("low"), F.bool_or(~F.col("last")).alias("on"))
    node = Window.partitionBy("node")
    parts = parts.select("node", "salt", F.min("low").over(node).alias("owner"), F.bool_or("on").over(node).alias("goes_on"))
    marked = salted.join(parts, ["node", "salt"]).withColumn("owned", F.col("owner") == F.col("conv_id"))

    # Along each path from its end: a running frame sums what lies below.
    from_end = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    below = from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = marked.select(
        "node",
        "depth",
        "owner",
        F.lead("owner").over(from_end).alias("parent"),
        F.sum(F.when(F.col("owned"), 0).otherwise(F.col("tokens"))).over(below).alias("saved"),
        F.coalesce(F.lag("owned").over(from_end), F.lit(False)).cast("long").alias("child"),
        F.max((F.col("owned") & F.col("last") & ~F.col("goes_on")).cast("long")).over(below).alias("leaf"),
    )
    nodes = shares.groupBy("node").agg(
        F.min("owner").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    return nodes.join(end_digests(visits.where("last")), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )
