"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, in each text and over the corpus.

A text is encoded by a byte-level BPE (A) and a SentencePiece model (B). Their tokens
end at byte offsets; where both end is a cut, and the tokens between two cuts are a
group. Within it, tokens whose byte ranges overlap are linked.

Neither tokenizer lets a token go on past the beginning of white space, so texts are
cut there into chunks, whose alignment doesn't depend on what stands around them. New
chunks of a batch are encoded together by the two libraries and aligned together: ends
are cumulative sums, cuts their intersection, groups a binary search, and links come
from repeated ranges. A text is then a list of numbered chunks, and its pairs with
multiplicities are sums over its distinct chunks.

How many documents hold a pair linked is counted over salted parts and then over the
parts. The counts are joined to the documents' distinct pairs, which were written once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datumloom.llm.common import Memory, cut_lineage, pick, slices, taken
from datumloom.llm.tokens import byte_characters, tokenizer_path

SPACE = "▁"
#: Texts that are aligned together, and new chunks that the libraries encode together: what they return takes a hundred bytes a token.
ALIGN_ROWS, LEARN_CHUNKS = 500, 8192
#: White space other than ASCII's: texts that have some are encoded as one chunk.
FAR_SPACE = re.compile(r"[^\S \t\n\v\f\r]")
#: Parts of a pair's documents, in counting and in the join of a table that isn't broadcast.
SALTS = 16
#: Pairs are broadcast up to this number (16 bytes each), else joined by shuffling.
BROADCAST_PAIRS = 2_000_000


class Aligned(NamedTuple):
    """A chunk's groups as text (None where the bytes differ), its links' pairs and its counts."""

    groups: str | None
    pairs: bytes
    n_a: int
    n_b: int
    n_groups: int


DIFFERS = Aligned(None, b"", 0, 0, 0)


class Aligner:
    """Alignments of chunks, with a bounded memory of those used last."""

    _kept: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str, max_chunks: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_b, plain = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)):
                plain.append(piece)
        self.size_b = len(self.bytes_b)
        if len(self.bytes_a) * self.size_b >= 1 << 31:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        self.length_a, self.length_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # What B puts in front of a text, here followed by a letter, so that chunks can start with any character.
        self.front = self.b.encode("x")
        if len(self.front) != 1 or self.bytes_b[self.front[0]] != b" x":
            raise ValueError(f"{path_b} doesn't put a space in front of a text")
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError(f"{path_b} has pieces that go on past the beginning of white space")
        # A chunk may begin at a space, and at other white space that no piece has.
        cuts = " " + "".join(c for c in "\t\n\v\f\r" if not any(c in p for p in plain))
        others = "".join(c for c in "\t\n\v\f\r" if c not in cuts)
        self.chunk = re.compile(rf"[{cuts}]\s*\S*(?:[{others}]\s*\S*)*" if others else r"\s+\S*")
        self.chunks: Memory[str, Aligned] = Memory(self.learn, max_chunks)

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def learn(self, chunks: list[str]) -> list[Aligned]:
        """Alignments of new chunks, each of which begins at a cut."""
        # A chunk that ends in white space is a text's last: joined to others, its spaces would be theirs. B reads its own space mark as a space.
        alone = [c[-1:].isspace() or SPACE in c for c in chunks]
        joined = [c for c, x in zip(chunks, alone) if not x]
        together = iter([a for i in range(0, len(joined), LEARN_CHUNKS) for a in self.aligned(joined[i : i + LEARN_CHUNKS])])
        return [self.aligned([c])[0] if x else next(together) for c, x in zip(chunks, alone)]

    def aligned(self, chunks: list[str]) -> list[Aligned]:
        if not chunks:
            return []
        text = "".join(chunks)
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        ids_b = np.array(self.b.encode("x" + text)[1:], dtype=np.int64)
        data = text.encode()
        if b"".join([self.bytes_b[i] for i in ids_b]) != data or b"".join([self.bytes_a[i] for i in ids_a]) != data:
            return [DIFFERS] if len(chunks) == 1 else [self.aligned([c])[0] for c in chunks]
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        starts_a, starts_b = ends_a - self.length_a[ids_a], ends_b - self.length_b[ids_b]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        chunk_ends = np.cumsum([len(c.encode()) for c in chunks])
        if not np.isin(chunk_ends, cuts, assume_unique=True).all():
            raise ValueError("a token goes on past a chunk")

        # Links: the B tokens that overlap each A token are neighbours.
        first, past = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a, side="left")
        n = past - first
        before = np.cumsum(n) - n
        pairs = np.repeat(ids_a, n) * self.size_b + ids_b[np.repeat(first - before, n) + np.arange(n.sum())]

        # The first token, group and link of each chunk, and the first tokens of each group.
        def bounds(ends: np.ndarray, at: np.ndarray) -> list[int]:
            return [0, *np.searchsorted(ends, at, side="right").tolist()]

        of_a, of_b, of_group = bounds(ends_a, chunk_ends), bounds(ends_b, chunk_ends), bounds(cuts, chunk_ends)
        upto = [0, *np.cumsum(n)[np.array(of_a[1:]) - 1].tolist()]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        each = np.arange(len(cuts) + 1)
        cut_a, cut_b = np.searchsorted(group_a, each).tolist(), np.searchsorted(group_b, each).tolist()
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups = [f"{','.join(a[p:q])}|{','.join(b[r:s])}" for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        packed = pairs.astype(np.int32)
        return [
            Aligned(";".join(groups[of_group[i] : of_group[i + 1]]), packed[upto[i] : upto[i + 1]].tobytes(), of_a[i + 1] - of_a[i], of_b[i + 1] - of_b[i], of_group[i + 1] - of_group[i])
            for i in range(len(chunks))
        ]

    def batch(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """For each text its counts, the digest of its groups, and its distinct pairs with multiplicities."""
        found: list[list[str]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if text and FAR_SPACE.search(text):
                whole.append(i)
            found.append(self.chunk.findall(f" {text}") if text and (not whole or whole[-1] != i) else [])
        n_chunks = np.array(list(map(len, found)), dtype=np.int64)
        coded = pa.array([c for chunks in found for c in chunks], pa.large_string()).dictionary_encode()
        values = list(self.chunks.values(coded.dictionary.to_pylist()))
        which = coded.indices.to_numpy()
        # Whole texts are chunks of their own, which aren't worth remembering.
        for i in whole:
            which = np.insert(which, int(n_chunks[:i].sum()), len(values))
            n_chunks[i] = 1
            values += self.learn([f" {texts[i]}"])
        ends = np.cumsum(n_chunks)
        doc = np.repeat(np.arange(len(texts)), n_chunks)

        bad = np.array([v.groups is None for v in values], dtype=bool)[which] if len(values) else np.zeros(0, dtype=bool)
        good = np.bincount(doc[bad], minlength=len(texts)) == 0
        which, doc = which[good[doc]], doc[good[doc]]
        n_pairs = np.array([len(v.pairs) // 4 for v in values], dtype=np.int64)

        def total(counts: np.ndarray) -> pa.Array:
            return pa.array(np.bincount(doc, weights=counts[which], minlength=len(texts)).astype(np.int64))

        starts = ends - n_chunks
        all_groups = [v.groups for v in values]
        digests, at = [], 0
        for n, fine in zip((ends - starts).tolist(), good.tolist()):
            if not (n and fine):
                digests.append("")
                continue
            digests.append(hashlib.sha256(";".join([all_groups[i] for i in which[at : at + n].tolist()]).encode()).hexdigest())
            at += n

        # Distinct chunks of each text with their number, then distinct pairs with theirs.
        keys, times = np.unique(doc * len(values) + which, return_counts=True)
        of_doc, chunk = (keys // len(values), keys % len(values)) if len(values) else (keys, keys)
        pairs, _ = taken(np.frombuffer(b"".join([v.pairs for v in values]), dtype=np.int32), n_pairs, chunk)
        keys, place = np.unique((np.repeat(of_doc, n_pairs[chunk]) << 31) | pairs, return_inverse=True)
        times = np.bincount(place, weights=np.repeat(times, n_pairs[chunk]), minlength=len(keys)).astype(np.int32)
        offsets = pa.array(np.searchsorted(keys >> 31, np.arange(len(texts) + 1)).astype(np.int32))
        return {
            "n_a": total(np.array([v.n_a for v in values], dtype=np.int64)),
            "n_b": total(np.array([v.n_b for v in values], dtype=np.int64)),
            "n_groups": total(np.array([v.n_groups for v in values], dtype=np.int64)),
            "n_links": total(n_pairs),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(offsets, pa.array((keys & ((1 << 31) - 1)).astype(np.int32))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row.

    ``row`` numbers the rows. ``pairs`` are the distinct linked pairs, A's id times B's
    number of pieces plus B's id, and ``times`` says how often each occurs.
    """
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        for batch in slices(batches, ALIGN_ROWS):
            columns = aligner.batch(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns.values()], names=["row", "doc_id", *columns])
        aligner.chunks.clear()

    return rows.mapInArrow(make, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n_docs (rows that hold it linked) and best (whether no pair of its A id has more), counted in salted parts."""
    salt = F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")
    parts = aligned.select(salt, F.explode("pairs").alias("pair")).groupBy("pair", "salt").agg(F.count("*").alias("n"))
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    # An A id has at most as many pairs as B has pieces.
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def link_figures(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``count_sum`` adds, over a row's links, how many rows hold the pair linked; ``n_best``
    counts the links whose pair has the highest such count of all pairs of its A id.

    - A null or empty text, or one whose tokens' bytes differ from the text (B reads
      its own space mark as a space), has no tokens: zeros and an empty digest.
    - Each row is a document of its own, whatever its id; a null id stays null.
    - Strings of special tokens in a text are plain text. Extra columns are ignored.
    - An empty table gives an empty result.
    """
    path_b = path_b or tokenizer_path("piece_bpe_32k.model")
    aligned = cut_lineage(align(docs, path_a, path_b), "aligned")
    counts = cut_lineage(pair_counts(aligned, _pieces(path_b)), "pair-counts")
    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    if counts.count() <= BROADCAST_PAIRS:
        counted = links.join(F.broadcast(counts), "pair")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        counted = links.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(counts.select("*", salts), ["pair", "salt"])
    # A row's links are neighbours, so they are summed before they are shuffled.
    sums = counted.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
