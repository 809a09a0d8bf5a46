"""SentencePiece encoding and decoding with a suffix array.

A batch's normalized texts are cut where white space begins (no piece goes on past
such a place) and each distinct segment is kept once. The segments are concatenated
and a suffix array of the result is made, sorted as deep as the longest piece. Every
piece of the vocabulary is then found by binary search: its occurrences are one range
of the suffix array. The occurrences are edges (position, length, piece); a table by
position and length is their sorted form, since lengths are at most 16. Relaxing over
the edges gives the segments' pieces.

What relaxing means depends on the model. A unigram model asks for the path of best
score. The BPE model here has no path score: a symbol sequence is relaxed by taking,
in each segment, the adjacent pair whose joint edge has the best score (the leftmost
of equals) until no pair has an edge. That gives the library's ids; a best-score path
would not. All segments of a batch are relaxed together, a step at a time.

Characters that no piece covers become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.llm.common import Memory, id_lists, pick, slices, taken
from datumloom.llm.tokens import ENCODE_ROWS

SPACE = "▁"
SPACES = re.compile("  +")
SEPARATOR = "\0"
#: Characters in one suffix array, about; and segments longer than this are relaxed with a heap.
INDEX_CHARS, LONG = 600_000, 200
NONE = np.iinfo(np.int32).min
#: A text that the models which fold characters or spaces, or put none in front, encode otherwise.
PROBE = "The  ﬁnal Ⅳ quick brown foxes jumped over ½ lazy dogs' unbelievable tokenization ,.;  Ångström\n"
#: So many characters, of 21 bits each, are compared at once.
FOLD, CHARACTER, ALL = 3, (1 << 21) - 1, (1 << 63) - 1


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(codes: np.ndarray) -> np.ndarray:
    """At each place of the last axis, but the last few, the ``FOLD`` characters from there on as one number."""
    return sum(codes[..., i : codes.shape[-1] - FOLD + 1 + i].astype(np.int64) << (21 * (FOLD - 1 - i)) for i in range(FOLD))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` characters from there on (by three, nine, ... characters a round)."""
    n = len(codes)
    rank, known = codes.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        fold = min(3, 62 // bits) if known * 3 <= 2 * depth or known == 1 else 2
        key = np.zeros(n, dtype=np.int64)
        for i in range(fold):
            shifted = np.zeros(n, dtype=np.int64)
            if i * known < n:
                shifted[: n - i * known] = rank[i * known :]
            key = (key << bits) | shifted
        order = np.argsort(key, kind="stable")
        known *= fold
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])


class PieceEncoder:
    """A model's pieces, and a bounded memory of segments' ids while the process lives."""

    _kept: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, max_segments: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_ids = [0] * 256
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append((piece, i))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.depth = max(len(p) for p, _ in normal)
        self.ids = np.array([i for _, i in normal], dtype=np.int32)
        self.lengths = np.array([len(p) for p, _ in normal], dtype=np.int64)
        self.codes = np.zeros((len(normal), self.depth), dtype=np.int32)
        for row, (piece, _) in enumerate(normal):
            self.codes[row, : len(piece)] = [ord(c) for c in piece]
        # Scores as ranks: larger is better, equal scores keep equal ranks.
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self.byte_lengths = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        # Three characters of a piece in one number, and a mask for the characters that it has.
        self.packed = packed(np.pad(self.codes, ((0, 0), (0, FOLD))))[:, : self.depth : FOLD]
        has = np.where(np.arange(self.depth + FOLD) < self.lengths[:, None], CHARACTER, 0)
        self.masks = packed(has)[:, : self.depth : FOLD]
        self.segments: Memory[str, bytes] = Memory(self.learn, max_segments)
        # Models that fold characters or spaces, or relax otherwise, are none of those that this class can follow.
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal) or self.encode_batch([PROBE])[0].tolist() != model.encode(PROBE):
            raise ValueError(f"{path} isn't a BPE model with byte pieces, without normalization, whose pieces end before white space")

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Piece id by position and length (column 0 unused); -1 where no piece fits."""
        order = suffix_array(codes, self.depth)
        n = len(codes)
        suffixes = packed(np.pad(codes.astype(np.int64), (0, self.depth + 2 * FOLD)))
        # The first characters give a range; what is longer is searched for within it.
        heads, first = suffixes[order], self.packed[:, 0]
        low = np.searchsorted(heads, first)
        high = np.searchsorted(heads, first | (ALL ^ self.masks[:, 0]), side="right")
        longer = np.flatnonzero((self.lengths > FOLD) & (low < high))
        steps, rest, masks = np.arange(FOLD, self.depth, FOLD), self.packed[longer, 1:], self.masks[longer, 1:]
        each = np.arange(len(longer))

        def bound(after: bool) -> np.ndarray:
            """The first place in the range that isn't before each piece, or that is after all its occurrences."""
            from_, to = low[longer], high[longer]
            while (open_ := from_ < to).any():
                middle = (from_ + to) // 2
                difference = (suffixes[order[np.minimum(middle, n - 1)][:, None] + steps] & masks) - rest
                sign = difference[each, (difference != 0).argmax(axis=1)]
                right = open_ & ((sign < 0) | (after & (sign == 0)))
                from_, to = np.where(right, middle + 1, from_), np.where(open_ & ~right, middle, to)
            return from_

        low[longer], high[longer] = bound(False), bound(True)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        table = np.full((n, self.depth + 1), -1, dtype=np.int32)
        table[at, self.lengths[which]] = self.ids[which]
        return table

    def relax(self, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all symbols at the end, in order, for segments [starts, ends)."""
        lengths = ends - starts
        at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))
        segment = np.repeat(np.arange(len(starts)), lengths)
        to = at + 1
        done_at, done_to = [], []

        def joint(left: np.ndarray) -> np.ndarray:
            """The rank of joining the symbols at these indices with their successors; NONE if there is no edge."""
            out = np.full(len(left), NONE, dtype=np.int32)
            ok = left + 1 < len(at)
            ok[ok] = segment[left[ok]] == segment[left[ok] + 1]
            some = left[ok]
            size = to[some + 1] - at[some]
            fits = size <= self.depth
            piece = np.where(fits, table[at[some], np.where(fits, size, 0)], -1)
            out[ok] = np.where(piece >= 0, self.rank[piece], NONE)
            return out

        value = joint(np.arange(len(at)))
        while len(at):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.maximum.reduceat(value, first)
            size = np.diff(np.r_[first, len(at)])
            finished = np.repeat(best == NONE, size)
            if finished.any():
                done_at.append(at[finished])
                done_to.append(to[finished])
                keep = ~finished
                at, to, segment, value = at[keep], to[keep], segment[keep], value[keep]
                if not len(at):
                    break
                first, best, size = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]), best[best != NONE], size[best != NONE]
            hit = np.flatnonzero(value == np.repeat(best, size))
            hit = hit[np.r_[True, segment[hit[1:]] != segment[hit[:-1]]]]  # the leftmost of each segment
            to[hit] = to[hit + 1]
            keep = np.ones(len(at), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            at, to, segment, value = at[keep], to[keep], segment[keep], value[keep]
            value[moved] = joint(moved)
            before = moved[moved > 0] - 1
            value[before] = joint(before)
        if not done_at:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        all_at, all_to = np.concatenate(done_at), np.concatenate(done_to)
        order = np.argsort(all_at, kind="stable")
        return all_at[order], all_to[order]

    def relax_long(self, table: np.ndarray, start: int, end: int) -> tuple[list[int], list[int]]:
        """The same for one long segment, with a heap of pairs."""
        after = {i: i + 1 for i in range(start, end)}
        before = {i: i - 1 for i in range(start + 1, end)}
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < end and after[j] - i <= self.depth and (piece := table[i, after[j] - i]) >= 0:
                heapq.heappush(heap, (-int(self.rank[piece]), i, after[j]))

        for i in range(start, end):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            if i not in after or after[i] >= end or after[after[i]] != to:
                continue
            j = after.pop(i)
            after[i] = after.pop(j)
            if to < end:
                before[to] = i
            offer(i)
            if i in before and i > start:
                offer(before[i])
        at = sorted(after)
        return at, [after[i] for i in at]

    def learn(self, keys: list[str]) -> list[bytes]:
        """The ids of segments, given without the mark of white space that each begins with."""
        out: list[bytes] = []
        start = size = 0
        for stop, key in enumerate(keys, 1):
            size += len(key) + 2
            if size > INDEX_CHARS or stop == len(keys):
                out.extend(self.index([SPACE + k for k in keys[start:stop]]))
                start, size = stop, 0
        return out

    def index(self, segments: list[str]) -> list[bytes]:
        """The segments' ids by one suffix array over all of them."""
        text = SEPARATOR.join(segments) + SEPARATOR
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
        table = self.edges(codes)
        lengths = np.array(list(map(len, segments)), dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        short = lengths <= LONG
        at, to = self.relax(table, starts[short], ends[short])
        for s, e in zip(starts[~short].tolist(), ends[~short].tolist()):
            more = self.relax_long(table, s, e)
            at, to = np.r_[at, np.array(more[0])], np.r_[to, np.array(more[1])]
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        pieces = table[at, to - at]
        bare = np.flatnonzero(pieces < 0)  # single characters without a piece
        if len(bare):
            spelled = [[self.byte_ids[b] for b in text[a].encode()] for a in at[bare].tolist()]
            counts = np.ones(len(at), dtype=np.int64)
            counts[bare] = list(map(len, spelled))
            pieces, at = np.repeat(pieces, counts), np.repeat(at, counts)
            pieces[pieces < 0] = [p for s in spelled for p in s]
        bounds = (4 * np.r_[0, np.searchsorted(at, ends)]).tolist()
        data = pieces.astype("<u4").tobytes()
        return [data[low:high] for low, high in zip(bounds, bounds[1:])]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and their bounds. An empty text has none.

        Every segment begins with a mark of white space, the first one's put in front
        of the text. So cutting at a run's first mark gives the segments without it.
        """
        marked = [SPACES.sub(lambda m: " " + SPACE * (len(m[0]) - 1), f" {t}".replace(SPACE, " "))[1:] if "  " in t or SPACE in t or t[:1] == " " else t for t in texts]
        split = pc.split_pattern(pa.array([t or None for t in marked], pa.large_string()), " ")
        numbered = pc.dictionary_encode(pc.list_flatten(split))
        values = self.segments.values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.array(list(map(len, values)), dtype=np.int64) // 4
        ids, upto = taken(np.frombuffer(b"".join(values), dtype="<u4"), lengths, numbered.indices.to_numpy())
        return ids, upto[split.offsets.to_numpy()]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each stretch of ids: pieces with spaces for their marks, without the space put in front."""
        data, upto = taken(self.all_bytes, self.byte_lengths, ids)
        data, at = data.tobytes(), upto[bounds].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", errors="replace") for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit) and decoded text of every row.

    - A null or empty text has no ids and decodes to the empty text. A null id stays null.
    - Repeated rows are each encoded. A whole text is encoded, however long.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    path = path or model_path()
    rows = pick(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in slices(batches, ENCODE_ROWS):
            ids, bounds = encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            decoded = encoder.decode_batch(ids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(ids, bounds), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, the unsigned CRC-32 of the ids, and that of the decoded text's UTF-8 bytes."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
