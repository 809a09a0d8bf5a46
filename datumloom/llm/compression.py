"""Quality rules on how well a text compresses.

Zstandard's ratio (bytes in / bytes out) is high for repetitive text and near 1
for text without any structure. What is normal grows with length, because a longer
text gives the compressor more to refer back to; so each band of lengths has limits
of its own. A whole document may hide a repetitive or random passage in ordinary
text, so fixed chunks are also measured, each on its own, and the share of chunks
outside the chunk limits is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from datumloom.llm.common import pick


class Band(NamedTuple):
    """Texts of at most ``max_bytes`` pass with a ratio from ``low`` to ``high``."""

    max_bytes: float
    low: float
    high: float


# Clean prose of four languages compresses at least 1.14 times up to 256
# bytes, 1.34 to 512, 1.47 to 1024, 1.73 to 4096, 2.12 to 16384 and 2.34 beyond; its
# chunks 1.77 times. Base64 and random letters and digits give at most 1.08 at 250
# bytes, 1.21 at 500, 1.31 at 1000, 1.37 at 4000 and 1.4 beyond (lower case alone: 1.57).
BANDS = (
    Band(256, 1.05, 3.0),
    Band(512, 1.25, 3.2),
    Band(1024, 1.35, 3.4),
    Band(2048, 1.45, 3.6),
    Band(4096, 1.6, 3.6),
    Band(16384, 1.7, 4.0),
    Band(float("inf"), 1.8, 5.0),
)
CHUNK = Band(2048, 1.6, 3.6)
MAX_BAD_CHUNKS = 0.3

SYMBOLS = "#*$%&|<>"
WINDOW = 8

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, reason string, kept boolean"
)


def words_in_repeated_windows(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    seen = set(windows)
    if len(seen) == len(windows):
        return 0
    seen.clear()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered = upto = 0
    for at, window in enumerate(windows):
        if window in twice:
            covered += at + size - max(at, upto)
            upto = at + size
    return covered


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text and its UTF-8 bytes."""
    words = data.split()  # for bytes: at space, \\t, \\n, \\v, \\f and \\r alone
    white = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - white,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        words_in_repeated_windows(words),
    )


def chunks(data: bytes, size: int) -> list[bytes]:
    """Consecutive chunks of ``size`` bytes; a rest under half of that joins the last one."""
    cuts = list(range(0, len(data), size))
    if len(cuts) > 1 and len(data) - cuts[-1] < size / 2:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]


def verdict(data: bytes, compressor: zstandard.ZstdCompressor, bands: tuple[Band, ...] = BANDS, chunk: Band = CHUNK, max_bad: float = MAX_BAD_CHUNKS) -> tuple[float, int, int, str | None]:
    """Ratio of the whole, chunks, chunks outside the limits, and why it is rejected (None: it passes)."""
    if not data:
        return 0.0, 0, 0, "empty"
    ratio = len(data) / len(compressor.compress(data))
    band = next(b for b in bands if len(data) <= b.max_bytes)
    # A text of a single chunk has its own band already.
    parts = chunks(data, int(chunk.max_bytes)) if len(data) >= 1.5 * chunk.max_bytes else []
    bad = sum(not chunk.low <= len(p) / len(compressor.compress(p)) <= chunk.high for p in parts)
    if ratio > band.high:
        return ratio, len(parts), bad, "repetitive"
    if ratio < band.low:
        return ratio, len(parts), bad, "incompressible"
    return ratio, len(parts), bad, "chunks" if bad > max_bad * len(parts) else None


def compression_bands(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: tuple[Band, ...] = BANDS,
    chunk: Band = CHUNK,
    max_bad: float = MAX_BAD_CHUNKS,
    level: int = 3,
) -> DataFrame:
    """Base counts, compression ratios and a verdict for every row; one scan, no shuffle.

    Returns the id and ``SCHEMA``: base_failed (fewer than 20 words, or over 30 % of
    them in repeated 8-word windows), ratio, chunk counts, reason (``base``,
    ``empty``, ``repetitive``, ``incompressible``, ``chunks`` or null) and kept.

    - A null text counts as empty: all counts 0, base_failed, not kept.
    - A null id stays null. Repeated rows are each judged on their own.
    - A very long text is measured whole, at the cost of a few copies of it.
    - Extra columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, id_col, text_col)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = text.encode()
                counts = base_counts(text, data)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                ratio, n, bad, reason = verdict(data, compressor, bands, chunk, max_bad)
                reason = "base" if failed and data else reason
                out.append((*counts, failed, ratio, n, bad, reason, reason is None))
            columns = list(zip(*out)) if out else [[]] * 11
            types = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = [id_col, *(c.split()[0] for c in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names=names)

    return rows.mapInArrow(judge, schema)
