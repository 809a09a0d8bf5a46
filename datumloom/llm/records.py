"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A data file is a row of frames, one for each document:

    length of the payload      8 bytes, unsigned
    masked CRC-32C of those    4 bytes
    payload                    as long as stated
    masked CRC-32C of it       4 bytes

All numbers are little-endian. The mask of a checksum c is ((c >> 15 | c << 17) +
0xA282EAD8) mod 2^32. The payload is a byte that is 1 if the document has an id, the
id (8 bytes, signed; 0 if there is none) and the token ids, of 2 bytes each if the
vocabulary fits, else of 4.

Beside each data file lies an index file of 25 bytes a frame: the same flag and
document id, the frame's offset, and the number of ids before this document in the
same file. It lets a reader fetch any record alone. ``manifest.json`` names the committed files with their
record and id counts; files of failed or repeated attempts aren't in it.

Both directions are Spark data sources: ``df.write.format("token_records")`` encodes
texts and writes them, ``spark.read.format("token_records")`` gives their ids.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from datumloom.llm.common import pick, slices
from datumloom.llm.tokens import WordEncoder, tokenizer_path

MASK = 0xA282EAD8
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
BLOCK = 64
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("start", "<u8")])
HEAD = 9  # bytes of a payload before the token ids
#: Texts that a writer encodes together; more share more words.
WRITE_ROWS = 2000
READ_BYTES = 8 << 20
#: No document comes near this; a larger length is damage.
MAX_PAYLOAD = 1 << 31


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


TABLE = crc_table()


def zeros_operator(n_bytes: int) -> np.ndarray:
    """Four tables that carry a checksum past ``n_bytes`` zero bytes, by its own four bytes."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]).ravel()
    for _ in range(n_bytes):
        states = TABLE[states & 0xFF] ^ (states >> 8)
    return states.reshape(4, 256)


def shift(states: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][states & 0xFF] ^ tables[1][(states >> 8) & 0xFF] ^ tables[2][(states >> 16) & 0xFF] ^ tables[3][states >> 24]


_shifts: list[np.ndarray] = []


def shift_by_blocks(power: int) -> np.ndarray:
    """The operator for 2 ** power blocks of zero bytes."""
    while len(_shifts) <= power:
        if not _shifts:
            _shifts.append(zeros_operator(BLOCK))
        else:
            _shifts.append(np.stack([shift(row, _shifts[-1]) for row in _shifts[-1]]))
    return _shifts[power]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The CRC-32C of every part, all at once.

    Every part is cut into blocks that end where it ends (zero bytes in front change
    nothing, since the start value is folded into the first four bytes). All blocks
    go through the table together, byte by byte, and then neighbours are joined.
    """
    if not parts:
        return np.zeros(0, dtype=np.uint32)
    lengths = np.array([len(p) for p in parts])
    # The start value of all ones equals flipping the first four bytes; shorter parts are done apart.
    short = lengths < 4
    out = np.zeros(len(parts), dtype=np.uint32)
    for i in np.flatnonzero(short):
        state = 0xFFFFFFFF
        for byte in parts[i]:
            state = int(TABLE[(state ^ byte) & 0xFF]) ^ (state >> 8)
        out[i] = state ^ 0xFFFFFFFF
    long = np.flatnonzero(~short)
    if not len(long):
        return out
    lengths = lengths[long]
    n_blocks = -(-lengths // BLOCK)
    ends = np.cumsum(n_blocks) * BLOCK
    padded = np.zeros(int(ends[-1]), dtype=np.uint8)
    for i, end, n in zip(long, ends, lengths):
        padded[end - n : end] = np.frombuffer(parts[i], dtype=np.uint8)
    head = (ends - lengths)[:, None] + np.arange(4)[None, :]
    padded[head] ^= 0xFF
    columns = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    states = np.zeros(columns.shape[1], dtype=np.uint32)
    for column in columns:
        states = TABLE[(states ^ column) & 0xFF] ^ (states >> 8)
    # Join the blocks of each part from the right, two by two.
    owner = np.repeat(np.arange(len(long)), n_blocks)
    from_end = np.repeat(np.cumsum(n_blocks), n_blocks) - 1 - np.arange(len(owner))
    power = 0
    while len(states) > len(long):
        left = (from_end & 1) == 1
        moved = shift(states[left], shift_by_blocks(power))
        right = np.flatnonzero(left) + 1
        states[right] ^= moved
        keep = ~left
        states, from_end = states[keep], from_end[keep] >> 1
        power += 1
    out[long] = states ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and the two checksums."""
    if any(len(p) > MAX_PAYLOAD for p in payloads):
        raise ValueError("a payload is longer than a reader takes")
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    of_heads, of_payloads = masked(crc32c(heads)), masked(crc32c(payloads))
    return [b"".join((h, int(a).to_bytes(4, "little"), p, int(b).to_bytes(4, "little"))) for h, a, p, b in zip(heads, of_heads, payloads, of_payloads)]


def head(doc_id: int | None) -> bytes:
    return bytes([doc_id is not None]) + (doc_id or 0).to_bytes(HEAD - 1, "little", signed=True)


class Corrupt(ValueError):
    """A frame whose length or checksum is wrong."""


def unframe(data: bytes, name: str, at_end: bool) -> tuple[list[bytes], int]:
    """The payloads of the whole frames at the start of ``data``, and how many bytes they take."""
    payloads, heads, sums, at = [], [], [], 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        # A damaged length must not be waited for; others show by their checksum below.
        if size > MAX_PAYLOAD:
            raise Corrupt(f"{name}: bad length")
        if at + 16 + size > len(data):
            break
        heads.append((data[at : at + 8], int.from_bytes(data[at + 8 : at + 12], "little")))
        payloads.append(data[at + 12 : at + 12 + size])
        sums.append(int.from_bytes(data[at + 12 + size : at + 16 + size], "little"))
        at += 16 + size
    if (masked(crc32c([h for h, _ in heads])) != np.array([c for _, c in heads], dtype=np.uint32)).any():
        raise Corrupt(f"{name}: bad length checksum")
    if (masked(crc32c(payloads)) != np.array(sums, dtype=np.uint32)).any():
        raise Corrupt(f"{name}: bad payload checksum")
    if at_end and at != len(data):
        raise Corrupt(f"{name}: {len(data) - at} bytes after the last whole frame")
    return payloads, at


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a URI or of a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str | None
    n_records: int = 0
    n_ids: int = 0
    n_bytes: int = 0


class TokenRecordWriter(DataSourceArrowWriter):
    """Writes a data and an index file for each partition, in the order of its rows.

    Rows have doc_id and text, which is encoded here, so ids pass through no other process.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.width = options["path"], int(options.get("width", "2"))
        self.tokenizer, self.end_id = options["tokenizer"], int(options.get("end_id", "1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        # Every attempt has files of its own; the driver's manifest names those of one attempt.
        done = Written(task.partitionId(), f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}")
        encoder, kind = WordEncoder.of(self.tokenizer), "<u2" if self.width == 2 else "<u4"
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{done.name}.rec") as data, system.open_output_stream(f"{root}/{done.name}.idx") as index:
            for batch in slices(iterator, WRITE_ROWS):
                doc_ids = batch.column("doc_id").to_pylist()
                ids, bounds = encoder.encode_batch([t or "" for t in batch.column("text").to_pylist()], self.end_id)
                if self.width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 2 bytes")
                packed, cuts = ids.astype(kind).tobytes(), (self.width * bounds).tolist()
                framed = frames([head(i) + packed[a:b] for i, a, b in zip(doc_ids, cuts, cuts[1:])])
                counts, sizes = np.diff(bounds), np.array(list(map(len, framed)), dtype=np.int64)
                rows = np.zeros(len(framed), dtype=INDEX)
                rows["known"] = [i is not None for i in doc_ids]
                rows["doc_id"] = [i or 0 for i in doc_ids]
                rows["offset"] = done.n_bytes + np.cumsum(sizes) - sizes
                rows["start"] = done.n_ids + np.cumsum(counts) - counts
                index.write(rows.tobytes())
                for frame in framed:
                    data.write(frame)
                done.n_records += len(framed)
                done.n_ids += int(counts.sum())
                done.n_bytes += int(sizes.sum())
        # Words stay remembered for the worker's next file, unlike in packing, which shares its workers with other stages.
        if not done.n_records:
            for kind in ("rec", "idx"):
                system.delete_file(f"{root}/{done.name}.{kind}")
            done.name = None
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.partition):
            files.append({"name": m.name, "records": m.n_records, "ids": m.n_ids, "bytes": m.n_bytes, "start": start})
            start += m.n_ids
        with system.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"width": self.width, "ids": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        for m in messages:
            if m and m.name:
                for kind in ("rec", "idx"):
                    if system.get_file_info(f"{root}/{m.name}.{kind}").type == fs.FileType.File:
                        system.delete_file(f"{root}/{m.name}.{kind}")


@dataclass
class Part(InputPartition):
    name: str
    start: int
    width: int


class TokenRecordReader(DataSourceReader):
    """Reads each committed data file in order, checking every checksum, a few MB at a time."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        system, root = filesystem(self.path)
        with system.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
        parts = [Part(x["name"], x["start"], manifest["width"]) for x in manifest["files"]]
        return parts or [Part("", 0, 2)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = filesystem(self.path)
        kind, start, rest = "<u2" if partition.width == 2 else "<u4", partition.start, b""
        with system.open_input_stream(f"{root}/{partition.name}.rec") as data:
            while True:
                more = data.read(READ_BYTES)
                payloads, used = unframe(rest + more, partition.name, not more)
                rest = (rest + more)[used:]
                if payloads:
                    doc_ids = [int.from_bytes(p[1:HEAD], "little", signed=True) if p[0] else None for p in payloads]
                    ids = [np.frombuffer(p, dtype=kind, offset=HEAD).astype("<u4") for p in payloads]
                    counts = np.array([len(i) for i in ids], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array([i.tobytes() for i in ids], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += int(counts.sum())
                if not more:
                    return


class TokenRecords(DataSource):
    """Spark's way to these files. Options: path; for writing also tokenizer (its file), end_id, width (2 or 4 bytes an id)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> TokenRecordReader:
        return TokenRecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenRecordWriter:
        return TokenRecordWriter(self.options)


def write_records(docs: DataFrame, folder: str, path: str | None = None, width: int = 2, n_files: int | None = None, end_id: int = 1) -> None:
    """Encode all whole texts, each with ``end_id`` last, and write their records in ascending order of doc_id.

    The texts are sorted by ranges of ids, so each file holds one range; then each
    task encodes its texts and writes its own file. The number of files follows the
    session's shuffle partitions unless ``n_files`` says otherwise.

    - A null text is an empty document: the end id alone.
    - Documents with a null id come first and keep their null id.
    - Repeated ids are written as often as they occur, in the order of a hash of their texts.
    - Extra columns are ignored. An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    keys = [F.col("doc_id"), F.xxhash64("text")]  # hashes, since sampled range keys go to the driver
    ranged = rows.repartitionByRange(n_files, *keys) if n_files else rows.repartitionByRange(*keys)
    options = {"width": width, "tokenizer": path or tokenizer_path(), "end_id": end_id}
    ranged.sortWithinPartitions(*keys).write.format("token_records").options(**options).mode("append").save(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every record, checked."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").load(folder)


def fetch(folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """A few documents' ids by the index alone: what a shuffled reader does for each record."""
    system, root = filesystem(folder)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    wanted, found = set(doc_ids), {}
    for file in manifest["files"]:
        with system.open_input_stream(f"{root}/{file['name']}.idx") as f:
            index = np.frombuffer(f.read(), dtype=INDEX)
        ends = np.append(index["offset"][1:], file["bytes"])
        with system.open_input_file(f"{root}/{file['name']}.rec") as data:
            for i in np.flatnonzero(np.isin(index["doc_id"], list(wanted)) & (index["known"] == 1)):
                data.seek(int(index["offset"][i]))
                (payload,), _ = unframe(data.read(int(ends[i] - index["offset"][i])), file["name"], True)
                found[int(index["doc_id"][i])] = np.frombuffer(payload, dtype="<u2" if manifest["width"] == 2 else "<u4", offset=HEAD).astype("<u4")
    return found


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as 32-bit integers."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


