import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from datumloom.llm import packing, records, suffix_pieces
from datumloom.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def odd_texts(n):
    rnd = random.Random(3)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(128, 0x600), lambda: rnd.randrange(0x1E00, 0x2100), lambda: rnd.choice([9, 10, 0x1C, 0x3A3, 0x130, 0x301, 0x2028, 0x85, 0xA0, 0x2581])]
    return ["".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_words_ids_are_the_librarys(library, documents, odd_rows):
    encoder = WordEncoder(tokenizer_path(), max_words=500)
    texts = [r.text for r in documents.collect()] + odd_texts(2000) + [r[1] or "" for r in odd_rows] 
    texts += ["a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|><|endoftext|> ", "it's o'clock' 'S ..'s", "ΟΔΟΣ ΣΑΣ", "a\u0378b C\u0301 <|endoftext|>", "²³x½ 1a2b", "word…!! word!!…"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == e.ids


def test_crc32c():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in (0, 1, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000)]

    def slow(data):
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (records.POLYNOMIAL if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]


def test_damage_is_noticed():
    data = b"".join(records.frames([b"first payload", b"second"]))
    assert records.unframe(data, "f", True) == ([b"first payload", b"second"], len(data))
    for i in range(len(data)):
        broken = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
        with pytest.raises(records.Corrupt):
            records.unframe(broken, "f", True)


def test_records_round_trip(spark, documents, library, tmp_path):
    records.write_records(documents, str(tmp_path / "r"), n_files=3)
    rows = sorted(records.read_records(spark, str(tmp_path / "r")).collect(), key=lambda r: r.start)
    at = 0
    for r, d in zip(rows, sorted(documents.collect(), key=lambda d: d.doc_id), strict=True):
        ids = ids_of(library, d.text)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d.doc_id, at, len(ids), ids.tobytes())
        at += len(ids)
    digest = {r.doc_id: r.ids_crc32 for r in records.digests(records.read_records(spark, str(tmp_path / "r"))).collect()}
    assert digest == {r.doc_id: zlib.crc32(bytes(r.ids)) for r in rows}
    for doc_id, ids in records.fetch(str(tmp_path / "r"), [3, 150, 7]).items():
        assert ids.tobytes() == bytes(next(r.ids for r in rows if r.doc_id == doc_id))


def test_records_of_odd_rows(spark, odd, odd_rows, none, library, tmp_path):
    records.write_records(odd, str(tmp_path / "r"), n_files=2)
    rows = records.read_records(spark, str(tmp_path / "r")).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, ids_of(library, t).tobytes()) for i, t, *_ in odd_rows)
    records.write_records(none, str(tmp_path / "e"))
    assert records.read_records(spark, str(tmp_path / "e")).collect() == []


def check_packed(rows, want, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (capacity * len(sequences))


def test_packing_keeps_every_id_and_little_padding(documents, library):
    want = {d.doc_id: ids_of(library, d.text) for d in documents.collect()}
    assert check_packed(packing.pack_documents(documents).collect(), want, 2048) > 0.95


def test_differencing_is_near_equal_and_counts_rise():
    rng = np.random.default_rng(0)
    sizes = rng.integers(50, 512, 400)
    loads = np.bincount(packing.difference(sizes, 40), weights=sizes)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() < 30
    three = np.array([60, 60, 60])  # 180 fits two windows of 100 in sum, but no two pieces share one
    assert len(set(packing.windows_for(three, 100).tolist())) == 3
    assert packing.difference(np.array([5]), 3).tolist() == [0]
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_sequences_hold_the_ids(documents, library):
    packed = packing.pack_documents(documents.limit(20), capacity=256, with_ids=True)
    rows = packed.collect()
    built = {r.sequence_id: r.ids for r in packing.sequences(packed, 256, pad_id=7).collect()}
    for r in rows:
        assert np.array(built[r.sequence_id][r.offset : r.offset + r.length], dtype="<u4").tobytes() == bytes(r.ids)
    assert all(len(ids) == 256 for ids in built.values())


def test_packing_odd_rows(odd, odd_rows, none, library):
    rows = packing.pack_documents(odd, capacity=128).collect()
    once = {i: ids_of(library, t) for i, t, *_ in odd_rows if i not in (9, 10, None)}
    assert check_packed([r for r in rows], once, 128) > 0.5
    assert sum(r.length for r in rows) == sum(len(ids_of(library, t)) for _, t, *_ in odd_rows)
    assert packing.pack_documents(none).collect() == []


def test_equal_rows_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 500)
    equal = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'the same text' as text")
    rows = packing.pack_documents(equal, capacity=64).collect()
    blocks = Counter(r.sequence_id // packing.STRIDE for r in rows)
    assert len(rows) == 10_000 and len(blocks) == 20 and max(blocks.values()) < 700
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(h) == [(4 * i, 4) for i in range(len(h))] and len(h) <= 16 for h in held.values())


@pytest.mark.parametrize("length", [100, 121, 300, 342, 410, 415, 600, 683, 820, 1000, 1366, 1500, 1900, 2000])
def test_documents_of_one_length_leave_little_padding(length):
    rng = np.random.default_rng(length)
    n = 128 * 2048 // length
    sizes = np.array([x for _ in range(n) for x in packing.cut_lengths(length, 2048, int(rng.integers(2**32)))])
    window = packing.windows_for(sizes, 2048)
    assert np.bincount(window, weights=sizes).max() <= 2048
    assert 1 - n * length / ((window.max() + 1) * 2048) < 0.04


def test_pieces_cover_a_document():
    for capacity in (1, 2, 7, 33, 2048):
        for n in (1, 2, 31, 64, 65, 127, 512, 513, 2047, 2048, 2049, 5000):
            for seed in (0, 1, 2**32 - 1):
                cut = packing.cut_lengths(n, capacity, seed)
                assert sum(cut) == n and min(cut) >= 1
                assert all(x == capacity or x <= max(1, capacity // 4) for x in cut)


def test_windows_do_not_depend_on_the_files(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_WINDOWS", 4)
    cut = packing.pieces(documents.union(documents.limit(20)))
    one, many = (sorted(map(tuple, packing.pack(packing.cut_lineage(cut.repartition(n), "pieces")).collect())) for n in (1, 7))
    assert one == many


def test_a_payload_that_no_reader_takes_is_refused(monkeypatch):
    monkeypatch.setattr(records, "MAX_PAYLOAD", 10)
    with pytest.raises(ValueError):
        records.frames([b"x" * 11])


def test_suffix_array_sorts_to_the_depth():
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 4, 300).astype(np.int32)
    order = suffix_pieces.suffix_array(codes, 16)
    keys = [tuple(codes[i : i + 16]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


def test_pieces_are_the_librarys(documents, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=suffix_pieces.model_path())
    encoder = suffix_pieces.PieceEncoder(suffix_pieces.model_path(), max_segments=2000)
    texts = [r.text for r in documents.collect()] + odd_texts(1000) + [r[1] or "" for r in odd_rows] + ["", " ", "  a  b ", "a" * 1000, "the" * 200, "<s> <unk> <0x41>", "\0 x\0"]
    texts += [" a", "a ", "  ", "a   b", "▁", "▁ a▁▁b ", " \n x"]
    ids, bounds = encoder.encode_batch(texts)
    decoded = encoder.decode_batch(ids, bounds)
    for t, low, high, d in zip(texts, bounds[:-1], bounds[1:], decoded, strict=True):
        assert ids[low:high].tolist() == model.encode(t)
        assert d == model.decode(model.encode(t))


def test_pieces_of_odd_rows(odd, odd_rows, none):
    rows = suffix_pieces.encode(odd).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, (t or "").replace("▁", " ")) for i, t, *_ in odd_rows)
    assert {r.n_tokens for r in suffix_pieces.digests(suffix_pieces.encode(odd)).collect() if r.doc_id in (2, 3)} == {0}
    assert suffix_pieces.encode(none).collect() == []
