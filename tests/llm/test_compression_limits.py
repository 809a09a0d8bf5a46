import base64
import random

import zstandard

from datumloom.llm import compression

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_encoded_and_random_text_is_incompressible(spark):
    rng = random.Random(5)
    lined = [base64.encodebytes(rng.randbytes(n * 3 // 4)).decode() for n in (2000, 4000, 11000, 27000, 270000)]
    words = [" ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))) for _ in range(n // 7)) for n in (400, 900, 2000, 4000, 27000)]
    df = spark.createDataFrame(list(enumerate(lined + words)), "doc_id long, text string")
    rows = compression.compression_bands(df).collect()
    assert [r.doc_id for r in rows if r.kept or r.base_failed or r.reason != "incompressible"] == []


def test_encoded_passage_in_prose_is_found(spark, documents):
    compressor = zstandard.ZstdCompressor(level=3)
    prose = next(r.text for r in documents.orderBy("doc_id").collect() if 9000 < len(r.text or "") < 16000 and compression.verdict(r.text.encode(), compressor)[3] is None)
    passage = base64.encodebytes(random.Random(6).randbytes(9000)).decode()
    text = prose[:6000] + "\n" + passage + prose[6000:]
    assert compression.verdict(text.encode(), compressor)[3] in ("chunks", "incompressible")
