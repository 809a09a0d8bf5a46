import zlib
from collections import Counter, defaultdict

from datumloom.llm import sharding


def placed(df, **options):
    return sharding.interleave(df, **options).collect()


def test_counts_slots_and_digests(documents):
    rows = placed(documents, n_shards=16)
    texts = {r.doc_id: r.text for r in documents.collect()}
    slots = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 4 < 3, 'big', 'small') as source")
    per = Counter((r.shard, r.source) for r in placed(docs, n_shards=8, carry=("source",)))
    for shard in range(8):
        assert abs(per[shard, "big"] - 375) <= 2 and abs(per[shard, "small"] - 125) <= 2


def test_partitioning_does_not_matter(documents):
    one = {(r.doc_id, r.shard, r.slot) for r in placed(documents.repartition(1))}
    assert one == {(r.doc_id, r.shard, r.slot) for r in placed(documents.repartition(7))}


def test_a_source_for_every_row(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'t' as text", "cast(id as string) as source")
    counts = Counter(r.shard for r in placed(docs))
    assert set(counts.values()) <= {31, 32}


def test_odd_rows(odd, odd_rows, none):
    rows = placed(odd, n_shards=4, carry=("lang", "shard"))
    assert len(rows) == len(odd_rows)
    assert sorted(r.position for r in rows) == list(range(len(odd_rows)))
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {1}
    assert {r.text_crc32 for r in rows if r.doc_id == 2} == {0}
    assert placed(none) == []


def test_written_shards_keep_slot_order(spark, documents, tmp_path):
    sharded = sharding.interleave(documents, n_shards=4, carry=("text",))
    sharding.write_shards(sharded, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.shard, r.slot, r.text) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot, r.text) for r in sharded.collect())
