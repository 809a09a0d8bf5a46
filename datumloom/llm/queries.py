"""The package's registered queries, each a thin use of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.llm import compression, conversation_trie, graph_search, license_scan, near_dedup, packing, pairwise_quality, records, sharding, simhash, suffix_pieces, token_alignment, toxicity
from datumloom.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 bytes of ``text``, byte by byte.
CRC32_SQL = """
crc_step AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
),
crc AS (
  SELECT doc_id, text, xor(list_reduce(
      list_prepend(4294967295::BIGINT,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT doc_id, text FROM documents), crc_step
)"""


@query(
    "op1_shard_interleave",
    f"""WITH {CRC32_SQL},
ranked AS (
  SELECT doc_id, text, 's' || source AS source, md5('7|' || doc_id) AS h,
         count(*) OVER (PARTITION BY source) AS total,
         row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS rank
  FROM documents
),
placed AS (
  SELECT doc_id, text,
         row_number() OVER (ORDER BY (rank - (('0x' || substr(md5('7|' || source), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
                                     / total, source, h, doc_id) - 1 AS pos,
         count(*) OVER () AS n
  FROM ranked
)
SELECT p.doc_id, strlen(coalesce(p.text, '')) + 1 AS size, text_crc32, 'rows' AS law,
       (pos * 16 // n)::INT AS shard, (pos - ((pos * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed p JOIN crc ON crc.doc_id = p.doc_id AND crc.text IS NOT DISTINCT FROM p.text""",
)
def op1_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of all documents, interleaved by source: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = sharding.interleave(table(spark, sf_dir, "documents"), n_shards=16, seed=7)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_compression_bands")
def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression verdict of every document."""
    return compression.compression_bands(table(spark, sf_dir, "documents"))


@query("op3_toxicity_ordinal")
def op3_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grades of every document, learned from ``labels.toxic``."""
    return toxicity.toxicity_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality_pairwise")
def op8_quality_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from ``labels.quality``."""
    return pairwise_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_token_records")
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as framed records and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_folder(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), folder)
    return records.digests(records.read_records(spark, folder))


@query("op6_pack_differencing")
def op6_pack_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in windows of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query(
    "op9_near_dedup",
    r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)
),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are 80 % alike: doc_id, n_shingles, component_id, kept."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query("op10_graph_search")
def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector's ten nearest among all others: query_id, rank, vec_id, score."""
    return graph_search.nearest(table(spark, sf_dir, "embeddings"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts in all documents, with coverage and spans."""
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


@query("op7_suffix_pieces")
def op7_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids and their decoding: doc_id, n_tokens, ids_crc32, decoded_crc32."""
    return suffix_pieces.digests(suffix_pieces.encode(table(spark, sf_dir, "documents")))


@query(
    "op12_prefix_trie",
    r"""WITH RECURSIVE crc_step AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_step
),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
),
visits AS (
  SELECT conv_id, list([role, text]) OVER (PARTITION BY conv_id ORDER BY part, place) AS path,
         length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY part DESC, place DESC) = 1 AS ends
  FROM rebuilt
  UNION ALL
  SELECT conv_id, [], 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM c
),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM visits GROUP BY path
),
below AS (
  SELECT list_slice(path, 1, d) AS path, sum(leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT path, n_convs, words, path NOT IN (SELECT list_slice(path, 1, len(path) - 1) FROM nodes WHERE len(path) > 0) AS leaf,
               unnest(range(0, len(path) + 1)) AS d FROM nodes)
  GROUP BY 1
),
children AS (SELECT list_slice(path, 1, len(path) - 1) AS path, count(*) AS n FROM nodes WHERE len(path) > 0 GROUP BY 1)
SELECT n.conv_id, len(n.path)::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children k ON k.path = n.path
LEFT JOIN nodes p ON len(n.path) > 0 AND p.path = list_slice(n.path, 1, len(n.path) - 1)""",
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = conversation_trie.turns_of(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.with_shared_heads(turns))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' tokens of every document aligned: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return token_alignment.link_figures(table(spark, sf_dir, "documents"))


@query("op11_simhash_dedup")
def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 2 bits: doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, distance=2)
