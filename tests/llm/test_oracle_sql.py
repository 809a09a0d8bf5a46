"""The SQL of the operators that have one, on a fixture small enough for a join of all shingles."""

import duckdb

from datumloom.llm.queries import ORACLES, QUERIES


def test_queries_equal_their_sql(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(120)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    spark.read.parquet(f"{sf}/conversations.parquet").write.parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert set(ORACLES) == {"op1_shard_interleave", "op9_near_dedup", "op12_prefix_trie"}
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, str(tmp_path))
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))
