import corpus_pipeline
from datumloom.llm import near_dedup, packing, pairwise_quality, toxicity
from datumloom.llm.queries import ORACLES, QUERIES


def test_stages_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near duplicates", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_the_stages_against_their_operators(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id for r in toxicity.toxicity_grades(docs, labels).where("kept").collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == clean
    good = {r.doc_id for r in pairwise_quality.quality_scores(first, labels).where("predicted = 1").collect()}
    second = corpus_pipeline.keep_quality(spark, first, sf)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == good
    alone = {r.doc_id for r in near_dedup.near_duplicates(second, k=5).where("kept").collect()}
    third = corpus_pipeline.keep_one_of_each_group(spark, second, sf)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == alone
    want = sorted(tuple(r) for r in packing.pack_documents(third).collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want
    assert 0 < len(alone) < len(good) <= len(clean) < docs.count()


def test_odd_rows_pass_every_stage(spark, odd, none, sf):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_different_texts_of_a_kept_id_stay(spark, odd, odd_rows, sf):
    out = corpus_pipeline.keep_one_of_each_group(spark, odd, sf).collect()
    assert sorted(r.text for r in out if r.doc_id == 10) == ["one id", "two texts"]
    assert [r.text for r in out if r.doc_id == 9] == ["repeated row"]
    assert sum(r.doc_id is None for r in out) == 2
