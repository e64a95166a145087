import corpus_pipeline


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert 0 < docs.count() <= before
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids", "decoded"} <= set(out.columns) and out.count() > 0
