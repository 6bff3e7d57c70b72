"""The pipeline's stages, one after another, on a small table."""

import corpus_pipeline
import duckdb


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns
        assert (docs.count() == n) if name == "secrets" else (0.5 * n < docs.count() <= n)
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").distinct().collect()) == sorted({r["doc_id"] for r in packed})


def test_odd_rows_pass_all_stages(spark, odd, nothing, data):
    for start in (odd, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).where("length < 1").count() == 0
