"""Corpus pipeline: every stage on all rows of the one before."""

import corpus_pipeline
from branchlens.llm import line_dedup, near_dup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = spark.createDataFrame(stage(spark, out, SF).toPandas(), docs.schema)
        assert out.columns == docs.columns, name
    ids = [r["doc_id"] for r in out.collect()]
    assert ids and len(ids) == len(set(ids)) <= docs.count()
    report = near_dup.near_dup_report(out)
    assert report.where("NOT kept").count() == 0
    assert line_dedup.line_report(out).where("n_kept < n_lines").count() <= 0.05 * len(ids)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.where("NOT round_trip OR n_tokens <> size(token_ids)").count() == 0
    assert got.count() > 0


def test_clashing_columns_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, token_ids string, ids string"
    rows = [(1, None, None, None, None, "a", "b", "c"), (2, "", "en", "s", 0, "a", "b", "c"),
            (3, "some words\n\n and more words", "en", "s", 9, "a", "b", "c")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        got = corpus_pipeline.bpe_stage(spark, docs, SF)
        assert got.columns == [*docs.columns, "_n_tokens", "_token_ids", "round_trip"]
        assert got.where("NOT round_trip OR _n_tokens <> size(_token_ids)").count() == 0 and got.count() == len(data)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
