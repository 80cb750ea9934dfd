"""Every query, and every stage of the pipeline, on odd rows and on no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import entries

BY_DOCUMENT = ["op2_quality_classifier", "op3_near_duplicates", "op4_brown_lm", "op5_quality_rules", "op6_length_buckets", "op7_language_id", "op8_source_mix"]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd_rows(spark, folder, docs, name):
    out = entries.queries()[name](spark, folder)
    ids = lambda df: sorted((r[0] for r in df.select("doc_id").collect()), key=str)
    assert ids(out) == ids(docs)


@pytest.mark.parametrize("name", [*BY_DOCUMENT, "op1_training_order"])
def test_no_rows(spark, empty_folder, name):
    assert entries.queries()[name](spark, empty_folder).count() == 0


def test_odd_and_no_urls(spark, tmp_path):
    """Columns that clash, repeated pages, null urls, and no pages at all."""
    schema = "page_id long, url string, html string, host string, path string, rule string, verdict string, hit int"
    rows = [(1, "http://a.org/x", None, "h", "p", "r", "v", 1), (1, "http://a.org/x", "", "h", "p", "r", "v", 1), (2, None, "x", *"hprv", 0), (None, "http://b.com/de/" + "z" * 9000, "x", *"hprv", 0)]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "pages.parquet"))
    out = entries.queries()["op10_url_filters"](spark, str(tmp_path / "full")).select("page_id", "host", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, "a.org", "org/", "allow"), (1, "a.org", "org/", "allow"), (2, "", None, "allow"), (None, "b.com", "com/de/", "block")]))
    assert entries.queries()["op10_url_filters"](spark, str(tmp_path / "none")).count() == 0


def test_odd_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, id int, v string, d int, cell string, score string, rank string"
    rows = [(i, v, 1, "x", 2, "y", "z", "w") for i, v in ((0, [1.0, 0.0]), (50, [1.0, 0.1]), (7, [0.0, 1.0]), (9, None), (11, []), (None, [1.0, 1.0]))]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    out = entries.queries()["op9_vector_search"](spark, str(tmp_path / "full")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert entries.queries()["op9_vector_search"](spark, str(tmp_path / "none")).count() == 0


def test_stages(spark, docs, no_docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, "")
        assert kept.schema.names == docs.schema.names, name
        assert stage(spark, no_docs, "").count() == 0, name
        rows = spark.createDataFrame(kept.collect(), docs.schema)
        assert rows.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()


def test_stage_decisions(spark, docs, texts):
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert not good & {90, 91, 92, 93, 94, 95, 96, 98, 101} and set(range(1, 59)) <= good
    named = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert not named & {90, 91, 92, 96} and set(range(60)) <= named
    single = corpus_pipeline.near_dedup(spark, docs, "").where("doc_id between 80 and 84 or doc_id = 7").select("doc_id").collect()
    assert [r[0] for r in single] == [7]
    counts = corpus_pipeline.mix(spark, docs.where("doc_id < 60"), "").groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= counts <= 3


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"]
    assert out.count() == out.select("bucket", "batch", "slot").distinct().count() > 0
