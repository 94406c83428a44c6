import corpus_pipeline

from emberline.llm.common import stored


def test_stages_keep_columns_and_only_drop_or_copy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == counts[4]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def test_run_is_the_stages_in_order(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixing sources", "packing"]
    assert "sequence_id" in corpus_pipeline.run(spark, sf).columns


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, sf)
        assert docs_out.count() == 0
