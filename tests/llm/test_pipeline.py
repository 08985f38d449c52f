"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from tests.conftest import SF
from tidewell.llm import decontaminate


def test_stages(spark, tmp_path):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        counts.append(kept.count())
        docs = kept
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert decontaminate.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == counts[-1]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == pieces.count()


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
