import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "piece_coding"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        left = docs.count()
        assert 0 < left <= size
        assert name != "line_dedup" or left == size
        size = left
