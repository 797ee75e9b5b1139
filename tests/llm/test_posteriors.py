"""The posteriors of source mixing against labels that the fit didn't see."""

import pytest
from pyspark.sql import functions as F

from clearspan.llm import source_mixing

DIR = "/root/testdata/sf0.1"


def test_held_out_labels_by_length(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = source_mixing.fit_domains(docs, labels.where(~held))
    judged = docs.join(labels.where(held).withColumn("domain", source_mixing.label_domain()), "doc_id")
    out = source_mixing.with_posteriors(judged, model).drop("text").toPandas()
    assert (out[["p_clean", "p_poor", "p_toxic"]].sum(axis=1) - 1).abs().max() < 1e-9
    out["long"] = out.n_tokens > out.n_tokens.median()
    for _, part in out.groupby("long"):
        clean, toxic, poor = (part[part.domain == d] for d in ("clean", "toxic", "poor"))
        assert len(clean) > 300 and (clean.p_toxic > 0.5).mean() < 0.01
        assert (clean.n_tokens * clean.p_clean).sum() > 0.97 * clean.n_tokens.sum()
        assert (toxic.p_toxic > 0.5).mean() > 0.75 and (poor.p_poor > 0.5).mean() > 0.9


@pytest.mark.parametrize("count", [0, 1, 600, 3000])
def test_no_two_features_share_a_place(count):
    features = [(k * 0x9E3779B97F4A7C15 + 5) % 2**64 - 2**63 for k in range(count)]
    shift, size = source_mixing.places(features)
    assert len({((h % 2**64) >> shift) % size for h in features}) == count


def test_texts_without_words_and_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in source_mixing.with_posteriors(docs, source_mixing.fit_domains(docs, labels)).collect():
        assert [round(r[f"p_{d}"], 9) for d in source_mixing.DOMAINS] == [round(1 / 3, 9)] * 3
