"""A labelled text gives all of its distinct counterfactual pairs to the fit."""

from pyspark.sql import functions as F

from clearspan.llm import toxicity


def test_long_texts_keep_all_pairs(spark):
    text = ". ".join(f"sentence number{'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10 % 10]}" for k in range(300)) + ". some women spoke"
    want = set(toxicity.counterfactuals(text))
    assert len(want) > 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(True), text="text", doc="doc_id", fit_rows=10)
    assert {tuple(p.split(" ")) for p in rows["pairs"].iloc[0].split("\n")} == want
    assert any(p[0] == "women" and p[1] for p in want)
