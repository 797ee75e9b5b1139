"""The mixing stage keeps clean documents, however frequent toxic ones are."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from clearspan.llm import source_mixing  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in "blmst" for b in "aeiou" for c in "nrsd"]


@pytest.mark.parametrize("every", [50, 3])
def test_labelled_clean_documents_stay(spark, tmp_path, every):
    r = np.random.default_rng(3)
    rows = [(k, " ".join(WORDS[i] for i in r.integers(0, len(WORDS), int(r.integers(20, 400)))) + (" foulword" if k % every == 0 else " fair"), "x") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(k, 1, int(k % every == 0)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    kept = {x.doc_id for x in left.select("doc_id").collect()}
    assert kept >= {k for k in range(600) if k % every}
    toxic = [k for k in kept if k % every == 0]
    assert len(toxic) < 0.16 * len(kept) and (every > 10 or len(toxic) < 100)


def test_capped():
    rare = {"clean": 97.0, "poor": 1.0, "toxic": 2.0}
    assert source_mixing.capped(rare, {"poor": 0.02, "toxic": 0.1}) == rare
    out = source_mixing.capped({"clean": 88.0, "poor": 30.0, "toxic": 50.0}, {"poor": 0.02, "toxic": 0.1})
    assert out["clean"] == 88.0 and abs(out["poor"] - 2) < 1e-9 and abs(out["toxic"] - 10) < 1e-9


def test_the_fit_makes_no_second_table_of_doubles():
    """The driver holds the single-precision table and slices of it."""
    import tracemalloc

    import numpy as np

    from clearspan.llm.source_mixing import logistic

    r = np.random.default_rng(4)
    x = np.c_[np.ones(12_000), r.random((12_000, 201)) < 0.1].astype(np.float32)
    y = (x[:, 2] + r.random(12_000) > 0.9).astype(float)
    tracemalloc.start()
    w = logistic(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w[2] > 1 and peak < 1.5 * x.nbytes
