"""Results recomputed by other means: the log-likelihood ratio in plain Python, rates by a plain solver; extra columns with
the names that operators use inside; the pipeline's five stages."""

import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from clearspan.llm import line_dedup, quality_rules, shared, source_mixing  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in "blmst" for b in "aeiou" for c in "nrsd"]
#: Columns that operators make inside, and one that differs from an output in case only.
CLASHING = ["__hot", "__lines", "__kept", "__doc", "__words", "__s", "__row", "__found", "__toxic", "__poor", "__id"]


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def spark_hash(*parts):
    """Spark's xxhash64 of strings, 32-bit numbers given as int, and 64-bit numbers given as (int,)."""
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little", signed=True) if isinstance(p, int) else p[0].to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def test_llr_in_plain_python(spark):
    rows = [(k, sentence(k, 30 + k)) for k in range(40)] + [(40, ""), (41, None), (42, "ends, with: marks!"), (None, sentence(5, 30)), (3, "again " * 30)]
    labels = [(k, int(k % 3 == 0)) for k in range(30)] + [(None, 1), (3, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks, buckets = spark.createDataFrame(labels, "doc_id long, quality int"), 64
    good = {i for i, q in labels if q == 1 and i is not None}

    def places(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out = []
        for a, b in zip(w, w[1:] + [None]):
            out += [spark_hash(a) % buckets, spark_hash((spark_hash(a),), (spark_hash(b) if b else 0,)) % buckets, spark_hash(2, a[-2:]) % buckets]
        return out

    raw, own = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(places(t))
        if i in good:
            own.update(places(t))
    n_raw, n_own = sum(raw.values()) + buckets, sum(own.values()) + buckets
    want = collections.Counter()
    for i, t in rows:
        p = places(t)
        want[i, round(sum(math.log((own[k] + 1) / n_own) - math.log((raw[k] + 1) / n_raw) for k in p) / len(p) if p else 0.0, 6)] += 1
    out = quality_rules.with_quality(d, marks, buckets=buckets).collect()
    assert collections.Counter((r.doc_id, round(r.llr, 6) + 0.0) for r in out) == want


def test_ratio_does_not_follow_the_table_size(spark):
    """Twice the same rows have the same ratios, but for the one count that each bucket gets."""
    body = [(k, " ".join(f"w{(k * j) % 50}" for j in range(40)) + " end") for k in range(200)]
    marks = spark.createDataFrame([(k, 1) for k in range(100)], "doc_id long, quality int")
    one = {r.doc_id: r.llr for r in quality_rules.with_quality(spark.createDataFrame(body * 50, "doc_id long, text string"), marks).collect()}
    two = {r.doc_id: r.llr for r in quality_rules.with_quality(spark.createDataFrame(body * 100, "doc_id long, text string"), marks).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 0.05


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates_against_a_plain_solver(spark, most):
    r = np.random.default_rng(4)
    p, n = r.dirichlet([0.4, 0.3, 0.3], 200), r.integers(5, 500, 200)
    rows = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_clean double, p_poor double, p_toxic double")
    goal = n.sum() * np.array([1.1, 0.02, 0.3])
    steps = source_mixing.fit_rates(rows, dict(zip(source_mixing.DOMAINS, goal)), most=most, tolerance=1e-6)
    rates = np.array([x.r for x in rows.select(source_mixing.rate_after(steps, most).alias("r")).collect()])
    assert rates.min() >= 0 and (most is None or rates.max() <= most)
    # the same weights on the three misses, plain steps on each rate
    h = (n[:, None] * p * p).sum(axis=0)
    scale = np.maximum(h, 0.01 * h.max())
    miss = lambda v: float((((n * v) @ p - goal) ** 2 / scale).sum())
    plain = np.ones(200)
    a = (n[:, None] * p) / np.sqrt(scale)
    step = 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(5_000):
        plain = np.clip(plain - step * (a @ (a.T @ plain - goal / np.sqrt(scale))), 0, most)
    assert miss(rates) <= miss(plain) + 0.01 * miss(np.ones(200))


def test_columns_with_names_used_inside(spark):
    shape = ", ".join(f"`{c}` int" for c in CLASHING)
    d = spark.createDataFrame([(k, sentence(k % 5, 30) + "\nshared line", *range(len(CLASHING))) for k in range(12)], f"doc_id long, text string, {shape}")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0), 7) for k in range(12)], "doc_id long, quality int, toxic int, `__trusted` int")
    for out in (line_dedup.drop_frequent_lines(d), quality_rules.with_quality(d, labels), source_mixing.mix_sources(d, labels, {"clean": 1.0})):
        assert set(d.columns) <= set(out.columns)
        assert {tuple(r[c] for c in CLASHING) for r in out.collect()} == {tuple(range(len(CLASHING)))}
    upper = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, N_Lines int, LLR int")
    assert line_dedup.drop_frequent_lines(upper).first().n_lines == 1 and quality_rules.with_quality(upper, labels).first().llr is not None


def test_a_shared_folder_is_needed_outside_local_mode(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Elsewhere())


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean, poor, toxic and copied documents, and tables with nulls in every column and names used inside."""
    where, rows, labels = str(tmp_path_factory.mktemp("planted")), [], []
    for k in range(300):
        rows.append((k, sentence(k, 60) + "\nthe same line of all\n" + sentence(1000 + k, 40) + (" foulword" * 3 if k % 10 == 0 else " fair"), "en", "hot" if k % 3 else None, None))
        labels.append((k, 1, int(k % 10 == 0)))
    for k in range(300, 330):
        rows.append((k, " ".join(w + "%%%" for w in sentence(k, 60).split()), "en", "x", 1))
        labels.append((k, 0, 0))
    rows += [(400 + k, rows[k + 1][1], "en", "copy", 1) for k in range(5)] + [(420, rows[7][1].replace("fair", "fairly"), None, "near", 1), (430, "too short", "en", "x", 1), (431, None, None, None, None), (432, "", "en", "x", 0), (None, sentence(9999, 80), "en", "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_pipeline_from_end_to_end(spark, planted):
    import public_tokenizers
    import sentencepiece

    docs, left = spark.read.parquet(f"{planted}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared.stored(stage(spark, docs, planted), name)
        left[name] = docs
        if name != "piece_coding":
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in left.items()}
    assert ids["quality_rules"] == set(range(300)) | set(range(400, 405)) | {420, None} == ids["line_dedup"]
    assert not left["line_dedup"].where("text LIKE '%the same line of all%' OR n_chars <> length(text)").count()
    assert ids["near_dedup"] == set(range(300)) | {None}
    clean = {k for k in range(300) if k % 10}
    assert ids["source_mixing"] >= clean and len(ids["source_mixing"] - clean) <= 34
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in left["source_mixing"].collect()}
    assert {r.doc_id: bytes(r.ids) for r in left["piece_coding"].collect()} == {i: np.array(library.encode(t), "<i4").tobytes() for i, t in texts.items()}
    assert corpus_pipeline.run(spark, planted).count() == len(texts)


def test_pipeline_on_an_empty_table(spark, planted, tmp_path):
    spark.read.parquet(f"{planted}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_extra_columns(spark, planted):
    shape = {c: F.lit(3) for c in ("__hot", "__words", "rate", "kept", "component_id")}
    docs = spark.read.parquet(f"{planted}/documents.parquet").withColumns(shape)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, planted)
        assert docs.where("rate = 3 AND kept = 3").count() > 0 and "__hot" in docs.columns
