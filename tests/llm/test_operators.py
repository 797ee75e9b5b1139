"""The corpus operators against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and
extra columns with clashing names; and on empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from clearspan.llm import components, license_scan, line_dedup, near_dedup, piece_coding, quality_rules, source_mixing, substring_dedup, token_store, topk_search, toxicity  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in "blmst" for b in "aeiou" for c in "nrsd"]
SCHEMA = "doc_id long, text string, n_words long, labels string, rank int, kept boolean, score double, words string"


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def texts():
    shared = sentence(7, 40)
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One two"),
        (9, sentence(2, 30) + "\n" + shared + "\nCommon line\n" + sentence(3, 10)), (10, shared + " tail"), (11, "a b " * 60), (12, sentence(4, 3000) + "é漢😀 ends."),
        (13, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. CC BY-NC 4.0"), (None, base), (None, "x y"),
    ]
    return rows + [(20 + k, f"  COMMON line \n{sentence(100 + k, 25)}") for k in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, -1, "x", -2, False, 0.5, "w") for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i in (9, 11))) for i in range(1, 30)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def bag(rows):
    return collections.Counter(rows)


def test_line_dedup(docs, empty):
    key = lambda x: "".join(c.lower() if c < "\x80" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    seen = collections.defaultdict(set)
    for i, t in texts():
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    hot = {k for k, d in seen.items() if len(k) >= 1 and len(d) >= 10}
    want = bag((i, len((t or "").split("\n")), sum(key(x) in hot for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in hot)) for i, t in texts())
    out = line_dedup.drop_frequent_lines(docs)
    assert set(docs.columns) < set(out.columns) and hot
    assert bag((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_quality_counts(docs, labels, empty):
    def counts(t):
        w = words(t)
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    out = quality_rules.with_quality(docs, labels).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == bag((i, *counts(t)) for i, t in texts())
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= -0.4)
    assert quality_rules.with_quality(empty, labels).count() == 0
    assert quality_rules.with_quality(docs, labels.limit(0)).count() == len(texts())


def test_junk_is_rejected_and_clean_text_kept(spark):
    good = [(k, sentence(k, 60)) for k in range(60)]
    bad = [(k, " ".join(w + "%%%" for w in sentence(k, 60).split())) for k in range(60, 90)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    assert {r.doc_id for r in quality_rules.with_quality(d, marks).where("kept").collect()} == set(range(60))


PASSAGE = sentence(50, 35)


def repeating():
    """texts() with a passage of 35 words in two of them, words that repeat without end, and words longer than a row carries."""
    return texts() + [
        (100, f"{sentence(51, 30)} {PASSAGE} {sentence(52, 30)}"), (101, f"{sentence(53, 41)}\n{PASSAGE}  {sentence(54, 33)}"), (102, sentence(7, 40) + " " + sentence(55, 9)),
        (103, "a b " * 30 + sentence(51, 30)), (104, ("x" * 500 + " y z ") * 20), (105, ("x" * 500 + " y z ") * 20 + sentence(51, 25)), (None, sentence(56, 25) + " " + PASSAGE)]


@pytest.mark.parametrize("group", [20_000, 3])
def test_substring_dedup(spark, docs, empty, group):
    rows = [((i is not None, i or 0, 0 if i is not None else hash_of(spark, t)), words(t)) for i, t in repeating()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 19):
            h = tuple(w[k : k + 20])
            first[h] = min(first.get(h, (i, k)), (i, k))
    want = collections.Counter()
    for i, w in rows:
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i[1] if i[0] else None, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    table = spark.createDataFrame([(i, t, -1) for i, t in repeating()], "doc_id long, text string, anchors int").repartition(3)
    out = substring_dedup.remove_repeats(table, group=group).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in out)
    assert substring_dedup.remove_repeats(empty, group=group).count() == 0


def hash_of(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text or ""))).first()[0]


def test_maximal_repeats(spark, empty):
    table = spark.createDataFrame([r for r in repeating() if r[0] in (100, 101)], "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.maximal_repeats(table).collect()] == [(35, 2, 100, 30)]
    # three places share 25 words and two of them 33: a node of depth 33 below one of depth 25
    w = sentence(60, 33).split()
    rows = [(1, " ".join(["p", *w, "q"])), (2, " ".join(["r", *w, "s"])), (3, " ".join(["t", *w[:25], "u"]))]
    found = substring_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == {(33, 2, 1, 1), (25, 3, 1, 1)}
    assert substring_dedup.maximal_repeats(empty).count() == 0


def test_word_places_of_a_long_text():
    from clearspan.llm import hashing

    text = (sentence(3, 400_000) + " " + "y" * 3_000_000 + "\t" + sentence(4, 1000)).encode()
    want = [text[m.start() : m.end()] for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert len(text) > 2 * hashing.PIECE
    short, (hashes, starts, ends), _ = hashing.word_places([b"a  b", text, b" c"])
    assert [text[a:b] for a, b in zip(starts, ends)] == want and short[1].tolist() == [0, 3]
    assert len(set(zip(hashes.tolist(), want))) == len(set(hashes.tolist())) == len(set(want))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, empty, size):
    def shingles(t):
        w = [x.lower() for x in words(t)]
        n = min(size, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    rows = [(i, shingles(t)) for i, t in texts()]
    group = {id(r): r[0] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a[0] is not None and b[0] is not None and a[1] and 100 * len(a[1] & b[1]) >= 80 * len(a[1] | b[1]):
                    group[id(a)] = group[id(b)] = min(group[id(a)], group[id(b)])
    want = bag((i, len(s), group[id(r)] if i is not None else None, i is None or group[id(r)] == i) for r in rows for i, s in [r])
    out = near_dedup.near_duplicates(docs, shingle_words=size).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Each text is near the next one only: tiles and components must still join all of them."""
    w, rows = sentence(11, 200).split(), []
    for k in range(40):
        rows.append((k, " ".join(w)))
        for j in range(4):
            w[(k * 4 + j) % 200] = f"new{k}x{j}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(d, shingle_words=2).collect()} == {0}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + k, 201 + k) for k in range(60)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[n] for n in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and got[5] == 5 and got[149] == 100 and got[260] == 200


def test_topk(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(350)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2100, [float("inf")] * 8), (None, rows[1][1]), (2200, []), (2300, [1e30] * 8), (400, rows[3][1])]
    ints = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    everyone = collections.Counter()
    for q, a in ints:
        if q % 100 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ints if i != q)[:10]
            everyone.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scored))
    whole = topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    assert bag(tuple(x) for x in whole.select("query_id", "rank", "vec_id", "score").collect()) == everyone
    finite = [r for r in rows if r[0] != 2300]
    small = spark.createDataFrame(finite, "vec_id long, embedding array<float>").repartition(3)
    ints = [x for x in ints if x[0] != 2300]
    want = collections.Counter()
    for q, a in ints:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:10]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scored))
    assert bag(tuple(x) for x in topk_search.search(small, megabytes=0.002).select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk_search.search(small.limit(0)).count() == 0


def test_license_scan(docs, empty):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    want = collections.Counter()
    for i, t in texts():
        w = split(t)
        hits = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(hits), min([k for k, _ in hits], default=None), max([k for k, _ in hits], default=None), ",".join(sorted({x for _, x in hits})))] += 1
    out = license_scan.scan_licenses(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    assert [r.labels for r in out if r.doc_id == 13] == ["apache-2.0,cc-by,cc-by-nc-4.0,reserved"]
    assert all(0 <= r.score <= 1 for r in out) and license_scan.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("text,end", [("use freely", 2), ("use it now freely", 4), ("use it freely", 3), ("use it at once and freely", -1), ("use", -1), ("using freely", -1)])
def test_template_automaton(text, end):
    made = license_scan.compile_template("t", "use [[it]] {{when:0-1}} freely")
    assert made.match(text.encode().split(), 0) == end


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_whole_licence_texts(spark):
    rows = [(1, "x.py\n# Copyright (c) 2020 A. Person\n# " + MIT.replace("\n", "\n# ")), (2, MIT.replace("WITHOUT WARRANTY", "WITH WARRANTY")), (3, MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "Foundation")), (4, MIT[: len(MIT) // 2])]
    out = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ["mit-text" in out[k].labels for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert all("mit-grant" in r.labels for r in out.values())
    found = next(x for x in out[3].spans if x.label == "mit-text")
    assert found.start == 0 and found.end == out[3].n_words


def test_token_store(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, collections.Counter()
    for i, x in sorted(((i, x or "") for i, x in texts()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    for kind, chunk in (("bit", 64), ("byte", 65_536)):
        manifest = token_store.write_tokens(docs, P.path("word_bpe_49k.json"), planes=kind, chunk_ids=chunk)
        assert bag(tuple(r) for r in token_store.read_tokens(manifest).collect()) == want
    assert token_store.read_tokens(token_store.write_tokens(empty, P.path("word_bpe_49k.json"))).count() == 0


def test_encoder_equals_the_library_on_any_text():
    from tokenizers import Tokenizer

    made, library, r = token_store.Encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json")), np.random.default_rng(6)
    parts = ["the", "ing", "Él", "ß", "İ", "漢字", "😀", "e\u0301", "\u00a0", "\u200b", "\t", "\n", " ", "  ", ".", ",", "'s", "'", "1", "23", "-", "_", "<|endoftext|>", "<|startoftext|>", "</w>", "&amp;", "#", "\x00", "\x7f", "A"]
    for _ in range(3000):
        text = "".join(r.choice(parts, size=int(r.integers(0, 12))))
        assert np.frombuffer(made.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_planes_round_trip():
    for ids in (np.zeros(0, np.uint32), np.array([0]), np.array([2**32 - 1, 0, 7]), np.arange(70_001)):
        for kind in ("bit", "byte"):
            assert np.array_equal(token_store.from_planes(token_store.to_planes(np.asarray(ids, np.uint32), kind), len(ids), kind), ids)


def test_piece_coding(spark, empty):
    """Ids are the library's, whole and in chunks; one text has more than a block of chunks, some have no place to cut at."""
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = texts() + [(200, sentence(9, 6000)), (201, "theonreationsthe" * 40), (202, "=" * 300), (203, "a\tb\n\n  c <s> <0x0A> </s>"), (204, "漢字かな" * 30), (205, "x"), (206, " lead and trail  ")]
    want = collections.Counter((i, np.array(library.encode(t or ""), "<i4").tobytes(), t or "") for i, t in rows)
    table = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    for chunk in (37, 32_768):
        out = piece_coding.decode(piece_coding.encode(table, model, chunk_chars=chunk), model).collect()
        assert bag((r.doc_id, bytes(r.ids), r.text) for r in out) == want
    assert len(rows[-7][1]) > 37 * piece_coding.FAN
    assert piece_coding.encode(empty, model).count() == 0


def test_chunks_of_any_text_meet_as_the_library_cuts_it():
    coder, r = piece_coding.Coder(P.path("piece_bpe_32k.model")), np.random.default_rng(8)
    alphabets = [list("abctheonr"), list("abc é\n\t,.☃😀漢▁<0x>-=aa  "), ["the", "ing", "er", "on", "a", "==", "un", "st", "ation", " "]]
    for k in range(600):
        text = "".join(r.choice(alphabets[k % 3], size=int(r.integers(1, 90))))
        body, size = piece_coding.marked(text), (16, 23, 50)[k // 3 % 3]
        parts = []
        for at in range(0, len(body), size):
            begin, end = max(0, at - coder.longest), min(at + size, len(body))
            parts.append((body[begin : end + coder.longest], at - begin, end - begin))
        entry, backs, state, ids = np.zeros(1), [], 0, []
        for part in parts:
            reached = entry[:, None] + coder.matrix(*part)
            backs.append(reached.argmax(axis=0))
            entry = reached.max(axis=0)
        for part, back in zip(parts[::-1], backs[::-1], strict=True):
            ids = coder.cut_chunk(*part, int(back[state]), state) + ids
            state = int(back[state])
        assert ids == coder.library.encode(text) and entry[0] == coder.score(ids)


def test_mixing_meets_its_targets(spark, docs, labels, empty):
    r = np.random.default_rng(3)
    rows = [(k, sentence(k, int(r.integers(20, 60))) + (" foulword" if k % 5 == 0 else " fair")) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    out = source_mixing.mix_sources(d, marks, {"clean": 0.9, "toxic": 0.1, "poor": 0.0}).toPandas()
    total = out.n_tokens.sum()
    assert (out.rate >= 0).all() and abs((out.n_tokens * out.rate * out.p_toxic).sum() / total - 0.1) < 0.005
    assert abs((out.n_tokens * out.copies).sum() / total - (out.n_tokens * out.rate).sum() / total) < 0.1
    boxed = source_mixing.mix_sources(d, marks, {"clean": 0.95, "toxic": 0.05}, most=1.0).toPandas()
    assert boxed.rate.between(0, 1).all() and boxed[boxed.doc_id % 5 != 0].rate.min() > 0.9
    assert source_mixing.mix_sources(docs, labels, {"clean": 1.0}).count() == len(texts())
    assert source_mixing.mix_sources(empty, labels, {"clean": 1.0}).count() == 0


def test_toxicity_learns_and_ignores_identity_terms(spark, docs, labels, empty):
    rows = [(k, sentence(k, 40) + (" vileword muslims" if k % 4 == 0 else " fine")) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    out = toxicity.classify(d, marks).toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and ((held.doc_id % 4 == 0).astype(int) == held.predicted).all()
    train = toxicity.training_rows(d, marks, F.lit(True), text="text", doc="doc_id", fit_rows=600)
    fair, plain = toxicity.fit(train, fairness=100.0), toxicity.fit(train, fairness=0.0)
    assert abs(fair.word("muslims")) < 0.5 * abs(plain.word("muslims")) and fair.word("vileword") > 2
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.classify(empty, labels).count() == 0 and toxicity.classify(docs, labels.limit(0)).count() == len(texts())
