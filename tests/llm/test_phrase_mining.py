"""op12's operator against plain counting."""

import collections
import pathlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clearspan.llm import phrase_mining
from clearspan.llm.shared import shared_dir

SCHEMA = "doc_id long, text string, lang string, n long, rank int, pair long, score string"


def plain(rows, threshold, cover, top):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[k : k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    found = collections.defaultdict(list)
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < threshold:
            continue
        if len(w) == 2 and any(100 * n >= cover * a for (g, x), n in counts.items() if len(x) == 3 and g == lang and n >= threshold and w in (x[:2], x[1:])):
            continue
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, every in found.items() for k, (s, a, p, left, right) in enumerate(sorted(every)[:top]))


def corpus(seed, n):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        words = [("A", "b", "ça", "D_", "e\x1cf", "in", "new", "york", "ünd", "Zz")[min(9, int(r.exponential(2.5)))] + str(int(r.integers(2))) * int(r.integers(2)) for _ in range(int(r.integers(1, 40)))]
        rows.append((["en", "de", None, "und"][int(r.integers(4))], "".join(w + [" ", " ", " \t", ". ", "\n", ","][min(5, int(r.exponential(1.3)))] for w in words)))
    return rows


@pytest.mark.parametrize(("shards", "pack"), [(2, 4_000_000), (3, 40)])
def test_plain(spark, shards, pack, monkeypatch):
    rows = corpus(4, 150) + [("en", None), ("en", ""), (None, " \t.\n"), ("fr", "one two"), ("en", "x y " * 3000), ("de", "it is so " * 700 + "." + "q " * 900)] * 2
    df = spark.createDataFrame([(1, t, lang, 1, 2, 3, "x") for lang, t in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, phrase_mining.collocations(df, threshold=10, top=60, shards=shards, pack=pack).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain(rows, 10, 50, 60)


def test_empty(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slices(monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE", 7)
    for raw in (b"", b"abc", b"a b c d e f g h i j", b"abcdefghijklmnop qr\nst", b"a" * 30):
        parts = list(phrase_mining.slices(raw))
        assert b"".join(parts) == raw and all(p[-1:] in b" \n" for p in parts[:-1])


def test_scores(spark):
    """Products beyond 64 bits."""
    rows = [(a, left, right) for a, left, right in ((10**13, 10**14 - 1, 10**13 + 7), (10, 10, 10), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (12, 13, 5_000_000))]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrase_mining.cut_score("a", "l", "r").alias("score"))
    assert all(r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_a_pack_takes_little_memory():
    """Bytes a word while a pack is counted, and rows that leave at once."""
    n, words = 600_000, 3000
    codes = np.random.default_rng(1).integers(0, words, n).astype(np.int32)
    packs = pa.table({"pack": pa.array([7]), "codes": [codes.tobytes()], "tail": pa.array([0], pa.int32())})
    ids = pa.table({"code": pa.array(range(words), pa.int32()), "id": pa.array(range(words)), "at": pa.array([1] * words, pa.int32()), "pair": pa.array([-1] * words)})
    tracemalloc.start()
    pairs = phrase_mining.pairs_of(-1, True)(packs, ids)
    peak = tracemalloc.get_traced_memory()[1]
    keys = pairs["pair"].to_numpy()
    answers = pa.table({"code": pa.array(np.full(len(keys), -1, np.int32)), "id": pa.array(np.full(len(keys), -1)), "at": pa.array(np.full(len(keys), 2, np.int32)), "pair": pairs["pair"].combine_chunks()}, ids.schema)
    known = pa.concat_tables([ids, answers])
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    triples = phrase_mining.triples_of(-1)(packs, known)
    peak = max(peak, tracemalloc.get_traced_memory()[1] - before)
    tracemalloc.stop()
    assert peak < 110 * n
    assert max(b.num_rows for t in (pairs, triples) for b in t.to_batches()) <= phrase_mining.BATCH
    assert pairs["n"].to_numpy().sum() == n - 1 and triples["n"].to_numpy().sum() == n - 2


def test_states_are_not_kept(spark):
    """Of the tables that a scan replaces, none stays in the shared folder."""
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    here = set(folder.iterdir())
    rows = [("en", "one two three four. " * 20)] * 8
    got = phrase_mining.collocations(spark.createDataFrame([(1, t, lang, 1, 2, 3, "x") for lang, t in rows], SCHEMA).repartition(4)).collect()
    made = collections.Counter(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - here)
    assert len(got) == 2 and made["counts"] == made["pairs_of_packs"] == 0 and made["words"] == 1 and made["pairs"] == made["triples"] == 2  # the last state, and the named phrases
