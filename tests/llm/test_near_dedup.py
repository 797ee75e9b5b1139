"""op8's operator against all pairs, where ids stand on several texts and where components have blocks of their own."""

import re

import numpy as np
import pytest

from clearspan.llm import near_dedup

WORDS = [f"{a}{b}{c}" for a in "blmst" for b in "aeiou" for c in "nrsd"]


def brute(rows, size, percent=80):
    """(id, shingles, component, kept) of each row; each row stands for itself, and names its component by its smallest id."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows))


def crowd():
    """Chains of texts of which each shares about 0.8 with the next: buckets with many components and large ones."""
    r = np.random.default_rng(11)
    rows, doc = [], 0
    for _ in range(6):
        words = [WORDS[k] for k in r.integers(0, len(WORDS), 60)]
        for _ in range(45):
            rows.append((doc, " ".join(words)))
            words = list(words)
            for _ in range(int(r.integers(1, 4))):
                words[int(r.integers(60))] = WORDS[int(r.integers(len(WORDS)))]
            doc += 1
    return rows


def test_crowds_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = np.random.default_rng(2)
    x, y = (" ".join(WORDS[k] for k in r.integers(0, len(WORDS), 200)) for _ in range(2))
    rows = crowd() + [(1001, x), (1001, y), (1002, x + " more"), (1003, y + " more"), (1003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_dedup.near_duplicates(df, shingle_words=2).collect())) == brute(rows, 2)


def test_many_near_copies(spark):
    r = np.random.default_rng(5)
    base = [WORDS[k] for k in r.integers(0, len(WORDS), 300)]
    rows = []
    for doc in range(1000):
        words = list(base)
        words[int(r.integers(300))] = f"own{doc}"
        rows.append((doc, " ".join(words)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {tuple(x)[2:] for x in out.collect()} == {(0, True), (0, False)}


def test_buckets_of_two_need_no_tiles(spark, monkeypatch):
    """Texts that share buckets with one other, below the threshold: each was held against the smallest of its bucket, and nothing is left to compare."""
    r, rows = np.random.default_rng(3), []
    for k in range(60):
        words = [f"t{k}w{i}" for i in range(60)]
        rows.append((2 * k, " ".join(words)))
        for at in (10, 25, 40, 55) if k % 2 else (10,):
            words[at] = f"t{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    r.shuffle(rows)
    rows = [(int(d), t) for d, t in rows]
    monkeypatch.setattr(near_dedup, "tile_links", lambda *_: pytest.fail("tiles without a pair to compare"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, near_dedup.near_duplicates(df, shingle_words=2).collect()))
    assert got == brute(rows, 2) and sum(not kept for *_, kept in got) == 30
