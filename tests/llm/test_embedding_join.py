"""op11's operator against all pairs."""

import numpy as np
import pytest

from clearspan.llm import embedding_join

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, node int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "y") for i, v, c in rows], SCHEMA).repartition(3)


def brute(rows, least=0.93):
    """(id, links, component, kept) of each row."""
    good = [v is not None and i is not None and c is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, c in rows]
    dim = max((len(v) for (i, v, c), g in zip(rows, good, strict=True) if g), default=1)
    unit = np.zeros((len(rows), dim))
    for k, (_, v, _) in enumerate(rows):
        if good[k]:
            unit[k, : len(v)] = np.array(v) / np.abs(v).max()
            unit[k] /= np.linalg.norm(unit[k])
    label = np.array([-1 if c is None else c for _, _, c in rows])
    linked = (unit @ unit.T >= least) & (label[:, None] == label[None, :]) & np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(linked, False)
    top = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in zip(*np.nonzero(linked), strict=True):
        x, y = find(rows[a][0]), find(rows[b][0])
        top[max(x, y)] = min(x, y)
    return sorted(((i, int(linked[k].sum()), None if i is None else find(i), i is None or find(i) == i) for k, (i, _, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def clusters(n, dim, seed, noise):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    return [(int(i) * 3 + 1, (centres[r.integers(12)] + noise * r.standard_normal(dim)).tolist(), int(r.integers(3))) for i in range(n)]


@pytest.mark.parametrize(("leaf", "part"), [(2000, 4096), (10, 4096), (10, 7), (2000, 20)])
def test_all_pairs(spark, leaf, part):
    rows = clusters(260, 40, 5, 0.26)  # cosines around the threshold
    want = brute(rows)
    assert 100 < sum(r[1] for r in want) < 20_000
    assert result(embedding_join.near_vectors(table(spark, rows), leaf=leaf, part=part)) == want


def test_odd_rows(spark):
    base = clusters(30, 20, 9, 0.05)
    v = base[0][1]
    nan, inf = float("nan"), float("inf")
    odd = [(500, v, 0), (501, v, 0), (502, v, 1), (503, v, None), (504, None, 0), (505, [], 0), (506, [0.0] * 20, 0), (507, [nan] * 20, 0), (508, [1.0, None], 0), (509, [inf, 1.0], 0),
           (None, v, 0), (510, [x * 1e200 for x in v], 0), (511, [x * 1e-200 for x in v], 0), (512, v[:19] + [0.0], 0), (513, v[:19], 0), (500, v, 0), (514, [-x for x in v], 0)]
    for leaf, part in ((2000, 4096), (4, 3)):
        assert result(embedding_join.near_vectors(table(spark, base + odd), leaf=leaf, part=part)) == brute(base + odd)


def test_shared_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (9, a, 0), (9, b, 0), (12, b, 0), (20, [0.0, 0.0, 1.0], 0)]
    assert result(embedding_join.near_vectors(table(spark, rows))) == brute(rows)


def test_empty(spark):
    out = embedding_join.near_vectors(table(spark, []))
    assert out.collect() == [] and out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert result(embedding_join.near_vectors(table(spark, [(3, None, 1)]))) == [(3, 0, 3, True)]
