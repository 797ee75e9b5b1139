"""components() against a plain union of links, and how many rows its joins read."""

import random

import pytest

from clearspan.llm import components as C


def plain(links):
    of = {n: n for link in links for n in link}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        p, q = top(a), top(b)
        of[max(p, q)] = min(p, q)
    return {n: top(n) for n in of}


def graphs():
    r = random.Random(5)
    yield []
    yield [(4, 4)]
    yield [(3, 3), (2, 1), (1, 2), (2, 1)]
    for n in (5, 30, 120):
        yield [(r.randrange(n), r.randrange(n)) for _ in range(n)]
    names = r.sample(range(10_000), 120)
    yield list(zip(names, names[1:]))
    yield [(9999, n) for n in names[:50]] + [(n, 10_000 + n) for n in names]


@pytest.mark.parametrize("links", list(graphs()))
def test_components_are_those_of_a_plain_union(spark, links):
    made = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r.node for r in made}) == len(made)
    assert {r.node: r.component for r in made} == plain(links)


def test_links_that_are_settled_are_not_read_again(spark, monkeypatch):
    """Blocks in a long row: each round reads only the links that still part components, so all rounds together read few times the links."""
    sizes, plain_stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (out := plain_stored(df, name), sizes.append((name, out.count())))[0])
    r, links = random.Random(8), []
    for block in range(60):
        links += [(20 * block + r.randrange(20), 20 * block + r.randrange(20)) for _ in range(60)] + [(20 * block, 20 * block + 25)]
    C.components(spark.createDataFrame(links, "a long, b long")).count()
    tables = [n for name, n in sizes if name == "links"]
    assert sum(tables) <= 2 * tables[0] and tables[0] <= len(links)
    assert len(sizes) < 50


@pytest.mark.parametrize("links", list(graphs()))
def test_rounds_and_the_last_task_agree(spark, links):
    """All by rounds, and by rounds until few links are left."""
    for few in (0, 40):
        made = C.components(spark.createDataFrame(links, "a long, b long"), few=few).collect()
        assert len({r.node for r in made}) == len(made)
        assert {r.node: r.component for r in made} == plain(links)


def test_a_long_row_of_few_links_takes_few_tables(spark, monkeypatch):
    """The driver keeps what it knows of each job's tasks, so a tail of small rounds is no longer run job by job."""
    made, plain_stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (made.append(name), plain_stored(df, name))[1])
    names = random.Random(3).sample(range(10_000), 300)
    C.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")).count()
    assert len(made) <= 4
