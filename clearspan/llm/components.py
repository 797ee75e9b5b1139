"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Links, up to 16 bytes each, that one task takes at most. Rounds go on by shuffles until no more are left.
FEW = 50_000


def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, to) of the nodes that reach a smaller one by a task's own links (x, y): to is the smallest."""
    of: dict = {}

    def top(n):
        while of.setdefault(n, n) != n:
            of[n] = n = of[of[n]]
        return n

    for batch in batches:
        for x, y in zip(batch["x"].tolist(), batch["y"].tolist(), strict=True):
            p, q = top(x), top(y)
            of[max(p, q)] = min(p, q)
    found = [(n, top(n)) for n in list(of)]
    yield pd.DataFrame([r for r in found if r[0] != r[1]], columns=["node", "to"])


def components(links: DataFrame, a: str = "a", b: str = "b", *, few: int = FEW) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach, itself included.

    Each round sends a node to its smallest neighbour, and on from there while that has a smaller one itself: to a node without smaller
    neighbours, found in steps of twice the length each. Then the links' ends are replaced by what they were sent to, and
    links that became loops or equal ones are dropped, so the links get fewer in each round. A node that was sent somewhere is in no later
    round; where nodes were sent is composed at the end, from the last and smallest round to the first. Once few links are left, one task
    unites them, which is the last round: small graphs, and the long tails of large ones, cost no jobs of their own for each step. Each table is
    stored; the driver sees only how many rows are left. A node with very many links is the larger side of sort-merge joins over stored
    tables, which AQE splits.
    """
    every = stored(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "links")
    left, sent = every.where("x != y"), []
    kind = every.schema["x"].dataType.simpleString()
    while n := left.count():
        if n <= few:
            sent.append(stored(left.coalesce(1).mapInPandas(united, f"node {kind}, to {kind}"), "moves"))
            break
        moves = stored(left.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("to")), "moves")
        while True:
            on = moves.select(F.col("node").alias("via"), F.col("to").alias("next"))
            further = moves.join(on.hint("merge"), moves["to"] == on["via"], "left")
            longer = stored(further.select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "moves")
            moves = longer.select("node", "to")
            if not longer.where("moved").limit(1).count():
                break
        sent.append(moves)
        first, second = (moves.select(F.col("node").alias(f"from_{c}"), F.col("to").alias(f"to_{c}")) for c in "xy")
        moved = left.join(first.hint("merge"), F.col("x") == F.col("from_x")).join(second.hint("merge"), F.col("y") == F.col("from_y"), "left")
        p, q = F.col("to_x"), F.coalesce("to_y", "y")
        left = stored(moved.where(p != q).select(F.greatest(p, q).alias("x"), F.least(p, q).alias("y")).distinct(), "links")
    nodes = every.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    if not sent:
        return nodes.select("node", F.col("node").alias("component"))
    found = sent[-1].withColumnRenamed("to", "component")
    for moves in reversed(sent[:-1]):
        later = found.select(F.col("node").alias("at"), "component")
        through = moves.join(later.hint("merge"), moves["to"] == later["at"], "left").select("node", F.coalesce("component", "to").alias("component"))
        found = stored(through.unionByName(found), "found")
    return stored(nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
