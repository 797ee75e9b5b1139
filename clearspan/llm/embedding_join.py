"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of length 1 with a cosine of c or more are at most sqrt(2 - 2c) apart. A seeded rotation spreads the distance over all
coordinates, which are split into blocks of WIDTH at most. The squared distance of a pair is the sum over blocks, so in one
block at least it is within that block's share of the budget, its part of the coordinates. Each block is range-joined
under its share:
 1. Equal vectors of one label are one class from the start, with a weight.
 2. A block's space is cut at the medians of its first coordinates (those of a bounded sample), as often as the label's size asks for:
    about LEAF classes a leaf. A class has a home leaf, and visits each later leaf whose squared distance over the crossed cuts is
    within the budget; of two leaves the pair is met in the later one.
 3. A leaf with many rows is dealt into parts, and each two parts meet in a tile of their own, so no task holds a leaf.
 4. A tile finds pairs within the block's budget by one matrix product, verifies them by the cosine of the whole vectors, and counts those
    that no earlier block has within its budget: each linked pair is counted once, though several blocks find it.
    It returns one count a class, and of the links a spanning forest: never the pairs.
 5. Components over the links; counts, weights and components go back to the rows.
The sample places the cuts only. Whatever they are, no pair is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored
from .topk_search import usable

#: Coordinates of a block, and cuts of a block at most.
WIDTH = 16
#: Classes of a leaf that more cuts aim at; rows of a part of a leaf.
LEAF, PART = 2000, 4096
#: Vectors from which the cuts are taken, at most.
SAMPLE = 4096
#: Rows of a tile compared at once.
STRIP = 256
#: Slack of the squared distance: DISTANCE covers the rounding of a sum of squares, PRODUCT that of a matrix product.
DISTANCE, PRODUCT = 1e-11, 1e-9


@functools.lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20_240_229).standard_normal((dim, dim)))[0]


def edges(dim: int) -> np.ndarray:
    """The first coordinate of each block, and dim."""
    return np.linspace(0, dim, max(1, -(-dim // WIDTH)) + 1).round().astype(int)


def units(vectors: list, dim: int) -> np.ndarray:
    """Rows of length 1, with 0 for missing components."""
    out = np.zeros((len(vectors), dim))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)  # so that no square overflows or vanishes
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def leaves(coordinates: np.ndarray, cuts: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether it is the row's home): each row's home leaf and the later leaves within its budget."""
    row, leaf, cost = np.arange(len(coordinates)), np.zeros(len(coordinates), dtype=np.int64), np.zeros(len(coordinates))
    home = leaf.copy()
    for k, cut in enumerate(cuts):
        off = coordinates[:, k] - cut
        side, far = (off > 0).astype(np.int64), off * off
        home = home * 2 + side
        cross = cost + far[row] <= budget + PRODUCT
        row, leaf, cost = np.r_[row, row[cross]], np.r_[leaf * 2 + side[row], leaf[cross] * 2 + 1 - side[row[cross]]], np.r_[cost, (cost + far[row])[cross]]
    keep = leaf >= home[row]
    return row[keep], leaf[keep], (leaf == home[row])[keep]


class Forest:
    """A spanning forest of the links found so far."""

    def __init__(self, n: int):
        self.top = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.top[i], self.top[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each tree hangs itself below its smallest neighbour, once
            self.links.append((i[first], j[first]))
            self.top[high[first]] = low[first]
            while (self.top != self.top[self.top]).any():
                self.top = self.top[self.top]


def tile_counts(vectors: np.ndarray, home: np.ndarray, part: np.ndarray, weight: np.ndarray, block: int, least: float) -> tuple[np.ndarray, list]:
    """(links of each row, by weight; spanning links) of the pairs that this tile answers for: of different parts if there are two, else
    all; visitors of the leaf aren't compared with each other."""
    dim = vectors.shape[1]
    at, turned = edges(dim), vectors @ rotation(dim)
    budgets = (2 - 2 * least) * np.diff(at) / dim + DISTANCE
    own = turned[:, at[block] : at[block + 1]]
    norms = (own * own).sum(axis=1)
    counts, forest = np.zeros(len(vectors), dtype=np.int64), Forest(len(vectors))
    two = part.min() != part.max()
    left = np.flatnonzero(part == part.min())
    right = np.flatnonzero(part == part.max()) if two else left
    for start in range(0, len(left), STRIP):
        rows = left[start : start + STRIP]
        near = norms[rows, None] + norms[None, right] - 2 * (own[rows] @ own[right].T) <= budgets[block] + PRODUCT
        near &= home[rows, None] | home[None, right]
        if not two:
            near &= rows[:, None] < right[None, :]
        some, others = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            continue
        near = near[np.ix_(some, others)]
        some, others = rows[some], right[others]
        if near.mean() > 0.05:  # a dense group
            i, j = np.nonzero(near & (vectors[some] @ vectors[others].T >= least))
        else:
            i, j = np.nonzero(near)
            good = np.concatenate([np.einsum("ij,ij->i", vectors[some[i[k : k + 20_000]]], vectors[others[j[k : k + 20_000]]]) >= least for k in range(0, len(i), 20_000)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
        i, j = some[i], others[j]
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            gap = turned[a] - turned[b]
            within = np.add.reduceat(gap * gap, at[:-1], axis=1) <= budgets
            first = within.argmax(axis=1) == block
            np.add.at(counts, a[first], weight[b[first]])
            np.add.at(counts, b[first], weight[a[first]])
        forest.add(i, j)
    return counts, forest.links


def near_vectors(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", label: str = "label", least: float = 0.93, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: the number of other rows of the same label with a cosine of least or more in double
    precision, the smallest id reachable by such links, and whether it is the row's own.

    Rows whose label or vector is null, whose vector is empty, zero or holds null or non-finite components, link with nothing. A row without
    an id links with nothing either: its component_id is null and it is kept. Rows that share an id are rows of their own,
    and all of them are in the id's component. Missing components of a shorter vector count as 0. An empty table gives an
    empty one. Other columns take no part. leaf and part bound the rows that a task compares.
    """
    if not 0 < least <= 1:
        raise ValueError("least is a cosine over 0")
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.when(good, F.col(vector)).alias("v"))
    # equal vectors are told by 128 bits
    seen = stored(rows.select("id", "label", "v", F.xxhash64("label", "v").alias("ha"), F.xxhash64(F.lit(1), "v", "label").alias("hb")), "rows")
    grouped = seen.where("v IS NOT NULL").groupBy("ha", "hb").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    shape = classes.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    alone = seen.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if shape["n"]:
        found = _links(classes, int(shape["dim"]), least, leaf, part)
        counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
        tops = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "of")
        joined = classes.drop("label", "v").join(counts.hint("merge"), "node", "left").join(tops.hint("merge"), F.col("node") == F.col("of"), "left")
        joined = stored(joined.select("rep", "ha", "hb", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group")), "joined")
        linked = seen.where("v IS NOT NULL").select("id", "ha", "hb").join(_ids(joined, seen).hint("merge"), ["ha", "hb"])
        alone = alone.unionByName(linked.select("id", "n_links", "component_id"))
    return alone.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _ids(joined: DataFrame, seen: DataFrame) -> DataFrame:
    """(ha, hb, n_links, component_id). Rows that share an id tie their classes' groups together."""
    ties = seen.where("v IS NOT NULL").select("id", "ha", "hb").distinct()
    shared = stored(ties.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared")
    least = joined.groupBy("group").agg(F.min("rep").alias("least"))
    if shared.limit(1).count():
        tied = ties.join(shared.hint("merge"), "id").join(joined.select("ha", "hb", "group").hint("merge"), ["ha", "hb"]).groupBy("id", "group").count()
        met = components(tied.join(tied.groupBy("id").agg(F.min("group").alias("to")).hint("merge"), "id").select(F.col("group").alias("a"), F.col("to").alias("b")))
        joined = joined.join(met.withColumnRenamed("node", "of").hint("merge"), F.col("group") == F.col("of"), "left").withColumn("group", F.coalesce("component", "group")).drop("of", "component")
        joined = stored(joined, "tied")
        least = joined.groupBy("group").agg(F.min("rep").alias("least"))
    whole = joined.join(stored(least, "least").hint("merge"), "group")
    return whole.select("ha", "hb", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("least").alias("component_id"))


def _links(classes: DataFrame, dim: int, least: float, leaf: int, part: int) -> DataFrame:
    """(node, other, n), stored: a class's links in a tile where other is null, else a link of the tile's forest."""
    rows = classes.select("node", "label", "v", "weight")
    sizes = stored(rows.groupBy("label").agg(F.count("*").alias("n")), "labels")
    depth = F.greatest(F.lit(0), F.least(F.lit(WIDTH), F.ceil(F.log2(F.col("n") / F.lit(float(leaf)))))).cast("int")
    at, n_blocks = edges(dim), len(edges(dim)) - 1
    sample = [r["v"] for r in rows.orderBy("node").limit(SAMPLE).select("v").collect()]
    cuts = np.median(units(sample, dim) @ rotation(dim), axis=0)
    budgets = (2 - 2 * least) * np.diff(at) / dim + DISTANCE

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 2000):
                some = b.iloc[start : start + 2000]
                turned = units(some["v"].tolist(), dim) @ rotation(dim)
                for depth in some["depth"].unique():
                    these = np.flatnonzero(some["depth"].to_numpy() == depth)
                    for block in range(n_blocks):
                        row, where, home = leaves(turned[these, at[block] : at[block + 1]], cuts[at[block] : at[block + 1]][:depth], budgets[block])
                        picked = some.iloc[these[row]]
                        yield pd.DataFrame({"label": picked["label"], "block": np.int32(block), "leaf": where.astype(np.int32), "home": home, "node": picked["node"], "weight": picked["weight"], "v": picked["v"]})

    kind = classes.schema["label"].dataType.simpleString()
    values = classes.schema["v"].dataType.simpleString()
    placed = stored(rows.join(sizes.select("label", depth.alias("depth")).hint("merge"), "label").mapInPandas(place, f"label {kind}, block int, leaf int, home boolean, node long, weight long, v {values}"), "placed")
    counted = placed.groupBy("label", "block", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    parts = stored(counted.select("label", "block", "leaf", F.ceil(F.col("n") / F.lit(float(part))).cast("int").alias("parts")), "parts")
    dealt = placed.join(parts.hint("merge"), ["label", "block", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = met.select("label", "block", "leaf", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "home", "node", "weight", "v")

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        if rows["low"].iloc[0] != rows["high"].iloc[0] and rows["part"].nunique() < 2:
            return pd.DataFrame({"node": [], "other": [], "n": []}, dtype="Int64")
        node, weight = rows["node"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
        counts, links = tile_counts(units(rows["v"].tolist(), dim), rows["home"].to_numpy(bool), rows["part"].to_numpy(np.int64), weight, int(rows["block"].iloc[0]), least)
        some = np.flatnonzero(counts)
        out = [pd.DataFrame({"node": node[some], "other": pd.array([None] * len(some), dtype="Int64"), "n": pd.array(counts[some], dtype="Int64")})]
        out += [pd.DataFrame({"node": node[i], "other": pd.array(node[j], dtype="Int64"), "n": pd.array([0] * len(i), dtype="Int64")}) for i, j in links]
        return pd.concat(out)

    return stored(tiles.groupBy("label", "block", "leaf", "low", "high").applyInPandas(tile, "node long, other long, n long"), "found")
