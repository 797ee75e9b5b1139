"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Signatures: shingles are 64-bit hashes; a first permutation of 32-bit numbers spreads them, and coordinate k is the least
value of a second permutation at (spread - k) mod 2^32, so two permutations serve all coordinates. 32 bands of
4 rows miss a pair of similarity 0.8 with a chance of (1 - 0.8^4)^32 = 5e-8.

Documents with equal shingle sets are one class from the start, so a group of copies costs one signature row. Then
 1. star links: every class is compared with the smallest class that it shares a bucket with, and, where their components still differ,
    with the smallest one of each other bucket: linear in the buckets;
 2. components of the verified links;
 3. buckets that still hold several components beside their smallest class, which has met all others: those classes are compared in tiles of at most 2 x BLOCK classes, each
    of which returns only links that join components. Blocks of one component are never compared with each other, so
    a dense group, however large, costs nothing here;
 4. components of all links.
Every link is confirmed on full sets. Sets are made again from the texts of the classes that share a bucket; the sets of
all documents are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, mix32, word_hashes
from .shared import stored, whole

BANDS, ROWS, BLOCK = 32, 4, 256
#: Parts in which the components of a crowd are dealt when they meet the crowd's own row.
SALTS = 16
COORDINATES = BANDS * ROWS
#: Share of coordinates that must agree before a tile compares two sets. For 128 independent coordinates a pair of similarity 0.8 has fewer with a
#: chance of 2.7e-8; together with the bands (5e-8) a link is missed with a chance under 1e-7.
LEAST_AGREEING = 0.59


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: size words in a row, or the whole text if it has fewer."""
    out = []
    for words in word_hashes([t.encode().lower() for t in texts]):
        if not len(words):
            out.append(words)
            continue
        n = min(size, len(words))
        made = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            made = mix(made * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
        out.append(np.unique(made))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES circulant minima of a set that isn't empty."""
    spread = mix32((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32))
    shifts, least = np.arange(COORDINATES, dtype=np.uint32), None
    for at in range(0, len(spread), 2048):
        part = mix32(spread[at : at + 2048, None] - shifts[None, :]).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def profiles(docs: DataFrame, text: str, doc: str, size: int) -> DataFrame:
    """(doc, n, ha, hb, bands): size and 128-bit hash of each row's shingle set, and the hashes of its bands."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 500):
                b = whole_batch.iloc[at : at + 500]
                sets = shingle_sets(b["text"].tolist(), size)
                hashes = [set_hashes(s) for s in sets]
                yield pd.DataFrame({
                    "doc": b["doc"].astype("Int64").to_numpy(),
                    "n": [len(s) for s in sets],
                    "ha": [a for a, _ in hashes],
                    "hb": [b for _, b in hashes],
                    "bands": [band_hashes(signature(s)) if len(s) else None for s in sets],
                })

    return docs.select(F.col(doc).cast("long").alias("doc"), whole(F.col(text)).alias("text")).mapInPandas(profile, "doc long, n long, ha long, hb long, bands array<long>")


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(shingles):
        return 0, 0
    return int(mix(shingles).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(shingles + np.uint64(0x632BE59BD9B4E019))).view(np.int64))


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, doc: str, size: int) -> DataFrame:
    """(node, shingles): the set of each wanted class as bytes, made from a text of its rep that has just this set. wanted: (node, rep, ha, hb)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                some = b.iloc[at : at + 500]
                sets = shingle_sets(some["text"].tolist(), size)
                own = [set_hashes(s) == h for s, h in zip(sets, zip(some["ha"].tolist(), some["hb"].tolist(), strict=True), strict=True)]
                yield pd.DataFrame({"node": some["node"].to_numpy()[own], "shingles": [s.tobytes() for s, o in zip(sets, own, strict=True) if o]})

    texts = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("rep"), whole(F.col(text)).alias("text"))
    return texts.join(wanted.hint("shuffle_hash"), "rep").mapInPandas(make, "node long, shingles binary").dropDuplicates(["node"]).withColumnRenamed("node", "doc")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets are similar."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(p["x"], p["y"], strict=True)]
            yield p.loc[good, ["a", "b"]]

    left = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(left.hint("merge"), "b").join(right.hint("merge"), "a").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def tile_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, among all pairs of a group. members: (doc, component, crowd); crowd names the
    group. Components of more than BLOCK members in a crowd get blocks of their own, the others share blocks by hash."""
    sizes = members.groupBy("crowd", "component").agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") <= BLOCK).groupBy("crowd").agg(F.sum("size").alias("rest"))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("component"), F.lit(SALTS)).cast("int"))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shape = stored(salted.join(small.hint("merge"), ["crowd", "salt"], "left").drop("salt"), "shape")
    placed = members.join(shape.hint("merge"), ["crowd", "component"]).withColumn("large", F.col("size") > BLOCK)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(n / F.lit(BLOCK / 2)))
    placed = stored(placed.select("doc", "crowd", "component",
        F.when(F.col("large"), F.col("component")).alias("own"),
        F.when(F.col("large"), spread("doc", F.col("size"))).otherwise(spread("doc", F.col("rest"))).alias("part")), "placed")
    blocks = stored(placed.groupBy("crowd", "own", "part").agg(F.count("*").alias("n")).withColumn("block", F.xxhash64("own", "part")), "blocks")
    x, y = blocks.select("crowd", F.col("own").alias("own_x"), F.col("block").alias("block_x")), blocks.select("crowd", F.col("own").alias("own_y"), F.col("block").alias("block_y"))
    mixed = F.col("own_x").isNull() | F.col("own_y").isNull() | (F.col("own_x") != F.col("own_y"))
    tiles = x.join(y.hint("merge"), "crowd").where((F.col("block_x") <= F.col("block_y")) & mixed).select("crowd", "block_x", "block_y", F.xxhash64("crowd", "block_x", "block_y").alias("tile"))
    roles = stored(tiles.select("crowd", "tile", F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"), (F.col("block_x") == F.col("block_y")).alias("alone")), "tiles")
    rows = placed.withColumn("block", F.xxhash64("own", "part")).join(roles.hint("merge"), ["crowd", "block"]).join(sets.select("doc", "shingles").hint("merge"), "doc").select("tile", "block", "alone", "doc", "component", "shingles")

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("doc")
        sets_, docs = [np.frombuffer(s, dtype=np.uint64) for s in tile["shingles"]], tile["doc"].to_numpy()
        block, alone = tile["block"].to_numpy(), bool(tile["alone"].iloc[0])
        marks, size = np.array([signature(s) for s in sets_]), np.array([len(s) for s in sets_])
        of = {c: c for c in tile["component"]}
        mine = tile["component"].to_numpy()

        def top(c: int) -> int:
            while of[c] != c:
                of[c] = of[of[c]]
                c = of[c]
            return c

        found = []
        for i in range(len(docs)):
            others = np.flatnonzero((mine != mine[i]) & (np.arange(len(docs)) > i) & (alone | (block != block[i])) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            if len(others):
                agreeing = (marks[others] == marks[i]).mean(axis=1)
                for j in others[agreeing >= LEAST_AGREEING * percent / 80]:
                    p, q = top(mine[i]), top(mine[j])
                    if p != q and similar(sets_[i], sets_[j], percent):
                        of[max(p, q)] = min(p, q)
                        found.append((docs[i], docs[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("tile").applyInPandas(link, "a long, b long")


def with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, value, centre, doc, component) of the classes in shared buckets; a class without links is its own component."""
    joined = members.select("band", "value", "centre", F.col("node").alias("doc")).join(found.withColumnRenamed("node", "of").hint("merge"), F.col("doc") == F.col("of"), "left")
    return joined.select("band", "value", "centre", "doc", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: which rows are linked, directly or through others, by sets with
    100 * intersection >= percent * union; component_id is the smallest id reachable, kept whether it is the row's own.

    Texts without words (null, empty, blank) have no shingles and no links. Rows that share an id are looked at
    each for itself and keep that id. A row without an id is never linked: its component_id is null and it is kept. An
    empty table gives an empty one. Other columns of docs take no part. percent is 80 at least, for which the
    banding is made.
    """
    if percent < 80:
        raise ValueError("the banding finds pairs of similarity 0.8 and more")
    seen = stored(profiles(docs, text, doc, shingle_words), "profiles")
    named = seen.where("doc IS NOT NULL AND n > 0")
    # a class has a number of its own: its smallest id may be that of another class too
    grouped = named.groupBy("ha", "hb", "n").agg(F.min_by("bands", "doc").alias("bands"), F.min("doc").alias("rep"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "rep", "ha", "hb", F.posexplode("bands").alias("band", "value"))
    shared = stored(banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1").drop("n"), "buckets")
    members = stored(banded.join(shared.hint("merge"), ["band", "value"]).select("band", "value", "node", "rep", "ha", "hb", "centre"), "members")
    wanted = members.select("node", "rep", "ha", "hb").distinct()
    sets = stored(sets_of(docs, wanted, text, doc, shingle_words), "sets")
    # each class against the smallest centre of its buckets, then against the centres of other components: a group of copies gives about a link a class
    nearest = members.groupBy(F.col("node").alias("b")).agg(F.min("centre").alias("a")).where("a != b").select("a", "b")
    links = stored(confirmed(nearest, sets, percent), "links")
    found = stored(with_components(members, components(links)), "found")
    apart = found.groupBy("band", "value", "centre").agg(F.max_by("component", F.col("doc") == F.col("centre")).alias("own"))
    others = found.join(stored(apart, "centres").hint("merge"), ["band", "value", "centre"]).where("component != own").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    links = stored(links.union(confirmed(others, sets, percent)), "links")
    first = components(links)
    found = stored(with_components(members, first), "found")
    # a centre is linked to, or was held against, every class of its bucket by now: left are the pairs of the others, and none in a bucket of two
    rest = found.where("doc != centre")
    mixed = rest.groupBy("band", "value").agg(F.min("doc").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("band", "value", "least")
    open_ = stored(rest.join(stored(mixed, "mixed").hint("merge"), ["band", "value"]).select("doc", "component", "least").distinct(), "open")
    if open_.limit(1).count():
        crowds = components(open_.select(F.col("doc").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
        joined = open_.select("doc", "component").distinct().join(crowds.hint("merge"), "doc")
        more = stored(tile_links(joined, sets, percent), "links")
        final = components(links.union(more)) if more.limit(1).count() else first
    else:
        final = first
    placed = stored(classes.join(final.withColumnRenamed("node", "of").hint("merge"), F.col("node") == F.col("of"), "left").select("ha", "hb", "n", "rep", F.coalesce("component", "node").alias("group")), "placed")
    least = stored(placed.groupBy("group").agg(F.min("rep").alias("component_id")), "least")
    named_classes = stored(placed.join(least.hint("merge"), "group").select("ha", "hb", "n", "component_id"), "classes")
    out = seen.drop("bands").join(named_classes.hint("merge"), ["ha", "hb", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
