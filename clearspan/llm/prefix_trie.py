"""A prefix trie of conversations, with sums over its subtrees by centroid decomposition.

Turns are numbered, and prefixes hashed, by scans of two levels: rows are range-partitioned by conversation and turn, scanned within their
partition, and get the carry of the partitions before, one row for each; so a conversation may span any number of partitions.
A prefix is the exclusive or of 128-bit hashes of (place, turn), a node the prefix with its depth.

Nodes get preorder numbers: a node's subtree is the numbers from its own on, as many as its size. Its size is what its
member conversations own: each node is owned by its smallest member, so a conversation owns the end of its path. A node's number is the sum
along its path of 1 and the sizes of the siblings before, again a scan of two levels.

Rollup: in each component of the parent-edge forest the centroid is the deepest node that holds half of it. The totals of all that
hangs below the centroid are added to each node on the path from the centroid to the component's top; then the centroid goes, and its
children's subtrees and the rest are components of half the size at most. Every pair of ancestor and descendant is
met at one centroid, whose path the ancestor stands on. Levels run over all components at once, as joins and sums by component;
components of LIMIT nodes at most are finished many to a task, by the same steps.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, whole, words_of

#: Nodes of a component that a task may finish.
LIMIT = 20_000
#: Conversation ids whose decimals are joined to one string: those that agree but for the last CHUNK_BITS bits.
CHUNK_BITS = 14
#: Conversations that share a base are numbered base to base + FAMILY - 1.
FAMILY = 20
#: Bits of a hash that deal a node's children into buckets.
BUCKET_BITS = 12


def placed_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, part, at, ha, hb, words), stored: the turns in order; part is the range partition, at the row's place in the order of all rows."""
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), whole(F.col(role)).alias("role"), whole(F.col(text)).alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order)
    made = ranged.select("c", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("ha"), F.xxhash64(F.lit(1), "text", "role").alias("hb"), F.size(words_of(F.col("text"))).cast("long").alias("words"))
    return stored(made.withColumn("part", F.shiftright("at", 33).cast("int")), "turns")


def scanned(rows: DataFrame, by: str, add: dict[str, tuple[Column, type]]) -> DataFrame:
    """rows with new columns: each the aggregate of a column over the rows of its conversation up to it in the order of by, made of the rows of
    its part and one row for each part before. add: name -> (column, aggregate, how the two are put together)."""
    inside, before = W.partitionBy("c", "part").orderBy(by).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("c", "part").agg(*[agg(col).alias(f"{name}_part") for name, (col, agg, _) in add.items()])
    carry = stored(parts.select("c", "part", *[F.coalesce(agg(f"{name}_part").over(before), F.lit(0)).alias(f"{name}_carry") for name, (_, agg, _) in add.items()]), "carry")
    local = rows.select("*", *[agg(col).over(inside).alias(f"{name}_own") for name, (col, agg, _) in add.items()])
    both = local.join(carry.hint("merge"), ["c", "part"])
    return both.select(*rows.columns, *[join(F.col(f"{name}_own"), F.col(f"{name}_carry")).alias(name) for name, (_, _, join) in add.items()])


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations), stored: (c, part, depth, ha, hb, words) and (c, length). A conversation c has the first h turns of c - c % 20, then its
    own from its h-th on; h is the CRC-32 of its decimal, modulo 4."""
    numbered = stored(scanned(turns, "at", {"number": (F.lit(1), F.sum, _plus)}), "numbered")
    counts = stored(numbered.groupBy("c").agg(F.count("*").alias("own")), "counts")
    base = counts.select("c", "own", (F.col("c") - F.col("c") % FAMILY).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % 4).alias("h"))
    of_base = counts.select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    lead = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = stored(base.join(of_base.hint("merge"), "base", "left").select("c", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = numbered.where((F.col("number") <= 3) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("base"), F.col("number").alias("depth"), "ha", "hb", "words")
    heads = convs.where("lead > 0").select("c", "base", "lead").join(first.hint("merge"), "base").where("depth <= lead").select("c", F.lit(-1).alias("part"), "depth", "ha", "hb", "words")
    own = numbered.join(convs.select("c", "h", "lead").hint("merge"), "c").where("number > h").select("c", "part", (F.col("lead") + F.col("number") - F.col("h")).alias("depth"), "ha", "hb", "words")
    return stored(heads.unionByName(own), "rebuilt"), convs.select("c", "length")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations), stored, as rebuilt gives them, of conversations that are taken as they are."""
    rows = stored(scanned(turns, "at", {"depth": (F.lit(1), F.sum, _plus)}).drop("at"), "numbered")
    return rows, stored(rows.groupBy("c").agg(F.count("*").alias("length")), "conversations")


def numbered_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, ends), stored: (id, parent, depth, size, conv_id, n_convs, words), the root with the number 0; (c, depth, id) of each conversation that
    owns nodes; (id, c) of each conversation's last node."""
    x, y = F.xxhash64("depth", "ha", "hb"), F.xxhash64("hb", F.lit(7), "depth", "ha")
    hashed = rows.select("c", "part", "depth", "words", x.alias("x"), y.alias("y"))
    members = scanned(hashed, "depth", {"px": (F.col("x"), F.bit_xor, _xor), "py": (F.col("y"), F.bit_xor, _xor)})
    members = stored(members.select("c", "part", "depth", "words", "px", "py", F.col("px").bitwiseXOR(F.col("x")).alias("ux"), F.col("py").bitwiseXOR(F.col("y")).alias("uy")), "members")
    node = ["depth", "px", "py"]
    owned = stored(members.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("words").alias("words"), F.min("ux").alias("ux"), F.min("uy").alias("uy")), "owned")
    owns = stored(owned.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("owns")).join(convs.hint("merge"), "c").select("c", "owns", "length"), "owns")
    # what a node's members own, but for its owner, who has the rest of its path
    mine = members.join(owns.hint("merge"), "c")
    sizes = mine.groupBy(*node).agg((F.sum("owns") - F.min_by("owns", "c") + F.min_by("length", "c") - F.col("depth") + 1).alias("size"))
    sized = stored(owned.join(sizes.hint("merge"), node).withColumn("bucket", F.shiftright("px", 64 - BUCKET_BITS)), "sized")
    up = ["depth", "ux", "uy"]
    earlier = W.partitionBy(*up, "bucket").orderBy("px", "py").rowsBetween(W.unboundedPreceding, -1)
    buckets = sized.groupBy(*up, "bucket").agg(F.sum("size").alias("all")).withColumn("carry", F.coalesce(F.sum("all").over(W.partitionBy(*up).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")
    offset = F.lit(1) + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    offsets = stored(sized.withColumn("within", offset).join(stored(buckets, "buckets").hint("merge"), [*up, "bucket"]).select(*node, "size", "conv_id", "n_convs", "words", (F.col("within") + F.col("carry")).alias("offset")), "offsets")
    walked = members.select("c", "part", *node).join(offsets.select(*node, "offset").hint("merge"), node)
    paths = stored(scanned(walked, "depth", {"id": (F.col("offset"), F.sum, _plus)}), "paths")
    lookup = paths.select(F.col("c").alias("conv_id"), "depth", "id")
    nodes = offsets.join(lookup.hint("merge"), ["conv_id", "depth"]).select("id", (F.col("id") - F.col("offset")).alias("parent"), "depth", "size", "conv_id", "n_convs", "words")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    below = owned.agg((F.count("*") + 1).alias("size"))
    root = root.join(F.broadcast(below), F.lit(True)).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), "size", "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))  # one row each
    last = convs.where("length > 0").join(paths.hint("merge"), "c").where("depth = length").select("id", "c")
    ends = last.unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("id"), "c"))
    return stored(nodes.unionByName(root), "nodes"), paths.select("c", "depth", "id"), stored(ends, "ends")


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], limit: int = LIMIT) -> DataFrame:
    """(id, values): the sums of each value over each node's subtree. nodes: (id, size, depth, conv_id, values), numbered in preorder; paths: (c, depth, id)."""
    total = nodes.count()
    active = nodes.select(F.lit(0).cast("long").alias("comp"), F.lit(total).cast("long").alias("total"), "id", "size", F.col("size").alias("left"), "depth", "conv_id", *values)
    sums, small = [], []
    while True:
        small.append(active.where(F.col("total") <= limit).select("comp", "id", "size", "left", "depth", *values))
        big = active.where(F.col("total") > limit)
        heads = big.where(2 * F.col("left") >= F.col("total")).groupBy("comp").agg(F.min_by(F.struct("id", "size", "left", "depth"), F.struct("left", "id")).alias("top"))
        heads = stored(heads.select("comp", *[F.col(f"top.{k}").alias(f"c_{k}") for k in ("id", "size", "left", "depth")]), "centroids")
        if not heads.limit(1).count():
            break
        joined = big.join(heads.hint("merge"), "comp").withColumn("below", (F.col("id") >= F.col("c_id")) & (F.col("id") < F.col("c_id") + F.col("c_size")))
        joined = stored(joined.withColumn("path", (F.col("c_id") >= F.col("id")) & (F.col("c_id") < F.col("id") + F.col("size"))), "split")
        totals = stored(joined.where("below").groupBy("comp").agg(*[F.sum(v).alias(v) for v in values]), "totals")
        sums.append(joined.where("path").select("comp", "id").join(totals.hint("merge"), "comp").select("id", *values))
        cut = F.when(F.col("path"), F.col("c_left")).otherwise(F.lit(0))
        kept = ["id", "size", "depth", "conv_id", *values]
        rest = joined.where("NOT below").select("comp", (F.col("total") - F.col("c_left")).alias("total"), (F.col("left") - cut).alias("left"), *kept)
        child = paths.select(F.col("c").alias("conv_id"), F.col("depth").alias("to_depth"), F.col("id").alias("to"))
        fallen = joined.where("below AND id != c_id").withColumn("to_depth", F.col("c_depth") + 1).join(child.hint("merge"), ["conv_id", "to_depth"])
        tops = joined.where("below AND depth = c_depth + 1").select(F.col("id").alias("to"), F.col("left").alias("to_total"))
        parted = fallen.join(tops.hint("merge"), "to").select(F.col("to").alias("comp"), F.col("to_total").alias("total"), "left", *kept)
        active = stored(rest.unionByName(parted), "components")
    small = stored(functools.reduce(DataFrame.unionByName, small), "small")
    groups = max(1, 2 * (total // limit + 1))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        out = local_sums(*(rows[k].to_numpy(np.int64) for k in ("comp", "id", "size", "left", "depth")), rows[values].to_numpy(np.int64))
        return pd.DataFrame(np.c_[rows["id"].to_numpy(np.int64), out], columns=["id", *values])

    schema = ", ".join(f"{k} long" for k in ("id", *values))
    done = small.groupBy(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("group")).applyInPandas(finish, schema)
    every = functools.reduce(DataFrame.unionByName, [done, *sums])
    return every.groupBy("id").agg(*[F.sum(v).alias(v) for v in values])


def local_sums(comp: np.ndarray, node: np.ndarray, size: np.ndarray, left: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums that rolled_up's steps add within whole components, one row for each node. left: a node's subtree within its component."""
    out, rows, left = np.zeros_like(values), np.arange(len(node)), left.copy()
    group = np.unique(comp, return_inverse=True)[1]
    while len(rows):
        n = group.max() + 1
        total = np.bincount(group, minlength=n)
        holds = np.flatnonzero(2 * left[rows] >= total[group])
        order = holds[np.lexsort((node[rows[holds]], left[rows[holds]], group[holds]))]
        head = np.zeros(n, dtype=np.int64)  # place of each component's centroid
        head[group[order[::-1]]] = rows[order[::-1]]
        c = head[group]
        below = (node[rows] >= node[c]) & (node[rows] < node[c] + size[c])
        path = (node[c] >= node[rows]) & (node[c] < node[rows] + size[rows])
        sums = np.zeros((n, values.shape[1]), dtype=np.int64)
        np.add.at(sums, group[below], values[rows[below]])
        out[rows[path]] += sums[group[path]]
        cut = left[head]
        left[rows[path & ~below]] -= cut[group[path & ~below]]
        # below the centroid a node goes with the last of the centroid's children that is numbered before it
        keep = rows != c
        rows, group, c, below = rows[keep], group[keep], c[keep], below[keep]
        order = np.lexsort((node[rows], group))
        rows, group, c, below = rows[order], group[order], c[order], below[order]
        child = below & (depth[rows] == depth[c] + 1)
        last = np.maximum.accumulate(np.where(child, np.arange(len(rows)), -1))
        group = np.unique(np.where(below, n + last, group), return_inverse=True)[1]
    return out


def digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of each node's conversation ids in numerical order, as decimals with commas between.

    Ids are joined to strings by ranges, then each node's strings stream through one hash: a row for each range, none of them held.
    """
    chunk = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")))
    chunks = ends.groupBy("id", F.shiftright("c", CHUNK_BITS).alias("range")).agg(chunk.alias("chunk"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            done = []
            for node, chunk in zip(b["id"].tolist(), b["chunk"], strict=True):
                if node != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(chunk.encode())
                else:
                    state.update(b"," + chunk.encode())
            yield pd.DataFrame(done, columns=["id", "ends_sha256"]).astype({"id": "int64"})
        if state:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["id", "ends_sha256"])

    return chunks.repartition("id").sortWithinPartitions("id", "range").mapInPandas(hashed, "id long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: each distinct sequence of the first
    depth turns (role, text) of a conversation, from the root at depth 0.

    Turns are ordered by turn, null first, equal ones by role, then text; a turn that is there twice is two turns. A null role or text is an
    empty one. Rows without a conversation id are left out; without any conversation there are no nodes. rebuild: conversations share the first turns of
    the first of their family, as rebuilt describes; else they are taken as they are. Other columns take no part.
    conv_id is the smallest member, n_leaves counts childless nodes of the subtree, saved_tokens sums over it what each node's other members
    share with the first: words of its last text. limit is the number of nodes that a task may hold.
    """
    turns = placed_turns(conversations, conv, turn, role, text)
    rows, convs = rebuilt(turns) if rebuild else as_they_are(turns)
    nodes, paths, ends = numbered_nodes(rows, convs)
    children = stored(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    full = nodes.join(children.withColumnRenamed("parent", "id").hint("merge"), "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = stored(full.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "full")
    sums = stored(rolled_up(full, paths, ["leaf", "saved"], limit), "sums").withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"})
    parents = full.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shown = full.join(stored(digests(ends), "digests").hint("merge"), "id", "left").join(sums.hint("merge"), "id").join(parents.hint("merge"), "parent", "left")
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
