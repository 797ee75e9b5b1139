"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Candidates are packed into shards and queries into blocks, each a few MB of integers. A tile task gets some BUNDLE blocks and a few
shards, multiplies them in slices, and keeps k candidates a query. The lists of a query are then merged by twos of
FAN, level by level, so that no task sees more than FAN lists of a query however many shards there are. Blocks
are copied once for each group of shards and shards once for each bundle of blocks: the traffic of any tiled product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists of one query that a merge joins.
FAN = 16
#: Query blocks that a tile holds together: shards are copied once for each bundle of them.
BUNDLE = 8
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def packed(rows: DataFrame, megabytes: float) -> DataFrame:
    """(pack, ids, values, dim): rows (id, v) in packs of at most so many MB, in ascending id order within a pack. Values
    are floor(scale * x) as doubles, which hold these integers exactly."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            vectors = b["v"].tolist()
            dim = max((len(v) for v in vectors), default=0)
            step = max(1, int(megabytes * 1e6 / (8 * max(dim, 1))))
            for at in range(0, len(vectors), step):
                some, ids = vectors[at : at + step], b["id"].to_numpy(np.int64)[at : at + step]
                order = np.argsort(ids, kind="stable")
                values = np.zeros((len(some), dim))
                for row, k in enumerate(order):
                    values[row, : len(some[k])] = some[k]
                yield pd.DataFrame({"pack": [(part << 24) + n], "ids": [ids[order].tobytes()], "values": [values.tobytes()], "dim": [dim]})
                n += 1

    return rows.mapInPandas(pack, "pack long, ids binary, values binary, dim int")


def best(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, id) of the k best candidates of each query, ties to smaller ids; ids ascend. All values are
    integers: products are exact in doubles under 2^53, and are made with Python's integers beyond."""
    dim = min(queries.shape[1], values.shape[1])
    q, v = queries[:, :dim], values[:, :dim]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
    n, out = len(ids), []
    if (bound + 1) * (n + 1) >= EXACT:
        q, v = q.astype(object), v.astype(object)
        q = np.array([[int(x) for x in row] for row in q], dtype=object).reshape(q.shape)
        v = np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape)
        for row in range(len(q)):
            # at the limits before they are ranked, so that the result doesn't depend on how rows are packed
            scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in v.dot(q[row])] if dim else [0] * n
            top = sorted((c for c in range(n) if ids[c] != query_ids[row]), key=lambda c: (-scores[c], ids[c]))[:k]
            out.append((np.full(len(top), row), np.array([scores[c] for c in top], dtype=np.int64), ids[top]))
    else:
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            keys = (part @ v.T) * n - np.arange(n)  # one number for score and place
            keys[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
            top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), keys.shape)
            row = np.repeat(np.arange(at, at + len(part)), top.shape[1])
            found = np.take_along_axis(keys, top, axis=1).ravel()
            keep = found > -np.inf
            row, place, found = row[keep], top.ravel()[keep], found[keep]
            out.append((row, np.rint((found + place) / n).astype(np.int64), ids[place]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", queries: Column | None = None, k: int = 10, scale: float = 1024.0, megabytes: float = 4.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by the inner product of floor(scale * x).

    queries says which rows are queries (vec_id divisible by 100 unless given); candidates are all rows whose id is
    not the query's. Vectors that are null or hold null or non-finite components, and rows without an id, take
    no part. Missing components of a shorter vector count as 0. A query row that is there twice has two lists;
    candidates that are there twice take two ranks. Scores beyond a long end at its limits. No usable rows: no rows.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: _whole(x.cast("double") * scale) if scale else x.cast("double")).alias("v"))
    chosen = rows.where(F.col("id") % 100 == 0 if queries is None else queries)
    n_queries = max(1, chosen.count())
    per_block = 4096
    n_blocks = (n_queries + per_block - 1) // per_block
    blocks = packed(chosen.repartition(n_blocks), megabytes)
    from .shared import stored

    blocks, shards = stored(blocks, "blocks"), stored(packed(rows, megabytes), "shards")
    groups, bundles = max(1, (shards.count() + 3) // 4), max(1, (blocks.count() + BUNDLE - 1) // BUNDLE)
    left = blocks.withColumn("bundle", F.pmod(F.xxhash64("pack"), F.lit(bundles)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("bundle", "group", F.col("pack").alias("block"), "ids", "values", "dim")
    right = shards.withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int")).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).select("bundle", "group", "ids", "values", "dim")

    def unpack(r) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(r.ids, dtype=np.int64)
        return ids, np.frombuffer(r.values, dtype=np.float64).reshape(len(ids), r.dim)

    def tile(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        made = []
        for b in own.itertuples():
            query_ids, q = unpack(b)
            for s in others.itertuples():
                ids, values = unpack(s)
                row, score, found = best(q, query_ids, values, ids, k)
                made.append(pd.DataFrame({"block": b.block, "group": np.int32(b.group), "row": row, "query_id": query_ids[row], "score": score, "vec_id": found}))
        if not made:
            return pd.DataFrame({"block": [], "group": [], "row": [], "query_id": [], "score": [], "vec_id": []}).astype("int64")
        every = pd.concat(made).sort_values(["block", "row", "score", "vec_id"], ascending=[True, True, False, True], kind="stable")
        return every.groupby(["block", "row"], sort=False).head(k)

    schema = "block long, group int, row long, query_id long, score long, vec_id long"
    lists = left.groupBy("bundle", "group").cogroup(right.groupBy("bundle", "group")).applyInPandas(tile, schema)
    # ascending order of (-score - 1, vec_id) is descending score, then ascending id; -score - 1 cannot overflow
    entry = F.struct((-1 - F.col("score")).alias("under"), F.col("vec_id"))
    merged = lists.groupBy("block", "row", "query_id", F.floor(F.col("group") / FAN).cast("int").alias("group")).agg(_top(F.collect_list(entry), k).alias("top"))
    left_groups = (groups + FAN - 1) // FAN
    while left_groups > 1:
        merged = merged.groupBy("block", "row", "query_id", F.floor(F.col("group") / FAN).cast("int").alias("group")).agg(_top(F.flatten(F.collect_list("top")), k).alias("top"))
        left_groups = (left_groups + FAN - 1) // FAN
    return merged.select("query_id", F.posexplode("top").alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-1 - F.col("hit.under")).alias("score"))


def _whole(x: Column) -> Column:
    """floor as a double; from 2^52 on doubles are whole themselves, and a long couldn't hold all of them."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _top(entries: Column, k: int) -> Column:
    return F.slice(F.sort_array(entries), 1, k)
