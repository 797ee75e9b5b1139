"""Folds over recordings by stretches.

A recording is cut at time buckets into stretches of bounded rows. One of a single stretch is run once, from its beginning. A fold whose state forgets where it began need not hold a longer
recording in one task: each stretch is run from an entry state and gives an exit state, which is the next stretch's entry. Stretches whose entry has changed are run again until none changes.
The first stretch is right after the first round and each next one after one more at most; the fixed point is the fold's own result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import stored

#: Rows after which a recording is cut at the next bucket, and rows of the stretches that are run together, on average.
MOST = 10_000

Fold = Callable[[Iterable[tuple], tuple[list, list] | None], tuple[list[tuple], tuple[list, list]]]


def replayed(rows: DataFrame, fold: Fold, out: str, *, bucket_ns: int, key: str = "task_id", most: int | None = None) -> DataFrame:
    """What fold makes of each key's rows in the order of t. fold takes a stretch's rows (tuples of all columns but the key) and its entry (longs, doubles; None at the beginning) and returns the rows to show
    and its exit. rows: key, t and what fold reads; out: columns of the rows shown, without the key. Stretches begin with a bucket and end with the first one that brings them to most rows (MOST if None) or more, so
    that a task's rows stay few however long a recording is. Rows without a key or t are dropped."""
    kind, most = rows.schema[key].dataType.simpleString(), most or MOST
    same = [key, "stretch"]
    fields = [c for c in rows.columns if c != key]
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    rows = stored(rows.where(F.col("t").isNotNull() & F.col(key).isNotNull()).withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_ns)).cast("long")), "rows")
    sizes = stored(rows.groupBy(key, "bucket").agg(F.count("*").alias("n")), "buckets")
    parts = (sizes.agg(F.sum("n")).first()[0] or 0) // most + 1
    order = W.partitionBy(key).orderBy("bucket")  # a row for each bucket
    placed = sizes.withColumn("stretch", F.floor((F.sum("n").over(order) - F.col("n")) / F.lit(most)).cast("long")).withColumn("last", F.max("stretch").over(W.partitionBy(key)))
    spans = stored(placed.where("last > 0").select(key, "bucket", "stretch"), "spans")  # of recordings of several stretches
    states = f"{key} {kind}, stretch long, longs array<long>, doubles array<double>"
    part = F.pmod(F.xxhash64(*same), F.lit(parts)).alias("part")

    def each(part: pd.DataFrame, entries: pd.DataFrame | None):
        """(key, stretch, what fold gives) of the stretches of a part; one without an entry begins its recording."""
        given = [] if entries is None else zip(*[entries[c].tolist() for c in (*same, "longs", "doubles")], strict=True)
        begun = {(k, b): (list(longs), list(doubles)) for k, b, longs, doubles in given if longs is not None}
        part = part.sort_values([*same, "t"])
        values = zip(*[part[c].tolist() for c in fields], strict=True)
        for at, own in groupby(zip(part[key].tolist(), part["stretch"].tolist(), values, strict=True), key=lambda r: r[:2]):
            yield *at, fold((r[2] for r in own), begun.get(at))

    def exits_of(part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k, b, *made[1]) for k, b, made in each(part, entries)], columns=[*same, "longs", "doubles"])

    def shown(part: pd.DataFrame, entries: pd.DataFrame | None) -> pd.DataFrame:
        return pd.DataFrame([(k, *row) for k, _, made in each(part, entries) for row in made[0]], columns=names)

    if spans.isEmpty():
        dealt = rows.withColumn("stretch", F.lit(0).cast("long")).withColumn("part", part)
        return dealt.groupBy("part").applyInPandas(lambda own: shown(own, None), f"{key} {kind}, {out}")

    rows = stored(rows.join(spans.hint("merge"), [key, "bucket"], "left").withColumn("stretch", F.coalesce("stretch", F.lit(0).cast("long"))), "rows")
    chain = stored(spans.select(same).distinct().withColumn("next", F.lead("stretch").over(W.partitionBy(key).orderBy("stretch"))), "stretches")
    heads = chain.where("next IS NOT NULL").select(same)  # nobody enters with the exit of a last one

    def run(of: DataFrame, entries: DataFrame, what, schema: str) -> DataFrame:
        return of.withColumn("part", part).groupBy("part").cogroup(entries.withColumn("part", part).groupBy("part")).applyInPandas(what, schema)

    def exits(entries: DataFrame) -> DataFrame:
        """(key, stretch, exit) of those that have a next one."""
        entries = entries.join(heads.hint("merge"), same, "left_semi")
        made = run(rows.join(entries.select(same).hint("merge"), same, "left_semi"), entries, exits_of, states)
        return made.select(*same, F.struct("longs", "doubles").alias("exit"))

    empty = [F.lit(None).cast(f"array<{c}>").alias(f"{c}s") for c in ("long", "double")]
    entries = chain.select(*same, *empty)
    told = stored(entries.join(stored(exits(entries), "exits").hint("merge"), same, "left"), "states")
    while True:
        given = chain.where("next IS NOT NULL").join(told.select(*same, "exit").hint("merge"), same).select(key, F.col("next").alias("stretch"), "exit.*")
        before = told.select(*same, F.struct("longs", "doubles").alias("entry"))
        changed = given.join(before.hint("merge"), same).where(~F.struct("longs", "doubles").eqNullSafe(F.col("entry")))
        waiting = stored(changed.select(*same, "longs", "doubles"), "changed")
        if waiting.isEmpty():
            return run(rows, told.select(*same, "longs", "doubles"), shown, f"{key} {kind}, {out}")
        again = stored(exits(waiting), "exits")
        told = stored(told.join(waiting.select(same).hint("merge"), same, "left_anti").unionByName(waiting.join(again.hint("merge"), same, "left")), "states")
