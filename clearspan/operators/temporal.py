"""Joins of irregular streams on time, and operators on a stream's own gaps.

Streams have task_id and a time t in ns. A join with an age limit needs only the rows of a time bucket as wide as the limit and
of its neighbour, so both sides are united and windowed by (task_id, bucket): one shuffle for all streams, no
unbounded window, and a long recording is many small partitions.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rotation as R


def _bucket(width: int, t: str = "t") -> Column:
    """floor(t / width) in whole numbers: doubles cannot hold nanoseconds."""
    return F.expr(f"({t} - pmod({t}, {width}L)) div {width}L")


def _both(left: DataFrame, rights: dict[str, DataFrame], width: int, reach: range, key: str) -> DataFrame:
    """The union of left and right rows by bucket: columns key, __b, t, __side (right rows 0, left rows 1), __l, and one
    struct column for each right stream."""
    names = list(rights)
    payload = {n: F.struct(*[c for c in r.columns if c != key]) for n, r in rights.items()}
    types = {n: r.select(payload[n].alias("x")).schema["x"].dataType for n, r in rights.items()}
    own = left.select(key, _bucket(width).alias("__b"), "t", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), *[F.lit(None).cast(types[n]).alias(n) for n in names])
    left_type = own.schema["__l"].dataType
    parts = [own]
    for n, r in rights.items():
        copies = F.explode(F.array(*[_bucket(width) + k for k in reach]))
        parts.append(r.select(key, copies.alias("__b"), "t", F.lit(0).alias("__side"), F.lit(None).cast(left_type).alias("__l"), *[payload[n].alias(n) if m == n else F.lit(None).cast(types[m]).alias(m) for m in names]))
    return reduce(DataFrame.unionByName, parts)


def asof_join(left: DataFrame, rights: dict[str, tuple[DataFrame, int]], key: str = "task_id") -> DataFrame:
    """left with a struct column for each right stream: its newest row no later than t and no older than the stream's limit in
    ns, else null. Right rows have key, t, seq and more; of equal times the largest seq counts. All streams share one shuffle."""
    width = max(limit for _, limit in rights.values())
    every = _both(left, {n: r for n, (r, _) in rights.items()}, width, range(2), key)
    seq = F.coalesce(*[F.col(f"{n}.seq") for n in rights])
    order = W.partitionBy(key, "__b").orderBy("t", "__side", seq).rowsBetween(W.unboundedPreceding, 0)
    found = every.select("__l", "t", "__side", *[F.last(n, ignorenulls=True).over(order).alias(n) for n in rights]).where("__side = 1")
    fresh = [F.when(F.col("t") - F.col(f"{n}.t") <= limit, F.col(n)).alias(n) for n, (_, limit) in rights.items()]
    return found.select("__l.*", *fresh)


def hold_join(left: DataFrame, right: DataFrame, width_ns: int, key: str = "task_id") -> DataFrame:
    """left with held: the newest right row (by t, then seq) at or before t, however old. Each time bucket gets the last row of all earlier ones,
    which a window over one row a bucket finds, so a long recording is as many partitions as it has buckets of width_ns."""
    payload = F.struct(*[c for c in right.columns if c != key])
    kind = right.select(payload.alias("x")).schema["x"].dataType
    own = left.select(key, _bucket(width_ns).alias("__b"), "t", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(kind).alias("r"))
    none = F.lit(None).cast(own.schema["__l"].dataType)
    rows = right.select(key, _bucket(width_ns).alias("__b"), "t", F.lit(0).alias("__side"), none.alias("__l"), payload.alias("r"))
    lasts = rows.groupBy(key, "__b").agg(F.max_by("r", F.struct("t", "r.seq")).alias("r"))
    # a bucket of left rows alone holds no last row, but is carried to
    spots = lasts.unionByName(own.select(key, "__b").distinct().withColumn("r", F.lit(None).cast(kind)))
    before = W.partitionBy(key).orderBy("__b").rangeBetween(W.unboundedPreceding, -1)
    carried = spots.withColumn("r", F.last("r", ignorenulls=True).over(before)).where("r IS NOT NULL").distinct()
    starts = carried.select(key, "__b", (F.col("__b") * width_ns).alias("t"), F.lit(-1).alias("__side"), none.alias("__l"), "r")
    order = W.partitionBy(key, "__b").orderBy("t", "__side", "r.seq").rowsBetween(W.unboundedPreceding, 0)
    return own.unionByName(rows).unionByName(starts).withColumn("held", F.last("r", ignorenulls=True).over(order)).where("__side = 1").select("__l.*", "held")


def sample_hold(grid: DataFrame, source: DataFrame, timeout_ns: int, key: str = "task_id", *, width_ns: int = 60_000_000_000) -> DataFrame:
    """grid with the latest source row by receipt time: hold_t, hold_seq and age_ns however old it is, value only while it is
    no older than the timeout, and a reason otherwise."""
    held = hold_join(grid.select(key, "t"), source.select(key, "t", "seq", "v"), width_ns, key)
    age = F.col("t") - F.col("held.t")
    return held.select(key, "t", F.col("held.t").alias("hold_t"), F.col("held.seq").alias("hold_seq"), age.alias("age_ns"), F.when(age <= timeout_ns, F.col("held.v")).alias("value"),
        F.when(age.isNull(), "source_unavailable").when(age > timeout_ns, "source_timeout").alias("reason"))


def nearest_join(left: DataFrame, right: DataFrame, tolerance_ns: int, key: str = "task_id") -> DataFrame:
    """left with near: the right row nearest in time within the tolerance, earlier ones before later ones at equal distance."""
    every = _both(left, {"near": right}, tolerance_ns, range(-1, 2), key)
    back = W.partitionBy(key, "__b").orderBy("t", "__side", "near.seq").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key, "__b").orderBy("t", F.desc("__side"), "near.seq").rowsBetween(0, W.unboundedFollowing)
    both = every.withColumn("p", F.last("near", ignorenulls=True).over(back)).withColumn("n", F.first("near", ignorenulls=True).over(ahead)).where("__side = 1")
    dp, dn = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    take_p = dp.isNotNull() & (dn.isNull() | (dp <= dn))
    near = F.when(take_p & (dp <= tolerance_ns), F.col("p")).when(~take_p & (dn <= tolerance_ns), F.col("n"))
    return both.select("__l.*", near.alias("near"))


def interpolate_join(queries: DataFrame, poses: DataFrame, max_gap_ns: int, columns: list[str], key: str = "task_id", *, quaternion: tuple[str, str, str, str] | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """queries with found and the interpolated columns: an exact hit, else between the poses around t if they are no
    further apart than the gap. Nothing is extrapolated. columns mix in a straight line, the quaternion's four (w, x, y, z) by
    slerp, and flags hold where both poses have them."""
    every = _both(queries, {"p": poses}, max_gap_ns, range(-1, 2), key)
    seq = F.col("p.seq")
    back = W.partitionBy(key, "__b").orderBy("t", "__side", seq).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key, "__b").orderBy("t", F.desc("__side"), seq).rowsBetween(0, W.unboundedFollowing)
    both = every.withColumn("lower", F.last("p", ignorenulls=True).over(back)).withColumn("upper", F.first("p", ignorenulls=True).over(ahead)).where("__side = 1")
    exact = F.col("lower.t") == F.col("t")
    gap = F.col("upper.t") - F.col("lower.t")
    between = (gap > 0) & (gap <= max_gap_ns)
    found = F.coalesce(exact, F.lit(False)) | F.coalesce(between, F.lit(False))
    ratio = F.when(exact, F.lit(0.0)).when(between, (F.col("t") - F.col("lower.t")) / gap)
    values = [F.when(exact, F.col(f"lower.{c}")).when(between, F.col(f"lower.{c}") + (F.col(f"upper.{c}") - F.col(f"lower.{c}")) * ratio).alias(c) for c in columns]
    values += [F.when(exact, F.col(f"lower.{c}")).when(between, F.col(f"lower.{c}") & F.col(f"upper.{c}")).alias(c) for c in flags]
    if quaternion:
        a, b = (R.quaternion(*[F.col(f"{side}.{c}") for c in quaternion]) for side in ("lower", "upper"))
        # one column after the other, so that none is written out many times in the next
        both = both.withColumns({"__ratio": ratio, "__dot": R.dot(a, b)})
        wa, wb = R.slerp_weights(F.col("__dot"), F.col("__ratio"))
        both = both.withColumns({"__wa": F.when(exact, 1.0).otherwise(wa), "__wb": F.when(exact, 0.0).otherwise(wb)})
        both = both.withColumns({f"__q{c}": a[c] * F.col("__wa") + F.when(exact, 0.0).otherwise(b[c] * F.col("__wb")) for c in "wxyz"})
        both = both.withColumn("__n", F.sqrt(sum(F.col(f"__q{c}") * F.col(f"__q{c}") for c in "wxyz")))
        values += [F.when(found, F.col(f"__q{part}") / F.col("__n")).alias(c) for part, c in zip("wxyz", quaternion, strict=True)]
    return both.select("__l.*", found.alias("found"), ratio.alias("ratio"), *values)


def sync_inner(samples: DataFrame, poses: DataFrame, max_gap_ns: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples with a pose, and the number of samples without one by task."""
    joined = interpolate_join(samples, poses, max_gap_ns, columns)
    return joined.where("found").drop("found"), joined.groupBy("task_id").agg(F.count(F.when(~F.col("found"), 1)).alias("dropped"))


def exclude_pauses(samples: DataFrame, pauses: DataFrame, *, width_ns: int = 60_000_000_000, ns: str = "ts_ns") -> DataFrame:
    """Samples outside every pause [start, end); a pause without an end lasts. The largest end of the pauses that began no later than a sample
    decides, so there is no range join; buckets of width_ns get the largest end of all earlier ones."""
    far = 2**62
    own = samples.select("task_id", _bucket(width_ns, ns).alias("__b"), F.col(ns).alias("t"), F.lit(1).alias("side"), F.struct(*samples.columns).alias("s"), F.lit(None).cast("long").alias("until"))
    none = F.lit(None).cast(own.schema["s"].dataType)
    rows = pauses.select("task_id", _bucket(width_ns, "start_ns").alias("__b"), F.col("start_ns").alias("t"), F.lit(0).alias("side"), none.alias("s"), F.coalesce("end_ns", F.lit(far)).alias("until"))
    spots = rows.groupBy("task_id", "__b").agg(F.max("until").alias("until")).unionByName(own.select("task_id", "__b").distinct().withColumn("until", F.lit(None).cast("long")))
    before = W.partitionBy("task_id").orderBy("__b").rangeBetween(W.unboundedPreceding, -1)
    carried = spots.withColumn("until", F.max("until").over(before)).where("until IS NOT NULL").distinct()
    starts = carried.select("task_id", "__b", (F.col("__b") * width_ns).alias("t"), F.lit(-1).alias("side"), none.alias("s"), "until")
    order = W.partitionBy("task_id", "__b").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    every = own.unionByName(rows).unionByName(starts).withColumn("until", F.max("until").over(order)).where("side = 1")
    return every.where(F.col("until").isNull() | (F.col("until") <= F.col("t"))).select("s.*")


def endpoint_capture(events: DataFrame, fixes: DataFrame, max_age_ns: int, *, width_ns: int = 60_000_000_000) -> DataFrame:
    """Events with the newest fix at or before them however old: fix_seq, age_ns, confirmed, reason. fixes: (task_id, t, seq, ok)."""
    held = hold_join(events, fixes.select("task_id", "t", "seq", "ok"), width_ns)
    age = F.col("t") - F.col("held.t")
    reason = F.when(F.col("held.t").isNull(), "no_fix").when(~F.col("held.ok"), "invalid_fix").when(age > max_age_ns, "stale_fix")
    return held.select(*events.columns, F.col("held.seq").alias("fix_seq"), age.alias("age_ns"), reason.isNull().alias("confirmed"), reason.alias("reason"))


def tick_mean(rows: DataFrame, tick_ns: int, columns: list[str]) -> DataFrame:
    """Means of finite rows by tick, and how many."""
    whole_row = reduce(lambda a, b: a & b, [(~F.isnan(c)) & (F.abs(c) < F.lit(float("inf"))) for c in columns])
    return rows.where(whole_row).groupBy("task_id", _bucket(tick_ns).alias("tick")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def repeat_index(ticks: DataFrame) -> DataFrame:
    """How many earlier ticks of the task held the same source sequence."""
    return ticks.withColumn("repeat_index", F.row_number().over(W.partitionBy("task_id", "hold_seq").orderBy("t")).cast("long") - 1)


def expand_bundles(rows: DataFrame, period_ns: int, *, anchor_last: bool = False, reset_ns: int = 1_000_000_000) -> DataFrame:
    """Rows that share a raw stamp t, in seq order, get stamps a period apart, the first (or last) of them at t. A bundle that begins no later
    than the last published stamp is dropped whole; one that begins more than reset_ns before it starts the clock anew. Bundles
    arrive in the order of their first seq; only they are folded, a row for each, by task."""
    own = W.partitionBy("task_id", "t")
    place, size = F.row_number().over(own.orderBy("seq")) - 1, F.count("*").over(own)
    shift = (place - size + 1) if anchor_last else place
    placed = rows.withColumn("stamp", F.col("t") + shift * period_ns)
    bundles = placed.groupBy("task_id", "t").agg(F.min("seq").alias("seq"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))

    def fold(task: pd.DataFrame) -> pd.DataFrame:
        task, published, kept = task.sort_values("seq"), 0, []
        for t, first, last in zip(task["t"].tolist(), task["first"].tolist(), task["last"].tolist(), strict=True):
            if published > 0 and published - first > reset_ns:
                published = 0
            if t > 0 and first > 0 and (published <= 0 or first > published):
                kept.append(t)
                published = last
        return pd.DataFrame({"task_id": [task["task_id"].iloc[0]] * len(kept), "t": kept})

    schema = f"task_id {rows.schema['task_id'].dataType.simpleString()}, t long"
    kept = bundles.groupBy("task_id").applyInPandas(fold, schema)
    return placed.join(kept.hint("merge"), ["task_id", "t"], "left_semi")


def epoch_id(rows: DataFrame, rollback_ns: int, order_by: str = "seq") -> DataFrame:
    """Stamps in arrival order against the last accepted one: a fall of more than rollback_ns opens a new epoch, a smaller one is refused, an
    equal stamp replaces the row before (accepted, and superseded says that a later row took its place). A fold of (t, order) by task."""
    kind, by = rows.schema["task_id"].dataType.simpleString(), rows.schema[order_by].dataType.simpleString()

    def fold(task: pd.DataFrame) -> pd.DataFrame:
        task, last, epoch, at = task.sort_values(order_by, kind="stable"), None, 0, -1
        epochs, accepted, replaced = [], [], [False] * len(task)
        for i, t in enumerate(task["t"].tolist()):
            ok = True
            if last is not None and t < last:
                ok = last - t > rollback_ns
                epoch += ok
            elif last is not None and t == last:
                replaced[at] = True
            if ok:
                last, at = t, i
            epochs.append(epoch)
            accepted.append(ok)
        return pd.DataFrame({"task_id": task["task_id"], order_by: task[order_by], "epoch": epochs, "accepted": accepted, "superseded": replaced})

    folded = rows.select("task_id", order_by, "t").groupBy("task_id").applyInPandas(fold, f"task_id {kind}, {order_by} {by}, epoch long, accepted boolean, superseded boolean")
    return rows.join(folded.hint("merge"), ["task_id", order_by])


def pose_gaps(rows: DataFrame, limit_ns: int) -> DataFrame:
    """Gaps of more than the limit between neighbours: start, end, length."""
    lagged = rows.withColumn("gap_start", F.lag("t").over(W.partitionBy("task_id").orderBy("t", "seq")))
    return lagged.where(F.col("t") - F.col("gap_start") > limit_ns).select("task_id", "gap_start", F.col("t").alias("gap_end"), (F.col("t") - F.col("gap_start")).alias("gap_ns"))


def continuous_duration(rows: DataFrame, limit_ns: int) -> DataFrame:
    """Time since the last gap of more than the limit."""
    order = W.partitionBy("task_id").orderBy("t", "seq")
    marked = rows.withColumn("d", F.col("t") - F.lag("t").over(order)).withColumn("island", F.sum(F.coalesce((F.col("d") > limit_ns).cast("long"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("d")
    return marked.withColumn("continuous_ns", F.col("t") - F.min("t").over(W.partitionBy("task_id", "island")))


def receipt_to_sensor_time(reference_stamp: Column, reference_receipt: Column, receipt: Column, offset_ns: int = 0) -> Column:
    return reference_stamp + (receipt - reference_receipt) + F.lit(offset_ns)


def frame_context(frames: DataFrame, pose_bounds: DataFrame, *, partial_tail_ns: int = 0) -> DataFrame:
    """Frames (task_id, frame_id, first_ns, last_ns) against their task's poses (min_ns, max_ns): gaps at head and tail, and why a frame is
    dropped (null if it is not). A head without poses is never allowed and told first; at the tail up to partial_tail_ns may lack them. Bounds
    that are null, zero or less are no poses, and leave both gaps 0."""
    j = frames.join(pose_bounds.hint("merge"), "task_id", "left")
    head, tail = F.greatest(F.col("min_ns") - F.col("first_ns"), F.lit(0)), F.greatest(F.col("last_ns") - F.col("max_ns"), F.lit(0))
    none = F.coalesce((F.col("min_ns") <= 0) | (F.col("max_ns") <= 0), F.lit(True))
    reason = F.when(none, "POSE_NOT_AVAILABLE").when(head > 0, "CLOUD_OLDER_THAN_POSE_CACHE").when(tail > partial_tail_ns, "POSE_TAIL_TIMEOUT")
    return j.select("task_id", "frame_id", F.when(none, 0).otherwise(head).alias("head_gap_ns"), F.when(none, 0).otherwise(tail).alias("tail_gap_ns"), reason.alias("drop_reason"))
