"""Low-event analysis of recorded heights along the travelled distance.

samples: task_id, sample_index, height, valid, source_sequence, odo_x/y/z, point_x/y/z [, is_repeated, heading]. All tasks are
analysed at once: every step is a window or an aggregate by task, segment or event; only the search for periodic groups runs
as a grouped map, by task or, for tasks of many events, by blocks of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnomalyConfig
from ..functions.geodesy import finite, lateral_coordinate
from ..tables import stored

DEFAULT = AnomalyConfig()
#: Samples that a task of an analysis sorts.
SAMPLES_A_TASK = 50_000
#: What the search for periodic groups reads of an event, and the order in which it takes candidates (those of most members first).
MEASURES = ("centre", "length", "min_height", "lateral", "rep_z")
ORDER = ["members", "residual", "period", "i", "j"]
GROUPS = "task_id long, event long, group string, period double"
#: First events that a block of a large task searches from; events, and in large tasks pairs of them, for each Spark task of the search; cells of its arrays.
#: They bear on speed only.
ANCHORS, EVENTS_A_TASK, PAIRS_A_TASK, CELLS = 32, 20_000, 1_000_000, 200_000
OUTLIER, REVIEW, PERIODIC, STRUCTURE = "HIGH_CONFIDENCE_OUTLIER", "REVIEW_REQUIRED", "PROTECTED_PERIODIC_STRUCTURE", "VALID_STRUCTURE"


def travel_distance(samples: DataFrame, c: AnomalyConfig = DEFAULT) -> DataFrame:
    """samples with distance, reliable and segment. A step counts if this and the row just before have a position and lie
    no further apart than max_step; every other row but the first breaks the segment and is unreliable."""
    order = W.partitionBy("task_id").orderBy("sample_index")
    here = finite(F.col("odo_x"), F.col("odo_y"), F.col("odo_z"))
    step = F.sqrt(sum(F.pow(F.col(a) - F.lag(a).over(order), 2) for a in ("odo_x", "odo_y", "odo_z")))
    s = samples.withColumn("__here", here)
    s = s.withColumn("__first", F.row_number().over(order) == 1).withColumn("__step", F.when(F.col("__here") & F.lag("__here").over(order), step))
    good = F.coalesce(F.col("__step") <= c.max_step, F.lit(False))
    s = s.withColumn("__good", good).withColumn("reliable", F.col("__good") | (F.col("__first") & F.col("__here")))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("distance", F.sum(F.when(F.col("__good"), F.col("__step")).otherwise(0.0)).over(running))
    s = s.withColumn("segment", F.sum((~F.col("__good") & ~F.col("__first")).cast("long")).over(running))
    return s.drop("__here", "__first", "__step", "__good")


def classify_samples(samples: DataFrame) -> DataFrame:
    """samples with reason (null for usable rows) and usable: duplicate frame, then the device's own flag, then a height that is no
    height, then a point at the origin."""
    again = F.row_number().over(W.partitionBy("task_id", "source_sequence").orderBy("sample_index")) > 1
    repeated = F.coalesce(F.col("is_repeated"), F.lit(False)) if "is_repeated" in samples.columns else F.lit(False)
    device = F.coalesce(F.col("invalid_reason"), F.lit("device_invalid")) if "invalid_reason" in samples.columns else F.lit("device_invalid")
    duplicate = repeated | (F.col("source_sequence").isNotNull() & again)
    zero = (F.abs("point_x") <= 1e-12) & (F.abs("point_y") <= 1e-12) & (F.abs("point_z") <= 1e-12)
    reason = F.when(duplicate, "duplicate_source_frame").when(~F.col("valid"), device).when(~finite(F.col("height")) | (F.col("height") <= 0), "invalid_realtime_height").when(F.coalesce(zero, F.lit(False)), "zero_minimum_point")
    return samples.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def _quantile(sorted_: Column, q: float) -> Column:
    """Linear between the values of a sorted array."""
    at = (F.size(sorted_) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_, low), F.get(sorted_, F.least(low + 1, F.size(sorted_) - 1))
    return a + (b - a) * (at - low)


def _let(value: Column, kind: str, body) -> Column:
    """body(value), with value computed once: a lambda that named a computed column would compute it again for each element."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def _with_stats(rows: DataFrame, c: AnomalyConfig) -> DataFrame:
    """rows with near, an array of (h, d): baseline, mad, drop, count, span, low."""
    kind = "struct<baseline:double,mad:double,n:bigint,span:double>"
    spread = lambda near: F.array_max(F.transform(near, lambda n: n["d"])) - F.array_min(F.transform(near, lambda n: n["d"]))
    stats = _let(F.col("near"), kind, lambda near: _let(F.sort_array(F.transform(near, lambda n: n["h"])), kind, lambda h: _let(_quantile(h, 0.5), kind, lambda m: F.struct(
        _quantile(h, c.baseline_quantile).alias("baseline"), _let(F.sort_array(F.transform(h, lambda x: F.abs(x - m))), "double", lambda dev: _quantile(dev, 0.5)).alias("mad"), F.size(h).cast("long").alias("n"), spread(near).alias("span")))))
    rows = rows.withColumn("__s", stats)
    rows = rows.withColumns({"baseline": F.col("__s.baseline"), "mad": F.col("__s.mad"), "local_count": F.col("__s.n"), "local_span": F.col("__s.span"), "drop": F.col("__s.baseline") - F.col("height")})
    return rows.withColumn("low", F.col("drop") > F.greatest(F.lit(c.absolute_drop), F.lit(c.mad_multiplier * c.mad_scale) * F.col("mad"))).drop("near", "__s")


def local_baselines(samples: DataFrame, c: AnomalyConfig = DEFAULT) -> DataFrame:
    """Usable rows with baseline, mad, drop, local_count, local_span, low: over the reliable rows of the segment within the window,
    max_local_samples of them at most around the row; unreliable rows over their neighbours among all usable rows."""
    usable = samples.where("usable")
    entry = F.struct(F.col("height").alias("h"), F.col("distance").alias("d"))
    sure = usable.where("reliable")
    near = W.partitionBy("task_id", "segment").orderBy("distance")
    radius = int(c.window_radius)
    if radius != c.window_radius:
        raise ValueError("the window radius is a whole number of metres")
    reach = near.rangeBetween(-radius, radius)
    order = W.partitionBy("task_id", "segment").orderBy("distance", "sample_index")
    half, most = c.max_local_samples // 2, c.max_local_samples
    # places in the segment, from 0: the first row in reach, the end of those in reach, the row itself
    sized = sure.withColumn("__i", F.row_number().over(order).cast("long") - 1)
    sized = sized.withColumn("__left", F.min("__i").over(reach)).withColumn("__right", F.max("__i").over(reach) + 1)
    start = F.greatest(F.col("__left"), F.least(F.col("__i") - half, F.col("__right") - most))
    capped = F.col("__right") - F.col("__left") > most
    sized = sized.withColumn("__from", F.when(capped, start).otherwise(F.col("__left"))).withColumn("__to", F.when(capped, start + most).otherwise(F.col("__right")))
    around = order.rowsBetween(-most, most)
    listed = sized.withColumn("__near", F.collect_list(F.struct("__i", entry.alias("e"))).over(around))
    kept = F.filter("__near", lambda n: (n["__i"] >= F.col("__from")) & (n["__i"] < F.col("__to")))
    first = listed.withColumn("near", F.transform(kept, lambda n: n["e"])).drop("__near", "__i", "__left", "__right", "__from", "__to")
    rows = W.partitionBy("task_id").orderBy("sample_index").rowsBetween(-c.fallback_radius_rows, c.fallback_radius_rows)
    second = usable.withColumn("near", F.collect_list(entry).over(rows)).where("NOT reliable")
    return _with_stats(first.unionByName(second), c)


def low_events(rows: DataFrame, c: AnomalyConfig = DEFAULT) -> DataFrame:
    """Low rows with event (from 1): a new one starts where the gap to the low row before is more than merge_gap."""
    order = W.partitionBy("task_id").orderBy("sample_index")
    lows = rows.where("low")
    fresh = F.coalesce(F.col("distance") - F.lag("distance").over(order) > c.merge_gap, F.lit(True))
    return lows.withColumn("__new", fresh.cast("long")).withColumn("event", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def flanks(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Each sample's nearest normal one before and after it (structs d, h, x, y, z), however far; event_features takes those within its reach."""
    marks = rows.select("task_id", "sample_index", "low")
    return sides(samples.join(marks, ["task_id", "sample_index"], "left"))


def sides(marked: DataFrame) -> DataFrame:
    """flanks of samples that have low (null for unusable ones)."""
    normal = F.when(F.coalesce(~F.col("low"), F.lit(False)), F.struct(F.col("distance").alias("d"), F.col("height").alias("h"), F.col("point_x").alias("x"), F.col("point_y").alias("y"), F.col("point_z").alias("z")))
    order = W.partitionBy("task_id").orderBy("sample_index")
    s = marked.withColumn("before", F.last(normal, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.first(normal, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    return s.select("task_id", "sample_index", "before", "after")


def _apart(a: Column, x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - x, 2) + F.pow(a["y"] - y, 2) + F.pow(a["z"] - z, 2))


def event_features(events: DataFrame, sides: DataFrame, c: AnomalyConfig = DEFAULT, parts: int | None = None) -> DataFrame:
    """One row for each event with its measures. parts: partitions in which the events are gathered."""
    e = events.join(sides, ["task_id", "sample_index"])
    if "heading" not in e.columns:
        e = e.withColumn("heading", F.lit(None).cast("double"))
    row = F.struct("height", "sample_index")
    pick = lambda col, by: getattr(F, by)(col, "sample_index")
    keys = ["task_id", "event"]
    e = e.repartition(parts, *keys) if parts else e
    lateral = lateral_coordinate(F.col("point_x"), F.col("point_y"), F.col("heading"))
    world = {a: F.col(f"point_{a}") + F.col(f"odo_{a}") for a in "xyz"}
    both = finite(*world.values())
    g = e.groupBy(*keys).agg(
        F.sort_array(F.collect_list("sample_index")).alias("samples"), F.min("distance").alias("start"), F.max("distance").alias("end"), F.count("*").alias("n"),
        F.min("height").alias("min_height"), F.percentile("height", F.lit(0.5)).alias("median_height"), F.percentile("baseline", F.lit(0.5)).alias("baseline"), F.max("drop").alias("max_drop"),
        F.min_by("point_x", row).alias("rep_x"), F.min_by("point_y", row).alias("rep_y"), F.min_by("point_z", row).alias("rep_z"), F.min_by(lateral, row).alias("lateral"),
        pick("before", "min_by").alias("before"), pick("after", "max_by").alias("after"),
        pick(F.struct("point_x", "point_y", "point_z"), "min_by").alias("first"), pick(F.struct("point_x", "point_y", "point_z"), "max_by").alias("last"),
        *[F.percentile(F.when(both, world[a]), F.lit(0.5)).alias(f"w{a}") for a in "xyz"], F.count(F.when(both, 1)).alias("n_world"),
        F.every((F.col("local_count") >= c.min_local_samples) & (F.col("local_span") >= c.min_local_span) & F.col("reliable")).alias("sufficient"))
    spread = e.join(g.select(*keys, "median_height", "wx", "wy", "wz"), keys).groupBy(*keys).agg(
        F.percentile(F.abs(F.col("height") - F.col("median_height")), F.lit(0.5)).alias("height_mad"),
        F.max(F.when(both, F.sqrt(sum(F.pow(world[a] - F.col(f"w{a}"), 2) for a in "xyz")))).alias("spread"))
    g = g.join(spread, keys)
    before = F.when(F.abs(F.col("before.d") - F.col("start")) <= c.flank_search, F.col("before"))
    after = F.when(F.abs(F.col("after.d") - F.col("end")) <= c.flank_search, F.col("after"))
    g = g.withColumns({"before": before, "after": after})
    spread = F.when(F.col("n_world") >= 2, F.col("spread"))
    return g.select(*keys, F.format_string("E%04d", "event").alias("event_id"), "samples", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("centre"), (F.col("end") - F.col("start")).alias("length"), "n", "min_height", "median_height", "baseline", "max_drop", "rep_x", "rep_y", "rep_z", "lateral", "height_mad",
        F.col("before.h").alias("front_height"), F.col("after.h").alias("back_height"),
        F.when(F.col("start") > F.col("before.d"), (F.col("median_height") - F.col("before.h")) / (F.col("start") - F.col("before.d"))).alias("entry_gradient"),
        F.when(F.col("after.d") > F.col("end"), (F.col("after.h") - F.col("median_height")) / (F.col("after.d") - F.col("end"))).alias("exit_gradient"),
        F.greatest(_apart(F.col("before"), F.col("first.point_x"), F.col("first.point_y"), F.col("first.point_z")), _apart(F.col("after"), F.col("last.point_x"), F.col("last.point_y"), F.col("last.point_z"))).alias("boundary_jump"),
        spread.alias("spread"), (spread <= F.greatest(F.lit(c.point_spread), (F.col("end") - F.col("start")) * c.point_spread_ratio)).alias("continuous"), "sufficient")


def _measures(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {name: rows[name].to_numpy(float) for name in MEASURES}


def _alike(t: dict[str, np.ndarray], a, b, c: AnomalyConfig) -> np.ndarray:
    """Whether events a and b (places, broadcast) may be of one structure. What is unknown does not part them."""
    short, long = np.minimum(t["length"][a], t["length"][b]), np.maximum(t["length"][a], t["length"][b])
    with np.errstate(divide="ignore", invalid="ignore"):
        alike = (long <= 1e-9) | ((short > 1e-9) & (long / short <= c.periodic_length_ratio))
        for name, most in (("min_height", c.periodic_height), ("lateral", c.periodic_lateral), ("rep_z", c.periodic_vertical)):
            alike &= ~(np.abs(t[name][b] - t[name][a]) > most)
    return alike


def _grid(centre: np.ndarray, start: np.ndarray, period: np.ndarray, c: AnomalyConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ordinal, residual, fits) of events at centre on the grids from start with these periods."""
    ordinal = np.rint((centre - start) / period)
    residual = np.abs(centre - (start + ordinal * period))
    return ordinal, residual, residual <= np.maximum(c.periodic_tolerance, c.periodic_tolerance_ratio * period)


def _members(t: dict[str, np.ndarray], i: int, alike: np.ndarray, period: np.ndarray, c: AnomalyConfig) -> tuple[np.ndarray, np.ndarray]:
    """(member, residual) by period and event alike i: of the events that fit one ordinal the first is a member. Ordinals rise with the events."""
    ordinal, residual, member = _grid(t["centre"][alike], t["centre"][i], period[:, None], c)
    last = np.maximum.accumulate(np.where(member, ordinal, -np.inf), axis=1)
    member[:, 1:] &= ordinal[:, 1:] > last[:, :-1]
    return member, residual


def _candidates(t: dict[str, np.ndarray], anchors, c: AnomalyConfig):
    """For each anchor i a frame (members, residual, period, i, j): the even spacings from i over each later event j that enough events keep."""
    every = np.arange(len(t["centre"]))
    for i in anchors:
        alike = np.flatnonzero(_alike(t, i, every, c))
        later = every[i + 1 :]
        period = (t["centre"][later] - t["centre"][i]) / (later - i)
        later, period = later[period >= c.periodic_min_spacing], period[period >= c.periodic_min_spacing]
        if len(alike) < c.periodic_min_events or not len(later):
            continue
        sums = []
        for part in np.array_split(period, len(period) * len(alike) // CELLS + 1):
            member, residual = _members(t, i, alike, part, c)
            sums.append((member.sum(axis=1), np.where(member, residual, 0.0).cumsum(axis=1)[:, -1]))
        members, residual = (np.concatenate(s) for s in zip(*sums))
        enough = members >= c.periodic_min_events
        yield pd.DataFrame({"members": members[enough], "residual": residual[enough], "period": period[enough], "i": i, "j": later[enough]})


class _Choice:
    """The groups of a task, chosen among its candidates in their order: each takes those of its members that are free, if they are enough."""

    def __init__(self, rows: pd.DataFrame, c: AnomalyConfig):
        self.rows, self.t, self.c, n = rows, _measures(rows), c, len(rows)
        self.every, self.number = np.arange(n), 0
        self.group, self.period = np.zeros(n, int), np.full(n, np.nan)
        self.left = None

    def offer(self, i: np.ndarray, period: np.ndarray) -> None:
        if self.left is None:
            # free events alike each event; where they are too few, its candidates are done with
            parts = np.array_split(self.every, len(self.every) ** 2 // CELLS + 1)
            self.left = np.concatenate([_alike(self.t, part[:, None], self.every, self.c).sum(axis=1) for part in parts])
        for at in self._hopeful(i, period):
            if self.left[i[at]] < self.c.periodic_min_events:
                continue
            alike = np.flatnonzero(_alike(self.t, i[at], self.every, self.c))
            member, _ = _members(self.t, i[at], alike, period[at : at + 1], self.c)
            free = alike[member[0] & (self.group[alike] == 0)]
            if len(free) >= self.c.periodic_min_events:
                self.number += 1
                self.group[free], self.period[free] = self.number, period[at]
                for m in free:
                    self.left -= _alike(self.t, m, self.every, self.c)

    def _hopeful(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Places of the candidates that enough free events fit. Fewer of these may be members, and fewer may be free at their turn; never more."""
        rows = np.flatnonzero(self.left[i] >= self.c.periodic_min_events)
        low, free = self.t["min_height"], np.flatnonzero(self.group == 0)
        rows, free = rows[np.argsort(low[i[rows]])], free[np.argsort(low[free])]
        kept = [np.zeros(0, int)]
        for part in np.array_split(rows, len(rows) // 64 + 1):
            if not len(part):
                continue
            a = i[part][:, None]
            # twice the height's tolerance, so that rounding leaves none out
            ends = np.searchsorted(low[free], low[a[0, 0]] - 2 * self.c.periodic_height), np.searchsorted(low[free], low[a[-1, 0]] + 2 * self.c.periodic_height, "right")
            near = free[slice(*ends)]
            fits = _grid(self.t["centre"][near], self.t["centre"][a], period[part][:, None], self.c)[2] & _alike(self.t, a, near, self.c)
            kept.append(part[fits.sum(axis=1) >= self.c.periodic_min_events])
        return np.sort(np.concatenate(kept))

    def result(self) -> pd.DataFrame:
        names = pd.Series([f"P{g:03d}" if g else None for g in self.group], index=self.rows.index, dtype=object)
        return self.rows[["task_id", "event"]].assign(group=names, period=self.period)


def periodic_groups(events: DataFrame, c: AnomalyConfig = DEFAULT) -> DataFrame:
    """(task_id, event, group, period): events that recur at an even spacing; their centres rise with event. Every task is searched: one of
    periodic_max_events events at most in one group, a larger one by blocks of its events."""
    events = events.select("task_id", "event", *MEASURES)
    sizes = events.groupBy("task_id").agg(F.count("*").alias("n"))
    large = F.col("n") > c.periodic_max_events
    n, pairs = sizes.agg(F.sum("n"), F.sum(F.when(large, F.col("n") * F.col("n")))).first()
    least = events.sparkSession.sparkContext.defaultParallelism
    parts = max(least, (n or 0) // EVENTS_A_TASK + 1)
    if pairs is None:
        return _groups_of_small(events, parts, c)
    sized = events.join(sizes.hint("merge"), "task_id")
    few, many = sized.where(~large).drop("n"), sized.where(large)
    return _groups_of_small(few, parts, c).unionByName(_groups_of_large(many, max(least, pairs // PAIRS_A_TASK + 1), c))


def _groups_of_small(events: DataFrame, parts: int, c: AnomalyConfig) -> DataFrame:
    def greedy(task: pd.DataFrame) -> pd.DataFrame:
        rows = task.sort_values("event").reset_index(drop=True)
        choice, found = _Choice(rows, c), list(_candidates(_measures(rows), range(len(rows)), c))
        if found:
            found = pd.concat(found).sort_values(ORDER, ascending=[name != "members" for name in ORDER])
            choice.offer(found["i"].to_numpy(), found["period"].to_numpy())
        return choice.result()

    return events.repartition(parts, "task_id").groupBy("task_id").applyInPandas(greedy, GROUPS)


def _groups_of_large(events: DataFrame, parts: int, c: AnomalyConfig) -> DataFrame:
    """Each block of anchors finds its candidates with all events of its task at hand. Spark sorts a task's candidates, and the choice, in
    which each depends on those before it, meets them in batches: it holds the task's events, never its candidates."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("i")
        first = int(rows["block"].iloc[0]) * ANCHORS
        for found in _candidates(_measures(rows), range(first, min(first + ANCHORS, len(rows))), c):
            yield found.assign(task_id=rows["task_id"].iloc[0])[["task_id", *ORDER]]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, choice, before = [], None, None
        for batch in batches:
            event = batch["members"].isna().to_numpy()
            if event.any():
                if choice:
                    raise ValueError("an event after candidates")
                own.append(batch.loc[event, ["task_id", "j", *MEASURES]].rename(columns={"j": "event"}))
            found = batch[~event]
            if len(found):
                ends = [tuple(-v if name == "members" else v for name, v in zip(ORDER, found[ORDER].iloc[at])) for at in (0, -1)]
                if ends[0] > ends[1] or before and before > ends[0]:
                    raise ValueError("candidates out of order")
                choice, before = choice or _Choice(pd.concat(own, ignore_index=True), c), ends[1]
                choice.offer(found["i"].to_numpy(), found["period"].to_numpy())
        yield (choice or _Choice(pd.concat(own, ignore_index=True), c)).result()

    placed = events.withColumn("i", F.row_number().over(W.partitionBy("task_id").orderBy("event")).cast("long") - 1)
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) DIV {ANCHORS} AS INT)"))))
    found = blocks.drop("n").repartition(parts, "task_id", "block").groupBy("task_id", "block").applyInPandas(search, "task_id long, members long, residual double, period double, i long, j long")
    # an event has a candidate's columns too, without members, so that it comes before all of them
    none = {"members": "long", "residual": "double", "period": "double"}
    own = placed.select("task_id", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()], "i", F.col("event").alias("j"), *MEASURES)
    order = [F.col("members").desc_nulls_first() if name == "members" else F.col(name) for name in ORDER]
    rows = own.unionByName(found, allowMissingColumns=True).repartition(parts, "task_id").sortWithinPartitions("task_id", *order)
    return rows.groupBy("task_id").applyInPandas(choose, GROUPS)


def score_events(events: DataFrame, groups: DataFrame, c: AnomalyConfig = DEFAULT) -> DataFrame:
    """events with group, period, score, rules and status."""
    e = events.join(groups.hint("merge"), ["task_id", "event"])
    back = F.coalesce((F.col("front_height") >= F.col("baseline") - c.normal_return) & (F.col("back_height") >= F.col("baseline") - c.normal_return), F.lit(False))
    stable, long_enough, periodic = F.col("height_mad") <= c.structure_max_mad, F.col("length") >= c.structure_min_length, F.col("group").isNotNull()
    broken, whole = F.coalesce(~F.col("continuous"), F.lit(False)), F.coalesce("continuous", F.lit(False))
    # conditions, weights and names of the rules. Fixed values.
    rules = [
        (F.col("n") == 1, 2, "ISOLATED_MEASUREMENT"),
        (F.col("length") < c.short_length, 2, "VERY_SHORT_DISTANCE"),
        (F.col("max_drop") >= c.large_drop, 2, "LARGE_LOCAL_DROP"),
        (back, 2, "IMMEDIATE_TWO_SIDED_RECOVERY"),
        (F.coalesce(F.col("boundary_jump") >= c.point_jump, F.lit(False)), 1, "LARGE_MINIMUM_POINT_JUMP"),
        (broken, 2, "INCONSISTENT_WORLD_POINT_TRAJECTORY"),
        (F.col("n") >= c.structure_min_samples, -1, "MULTIPLE_MEASUREMENTS"),
        (long_enough, -1, "MEANINGFUL_DISTANCE"),
        (stable & (F.col("n") >= 2), -1, "STABLE_EVENT_HEIGHT"),
        (whole, -2, "CONTINUOUS_STRUCTURE_POINT"),
        (periodic, -4, "PERIODIC_STRUCTURE_GROUP"),
    ]
    score = sum(F.when(cond, w).otherwise(0) for cond, w, _ in rules)
    names = F.array_compact(F.array(*[F.when(cond, F.lit(f"{name}:{w:+d}")) for cond, w, name in rules]))
    structure = (F.col("n") >= c.structure_min_samples) & long_enough & stable & ~broken
    e = e.withColumn("score", score).withColumn("rules", names)
    status = F.when(periodic, PERIODIC).when(structure, STRUCTURE).when(~F.col("sufficient"), REVIEW).when(F.col("score") >= c.high_score, OUTLIER).when(F.col("score") >= c.review_score, REVIEW).otherwise(STRUCTURE)
    return e.withColumn("status", status)


def tasks_for(samples: DataFrame) -> int:
    """Partitions of SAMPLES_A_TASK samples about. All windows of a stage sort a partition at once, so it must not be left to the size of the shuffle."""
    return max(samples.sparkSession.sparkContext.defaultParallelism, samples.count() // SAMPLES_A_TASK + 1)


def analyze(samples: DataFrame, c: AnomalyConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(events, rollup): the scored low events, and by task the raw and effective minimum with counts. The samples with their baselines, and the events, are
    written to the shared folder once; all later steps read them there."""
    parts = tasks_for(samples)
    s = classify_samples(travel_distance(samples.repartition(parts, "task_id"), c))
    marked = stored(local_baselines(s, c).unionByName(s.where("NOT usable"), allowMissingColumns=True), "baselines")
    events = stored(event_features(low_events(marked, c), sides(marked), c, parts), "events")
    scored = stored(score_events(events, periodic_groups(events, c), c), "scored")
    return scored, rollup(marked, scored)


def rollup(s: DataFrame, scored: DataFrame) -> DataFrame:
    """Minima and counts by task; the effective minimum leaves out the samples of high-confidence outliers."""
    gone = scored.where(F.col("status") == OUTLIER).select("task_id", F.explode("samples").alias("sample_index")).withColumn("gone", F.lit(True))
    kinds = scored.groupBy("task_id").agg(F.count("*").alias("events"), F.count(F.when(F.col("status") == OUTLIER, 1)).alias("outliers"), F.count(F.when(F.col("status") == REVIEW, 1)).alias("reviews"))
    base = s.join(gone.hint("merge"), ["task_id", "sample_index"], "left").groupBy("task_id").agg(
        F.min(F.when(F.col("usable"), F.col("height"))).alias("raw_min"), F.min(F.when(F.col("usable") & F.col("gone").isNull(), F.col("height"))).alias("effective_min"),
        F.count(F.when(F.col("usable"), 1)).alias("n_valid"), F.count(F.when(~F.col("usable"), 1)).alias("n_invalid"), F.count(F.when(F.col("reason") == "duplicate_source_frame", 1)).alias("n_duplicate"))
    return base.join(kinds, "task_id", "left").withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("events", "outliers", "reviews")})


def event_pairs(events: DataFrame, most: int = 128) -> DataFrame:
    """(task_id, i, j, period, complete): pairs of a task's events in order. No periodic group is searched in a task of more than most events: it has one row instead, without a pair,
    and complete is false."""
    sized = events.join(events.groupBy("task_id").agg(F.count("*").alias("n")).hint("merge"), "task_id")
    few = sized.where(F.col("n") <= most)
    a, b = few.select("task_id", F.col("event").alias("i"), F.col("centre").alias("ci")), few.select("task_id", F.col("event").alias("j"), F.col("centre").alias("cj"))
    pairs = a.join(b.hint("merge"), "task_id").where("i < j").select("task_id", "i", "j", ((F.col("cj") - F.col("ci")) / (F.col("j") - F.col("i"))).alias("period"), F.lit(True).alias("complete"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in pairs.dtypes if c in ("i", "j", "period")]
    return pairs.unionByName(sized.where(F.col("n") > most).select("task_id").distinct().select("task_id", *none, F.lit(False).alias("complete")))


def analysis_trace(scored: DataFrame, roll: DataFrame) -> DataFrame:
    """One JSON document for each task: its rollup and events."""
    events = scored.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "samples", "start", "end", "min_height", "score", "rules", "status"))).alias("low_events"))
    return roll.join(events, "task_id", "left").select("task_id", F.to_json(F.struct(F.lit(1).alias("version"), "raw_min", "effective_min", "n_valid", "n_invalid", F.col("low_events"))).alias("trace"))
