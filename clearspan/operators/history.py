"""History queries over recorded samples: statistics, windows, extrema-preserving downsampling, series caches.

Samples have task_id, sample_index, ts_ns, height and valid. Every operator aggregates or windows by task, so tasks run
in parallel and nothing orders the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("entry", "exit")


def finite_or_null(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def series_projection(samples: DataFrame) -> DataFrame:
    """The narrow columns of a chart; nanoseconds as whole milliseconds, rounded down."""
    return samples.select("task_id", "sample_index", F.expr("ts_ns div 1000000L").alias("ts_ms"), "height", "valid")


def task_statistics(samples: DataFrame) -> DataFrame:
    """Per task: counts, min/avg/max height, duration and sample rate. A sample counts as valid if it also has a height;
    the height aggregates need the flag alone."""
    flagged = F.when(F.col("valid"), F.col("height"))
    grouped = samples.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count(flagged).alias("valid_samples"),
        F.min(flagged).alias("min_height"), F.avg(flagged).alias("avg_height"), F.max(flagged).alias("max_height"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e6).alias("duration_ms"),
    )
    rate = F.when(F.col("duration_ms") > 0, (F.col("total") - 1) * 1000.0 / F.col("duration_ms"))
    return grouped.withColumn("invalid_samples", F.col("total") - F.col("valid_samples")).withColumn("rate_hz", rate)


def resolve_bound(*candidates: Column, default: float) -> Column:
    """The first bound that is set."""
    return F.coalesce(*candidates, F.lit(default))


def normal_height_statistics(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """Counts of valid heights in, below and above each task's [lo, hi], and the least one within. Bounds that are not
    0 <= lo <= hi <= 20 give no row."""
    usable = bounds.where("lo >= 0 AND lo <= hi AND hi <= 20")
    h = F.when(F.col("valid"), F.col("height"))
    inside = (h >= F.col("lo")) & (h <= F.col("hi"))
    return samples.join(usable, "task_id").groupBy("task_id").agg(
        F.count(F.when(inside, 1)).alias("within"), F.count(F.when(h < F.col("lo"), 1)).alias("below"),
        F.count(F.when(h > F.col("hi"), 1)).alias("above"), F.min(F.when(inside, h)).alias("min_within"))


def sample_bounds(samples: DataFrame) -> DataFrame:
    """First and last sample of each task."""
    return samples.groupBy("task_id").agg(
        F.min("sample_index").alias("first_index"), F.max("sample_index").alias("last_index"),
        F.expr("min_by(ts_ns, sample_index) div 1000000L").alias("first_ms"),
        F.expr("max_by(ts_ns, sample_index) div 1000000L").alias("last_ms"))


def task_summary(samples: DataFrame, endpoints: DataFrame, pauses: DataFrame) -> DataFrame:
    """Statistics, bounds, the entry and exit endpoints side by side, and the number of pauses."""
    ends = endpoints.groupBy("task_id").pivot("role", list(ROLES)).agg(F.first("fix_id"))
    ends = ends.select("task_id", *[F.col(r).alias(f"{r}_fix") for r in ROLES])
    paused = pauses.groupBy("task_id").agg(F.count("*").alias("pauses"))
    joined = task_statistics(samples).join(sample_bounds(samples), "task_id").join(ends, "task_id", "left").join(paused, "task_id", "left")
    return joined.withColumn("pauses", F.coalesce("pauses", F.lit(0)).cast("long"))


def series_window(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Samples of a closed window; its end covers the whole millisecond."""
    if start_ms > end_ms:
        raise ValueError("the window ends before it starts")
    return samples.where(F.col("ts_ns").between(start_ms * 1_000_000, end_ms * 1_000_000 + 999_999))


def series_prefix(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples of each task (a window limit, so no more than n rows of a task are kept by any sort)."""
    ranked = samples.withColumn("__n", F.row_number().over(W.partitionBy("task_id").orderBy("sample_index")))
    return ranked.where(F.col("__n") <= n).drop("__n")


def full_history(samples: DataFrame, cap: int = 500_000) -> DataFrame:
    """All samples of tasks that have cap samples at most, with over_cap false; a larger task gives one row with over_cap set and nothing
    else, for the caller to refuse."""
    sizes = samples.groupBy("task_id").agg((F.count("*") > cap).alias("over_cap"))
    kept = samples.join(sizes.where("NOT over_cap"), "task_id")
    return kept.unionByName(sizes.where("over_cap"), allowMissingColumns=True)


def downsample_extrema(samples: DataFrame, max_points: int, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Each task's samples of a window (all by default, clipped to the task's own time): all of them if they are max_points or
    fewer, else those that keep its extremes: of each time bucket the lowest, the highest and the first sample that is invalid or has
    no height, and the window's first and last. Ties go to the smaller sample_index."""
    if max_points < 5:
        raise ValueError("max_points is 5 at least")
    buckets = max(1, (max_points - 2) // 3)
    low = F.lit(-(2**62) if start_ms is None else start_ms * 1_000_000)
    high = F.lit(2**62 if end_ms is None else end_ms * 1_000_000 + 999_999)
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("the window ends before it starts")
    # the window covers whole milliseconds at both ends
    spans = samples.groupBy("task_id").agg(
        F.greatest(F.expr("min(ts_ns) div 1000000L") * 1_000_000, low).alias("__start"), F.least(F.expr("max(ts_ns) div 1000000L") * 1_000_000 + 999_999, high).alias("__end"),
        F.count(F.when(F.col("ts_ns").between(low, high), 1)).alias("__size"))
    own = samples.select("task_id", "sample_index", "ts_ns", "height", "valid").where(F.col("ts_ns").between(low, high)).join(spans, "task_id")
    row = F.struct("sample_index", "ts_ns", "height", "valid")
    bucket = F.least(F.lit(buckets - 1), F.expr(f"((ts_ns - __start) * {buckets}L) div (__end - __start + 1)"))
    shown = F.col("valid") & F.col("height").isNotNull()
    ends = F.struct("ts_ns", "sample_index")
    picked = own.where(F.col("__size") > max_points).groupBy("task_id", bucket.alias("__bucket")).agg(
        F.min_by(row, F.when(shown, F.struct("height", "sample_index"))).alias("lo"), F.min_by(row, F.when(shown, F.struct((-F.col("height")).alias("h"), "sample_index"))).alias("hi"),
        F.min_by(row, F.when(~F.coalesce(shown, F.lit(False)), F.col("sample_index"))).alias("bad"), F.min_by(row, ends).alias("first"), F.max_by(row, ends).alias("last"))
    whole_window = W.partitionBy("task_id")
    edge = picked.withColumn("__a", F.min("__bucket").over(whole_window)).withColumn("__z", F.max("__bucket").over(whole_window))
    rows = F.array("lo", "hi", "bad", F.when(F.col("__bucket") == F.col("__a"), F.col("first")), F.when(F.col("__bucket") == F.col("__z"), F.col("last")))
    chosen = edge.select("task_id", F.explode(F.array_distinct(F.filter(rows, lambda r: r.isNotNull()))).alias("r")).select("task_id", "r.*")
    return chosen.unionByName(own.where(F.col("__size") <= max_points).drop("__start", "__end", "__size"))


def interval_coverage(ranges: DataFrame, *, start: int, end: int, target_ms: float) -> DataFrame:
    """How far each task's cached ranges cover [start, end] without a gap: covered_to, and whether it reaches end. Usable
    ranges have full resolution (0) or at most 1.05 of the target; neighbours may leave a gap of one millisecond."""
    usable = ranges.where((F.col("resolution_ms") == 0) | (F.col("resolution_ms") <= 1.05 * target_ms)).where((F.col("end_ms") >= start) & (F.col("start_ms") <= end))
    clipped = usable.select("task_id", F.greatest("start_ms", F.lit(start)).alias("a"), F.least("end_ms", F.lit(end)).alias("b"))
    order = W.partitionBy("task_id").orderBy("a", "b")
    before = F.coalesce(F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(start - 1))
    gaps = clipped.withColumn("gap", (F.col("a") > before + 1).cast("int")).withColumn("broken", F.sum("gap").over(order))
    done = gaps.groupBy("task_id").agg(F.max(F.when(F.col("broken") == 0, F.col("b"))).alias("covered_to"))
    return done.withColumn("complete", F.coalesce(F.col("covered_to") >= end, F.lit(False)))


def merge_series(*series: DataFrame) -> DataFrame:
    """Upsert by (task_id, sample_index): later series win."""
    marked = [s.withColumn("__arrival", F.lit(i)) for i, s in enumerate(series)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    latest = W.partitionBy("task_id", "sample_index").orderBy(F.desc("__arrival"))
    return every.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__arrival")


def chart_y_range(samples: DataFrame, pad: float = 0.12, min_span: float = 0.1) -> DataFrame:
    """Axis limits of each task's finite heights: padded, not below 0, and never closer than min_span. Tasks without a finite height
    have no limits and no row."""
    h = finite_or_null(F.col("height"))
    limits = samples.groupBy("task_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo IS NOT NULL")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(min_span))
    low = F.greatest(F.col("lo") - span * pad, F.lit(0.0))
    return limits.select("task_id", low.alias("y_min"), F.greatest(low + min_span, F.col("hi") + span * pad).alias("y_max"))


def last_n(samples: DataFrame, n: int = 120) -> DataFrame:
    """The live window: the newest n samples of each task, one for each source frame."""
    newest = W.partitionBy("task_id", "source_sequence").orderBy(F.desc("sample_index"))
    single = samples.withColumn("__d", F.row_number().over(newest)).where("__d = 1").drop("__d")
    ranked = single.withColumn("__n", F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("sample_index"))))
    return ranked.where(F.col("__n") <= n).drop("__n")


def trim_history(samples: DataFrame, seconds: float, rows: int) -> DataFrame:
    """What a buffer of so many seconds and rows holds at each task's end."""
    order = W.partitionBy("task_id").orderBy(F.desc("ts_ns"), F.desc("sample_index"))
    newest = F.max("ts_ns").over(W.partitionBy("task_id"))
    ranked = samples.withColumn("__age", newest - F.col("ts_ns")).withColumn("__n", F.row_number().over(order))
    return ranked.where((F.col("__age") <= int(seconds * 1e9)) & (F.col("__n") <= rows)).drop("__age", "__n")


def stream_health(stream: DataFrame, *, last: int = 100, now_ns: int, timeout_s: float, expected: DataFrame | None = None, grace_s: float = 0.0) -> DataFrame:
    """Rate over the newest messages (0 for fewer than two), age in whole milliseconds and state of each task's stream. expected: (task_id,
    started_ns) of streams that ought to be there; one without a message has age -1 and waits for grace_s, then it timed out."""
    order = W.partitionBy("task_id").orderBy(F.desc("ts_ns"), F.desc("sample_index"))
    recent = stream.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= last)
    agg = recent.groupBy("task_id").agg(F.count("*").alias("n"), F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    agg = agg.withColumn("started_ns", F.lit(None).cast("long")) if expected is None else expected.select("task_id", "started_ns").join(agg, "task_id", "full")
    age = F.expr(f"({now_ns}L - b) div 1000000L")
    waited = F.expr(f"({now_ns}L - started_ns) div 1000000L")
    rate = F.when((F.col("n") > 1) & (F.col("b") > F.col("a")), (F.col("n") - 1) * 1e9 / (F.col("b") - F.col("a"))).otherwise(0.0)
    state = F.when(F.col("n").isNull(), F.when(waited <= int(grace_s * 1000), "waiting").otherwise("timeout")).when(age <= int(timeout_s * 1000), "ok").otherwise("timeout")
    return agg.select("task_id", rate.alias("rate_hz"), F.coalesce(age, F.lit(-1)).alias("age_ms"), state.alias("state"))


def mount_adjusted_height(lidar_to_top: Column, mount: Column) -> Column:
    """Height above the road: the measured distance and the height at which the sensor is mounted; null if either is."""
    return lidar_to_top + mount
