"""Task catalogue queries, identifiers, idempotent requests and report eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_batches(tasks: DataFrame, batches: DataFrame, parameters: DataFrame) -> DataFrame:
    """tasks with their batch (required) and parameters (optional)."""
    return tasks.join(batches, "batch_id").join(parameters, "task_id", "left")


def list_tasks(tasks: DataFrame, *, status: str | None = None, include_deleted: bool = False, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of tasks by creation time, then id."""
    rows = tasks if include_deleted else tasks.where(~F.col("deleted"))
    rows = rows.where(F.col("status") == status) if status else rows
    order = [F.desc("created_at"), F.desc("task_id")] if descending else [F.asc("created_at"), F.asc("task_id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def lookup_all(requested: DataFrame, tasks: DataFrame, blocked: tuple[str, ...] = ("running",)) -> DataFrame:
    """requested (position, task_id) with what became of each: found, blocked or missing."""
    j = requested.join(tasks.select("task_id", "status", F.lit(True).alias("there")), "task_id", "left")
    return j.select("position", "task_id", F.when(F.col("there").isNull(), "missing").when(F.col("status").isin(*blocked), "blocked").otherwise("found").alias("outcome"))


def idempotent_requests(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (key, hash) against stored responses: reuse, conflict or new."""
    j = requests.join(stored.select("key", F.col("hash").alias("known"), "response"), "key", "left")
    return j.select("key", F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("hash"), "reuse").otherwise("conflict").alias("outcome"), F.when(F.col("known") == F.col("hash"), F.col("response")).alias("response"))


def batch_rollup(tasks: DataFrame) -> DataFrame:
    """Visible tasks, their bytes and the unfinished ones of each batch."""
    seen = ~F.col("deleted")
    return tasks.groupBy("batch_id").agg(F.count(F.when(seen, 1)).alias("visible"), F.round(F.sum(F.when(seen, F.col("size_bytes")).otherwise(0.0)), 2).alias("bytes"), F.count(F.when(seen & (F.col("status") != "completed"), 1)).alias("unfinished"))


def display_ids(rows: DataFrame, base: str = "base", order: str = "task_id") -> DataFrame:
    """display_id: the base, with _02, _03, ... from its second row on."""
    n = F.row_number().over(W.partitionBy(base).orderBy(order))
    return rows.withColumn("__n", n).withColumn("display_id", F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.when(F.col("__n") < 100, F.lpad(F.col("__n").cast("string"), 2, "0")).otherwise(F.col("__n").cast("string"))))).drop("__n")


def assign_sequences(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """batch_sequence and day_sequence after the largest existing ones, and the batch code of the day."""
    known = existing.groupBy("batch_id").agg(F.max("batch_sequence").alias("__b"))
    days = existing.groupBy("day").agg(F.max("day_sequence").alias("__d"))
    j = rows.join(known, "batch_id", "left").join(days, "day", "left")
    j = j.withColumn("batch_sequence", F.coalesce("__b", F.lit(0)) + F.row_number().over(W.partitionBy("batch_id").orderBy("task_id")))
    j = j.withColumn("day_sequence", F.coalesce("__d", F.lit(0)) + F.row_number().over(W.partitionBy("day").orderBy("task_id")))
    return j.withColumn("code", F.format_string("%s-%02d", F.regexp_replace("day", "-", ""), F.col("day_sequence"))).drop("__b", "__d")


def latest_batch(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(1)


def preview_order(requested: DataFrame, tasks: DataFrame) -> DataFrame:
    """The distinct requested tasks by global sequence, then display id."""
    first = requested.groupBy("task_id").agg(F.min("position").alias("position"))
    return first.join(tasks, "task_id").orderBy("sequence", "display_id")


def export_eligibility(tasks: DataFrame) -> DataFrame:
    """The first reason that keeps a task out of a report, or null. tasks: status, origin, complete, n_valid, effective_min."""
    reason = (F.when(F.col("n_valid").isNull(), "no_data").when(F.col("status") != "completed", "status").when(F.col("origin") == "test_fixture", "fixture").when(~F.col("complete"), "incomplete").when(F.col("n_valid") == 0, "no_valid_samples").when(F.col("effective_min").isNull(), "no_effective_minimum"))
    return tasks.withColumn("blocked_by", reason)


def task_timeline(events: DataFrame, deadlines_s: dict[str, float], now_us: int) -> tuple[DataFrame, DataFrame]:
    """(phases, latest): each phase with its length, and each task's latest phase with whether it is overdue. events: task_id, us,
    event_id, phase."""
    order = W.partitionBy("task_id").orderBy("us", "event_id")
    phases = events.withColumn("before", F.lag("phase").over(order)).withColumn("length_us", F.lead("us").over(order) - F.col("us"))
    last = events.groupBy("task_id").agg(F.max_by(F.struct("phase", "us"), F.struct("us", "event_id")).alias("l")).select("task_id", "l.*")
    limit = F.coalesce(*[F.when(F.col("phase") == p, F.lit(float(s))) for p, s in deadlines_s.items()])
    return phases, last.withColumn("overdue", F.coalesce((F.lit(now_us) - F.col("us")) / 1e6 > limit, F.lit(False)))


def recording_counters(samples: DataFrame, stops: DataFrame) -> DataFrame:
    """Counts of the rows no later than each task's stop request (all, where there is none)."""
    kept = samples.join(stops, "task_id", "left").where(F.col("stop_ns").isNull() | (F.col("ts_ns") <= F.col("stop_ns")))
    return kept.groupBy("task_id").agg(F.count("*").alias("rows"), F.count(F.when(F.col("valid"), 1)).alias("valid_rows"))


def processing_diagnostics(frames: DataFrame) -> DataFrame:
    """Received, processed and dropped frames by reason, with last, mean and greatest waits. frames: task_id, frame_id, reason, wait_ms."""
    return frames.groupBy("task_id", F.coalesce("reason", F.lit("processed")).alias("reason")).agg(F.count("*").alias("n"), F.max_by("wait_ms", "frame_id").alias("last_wait"), F.avg("wait_ms").alias("mean_wait"), F.max("wait_ms").alias("max_wait"))


def device_levels(metrics: DataFrame) -> DataFrame:
    """Level of each metric row (metric, value): warnings from 80 C, 85 % memory, 90 % CPU; storage free in GiB: error to 5, warning to 20."""
    m, v = F.col("metric"), F.col("value")
    warn = ((m == "temperature") & (v >= 80)) | ((m == "memory") & (v >= 85)) | ((m == "cpu") & (v >= 90)) | ((m == "storage_free_gib") & (v <= 20))
    return metrics.withColumn("level", F.when((m == "storage_free_gib") & (v <= 5), "error").when(warn, "warning").otherwise("ok"))


def counter_delta_percent(rows: DataFrame) -> DataFrame:
    """Busy share between a host's neighbouring readings of (total, idle)."""
    order = W.partitionBy("task_id").orderBy("seq")
    dt, di = F.col("total") - F.lag("total").over(order), F.col("idle") - F.lag("idle").over(order)
    return rows.withColumn("__t", dt).withColumn("__i", di).withColumn("busy_percent", F.when(F.col("__t") > 0, 100.0 * (F.col("__t") - F.col("__i")) / F.col("__t"))).drop("__t", "__i")


def track_segments(rows: DataFrame) -> DataFrame:
    """Polylines of a track: rows that repeat a place are dropped, a change of source starts a new line that shares the vertex before."""
    order = W.partitionBy("task_id").orderBy("t", "seq")
    moved = rows.withColumn("__p", F.lag(F.struct("x", "y")).over(order)).where(F.col("__p").isNull() | (F.col("__p.x") != F.col("x")) | (F.col("__p.y") != F.col("y")))
    fresh = F.coalesce(F.col("source") != F.lag("source").over(order), F.lit(True))
    lines = moved.withColumn("__new", fresh.cast("long")).withColumn("line", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__before", F.struct(F.lag("x").over(order).alias("x"), F.lag("y").over(order).alias("y"), F.lit(True).alias("ok")))
    grouped = lines.groupBy("task_id", "line").agg(F.first("source").alias("source"), F.min_by("__before", F.struct("t", "seq")).alias("b"), F.sort_array(F.collect_list(F.struct("t", "seq", "x", "y"))).alias("v"))
    shared = F.when(F.col("b.x").isNotNull(), F.array(F.struct(F.col("b.x").alias("x"), F.col("b.y").alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return grouped.select("task_id", "line", "source", F.concat(shared, F.transform("v", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))).alias("vertices"))


def overdue_transitions(tasks: DataFrame, now_us: int) -> DataFrame:
    """Active tasks that aren't deleted and whose deadline has passed."""
    return tasks.where(F.col("active") & ~F.col("deleted") & (F.col("deadline_us") < now_us))


def replay_summary(results: DataFrame) -> DataFrame:
    """Per replay of results (task_id, seq, ok, planes, height, processing_ms, reason): frames, valid and invalid ones, planes (last, mean, most), heights of valid frames (last, least, mean, greatest), and the last
    processing time, reason and validity. A frame is valid if it is marked so and has a finite height."""
    h = F.col("height")
    good = F.coalesce(F.col("ok") & ~F.isnan(h) & (F.abs(h) < float("inf")), F.lit(False))
    shown, planes = F.when(good, h), F.greatest(F.col("planes"), F.lit(0))
    return results.groupBy("task_id").agg(
        F.count("*").alias("frames"), F.count(F.when(good, 1)).alias("valid_frames"), F.count(F.when(~good, 1)).alias("invalid_frames"), F.max_by(planes, "seq").alias("planes_last"), F.avg(planes).alias("planes_mean"), F.max(planes).alias("planes_max"),
        F.max_by(shown, F.when(good, F.col("seq"))).alias("height_last"), F.min(shown).alias("height_min"), F.avg(shown).alias("height_mean"), F.max(shown).alias("height_max"), F.max_by("processing_ms", "seq").alias("processing_last"), F.max_by("reason", "seq").alias("reason_last"), F.max_by(good, "seq").alias("valid_last"))


#: Topics without which a recording can't be replayed. Fixed values.
REPLAY_TOPICS = ("/capture/lidar/points_raw", "/capture/odometry/high_rate_raw")


def list_recordings(manifests: DataFrame, files: DataFrame, pattern: str = "^[0-9]{8}_[0-9]{6}$") -> DataFrame:
    """Recordings with a usable id, newest first: profile, bytes, duration and replay_ready (both raw topics recorded). manifests: recording_id, profile, topics, duration_seconds; files: recording_id, length, modified_us."""
    sizes = files.groupBy("recording_id").agg(F.sum("length").alias("bytes"), F.max("modified_us").alias("modified_us"))
    ready = F.lit(True)
    for t in REPLAY_TOPICS:
        ready = ready & F.coalesce(F.array_contains("topics", t), F.lit(False))
    j = sizes.where(F.col("recording_id").rlike(pattern)).join(manifests, "recording_id", "left")
    return j.select("recording_id", "profile", "bytes", "modified_us", "duration_seconds", ready.alias("replay_ready")).orderBy(F.desc("modified_us"), "recording_id")
