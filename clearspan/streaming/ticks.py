"""Streaming forms of the recorder: ticks, de-duplication, sessions, latest values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, ns: str = "t") -> DataFrame:
    """A TIMESTAMP column for watermarks; the nanoseconds stay as they are."""
    return stream.withColumn("event_time", F.timestamp_micros(F.expr(f"{ns} div 1000L")))


def tick_means(stream: DataFrame, columns: list[str], *, tick: str = "20 milliseconds", late: str = "1 second") -> DataFrame:
    """Means and counts of each task's tick; rows later than the watermark are dropped."""
    return stream.withWatermark("event_time", late).groupBy("task_id", F.window("event_time", tick)).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def sliding_rate(stream: DataFrame, *, window: str = "10 seconds", slide: str = "1 second", late: str = "1 second") -> DataFrame:
    """Messages of each task's sliding window."""
    return stream.withWatermark("event_time", late).groupBy("task_id", F.window("event_time", window, slide)).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, *, gap: str = "30 seconds", late: str = "1 second") -> DataFrame:
    """Recording sessions by gap."""
    return stream.withWatermark("event_time", late).groupBy("task_id", F.session_window("event_time", gap)).agg(F.count("*").alias("n"))


def drop_repeated(stream: DataFrame, *, late: str = "1 second") -> DataFrame:
    """The first row of each source stamp."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["task_id", "t"])


def latest(stream: DataFrame, columns: list[str]) -> DataFrame:
    """The newest values of each task (update mode)."""
    return stream.groupBy("task_id").agg(F.max_by(F.struct("t", *columns), F.col("t")).alias("last")).select("task_id", "last.*")


def until_stop(stream: DataFrame, stop_ns: int) -> DataFrame:
    """Rows recorded no later than the stop request."""
    return stream.where(F.col("t") <= stop_ns)


def record(stream: DataFrame, path: str, checkpoint: str):
    """An append-only table by task; Spark's commit protocol makes each micro-batch appear whole or not at all."""
    return stream.writeStream.format("parquet").partitionBy("task_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_rate(stream: DataFrame, *, window: str = "10 seconds", slide: str = "1 second", late: str = "1 second") -> DataFrame:
    """(task_id, window, n, rate_hz): messages of each sliding window over the time from the first to the last of them (0 for fewer than two)."""
    g = stream.withWatermark("event_time", late).groupBy("task_id", F.window("event_time", window, slide)).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return g.select("task_id", "window", "n", F.when(F.col("b") > F.col("a"), (F.col("n") - 1) * 1e9 / (F.col("b") - F.col("a"))).otherwise(0.0).alias("rate_hz"))


def wait_for_poses(frames: DataFrame, poses: DataFrame, *, wait: str = "50 milliseconds", late: str = "1 second") -> DataFrame:
    """Frames (task_id, frame_id, tail_time) with the time of a pose at or after their tail that came no later than wait beyond it; those without one get it null and reason POSE_TAIL_TIMEOUT
    once the watermark has passed. poses: task_id, pose_time."""
    f, p = frames.withWatermark("tail_time", late).alias("f"), poses.withWatermark("pose_time", late).alias("p")
    on = F.expr(f"f.task_id = p.task_id AND p.pose_time >= f.tail_time AND p.pose_time <= f.tail_time + INTERVAL {wait}")
    j = f.join(p, on, "leftOuter")
    return j.select("f.task_id", "f.frame_id", "f.tail_time", "p.pose_time", F.when(F.col("p.pose_time").isNull(), "POSE_TAIL_TIMEOUT").alias("reason"))


def keep_latest(batch: DataFrame, key: str = "task_id", order: str = "t") -> DataFrame:
    """For foreachBatch: each key's newest row, with dropped false, and all others, with dropped true."""
    newest = F.max(order).over(W.partitionBy(key))
    return batch.withColumn("dropped", F.col(order) < newest)


def rate_limited(stream: DataFrame, *, period_ns: int, rollback_ns: int = 1_000_000_000, timeout: str | None = None) -> DataFrame:
    """(task_id, t, epoch, event): rows that run, a period or more after the last one that ran, in the order of t within a micro-batch; a stamp that falls back by more than rollback_ns clears the state and opens an
    epoch, a smaller fall is refused. With a timeout ('5 minutes', of event time) a task without rows for so long gives one row with event TIMEOUT, and its state is dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema["task_id"].dataType.simpleString()
    wait_ms = int(interval_ms(timeout)) if timeout else 0

    def step(key, batches, state):
        if state.hasTimedOut:
            last, newest, epoch = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "t": [newest], "epoch": [epoch], "event": ["TIMEOUT"]})
            return
        last, newest, epoch = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        out = []
        for t in rows["t"].tolist():
            if newest is not None and newest - t > rollback_ns:
                last, newest, epoch = None, None, epoch + 1
            elif newest is not None and t < newest:
                continue
            newest = t
            if last is None or t - last >= period_ns:
                last = t
                out.append((key[0], t, epoch, "RUN"))
        state.update((last, newest, epoch))
        if timeout:
            state.setTimeoutTimestamp(max(newest // 1_000_000, state.getCurrentWatermarkMs()) + wait_ms)
        yield pd.DataFrame(out, columns=["task_id", "t", "epoch", "event"])

    marked = stream.withWatermark("event_time", "0 seconds") if timeout else stream
    mode = GroupStateTimeout.EventTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return marked.groupBy("task_id").applyInPandasWithState(step, f"task_id {kind}, t long, epoch long, event string", "last long, newest long, epoch long", "append", mode)


def interval_ms(text: str) -> float:
    """Milliseconds of a text such as '250 milliseconds' or '5 minutes'."""
    number, unit = text.split()
    return float(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def recorded(stream: DataFrame, controls: DataFrame) -> DataFrame:
    """Rows of a stream recorded while their session runs: from its start to its stop, outside its pauses. controls: a table with task_id, start_ns, stop_ns (null while it runs) and pauses array<struct<start_ns, end_ns>>, a row for each
    session; a stream is joined with it as it is at each micro-batch."""
    j = stream.join(controls, "task_id").where((F.col("t") >= F.col("start_ns")) & (F.col("stop_ns").isNull() | (F.col("t") <= F.col("stop_ns"))))
    paused = F.exists("pauses", lambda p: (F.col("t") >= p["start_ns"]) & (p["end_ns"].isNull() | (F.col("t") < p["end_ns"])))
    return j.where(~F.coalesce(paused, F.lit(False))).drop("start_ns", "stop_ns", "pauses")
