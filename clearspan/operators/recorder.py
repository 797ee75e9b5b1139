"""The recorder's wide table: one row a tick, joined from streams of their own pace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .history import finite_or_null, mount_adjusted_height
from .temporal import asof_join, exclude_pauses, hold_join

MINUTE = 60_000_000_000


def tick_grid(sessions: DataFrame, period_ns: int) -> DataFrame:
    """(task_id, t, tick): ticks of each session (task_id, start_ns, stop_ns), the first one at its start."""
    ticks = sessions.select("task_id", "start_ns", F.explode(F.sequence("start_ns", "stop_ns", F.lit(period_ns))).alias("t"))
    return ticks.select("task_id", "t", F.expr(f"(t - start_ns) div {period_ns}L").alias("tick"))


def channel_means(rows: DataFrame, sessions: DataFrame, columns: list[str], period_ns: int) -> DataFrame:
    """(task_id, tick, n, means): each row counts toward the next tick at or after it; rows with a part that isn't finite are left out."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & finite_or_null(F.col(c)).isNotNull()
    late = F.col("t") - F.col("start_ns")
    timed = rows.where(whole).join(sessions, "task_id").where((F.col("t") >= F.col("start_ns")) & (F.col("t") <= F.col("stop_ns")))
    tick = F.expr(f"(t - start_ns + {period_ns - 1}L) div {period_ns}L")
    return timed.where(late >= 0).groupBy("task_id", tick.alias("tick")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def record(sessions: DataFrame, source: DataFrame, channels: DataFrame, channel_columns: list[str], pauses: DataFrame, mounts: DataFrame, snapshots: dict[str, tuple[DataFrame, int]], *,
           period_ns: int = 20_000_000, timeout_ns: int = 250_000_000, width_ns: int = MINUTE) -> DataFrame:
    """The wide table of all sessions.

    Ticks in a pause are left out, and so are channel rows in one. The newest source frame by receipt time (task_id, t, seq, height, ok, reason,
    quality) is held: its seq, age and quality are given however old it is, its height only while fresh and valid, else a reason. Each of
    snapshots, by name (stream with task_id, t, seq; age limit), is a struct or null. mounts: (task_id, mount_m).
    """
    grid = exclude_pauses(tick_grid(sessions, period_ns), pauses, width_ns=width_ns, ns="t")
    held = hold_join(grid, source, width_ns)
    age = F.col("t") - F.col("held.t")
    shown = finite_or_null(F.col("held.height"))
    reason = F.when(age.isNull(), "source_unavailable").when(age > timeout_ns, "source_timeout").when(~F.col("held.ok") | shown.isNull(), F.coalesce(F.nullif("held.reason", F.lit("")), F.lit("source_invalid")))
    rows = held.select("task_id", "t", "tick", F.coalesce("held.seq", F.lit(0)).alias("source_sequence"), F.coalesce(age / 1e6, F.lit(0.0)).alias("source_age_ms"), F.col("held.quality").alias("quality"), reason.alias("reason"), reason.isNull().alias("valid"), F.when(reason.isNull(), shown).alias("lidar_to_top"))
    again = W.partitionBy("task_id", "source_sequence").orderBy("t")
    rows = rows.withColumn("repeat_index", F.when(F.col("source_sequence") > 0, F.row_number().over(again).cast("long") - 1).otherwise(0)).withColumn("is_repeated", F.col("repeat_index") > 0)
    if snapshots:
        rows = asof_join(rows, snapshots)
    means = channel_means(exclude_pauses(channels, pauses, width_ns=width_ns, ns="t"), sessions, channel_columns, period_ns)
    # the grid comes from sequences, whose size Spark can't estimate
    rows = rows.join(means.hint("merge"), ["task_id", "tick"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.join(mounts.hint("shuffle_hash"), "task_id", "left").withColumn("height", mount_adjusted_height(F.col("lidar_to_top"), F.col("mount_m")))
