"""Recorded samples as tables: reading, schema tolerance, integrity checks, size on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the sample table in the order of its newest version, after task_id. Fixed values. Older files lack some of them.
_COLUMNS = """
    sample_index long, source_timestamp_ns long, recorded_timestamp_ns long, elapsed_ms double, lidar_to_top_m double, clearance_height_m double, valid int, invalid_reason string, quality_score double,
    source_sequence long, source_age_ms double, is_repeated int, repeat_index long,
    rtk_timestamp_ns long, rtk_latitude_deg double, rtk_longitude_deg double, rtk_altitude_m double, rtk_fix_type string, rtk_valid int, rtk_satellite_count int, rtk_hdop double, rtk_pdop double, rtk_speed_knots double, rtk_track_degrees double,
    gyro_x_rad_s double, gyro_y_rad_s double, gyro_z_rad_s double, accel_x_m_s2 double, accel_y_m_s2 double, accel_z_m_s2 double, imu_sample_count long, radar_temperature_c double,
    minimum_point_x_m double, minimum_point_y_m double, minimum_point_z_m double, vehicle_pitch_deg double, vehicle_roll_deg double, vehicle_heading_deg double,
    odin_position_x_m double, odin_position_y_m double, odin_position_z_m double, odin_qx double, odin_qy double, odin_qz double, odin_qw double"""
_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
SAMPLES = T.StructType([T.StructField("task_id", T.StringType()), *[T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in _COLUMNS.split(","))]])
VERSIONS = range(1, 13)


def read_measurements(spark: SparkSession, root: str) -> DataFrame:
    """Sample tables under root, partitioned by task_id, in the canonical schema; task filters prune folders."""
    return conform_schema(spark.read.option("mergeSchema", "true").parquet(root))


def conform_schema(df: DataFrame) -> DataFrame:
    """The canonical columns in order and type; those that a file lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLES])


def conform_metadata(meta: DataFrame) -> DataFrame:
    """lane_side falls back to lane, travel_direction to 'unknown'."""
    side = F.coalesce("lane_side", "lane") if "lane_side" in meta.columns else F.col("lane")
    direction = F.coalesce("travel_direction", F.lit("unknown")) if "travel_direction" in meta.columns else F.lit("unknown")
    return meta.withColumn("lane_side", side).withColumn("travel_direction", direction)


def validate_recordings(meta: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, violation): recordings whose version, task, origin, lane or direction is not one that readers know."""
    m = conform_metadata(meta).join(tasks.select("task_id", F.lit(True).alias("__known")).distinct(), "task_id", "left")
    violation = (
        F.when(~F.col("schema_version").isin(*VERSIONS), "schema_version").when(F.col("__known").isNull(), "task_id").when(~F.col("data_origin").isin("recorded", "test_fixture"), "data_origin")
        .when(~F.col("lane").isin("left", "right", "unknown"), "lane").when(~F.col("travel_direction").isin("up", "down", "unknown"), "travel_direction"))
    return m.withColumn("violation", violation).where(F.col("violation").isNotNull()).select("task_id", "violation")


def broken_samples(samples: DataFrame) -> DataFrame:
    """(task_id, sample_index, violation): rows that the table's own rules refuse."""
    c = F.col
    missing = [F.when(c(n).isNull(), f"{n} is missing") for n in ("sample_index", "source_timestamp_ns", "recorded_timestamp_ns", "elapsed_ms", "valid")]
    flags = [F.when(~c(n).isin(0, 1), f"{n} is no flag") for n in ("valid", "is_repeated", "rtk_valid")]
    low = [F.when(c(n) < 0, f"{n} is negative") for n in ("sample_index", "elapsed_ms", "imu_sample_count")]
    return samples.withColumn("violation", F.coalesce(*missing, *flags, *low)).where("violation IS NOT NULL").select("task_id", "sample_index", "violation")


def broken_pauses(pauses: DataFrame) -> DataFrame:
    """Pauses (task_id, started_elapsed_ms, ended_elapsed_ms) that start before 0 or end before they start."""
    return pauses.where((F.col("started_elapsed_ms") < 0) | (F.col("ended_elapsed_ms") < F.col("started_elapsed_ms")))


def recover_orphans(meta: DataFrame, samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Recordings that were never closed (complete = 0, no ended_at), as they are closed after the fact: counts from their tables, the last sample's time as their end, complete 0, and the exit unconfirmed unless it was
    confirmed before. meta: task_id, complete, ended_at, exit_status; samples: task_id, recorded_timestamp_ns, valid; frames: task_id."""
    counts = samples.groupBy("task_id").agg(F.count("*").alias("n_samples"), F.count(F.when(F.col("valid") == 1, 1)).alias("n_valid"), F.max("recorded_timestamp_ns").alias("last_ns"))
    sources = frames.groupBy("task_id").agg(F.count("*").alias("n_frames"))
    open_ = meta.where((F.col("complete") == 0) & F.col("ended_at").isNull())
    j = open_.join(counts, "task_id", "left").join(sources, "task_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return j.select("task_id", F.lit(0).alias("complete"), F.when(F.col("exit_status") == "confirmed", "confirmed").otherwise("unconfirmed").alias("exit_status"), F.col("last_ns").alias("ended_ns"), zero("n_samples"), zero("n_valid"), zero("n_frames"))


def storage_usage(spark: SparkSession, pattern: str) -> DataFrame:
    """(task_id, bytes) of the files under .../task_id=<id>/..., from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "length")
    return files.withColumn("task_id", F.regexp_extract("path", r"task_id=([^/]+)/", 1)).groupBy("task_id").agg(F.sum("length").alias("bytes"))


def select_topics(messages: DataFrame, profiles: dict[str, list[str]], name: str) -> DataFrame:
    """Messages of a profile's topics; 'full' is every topic of all profiles."""
    wanted = sorted({t for p in profiles.values() for t in p}) if name == "full" else profiles[name]
    return messages.where(F.col("topic").isin(*wanted))
