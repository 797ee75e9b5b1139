"""The driver's tables in the shape of recordings: the same mapping as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded samples, a task for each user: 0.5 m of travel a sample, the point of a sample below its height."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        e.select("user_id", "event_id", "event_type", "value", "ts")
        .withColumn("sample_index", F.row_number().over(order).cast("long") - 1)
        .select(
            F.col("user_id").alias("task_id"), "sample_index",
            (micros() * 1000).alias("ts_ns"),
            (F.col("value") / 50).alias("height"),
            (F.col("event_type") != "error").alias("valid"),
            F.col("event_id").alias("source_sequence"),
            (F.col("sample_index") * 0.5).alias("odo_x"), F.lit(0.0).alias("odo_y"), F.lit(0.0).alias("odo_z"),
            (F.pmod("event_id", F.lit(7)) * 0.25).alias("point_x"), F.lit(10.0).alias("point_y"), (F.col("value") / 50 - 2.25).alias("point_z"),
        )
    )


SAMPLES = """samples AS (
  SELECT user_id AS task_id, sample_index, epoch_us(ts) * 1000 AS ts_ns, value / 50 AS height, event_type <> 'error' AS valid,
    event_id AS source_sequence, sample_index * 0.5 AS odo_x, 0.0::DOUBLE AS odo_y, 0.0::DOUBLE AS odo_z,
    (event_id % 7) * 0.25::DOUBLE AS point_x, 10.0::DOUBLE AS point_y, value / 50 - 2.25 AS point_z
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index FROM events))"""


def stream_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One event type as a stream (task_id, t, seq, v); t in ns."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("task_id"), (micros() * 1000).alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("v"))


def stream_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id AS task_id, epoch_us(ts) * 1000 AS t, event_id AS seq, value AS v FROM events WHERE event_type = '{kind}')"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point rows, a frame for each label: x, y, z and the time offset are the first components, scaled to metres."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_idx"), (at(1) * 10).alias("x"), (at(2) * 10).alias("y"), (at(3) * 10 + 5).alias("z"), F.abs(at(4)).alias("offset_s"))


POINTS = """points AS (
  SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_idx, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y,
    CAST(embedding[3] AS DOUBLE) * 10 + 5 AS z, abs(CAST(embedding[4] AS DOUBLE)) AS offset_s FROM embeddings)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GNSS fixes from suppliers: places spread over a degree, by arithmetic on the key."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("fix_id"), F.col("s_nationkey").cast("long").alias("task_id"), (30 + F.pmod(k * 7919, F.lit(10007)) / 10007.0).alias("lat"), (114 + F.pmod(k * 104729, F.lit(10009)) / 10009.0).alias("lon"), (F.col("s_acctbal") / 100).alias("alt"))


FIXES = """fixes AS (
  SELECT s_suppkey AS fix_id, CAST(s_nationkey AS BIGINT) AS task_id, 30 + ((s_suppkey * 7919) % 10007) / 10007.0::DOUBLE AS lat,
    114 + ((s_suppkey * 104729) % 10009) / 10009.0::DOUBLE AS lon, s_acctbal / 100 AS alt FROM supplier)"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of local and global places by supplier: the global ones are turned by 30 degrees, scaled by 1.01 and shifted."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    c, s = F.cos(F.radians(F.lit(30.0))) * 1.01, F.sin(F.radians(F.lit(30.0))) * 1.01
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("stamp_ns"), F.col("l_linenumber").alias("line"), x.alias("x"), y.alias("y"), (x * c - y * s + 100).alias("east"), (x * s + y * c - 50).alias("north"))


TRAJECTORY = """trajectory AS (
  SELECT l_suppkey AS task_id, l_orderkey AS stamp_ns, l_linenumber AS line, l_quantity AS x, l_extendedprice / 1000 AS y,
    l_quantity * cos(radians(30.0)) * 1.01 - l_extendedprice / 1000 * (sin(radians(30.0)) * 1.01) + 100 AS east,
    l_quantity * (sin(radians(30.0)) * 1.01) + l_extendedprice / 1000 * (cos(radians(30.0)) * 1.01) - 50 AS north FROM lineitem)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from orders: their status, batch and creation time."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("batch_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size_bytes"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))


TASKS = """tasks AS (
  SELECT o_orderkey AS task_id, o_custkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
    o_orderdate AS created_at, o_totalprice AS size_bytes, o_orderpriority = '5-LOW' AS deleted FROM orders)"""
