from pyspark.sql import functions as F

from clearspan.sources import detail_text, measurements
from clearspan.streaming import ticks


def test_schema_tolerance_and_checks(spark):
    old = spark.createDataFrame([("t1", 0, 5.2)], "task_id string, sample_index long, clearance_height_m double")
    row = measurements.conform_schema(old).first()
    assert row.clearance_height_m == 5.2 and row.repeat_index is None
    meta = spark.createDataFrame([("t1", 12, "recorded", "left"), ("t2", 13, "recorded", "left"), ("t3", 1, "recorded", "left"), ("t1", 1, "made_up", "left")], "task_id string, schema_version int, data_origin string, lane string")
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    assert sorted(tuple(r) for r in measurements.validate_recordings(meta, tasks).collect()) == [("t1", "data_origin"), ("t2", "schema_version"), ("t3", "task_id")]


def test_detail_round_trip(spark, tmp_path):
    rows = [(1, 0, 5.2), (1, 1, None), (1, 2, float("nan"))]
    s = spark.createDataFrame(rows, "task_id long, sample_index long, height double")
    lines = [r.value for r in detail_text.detail_lines(s, {"sample_index": None, "height": 3}).orderBy("sample_index").collect()]
    assert lines[:2] == ["0    5.200", "1    0"]
    path = tmp_path / "detail.txt"
    path.write_bytes("﻿title\r\nindex    height\r\n0    5.200\r\n1    0\r\nodd\r\n2    nan\r\n".encode())
    got = {r["index"]: (r.height, r.valid) for r in detail_text.read_detail(spark, str(path), ("index", "height")).collect()}
    assert got == {0: (5.2, True), 1: (0.0, False), 2: (None, False)}


def test_storage_and_topics(spark, tmp_path):
    spark.range(10).withColumn("task_id", F.col("id") % 2).write.partitionBy("task_id").parquet(str(tmp_path / "s"))
    assert {r.task_id for r in measurements.storage_usage(spark, str(tmp_path / "s")).where("bytes > 0").collect() if r.task_id} == {"0", "1"}
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    assert measurements.select_topics(m, {"raw": ["a"], "result": ["b"]}, "full").count() == 2


def test_streams_equal_batch(spark, tmp_path):
    base = 1_700_000_000_000_000_000
    rows = [(1, base + i * 10_000_000, float(i)) for i in range(100)] + [(1, base, 0.0)]
    spark.createDataFrame(rows, "task_id long, t long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ticks.with_event_time(spark.readStream.schema("task_id long, t long, v double").parquet(str(tmp_path / "in")))
    ticks.record(ticks.drop_repeated(stream), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    q = ticks.tick_means(stream, ["v"]).writeStream.format("memory").queryName("tick_means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("tick_means").orderBy("window").collect()
    assert len(got) == 50 and got[0].n == 3 and got[1].v == 2.5
    q = ticks.latest(stream, ["v"]).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("latest").first().v == 99.0
