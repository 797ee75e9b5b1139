"""Streams with state, raw inputs, and operators without SQL against plain Python."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearspan.operators import cloud, navigation, surface, temporal
from clearspan.sources import clouds, detail_text
from clearspan.streaming import ticks

FRAME = "frame_id long, width int, height int, point_step int, row_step int, is_bigendian boolean, fields array<struct<name:string,offset:int,datatype:int>>, data binary"


def stream(spark, tmp_path, rows, schema):
    """The rows as a stream of one file for each list, in order."""
    where = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
    return ticks.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where))


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


S = 1_000_000_000


def test_rate_and_sessions(spark, tmp_path):
    rows = [[(1, k * S // 2) for k in range(20)] + [(1, 100 * S)], [(1, 500 * S)]]
    s = stream(spark, tmp_path, rows, "task_id long, t long")
    found = {r.window.start.timestamp(): (r.n, r.rate_hz) for r in drained(ticks.message_rate(s, window="10 seconds", slide="10 seconds"), tmp_path, "rate")}
    assert found[0.0] == (20, 2.0) and found[100.0] == (1, 0.0)
    sizes = sorted(r.n for r in drained(ticks.sessions(s, gap="30 seconds"), tmp_path, "sessions"))
    assert sizes[-1] == 20 and 1 in sizes
    assert {r.t for r in drained(ticks.until_stop(s, 5 * S), tmp_path, "stopped")} == {k * S // 2 for k in range(11)}


def test_recorded_between_start_stop_and_pauses(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, k * S) for k in range(20)] + [(2, 5 * S)]], "task_id long, t long")
    controls = spark.createDataFrame([(1, 2 * S, 15 * S, [(4 * S, 6 * S), (14 * S, None)])], "task_id long, start_ns long, stop_ns long, pauses array<struct<start_ns:long,end_ns:long>>")
    assert sorted(r.t // S for r in drained(ticks.recorded(s, controls), tmp_path, "recorded")) == [2, 3, *range(6, 14)]


def test_rate_limit_with_epochs(spark, tmp_path):
    rows = [[(1, t, i) for i, t in enumerate([0, 1, 3, 10, 9])], [(1, t, 10 + i) for i, t in enumerate([11, 100, 2, 6, 8])]]
    s = stream(spark, tmp_path, rows, "task_id long, t long, arrival long")
    out = drained(ticks.rate_limited(s, period_ns=5, rollback_ns=50), tmp_path, "limited")
    assert sorted((r.epoch, r.t) for r in out) == [(0, 0), (0, 10), (0, 100), (1, 2), (1, 8)]


def test_frames_wait_for_poses(spark, tmp_path):
    f = stream(spark, tmp_path, [[(1, 1, 10 * S), (1, 2, 20 * S), (1, 3, 900 * S)]], "task_id long, frame_id long, t long").withColumnRenamed("event_time", "tail_time").drop("t")
    (tmp_path / "p").mkdir()
    p = stream(spark, tmp_path / "p", [[(1, 10 * S + 20_000_000), (1, 20 * S + 80_000_000), (1, 900 * S)]], "task_id long, t long").withColumnRenamed("event_time", "pose_time").drop("t")
    got = {r.frame_id: r.reason for r in drained(ticks.wait_for_poses(f, p), tmp_path, "waited")}
    assert got[1] is None and got[2] == "POSE_TAIL_TIMEOUT"


def test_keep_latest(spark):
    d = ticks.keep_latest(spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "task_id long, t long"))
    assert {(r.task_id, r.t, r.dropped) for r in d.collect()} == {(1, 5, True), (1, 7, False), (2, 1, False)}


def test_point_clouds(spark):
    fields = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("offset_time", 16, 7)]
    data = b"".join(struct.pack("<fffIf", k, k + 0.5, -k, 9, k / 10) for k in range(6)) + b"tail"
    good = (1, 3, 2, 20, 60, False, fields, data)
    bad = [(2, 3, 2, 20, 60, True, fields, data), (3, 3, 2, 20, 60, False, fields[:3], data), (4, 3, 2, 20, 60, False, fields, data[:100]), (5, 3, 2, 0, 60, False, fields, data), (6, 3, 2, 20, 60, False, [*fields[:3], ("offset_time", 16, 8)], data), (7, 3, 2, 20, 60, False, None, None)]
    d = spark.createDataFrame([good, *bad], FRAME)
    assert {r.frame_id: r.error for r in clouds.cloud_errors(d).collect()} == {1: None} | {k: clouds.BAD_LAYOUT for k in range(2, 8)}
    got = [(r.point_idx, r.x, r.y, r.z, round(r.offset_s, 6)) for r in clouds.ingest_point_clouds(d).orderBy("point_idx").collect()]
    assert got == [(k, float(k), k + 0.5, float(-k), k / 10) for k in range(6)]


def test_sentences_and_topics(spark, tmp_path):
    (tmp_path / "s.txt").write_text("$GPGGA,1\r\n\r\n$GPRMC,2\n")
    assert [r.line for r in clouds.read_gnss_sentences(spark, str(tmp_path / "s.txt")).collect()] == ["$GPGGA,1", "$GPRMC,2"]
    (tmp_path / "root" / "imu").mkdir(parents=True)
    (tmp_path / "root" / "imu" / "a.json").write_text('{"task_id":1,"t":5}\n')
    assert [(r.task_id, r.t) for r in drained(clouds.topic_stream(spark, str(tmp_path / "root"), "imu", "task_id long, t long"), tmp_path, "topic")] == [(1, 5)]


def test_detail_text_of_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("title\r\nindex    x    height m\r\n1    9    5.5\r\n2    9    nan\r\n", encoding="utf-8-sig")
    (tmp_path / "b.txt").write_text("height m\tindex\n7.5\t3\nbroken\n")
    got = {(r["index"], r.height, r.valid) for r in detail_text.read_detail(spark, str(tmp_path), ("index", "height m")).collect()}
    assert got == {(1, 5.5, True), (2, None, False), (3, 7.5, True)}


def crown(n=60, half=1.2, dip=0.0):
    axis = np.linspace(-half, half, n)
    return [(1, i, float(x), float(y), float(5 - 0.1 * x * x + 0.02 * x * y - 0.05 * y * y + 0.01 * x - dip)) for i, (x, y) in enumerate((x, y) for x in axis for y in axis)]


def test_quadratic_surface(spark):
    d = spark.createDataFrame(crown(), "frame_id long, point_idx long, x double, y double, z double")
    r = surface.quadratic_fit(d).first()
    assert np.allclose([r.a, r.b, r.c, r.d, r.e, r.f], [-0.1, 0.02, -0.05, 0.01, 0.0, 5.0], atol=1e-8)
    line = spark.createDataFrame([(1, i, float(i), 2.0 * i, 1.0) for i in range(50)], "frame_id long, point_idx long, x double, y double, z double")
    assert surface.quadratic_fit(line).count() == 0
    found, frames = surface.detect_surfaces(d)
    got = found.collect()
    assert [f.reason for f in frames.collect()] == ["NONE"] and len(got) == 1 and got[0].confidence > 0.55
    edge = 5 - 0.1 * 1.44 - 0.02 * 1.44 - 0.05 * 1.44 - 0.012
    assert abs(got[0].height - edge) < 0.05 and got[0].p95 < 0.01
    few = surface.detect_surfaces(d.limit(30))
    assert few[0].count() == 0 and few[1].first().reason == "TOO_FEW_SURFACE_ROI_POINTS"
    assert surface.clearance_results(d).first().reason == "NONE"


def test_adaptive_voxel_keeps_its_bound(spark):
    r = np.random.default_rng(2)
    d = spark.createDataFrame([(f, i, *map(float, r.uniform(0, 3, 3))) for f in (1, 2) for i in range(3000 if f == 1 else 50)], "frame_id long, point_idx long, x double, y double, z double")
    sizes = {x.frame_id: x["count"] for x in surface.adaptive_voxel(d, 0.05, 200).groupBy("frame_id").count().collect()}
    assert sizes[2] == 50 and 0 < sizes[1] <= 200
    one = surface.adaptive_voxel(d, 0.001, 200, tries=1).groupBy("frame_id").count().where("frame_id = 1").first()["count"]
    assert 100 < one <= 200


def test_spatial_limit_in_plain_python(spark):
    r = np.random.default_rng(4)
    rows = [(1, i, *map(float, r.uniform(-2, 2, 3))) for i in range(60)]
    d = spark.createDataFrame(rows, "frame_id long, point_idx long, x double, y double, z double")
    for limit, leaf in ((20, 2.0), (20, 4.0), (100, 2.0), (4, 1.0)):
        reps = {}
        for _, i, *p in rows:
            reps.setdefault(tuple(math.floor(c / leaf) for c in p), i)
        chosen = sorted(reps.values())
        if limit >= 60:
            want = list(range(60))
        elif len(chosen) >= limit:
            want = [chosen[k * len(chosen) // limit] for k in range(limit)]
        else:
            taken, slots = set(chosen), limit - len(chosen)
            for k in range(slots):
                at = k * 60 // slots
                taken.add(next(i for i in [*range(at, 60), *range(60)] if i not in taken))
            want = sorted(taken)
        assert sorted(x.point_idx for x in cloud.spatial_limit(d, limit, leaf).collect()) == want


def test_bundles_and_epochs_of_the_probes(spark):
    d = spark.createDataFrame([(1, 100, 0), (1, 50, 1), (1, -60, 2), (1, 70, 3), (1, 70, 4)], "task_id long, t long, seq long")
    got = [(r.t, r.epoch, r.accepted, r.superseded) for r in temporal.epoch_id(d, 120).orderBy("seq").collect()]
    assert got == [(100, 0, True, False), (50, 0, False, False), (-60, 1, True, False), (70, 1, True, True), (70, 1, True, False)]
    # the second bundle begins before the first one's end and is dropped; the third begins after it, though not after the second one's end
    b = spark.createDataFrame([(1, 100, 0), (1, 100, 1), (1, 100, 2), (1, 115, 3), (1, 115, 4), (1, 115, 5), (1, 125, 6)], "task_id long, t long, seq long")
    assert [r.stamp for r in temporal.expand_bundles(b, 10).orderBy("seq").collect()] == [100, 110, 120, 125]


def test_slerp_between_poses(spark):
    q = lambda deg: (math.cos(math.radians(deg) / 2), 0.0, 0.0, math.sin(math.radians(deg) / 2))
    poses = spark.createDataFrame([(1, 0, 0, 0.0, *q(0), True), (1, 10, 1, 1.0, *q(90), False)], "task_id long, t long, seq long, px double, qw double, qx double, qy double, qz double, ok boolean")
    at = spark.createDataFrame([(1, 5), (1, 0), (1, 11)], "task_id long, t long")
    got = {r.t: (r.found, r.ok, r.qz) for r in temporal.interpolate_join(at, poses, 20, ["px"], quaternion=("qw", "qx", "qy", "qz"), flags=("ok",)).collect()}
    assert got[5][:2] == (True, False) and abs(got[5][2] - q(45)[3]) < 1e-12 and got[0] == (True, True, 0.0) and got[11] == (False, None, None)


def test_confirmation_and_bridge(spark):
    q = lambda deg: (math.cos(math.radians(deg) / 2), 0.0, 0.0, math.sin(math.radians(deg) / 2))
    rows = [(1, k, large, *q(deg)) for k, (large, deg) in enumerate([(True, 20), (True, 24), (True, 26), (True, 60), (True, 62), (False, 1), (True, 60)])]
    out = navigation.confirmation_run(spark.createDataFrame(rows, "task_id long, seq long, large boolean, qw double, qx double, qy double, qz double")).orderBy("seq").collect()
    assert [(r.confirmations, r.accepted) for r in out] == [(1, False), (2, False), (3, True), (1, False), (2, False), (0, True), (1, False)]
    none = (None,) * 4
    rows = [(1, 0, 0, 0.0, 0.0, 1.0, *q(0))] + [(1, k * 62_500_000, k, 0.0, 0.0, 1.0, *none) for k in range(1, 60)]
    out = navigation.gyro_bridge(spark.createDataFrame(rows, "task_id long, t long, seq long, wx double, wy double, wz double, qw double, qx double, qy double, qz double")).orderBy("t").collect()
    assert abs(2 * math.asin(out[16].qz) - 1.0) < 1e-9 and abs(2 * math.asin(out[-1].qz) - 2.0) < 1e-9 and abs(out[-1].bridged_s - 2.0) < 1e-9


def test_an_unknown_bound_is_refused():
    with pytest.raises(ValueError):
        from clearspan.operators import history

        history.downsample_extrema(None, 4)


def test_motion_compensation_of_the_fixture(spark):
    poses = [(1, S + k * 10_000_000, k, float(k), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, True) for k in range(3)]
    d = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.005), (1, 1, 0.0, 0.0, 0.0, 0.0), (1, 2, 2.0, 0.0, 0.0, 0.015)], "frame_id long, point_idx long, x double, y double, z double, offset_s double")
    frames = spark.createDataFrame([(1, 1, S)], "frame_id long, task_id long, stamp_ns long")
    p = spark.createDataFrame(poses, "task_id long, t long, seq long, px double, py double, pz double, qw double, qx double, qy double, qz double, ok boolean")
    moved, stats = cloud.motion_compensate(d, frames, p)
    assert {r.point_idx: round(r.x, 6) for r in moved.collect()} == {0: 1.5, 1: 0.0, 2: 3.5} and stats.first()["mode"] == "FULL"
    far = p.withColumn("px", F.col("px") * 5)
    moved, stats = cloud.motion_compensate(d, frames, far)
    assert {r.point_idx: round(r.x, 6) for r in moved.collect()} == {0: 1.0, 1: 0.0, 2: 2.0} and stats.first()["mode"] == "ROTATION_ONLY"


def test_sample_table_and_recovery(spark):
    from clearspan.sources import measurements

    d = measurements.conform_schema(spark.createDataFrame([("a", 0, 1, 1, 0.0, 1), ("a", -1, 1, 1, 0.0, 1), ("a", 1, None, 1, 0.0, 1), ("a", 2, 1, 1, 0.0, 3)], "task_id string, sample_index long, source_timestamp_ns long, recorded_timestamp_ns long, elapsed_ms double, valid int"))
    assert len(d.columns) == 46 and d.columns[-1] == "odin_qw"
    assert {r.sample_index: r.violation for r in measurements.broken_samples(d).collect()} == {-1: "sample_index is negative", 1: "source_timestamp_ns is missing", 2: "valid is no flag"}
    p = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("a", 5.0, 4.0), ("a", -1.0, 4.0)], "task_id string, started_elapsed_ms double, ended_elapsed_ms double")
    assert sorted(r.started_elapsed_ms for r in measurements.broken_pauses(p).collect()) == [-1.0, 5.0]
    meta = spark.createDataFrame([("a", 0, None, "confirmed"), ("b", 0, None, "stale_fix"), ("c", 1, "x", "confirmed")], "task_id string, complete int, ended_at string, exit_status string")
    out = {r.task_id: (r.exit_status, r.n_samples, r.n_valid, r.n_frames) for r in measurements.recover_orphans(meta, d, spark.createDataFrame([("a",)], "task_id string")).collect()}
    assert out == {"a": ("confirmed", 4, 3, 1), "b": ("unconfirmed", 0, 0, 0)}
