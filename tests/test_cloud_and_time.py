import numpy as np
import pytest

from clearspan.operators import cloud, history, surface, temporal


def grid(z, half, step, shift=0.0, frame=1, start=0):
    axis = np.arange(-half, half + 1e-9, step)
    return [(frame, start + i, float(x + shift), float(y), float(z)) for i, (x, y) in enumerate((x, y) for x in axis for y in axis)]


SCHEMA = "frame_id long, point_idx long, x double, y double, z double"


def test_three_planes_give_the_lowest(spark):
    # at a 5 cm step the 3 cm cells of one plane would not touch each other
    rows = grid(1.5, 0.6, 0.025) + grid(2.5, 0.6, 0.025, start=5000) + grid(3.5, 0.6, 0.025, start=10_000)
    found = cloud.detect_planes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) >= 3 and abs(min(r.height for r in found) - 1.5) <= 0.03


def test_dense_planes_are_found(spark):
    rows = grid(1.5, 0.6, 0.02) + grid(2.5, 0.6, 0.02, start=10_000)
    found = cloud.detect_planes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) >= 2 and abs(min(r.height for r in found) - 1.5) <= 0.03


def test_a_frame_without_a_plane_tells_why(spark):
    """One frame for each reason; the third plane is rougher than the residual gate allows, the fourth frame is a wall."""
    r = np.random.default_rng(7)
    wall = [(4, i, 0.5, float(n), float(u)) for i, (n, u) in enumerate(r.uniform((-1, 1.5), (1, 4), (400, 2)))]
    spots = [(2, i, float(e), float(n), 2.0) for i, (e, n) in enumerate(r.uniform(-0.02, 0.02, (300, 2)))]
    rough = [(3, i, float(e), float(n), float(2 + d)) for i, (e, n, d) in enumerate(r.uniform((-0.5, -0.5, -0.04), (0.5, 0.5, 0.04), (9000, 3)))]
    rows = grid(1.5, 0.6, 0.02, frame=1) + spots + rough + wall + [(5, 0, 0.0, 0.0, 2.0), (6, 0, 0.0, 0.0, -2.0)]
    points, config = spark.createDataFrame(rows, SCHEMA), cloud.PlaneConfig(residual_p95=0.03, max_planes=1)
    told = {f.frame_id: f for f in cloud.plane_frames(points, cloud.plane_search(points, config), config).collect()}
    assert {k: f.reason for k, f in told.items()} == {1: "NONE", 2: "NO_PLANE_PASSED_REGION_SIZE", 3: "NO_PLANE_PASSED_QUALITY_CHECK", 4: "NO_PLANE_FOUND", 5: "TOO_FEW_VALID_POINTS", 6: "TOO_FEW_VALID_POINTS"}
    assert told[1].models == 1 and told[1].valid_ratio == 1.0 and told[6].valid_ratio == 0.0
    every = {f.frame_id: f for f in surface.clearance_results(points, config).collect()}
    assert len(every) == 6 and every[1].valid and abs(every[1].height - 1.5) <= 0.03 and every[1].area > 0.3 and every[1].tilt < 1 and every[1].p95 < 0.01
    assert every[2].reason.startswith("PLANE:NO_PLANE_PASSED_REGION_SIZE|SURFACE:") and every[5].reason == "PLANE:TOO_FEW_VALID_POINTS|SURFACE:TOO_FEW_SURFACE_ROI_POINTS"


def test_frames_left_for_a_limit_of_rate_give_no_row(spark):
    planes = cloud.detect_planes(spark.createDataFrame(grid(1.5, 0.6, 0.02), SCHEMA))
    frames = spark.createDataFrame([(1, "NONE"), (2, "NO_PLANE_FOUND")], "frame_id long, reason string")
    curved, searched = surface.detect_surfaces(spark.createDataFrame([], SCHEMA))
    kept = lambda **how: sorted((r.frame_id, r.reason) for r in surface.choose_results(planes, frames, curved, searched, **how).collect())
    assert kept() == [(1, "NONE"), (2, "NO_PLANE_FOUND")] and kept(rate_limited=True) == [(1, "NONE")]


def test_frames_are_dropped_by_what_their_poses_lack(spark):
    frames = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 99, 200), (1, 3, 150, 305), (1, 4, 150, 306), (1, 5, 50, 400), (2, 6, 100, 200), (3, 7, 100, 200)], "task_id long, frame_id long, first_ns long, last_ns long")
    bounds = spark.createDataFrame([(1, 100, 300), (3, 0, 300)], "task_id long, min_ns long, max_ns long")
    got = {r.frame_id: r[2:] for r in temporal.frame_context(frames, bounds, partial_tail_ns=5).collect()}
    old, tail, none = "CLOUD_OLDER_THAN_POSE_CACHE", "POSE_TAIL_TIMEOUT", "POSE_NOT_AVAILABLE"
    assert got == {1: (0, 0, None), 2: (1, 0, old), 3: (0, 5, None), 4: (0, 6, tail), 5: (50, 100, old), 6: (0, 0, none), 7: (0, 0, none)}


def test_interpolation_between_poses_only(spark):
    poses = spark.createDataFrame([(1, 1_000_000_000, 0, 0.0), (1, 1_010_000_000, 1, 1.0)], "task_id long, t long, seq long, x double")
    q = spark.createDataFrame([(1, 1_005_000_000), (1, 999_000_000), (1, 1_020_000_000), (1, 1_010_000_000)], "task_id long, t long")
    got = {r.t: (r.found, r.x) for r in temporal.interpolate_join(q, poses, 15_000_000, ["x"]).collect()}
    assert got == {1_005_000_000: (True, 0.5), 999_000_000: (False, None), 1_020_000_000: (False, None), 1_010_000_000: (True, 1.0)}


def test_no_interpolation_over_a_wide_gap(spark):
    poses = spark.createDataFrame([(1, 0, 0, 0.0), (1, 10_000_000, 1, 1.0)], "task_id long, t long, seq long, x double")
    q = spark.createDataFrame([(1, 5_000_000)], "task_id long, t long")
    assert not temporal.interpolate_join(q, poses, 5_000_000, ["x"]).first().found


def test_downsampling_keeps_the_spike_and_the_invalid_row(spark):
    base = 1_785_978_000_000_000_000
    rows = [(1, i, base + i * 20_000_000, 3.0 if i == 523 else 5.2 + (i % 11) / 1000, i != 700) for i in range(1000)]
    s = spark.createDataFrame(rows, "task_id long, sample_index long, ts_ns long, height double, valid boolean")
    got = {r.sample_index for r in history.downsample_extrema(s, 200).collect()}
    assert {0, 523, 700, 999} <= got and len(got) <= 200
    first = base // 1_000_000
    window = history.series_window(s, first + 500 * 20, first + 550 * 20)
    assert window.count() == 51
    with pytest.raises(ValueError):
        history.series_window(s, 2, 1)


def test_empty_samples(spark):
    s = spark.createDataFrame([], "task_id long, sample_index long, ts_ns long, height double, valid boolean")
    assert history.task_statistics(s).count() == 0 and history.downsample_extrema(s, 200).count() == 0
