"""Frames of any size through the adaptive voxel: no task holds a frame, and leftovers are thinned by the same rule."""

import math

import pytest

from clearspan.operators import surface


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("points") / "p.parquet")
    rows = [(f, k, math.sin(k * 1.3 + f) * 9, math.cos(k * 2.1) * 9, math.sin(k * 0.7) * 9) for f in range(3) for k in range(60 + 700 * (f == 1))]
    spark.createDataFrame(rows, "frame_id long, point_idx long, x double, y double, z double").write.parquet(path)
    return spark.read.parquet(path), rows


def test_each_try_reads_stored_voxels(points):
    """The last plan begins at the tables of voxels, not at the points again for each try before."""
    df, _ = points
    small = surface.adaptive_voxel(df, 0.01, 50)
    assert not set(small.inputFiles()) & set(df.inputFiles())
    assert max(r["count"] for r in small.groupBy("frame_id").count().collect()) <= 50


@pytest.mark.parametrize("rows_in_range", [100_000, 37])
def test_leftover_frames_by_stride(points, monkeypatch, rows_in_range):
    monkeypatch.setattr(surface, "RANGE_ROWS", rows_in_range)
    df, rows = points
    found = {(r.frame_id, r.point_idx, r.x) for r in surface.adaptive_voxel(df, 0.0001, 100, tries=1).collect()}
    expected = set()
    for f in range(3):
        own = sorted(r[2:] for r in rows if r[0] == f)
        step = 1 if len(own) <= 100 else math.ceil(len(own) / 100)
        expected |= {(f, k + 1, p[0]) for k, p in enumerate(own) if k % step == 0}
    assert found == expected
