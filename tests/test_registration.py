"""Neighbours through the grid and alignment quality against numpy."""

import numpy as np
import pytest

from clearspan.config import RegistrationConfig
from clearspan.operators import registration as G
from clearspan.operators import surface as S

POINTS = "frame_id long, point_idx long, x double, y double, z double"
POSES = "frame_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def rows(frame, p):
    return [(frame, i, *map(float, v)) for i, v in enumerate(p)]


def brute(scan, cloud, turn, shift, c):
    """(evaluated, inliers, fitness, ratio, eigenvalues, dof, rotation dof, covariance) as the method is stated."""
    scan = scan[np.isfinite(scan).all(axis=1) & (scan != 0).any(axis=1)]
    info, squares, n = np.zeros((6, 6)), 0.0, 0
    for s in scan:
        r = turn @ s
        far = np.sqrt(((cloud - r - shift) ** 2).sum(axis=1))
        near = cloud[np.argsort(far, kind="stable")[: c.neighbours]]
        if len(near) < 5 or far.min() > c.max_distance:
            continue
        mean = near.mean(axis=0)
        values, vectors = np.linalg.eigh((near - mean).T @ (near - mean))
        if values.sum() <= 1e-12 or values[0] / values.sum() > c.max_variation:
            continue
        u = vectors[:, 0]
        j = np.r_[u, np.cross(r, u)]
        info, squares, n = info + np.outer(j, j), squares + (u @ (r + shift - mean)) ** 2, n + 1
    if n < 6:
        return len(scan), n, 0.0, 0.0, [0.0] * 6, 0, 0, np.eye(6)
    info, fitness = info / n, squares / n
    values, vectors = np.linalg.eigh(info)
    seen = values >= max(c.least_eigenvalue, c.least_relative * values[-1])
    spread = np.where(seen, np.maximum(1e-10, fitness / np.maximum(values, 1e-12)), c.blind_variance)
    covariance = vectors @ np.diag(spread) @ vectors.T + np.diag([c.position_noise**2] * 3 + [np.radians(c.attitude_noise_deg) ** 2] * 3)
    turning = np.linalg.eigvalsh(info[3:, 3:])
    return len(scan), n, fitness, n / len(scan), values, seen.sum(), (turning >= max(c.least_eigenvalue, c.least_relative * turning[-1])).sum(), covariance


def test_neighbours_with_gaps_ties_and_far_points(spark):
    r = np.random.default_rng(3)
    one = np.r_[r.normal(0, 1, (150, 3)), [[90.0, 0, 0], [-400.0, 5, 5]], np.repeat(r.normal(0, 1, (1, 3)), 6, axis=0)]
    df = spark.createDataFrame(rows(1, one) + rows(2, r.normal(0, 1, (3, 3))) + rows(3, np.zeros((1, 3))) + [(1, 900, float("nan"), 0.0, 0.0), (1, 901, None, 0.0, 0.0)], POINTS).repartition(3)
    got = {}
    for x in S.knn(df, 5, cell=0.3).collect():
        got.setdefault((x["frame_id"], x["point_idx"]), []).append((x["rank"], x["near_idx"], x["distance"]))
    for frame, p in ((1, one), (2, np.array([[x["x"], x["y"], x["z"]] for x in df.where("frame_id = 2").orderBy("point_idx").collect()]))):
        for i in range(len(p)):
            far = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
            far[i] = np.inf
            order = np.argsort(far, kind="stable")[: min(5, len(p) - 1)]
            found = sorted(got.pop((frame, i)))
            assert [f[0] for f in found] == list(range(1, len(order) + 1)) and [f[1] for f in found] == order.tolist()
            assert np.allclose([f[2] for f in found], far[order], atol=1e-12)
    assert not got


@pytest.fixture(scope="module")
def frames():
    """1: floor and two walls; 2: a tunnel along y; 3: a line; 4: too few points; 5: far from the map."""
    r = np.random.default_rng(8)
    n = 260
    a, b, e = r.uniform(0, 6, n), r.uniform(0, 6, n), r.normal(0, 0.01, n)
    room = np.r_[np.c_[a, b, e][:90], np.c_[a, e, b][90:180], np.c_[e, a, b][180:]]
    angle = r.uniform(0, 2 * np.pi, n)
    tunnel = np.c_[2 * np.cos(angle), r.uniform(-8, 8, n), 2 * np.sin(angle)]
    line = np.c_[np.linspace(0.1, 9, 60), np.zeros(60), np.zeros(60)]
    return {1: (room[::2] + r.normal(0, 0.02, (n // 2, 3)), room), 2: (tunnel[::2], tunnel), 3: (line[::2], line), 4: (room[:4], room), 5: (room[:40] + 200, room), 6: (np.r_[room[::5], [[0, 0, 0], [np.nan, 1, 1]]], room)}


def test_quality(spark, frames):
    c = RegistrationConfig(cell=0.4)
    yaw, pitch = 0.02, 0.01
    q = np.array([np.cos(yaw / 2) * np.cos(pitch / 2), -np.sin(yaw / 2) * np.sin(pitch / 2), np.cos(yaw / 2) * np.sin(pitch / 2), np.sin(yaw / 2) * np.cos(pitch / 2)])
    w, x, y, z = q
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    shift = np.array([0.05, -0.03, 0.02])
    scan = spark.createDataFrame([v for f, (s, _) in frames.items() for v in rows(f, s)] + rows(7, [[1, 1, 1]] * 9), POINTS).repartition(4)
    cloud = spark.createDataFrame([v for f, (_, m) in frames.items() for v in rows(f, m)], POINTS)
    poses = spark.createDataFrame([(f, *map(float, q), *map(float, shift)) for f in frames if f != 6] + [(6, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], POSES)
    got = {x["frame_id"]: x for x in G.alignment_quality(scan, cloud, poses, c).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and not got[7]["valid"] and got[7]["inliers"] == 0
    for f, (s, m) in frames.items():
        want = brute(s, m, *((turn, shift) if f != 6 else (np.eye(3), np.zeros(3))), c)
        x = got[f]
        assert (x["evaluated"], x["inliers"]) == want[:2] and x["valid"] == (want[1] >= 6)
        if f == 3:  # any normal across the line will do
            assert x["dof"] < 6 and max(x["covariance"]) > 1e5
            continue
        assert (x["dof"], x["rotation_dof"]) == (want[5], want[6])
        assert np.allclose([x["fitness"], x["inlier_ratio"], *x["eigenvalues"]], [want[2], want[3], *want[4]], rtol=1e-6, atol=1e-9)
        assert np.allclose(np.array(x["covariance"]).reshape(6, 6), want[7], rtol=1e-5, atol=1e-6 * np.abs(want[7]).max())
    assert got[1]["dof"] == 6 and np.diag(np.array(got[2]["covariance"]).reshape(6, 6))[:3].argmax() == 1  # along the tunnel


def test_empty(spark):
    none = spark.createDataFrame([], POINTS)
    assert G.alignment_quality(none, none, spark.createDataFrame([], POSES)).collect() == []
    assert G.nearest_points(none, none, 3).collect() == []
