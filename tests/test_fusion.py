"""The inertial filter over buckets against a plain one that takes a recording row by row."""

import numpy as np
import pytest

from clearspan.config import FusionConfig
from clearspan.operators import fusion as U

SCHEMA = "task_id string, t long, seq long, fix boolean, x double, y double, z double, variance double, qw double, qx double, qy double, qz double"


def matrix(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def about(axis, a):
    c, s = np.cos(a), np.sin(a)
    m = np.eye(3)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def angles(m):
    return np.array([np.arcsin(m[2, 1]), np.arctan2(-m[2, 0], m[2, 2]), np.arctan2(-m[0, 1], m[1, 1])])


def plain(rows, c):
    """(position, velocity, bias, reason) after each row of one recording."""
    s, out = None, []
    for t, fix, vec, var, q in rows:
        vec = np.array(vec, float)
        if not fix and np.linalg.norm(q) > 1e-12:
            odo = matrix(q)
            if s is None:
                yaw = np.arctan2(odo[1, 0], odo[0, 0])
                s = {"t": t, "corr": t, "p": np.zeros(3), "v": np.zeros(3), "b": np.zeros(3), "r": about(2, -yaw) @ odo, "odo": odo, "P": np.diag(np.repeat([c.position_std, c.velocity_std, c.attitude_std, c.bias_std], 3) ** 2), "last": None}
                s["why"] = why(s, c)
            elif t > s["t"]:
                dt = (t - s["t"]) * 1e-9
                r = s["r"] @ s["odo"].T @ odo
                f = vec - s["b"]
                a = r @ f - [0, 0, c.gravity]
                if dt > c.max_step_s:
                    s.update(t=t, odo=odo, last=None, corr=0, why="IMU_TIME_GAP")
                elif np.linalg.norm(a) > c.max_acceleration:
                    s.update(t=t, r=r, odo=odo, last=None, why="IMU_ACCELERATION_OUTLIER")
                else:
                    am, rm = (a, r) if s["last"] is None else ((a + s["last"][0]) / 2, (r + s["last"][1]) / 2)
                    s["p"], s["v"] = s["p"] + s["v"] * dt + am * dt * dt / 2, s["v"] + am * dt
                    n = rm @ f
                    lean = -np.array([[0, -n[2], n[1]], [n[2], 0, -n[0]], [-n[1], n[0], 0]])
                    step = np.eye(12)
                    step[:3, 3:6], step[:3, 6:9], step[:3, 9:], step[3:6, 6:9], step[3:6, 9:] = np.eye(3) * dt, lean * dt * dt / 2, -rm * dt * dt / 2, lean * dt, -rm * dt
                    noise = np.repeat([c.acceleration_noise**2 * dt**4 / 4, c.acceleration_noise**2 * dt**2, c.attitude_noise**2 * dt, c.bias_walk**2 * dt], 3)
                    s.update(P=step @ s["P"] @ step.T + np.diag(noise), t=t, r=r, odo=odo, last=(a, r))
                    s["why"] = why(s, c)
        elif fix and s is not None:
            h = np.eye(3, 12)
            k = s["P"] @ h.T @ np.linalg.inv(h @ s["P"] @ h.T + var * np.eye(3))
            d = k @ (vec - s["p"])
            keep = np.eye(12) - k @ h
            cov = keep @ s["P"] @ keep.T + var * k @ k.T
            turn = lambda a: about(2, a[2]) @ about(0, a[0]) @ about(1, a[1])
            jac, e = np.eye(12), 1e-7
            for i in range(3):
                up, down = d[6:9].copy(), d[6:9].copy()
                up[i], down[i] = up[i] + e, down[i] - e
                jac[6:9, 6 + i] = (angles(turn(up) @ turn(d[6:9]).T) - angles(turn(down) @ turn(d[6:9]).T)) / (2 * e)
            s.update(p=s["p"] + d[:3], v=s["v"] + d[3:6], b=s["b"] + d[9:], r=turn(d[6:9]) @ s["r"], P=jac @ cov @ jac.T, corr=s["t"])
            s["why"] = why(s, c)
        out.append((np.zeros(9) if s is None else np.r_[s["p"], s["v"], s["b"]], "NOT_INITIALIZED" if s is None else s["why"]))
    return out


def why(s, c):
    if np.sqrt(np.diag(s["P"])[:3].max()) > c.max_position_std:
        return "POSITION_UNCERTAINTY_TOO_LARGE"
    return "INERTIAL_ONLY_TIMEOUT" if s["corr"] <= 0 or (s["t"] - s["corr"]) * 1e-9 > c.max_inertial_s else "NONE"


def recording(seed, n, fixes=True):
    r = np.random.default_rng(seed)
    t, rows = 1_700_000_000_000_000_000, []
    for k in range(n):
        t += int(r.integers(2_000_000, 9_000_000)) if k % 90 != 60 else 50_000_000
        q = (np.cos(0.001 * k), 0.01, 0.02 * np.sin(k / 50), np.sin(0.001 * k))
        if fixes and k % 15 == 14:
            rows.append((t, True, (0.02 * k, 0.01 * k, 0.0), 0.05, (1, 0, 0, 0)))
        else:
            rows.append((t if k % 37 else t - 20_000_000, False, tuple(r.normal(0, 0.5, 3) + [0.3, 0, 9.8]) if k % 70 != 40 else (90.0, 0, 9.8), 0.0, q if k != 5 else (0, 0, 0, 0)))
    return rows


def test_against_plain(spark):
    c = FusionConfig()
    made = {"a": recording(1, 700), "b": recording(2, 40), "c": recording(3, 500, fixes=False), "d": [(5, True, (1, 1, 1), 1.0, (1, 0, 0, 0))]}
    # as rows are taken in the order of their stamps
    made = {k: sorted(v, key=lambda r: r[0]) for k, v in made.items()}
    df = spark.createDataFrame([(k, t, i, fix, *map(float, vec), float(var), *map(float, q)) for k, v in made.items() for i, (t, fix, vec, var, q) in enumerate(v)], SCHEMA).repartition(5)
    got = {}
    for x in U.fuse_navigation(df, c, bucket_ns=600_000_000).collect():
        got.setdefault(x["task_id"], []).append(x)
    reasons = set()
    for k, v in made.items():
        want, mine = plain(v, c), sorted(got[k], key=lambda x: x["seq"])
        assert [x["reason"] for x in mine] == [w[1] for w in want]
        reasons |= {w[1] for w in want}
        values = np.array([[x[n] for n in ("px", "py", "pz", "vx", "vy", "vz", "bx", "by", "bz")] for x in mine])
        assert np.allclose(values, np.array([w[0] for w in want]), atol=1e-6)
    assert reasons == {"NOT_INITIALIZED", "NONE", "IMU_TIME_GAP", "IMU_ACCELERATION_OUTLIER", "INERTIAL_ONLY_TIMEOUT", "POSITION_UNCERTAINTY_TOO_LARGE"}


def steps(f, n, force, odo, start=10**9):
    one = np.zeros(1, int)
    for k in range(n + 1):
        f.propagate(one, np.array([start + k * 2_500_000]), np.array([force]), odo, np.array([True]))
    return f


def fresh(**kw):
    return U.Filters(np.zeros((1, U.SIZE)), np.zeros(1, np.int64), np.zeros(1, np.int64), FusionConfig(max_inertial_s=10.0, **kw))


def test_cases():
    one, level = np.zeros(1, int), np.eye(3)[None]
    still = steps(fresh(), 100, [-0.27345, -0.03353, -9.79533], U.matrices(np.array([[-0.0022600009, 0.99990038, -0.00011300004, -0.013932005]]))[0])
    assert np.linalg.norm(still.v) < 0.01 and np.linalg.norm(still.p) < 0.002
    moving = steps(fresh(), 400, [1.0, 0.0, 9.80665], level)
    assert moving.v[0, 0] == pytest.approx(1.0, abs=0.01) and moving.p[0, 0] == pytest.approx(0.5, abs=0.01)
    pulled = steps(fresh(), 400, [0.5, 0.0, 9.80665], level)
    v, b = pulled.v[0, 0], pulled.b[0, 0]
    pulled.correct(one, np.zeros((1, 3)), np.array([0.01]))
    assert pulled.v[0, 0] < v and pulled.b[0, 0] > b
    leaning = steps(fresh(attitude_std=0.5), 400, [0.8, 0.0, 9.80665], level)
    r = leaning.r.copy()
    leaning.correct(one, np.zeros((1, 3)), np.array([1e-4]))
    assert np.abs(leaning.r - r).max() > 1e-6


def test_empty(spark):
    assert U.fuse_navigation(spark.createDataFrame([], SCHEMA)).collect() == []
