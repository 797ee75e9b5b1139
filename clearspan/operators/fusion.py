"""Inertial navigation with position fixes: a 12-state error filter, run over time buckets in parallel.

The filter is a fold over a recording, but its state is small and fixes make it forget where it began. Each bucket of a recording is replayed
from an entry state and gives an exit state, which is the next bucket's entry. Buckets whose entry has changed are replayed again,
until none changes: the first is right after the first round, each next one after another round at most, and
usually most are after a few. The fixed point is the fold's own result, and no task holds more than its buckets. In a task many buckets
advance together, a row of each at a time, with matrices of all of them in one array.

State: position, velocity, accelerometer bias, attitude (local from body) and the covariance of their errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FusionConfig
from ..tables import stored

REASONS = ["NOT_INITIALIZED", "NONE", "IMU_TIME_GAP", "IMU_ACCELERATION_OUTLIER", "LOCAL_NAVIGATION_INVALID", "POSITION_UNCERTAINTY_TOO_LARGE", "INERTIAL_ONLY_TIMEOUT"]
NEW, FINE, GAP, OUTLIER, INVALID, UNSURE, INERTIAL = range(7)
#: Entries of the state: name -> shape. Stamps are longs beside it.
SHAPES = {"begun": (), "p": (3,), "v": (3,), "b": (3,), "r": (3, 3), "odo": (3, 3), "cov": (12, 12), "has": (), "acc": (3,), "before": (3, 3), "sound": (), "valid": (), "reason": ()}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Step of the numerical derivative of the attitude reset (a fixed value).
RESET_STEP = 1.0e-7
#: Buckets that a task advances together.
LANES = 128


def turned_by(a: np.ndarray) -> np.ndarray:
    """Rotation matrices of attitude angles (pitch, roll, yaw: about x, y, z in the order z x y)."""
    s, c = np.sin(a), np.cos(a)
    (si, sj, sk), (ci, cj, ck) = np.moveaxis(s, -1, 0), np.moveaxis(c, -1, 0)
    rows = [cj * ck - si * sj * sk, -ci * sk, sj * ck + si * cj * sk, cj * sk + si * sj * ck, ci * ck, sj * sk - si * cj * ck, -ci * sj, si, ci * cj]
    return np.stack(rows, axis=-1).reshape(*a.shape[:-1], 3, 3)


def angles_of(m: np.ndarray) -> np.ndarray:
    """The attitude angles of rotation matrices."""
    return np.stack([np.arcsin(np.clip(m[..., 2, 1], -1, 1)), np.arctan2(-m[..., 2, 0], m[..., 2, 2]), np.arctan2(-m[..., 0, 1], m[..., 1, 1])], axis=-1)


def reset_jacobian(a: np.ndarray) -> np.ndarray:
    """How the attitude error changes when the correction a is taken into the attitude."""
    back, steps = np.swapaxes(turned_by(a), -1, -2), np.eye(3) * RESET_STEP
    columns = [(angles_of(turned_by(a + s) @ back) - angles_of(turned_by(a - s) @ back)) / (2 * RESET_STEP) for s in steps]
    return np.stack(columns, axis=-1)


def matrices(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation matrices, whether usable) of quaternions w, x, y, z."""
    norm = np.sqrt((q * q).sum(axis=1))
    good = np.isfinite(norm) & (norm > 1e-12)
    w, x, y, z = (q / np.where(good, norm, 1)[:, None]).T
    m = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)
    return m.reshape(-1, 3, 3), good


def skew(v: np.ndarray) -> np.ndarray:
    x, y, z = v.T
    o = np.zeros_like(x)
    return np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)


class Filters:
    """The states of many filters. All methods take the lanes they work on, and change nothing of the others."""

    def __init__(self, state: np.ndarray, t: np.ndarray, corrected: np.ndarray, c: FusionConfig):
        self.c, self.t, self.corrected, at = c, t.copy(), corrected.copy(), 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, state[:, at : at + size].reshape(len(state), *shape).copy())
            at += size

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).reshape(len(self.t), -1) for name in SHAPES], axis=1)

    def _finite(self, k: np.ndarray) -> np.ndarray:
        return np.all([np.isfinite(getattr(self, n)[k].reshape(len(k), -1)).all(axis=1) for n in ("p", "v", "b", "r", "cov")], axis=0)

    def judge(self, k: np.ndarray) -> None:
        std = np.sqrt(np.maximum(np.diagonal(self.cov[k], axis1=1, axis2=2)[:, :3].max(axis=1), 0))
        alone = np.where((self.corrected[k] > 0) & (self.t[k] > 0), np.maximum(0, self.t[k] - self.corrected[k]) * 1e-9, np.inf)
        reason = np.where((self.begun[k] == 0) | (self.sound[k] == 0), INVALID, np.where(~(std <= self.c.max_position_std), UNSURE, np.where(alone > self.c.max_inertial_s, INERTIAL, FINE)))
        self.reason[k], self.valid[k] = reason, reason == FINE

    def start(self, k: np.ndarray, t: np.ndarray, odo: np.ndarray) -> None:
        """Level axes whose heading is the body's; first uncertainties."""
        yaw = np.arctan2(odo[:, 1, 0], odo[:, 0, 0])
        c, s, o = np.cos(yaw), np.sin(yaw), np.zeros(len(k))
        level = np.stack([c, s, o, -s, c, o, o, o, o + 1], axis=1).reshape(-1, 3, 3)
        self.t[k], self.corrected[k], self.begun[k], self.has[k] = t, t, 1, 0
        self.p[k], self.v[k], self.b[k] = 0, 0, 0
        self.r[k], self.odo[k] = level @ odo, odo
        first = np.repeat([self.c.position_std, self.c.velocity_std, self.c.attitude_std, self.c.bias_std], 3)
        self.cov[k] = np.diag(first**2)
        self.sound[k] = self._finite(k)
        self.judge(k)

    def propagate(self, k: np.ndarray, t: np.ndarray, force: np.ndarray, odo: np.ndarray, usable: np.ndarray) -> None:
        good = usable & (t > 0)
        new = good & (self.begun[k] == 0)
        if new.any():
            self.start(k[new], t[new], odo[new])
        go = good & ~new & np.isfinite(force).all(axis=1) & (t > self.t[k])
        k, t, force, odo = k[go], t[go], force[go], odo[go]
        dt = (t - self.t[k]) * 1e-9
        late = dt > self.c.max_step_s
        if late.any():
            j = k[late]
            self.t[j], self.odo[j], self.has[j], self.corrected[j], self.valid[j], self.reason[j] = t[late], odo[late], 0, 0, 0, GAP
            k, t, force, odo, dt = k[~late], t[~late], force[~late], odo[~late], dt[~late]
        if not len(k):
            return
        r = self.r[k] @ (np.swapaxes(self.odo[k], 1, 2) @ odo)
        own = force - self.b[k]
        acc = (r @ own[:, :, None])[:, :, 0] - [0, 0, self.c.gravity]
        wild = ~(np.sqrt((acc * acc).sum(axis=1)) <= self.c.max_acceleration)
        if wild.any():
            j = k[wild]
            self.t[j], self.r[j], self.odo[j], self.has[j], self.valid[j], self.reason[j] = t[wild], r[wild], odo[wild], 0, 0, OUTLIER
            calm = ~wild
            k, t, odo, dt, r, own, acc = k[calm], t[calm], odo[calm], dt[calm], r[calm], own[calm], acc[calm]
            if not len(k):
                return
        has, d = self.has[k] > 0, dt[:, None]
        mean = np.where(has[:, None], (self.acc[k] + acc) / 2, acc)
        self.p[k] += self.v[k] * d + mean * d * d / 2
        self.v[k] += mean * d
        turn = np.where(has[:, None, None], (self.before[k] + r) / 2, r)
        lean, e = -skew((turn @ own[:, :, None])[:, :, 0]), dt[:, None, None]
        step = np.tile(np.eye(12), (len(k), 1, 1))
        step[:, 0:3, 3:6] = np.eye(3) * e
        step[:, 0:3, 6:9], step[:, 0:3, 9:12] = lean * e * e / 2, -turn * e * e / 2
        step[:, 3:6, 6:9], step[:, 3:6, 9:12] = lean * e, -turn * e
        a2, q2, w2 = self.c.acceleration_noise**2, self.c.attitude_noise**2, self.c.bias_walk**2
        noise = np.repeat(np.stack([a2 * dt**4 / 4, a2 * dt**2, q2 * dt, w2 * dt], axis=1), 3, axis=1)
        cov = step @ self.cov[k] @ np.swapaxes(step, 1, 2)
        cov[:, range(12), range(12)] += noise
        self.cov[k] = (cov + np.swapaxes(cov, 1, 2)) / 2
        self.t[k], self.r[k], self.odo[k], self.acc[k], self.before[k], self.has[k] = t, r, odo, acc, r, 1
        self.sound[k] = self._finite(k)
        self.judge(k)

    def correct(self, k: np.ndarray, place: np.ndarray, variance: np.ndarray) -> None:
        """A position fix with the same variance along all axes: gain, Joseph form, and the reset of the attitude error."""
        go = (self.begun[k] > 0) & np.isfinite(place).all(axis=1) & np.isfinite(variance) & (variance >= 0)
        k, place, variance = k[go], place[go], variance[go]
        seen = variance[:, None, None] * np.eye(3)
        whole = self.cov[k][:, :3, :3] + seen
        firm = np.isfinite(whole).all(axis=(1, 2))
        firm[firm] = np.linalg.eigvalsh(whole[firm])[:, 0] > 0
        k, place, seen, whole = k[firm], place[firm], seen[firm], whole[firm]
        if not len(k):
            return
        gain = self.cov[k][:, :, :3] @ np.linalg.inv(whole)
        change = (gain @ (place - self.p[k])[:, :, None])[:, :, 0]
        rest = np.tile(np.eye(12), (len(k), 1, 1))
        rest[:, :, :3] -= gain
        cov = rest @ self.cov[k] @ np.swapaxes(rest, 1, 2) + gain @ seen @ np.swapaxes(gain, 1, 2)
        reset = np.tile(np.eye(12), (len(k), 1, 1))
        reset[:, 6:9, 6:9] = reset_jacobian(change[:, 6:9])
        cov = reset @ cov @ np.swapaxes(reset, 1, 2)
        fine = np.isfinite(cov).all(axis=(1, 2)) & np.isfinite(change).all(axis=1)
        k, change, cov = k[fine], change[fine], cov[fine]
        self.p[k] += change[:, 0:3]
        self.v[k] += change[:, 3:6]
        self.b[k] += change[:, 9:12]
        self.r[k] = turned_by(change[:, 6:9]) @ self.r[k]
        self.cov[k] = (cov + np.swapaxes(cov, 1, 2)) / 2
        self.corrected[k] = self.t[k]
        self.judge(k)


ROWS = ["t", "seq", "fix", "x", "y", "z", "variance", "qw", "qx", "qy", "qz"]
OUT = ["px", "py", "pz", "vx", "vy", "vz", "bx", "by", "bz", "yaw", "position_std"]


def replay(rows: pd.DataFrame, c: FusionConfig, shown: bool) -> pd.DataFrame:
    """Of many buckets at once: their exit states, or what each row leaves."""
    rows = rows.sort_values(["lane", "t", "seq"], kind="stable").reset_index(drop=True)
    lane, first, n = np.unique(rows["lane"].to_numpy(), return_index=True, return_counts=True)
    head = rows.iloc[first]
    state = np.array([s if s is not None else np.zeros(SIZE) for s in head["state"]], dtype=float)
    f = Filters(state, head["state_t"].to_numpy(np.int64), head["state_fix"].to_numpy(np.int64), c)
    vector, variance, t, fix = rows[["x", "y", "z"]].to_numpy(float), rows["variance"].to_numpy(float), rows["t"].to_numpy(np.int64), rows["fix"].to_numpy(bool)
    odo, usable = matrices(rows[["qw", "qx", "qy", "qz"]].to_numpy(float))
    seen, told = np.zeros((len(rows), len(OUT))), np.zeros((len(rows), 2), dtype=np.int64)
    for step in range(n.max()):
        k = np.flatnonzero(n > step)
        at = first[k] + step
        a, b = ~fix[at], fix[at]
        if a.any():
            f.propagate(k[a], t[at[a]], vector[at[a]], odo[at[a]], usable[at[a]])
        if b.any():
            f.correct(k[b], vector[at[b]], variance[at[b]])
        if shown:
            std = np.sqrt(np.maximum(np.diagonal(f.cov[k], axis1=1, axis2=2)[:, :3].max(axis=1), 0))
            seen[at] = np.c_[f.p[k], f.v[k], f.b[k], angles_of(f.r[k])[:, 2], std]
            told[at] = np.c_[f.valid[k], f.reason[k]]
    if shown:
        out = pd.concat([rows[["task_id", "t", "seq"]], pd.DataFrame(seen, columns=OUT)], axis=1)
        return out.assign(valid=told[:, 0] > 0, reason=[REASONS[r] for r in told[:, 1]])
    ends = head[["task_id", "bucket"]].reset_index(drop=True)
    return ends.assign(state=list(f.packed()), state_t=f.t, state_fix=f.corrected)


def fuse_navigation(rows: DataFrame, c: FusionConfig = FusionConfig(), *, bucket_ns: int = 5_000_000_000, tolerance: float = 1e-9) -> DataFrame:
    """(task_id, t, seq, position, velocity, bias, yaw, position_std, valid, reason) after each row. rows: task_id, t, seq, fix, x, y, z, variance, qw, qx, qy, qz; in the
    order of t, then seq.

    A row with fix is a position with a variance; any other has the specific force of the body and the odometry's attitude, of which only the turn since the row before counts. The
    first such row starts the filter. Rows that aren't later than the last, or hold nulls, change nothing. A step over max_step_s, or an acceleration over max_acceleration,
    isn't integrated: IMU_TIME_GAP or IMU_ACCELERATION_OUTLIER. Then POSITION_UNCERTAINTY_TOO_LARGE or INERTIAL_ONLY_TIMEOUT name what makes a place unfit. Buckets are replayed until
    no entry state moves by more than tolerance.
    """
    kind = rows.schema["task_id"].dataType.simpleString()
    rows = stored(rows.select("task_id", *ROWS, F.floor(F.col("t") / F.lit(bucket_ns)).cast("long").alias("bucket")), "rows")
    order = W.partitionBy("task_id").orderBy("bucket")  # a row for each bucket
    buckets = stored(rows.select("task_id", "bucket").distinct().withColumn("next", F.lead("bucket").over(order)), "buckets")
    empty = [F.lit(None).cast("array<double>").alias("state"), F.lit(0).cast("long").alias("state_t"), F.lit(0).cast("long").alias("state_fix")]
    entries, waiting = stored(buckets.select("task_id", "bucket", *empty), "entries"), None
    states = f"task_id {kind}, bucket long, state array<double>, state_t long, state_fix long"
    shown = f"task_id {kind}, t long, seq long, " + ", ".join(f"{k} double" for k in OUT) + ", valid boolean, reason string"
    parts = max(1, buckets.count() // LANES + 1)

    def run(which: DataFrame, what: bool) -> DataFrame:
        lanes = which.withColumn("lane", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("task_id", "bucket"), F.lit(parts)))
        joined = rows.join(lanes.hint("merge"), ["task_id", "bucket"])
        return joined.groupBy("part").applyInPandas(lambda part: replay(part, c, what), shown if what else states)

    exits = stored(run(entries, False), "exits")
    moved = lambda a, b: F.coalesce(F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(~(F.abs(x - y) <= tolerance * (1 + F.abs(y))), F.lit(True))), lambda m: m), F.lit(True))
    while True:
        given = exits.join(buckets.where("next IS NOT NULL").hint("merge"), ["task_id", "bucket"]).select("task_id", F.col("next").alias("bucket"), *[F.col(k).alias(f"new_{k}") for k in ("state", "state_t", "state_fix")])
        changed = given.join(entries.hint("merge"), ["task_id", "bucket"]).where(moved(F.col("state"), F.col("new_state")) | (F.col("state_t") != F.col("new_state_t")) | (F.col("state_fix") != F.col("new_state_fix")))
        waiting = stored(changed.select("task_id", "bucket", *[F.col(f"new_{k}").alias(k) for k in ("state", "state_t", "state_fix")]), "changed")
        if not waiting.limit(1).count():
            return run(entries, True)
        same = ["task_id", "bucket"]
        entries = stored(entries.join(waiting.select(same).hint("merge"), same, "left_anti").unionByName(waiting), "entries")
        again = stored(run(waiting, False), "again")
        exits = stored(exits.join(again.select(same).hint("merge"), same, "left_anti").unionByName(again), "exits")
