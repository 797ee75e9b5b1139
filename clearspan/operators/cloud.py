"""Point-cloud operators by frame: filters, voxels, grids, fits, limits, compensation and plane detection.

Points are rows (frame_id, point_idx, x east, y north, z up). Work is keyed by frame; aggregates combine before the
shuffle. Only the plane search, which is sequential within a frame, runs as a grouped map, and a frame is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PlaneConfig
from ..functions import rotation as R
from ..functions.geodesy import finite
from ..tables import stored
from .temporal import interpolate_join


def in_roi(c: PlaneConfig) -> Column:
    x, y, z = (F.col(n).cast("double") for n in "xyz")
    return finite(x, y, z) & (F.sqrt(x * x + y * y + z * z) >= c.min_range) & z.between(c.up_min, c.up_max) & (F.abs(F.degrees(F.atan2(x, z))) <= c.half_angle_east) & (F.abs(F.degrees(F.atan2(y, z))) <= c.half_angle_north)


def valid_point() -> Column:
    """Finite and not the (0, 0, 0) that marks an invalid return."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return finite(x, y, z) & ~((x == 0) & (y == 0) & (z == 0))


def voxel(leaf: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(leaf)).cast("long").alias(f"v{c}") for c in "xyz"]


def voxel_centroids(points: DataFrame, leaf: float) -> DataFrame:
    return points.groupBy("frame_id", *voxel(leaf)).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def voxel_representatives(points: DataFrame, leaf: float) -> DataFrame:
    """The point of the lowest index in each voxel."""
    return points.groupBy("frame_id", *voxel(leaf)).agg(F.min_by(F.struct("point_idx", "x", "y", "z"), "point_idx").alias("p")).select("frame_id", "p.*")


def grid_cells(points: DataFrame, size: float) -> DataFrame:
    """Occupied cells of the horizontal grid and their points."""
    return points.groupBy("frame_id", F.floor(F.col("x") / F.lit(size)).cast("long").alias("cx"), F.floor(F.col("y") / F.lit(size)).cast("long").alias("cy")).agg(F.count("*").alias("n"))


def grid_occupancy(cells: DataFrame, size: float, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Cells, spans and area."""
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), (F.max("cx") - F.min("cx") + 1).alias("span_x"), (F.max("cy") - F.min("cy") + 1).alias("span_y"), (F.count("*") * size * size).alias("area"))


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of occupied cells that touch at a side or a corner: eight offsets and an equi-join."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    moved = cells.select("frame_id", "cx", "cy", steps.alias("s")).select("frame_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    return moved.hint("merge").join(cells.select("frame_id", "cx", "cy"), ["frame_id", "cx", "cy"]).select("frame_id", "ax", "ay", F.col("cx").alias("bx"), F.col("cy").alias("by"))


def label_cells(cells: DataFrame) -> DataFrame:
    """Connected components of the cells of each frame (8 neighbours); component is its smallest cell number. A frame's cells
    are a few thousand at most, so each frame is one group."""

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cx", "cy"], kind="stable").reset_index(drop=True)
        frame["component"] = _components(frame[["cx", "cy"]].to_numpy())
        return frame[["frame_id", "cx", "cy", "component"]]

    return cells.select("frame_id", "cx", "cy").groupBy("frame_id").applyInPandas(label, "frame_id long, cx long, cy long, component long")


def _components(cells: np.ndarray) -> np.ndarray:
    place, labels = {(int(a), int(b)): i for i, (a, b) in enumerate(cells)}, np.full(len(cells), -1, dtype=np.int64)
    for start in range(len(cells)):
        if labels[start] >= 0:
            continue
        labels[start], todo = start, [start]
        while todo:
            a, b = cells[todo.pop()]
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    k = place.get((int(a) + dx, int(b) + dy))
                    if k is not None and labels[k] < 0:
                        labels[k] = start
                        todo.append(k)
    return labels


def plane_moments(points: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Centroid and covariance by key."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def plane_fit(points: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The least-squares plane of each key: unit normal with z >= 0, offset d, tilt in degrees, and the second eigenvalue
    (how well the points span a plane). The 3 x 3 eigenproblem is solved on one row for each key."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy(float).reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(m) if len(m) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            normal = vectors[:, :, 0] * np.where(vectors[:, 2:3, 0] < 0, -1, 1)
            centre = b[["mx", "my", "mz"]].to_numpy(float)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "d": -(normal * centre).sum(axis=1), "tilt": np.degrees(np.arccos(np.clip(normal[:, 2], -1, 1))), "second": values[:, 1]})

    made = plane_moments(points, keys)
    schema = ", ".join(f"{k} {made.schema[k].dataType.simpleString()}" for k in keys)
    return made.mapInPandas(solve, schema + ", nx double, ny double, nz double, d double, tilt double, second double")


def plane_inliers(points: DataFrame, planes: DataFrame, distance: float) -> DataFrame:
    """Points within a distance of their frame's plane (a, b, c, d)."""
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) / F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return points.join(planes, "frame_id").withColumn("off", off).where(F.col("off") <= distance).select(*points.columns, "off")


def subtract(points: DataFrame, inliers: DataFrame) -> DataFrame:
    return points.join(inliers.select("frame_id", "point_idx"), ["frame_id", "point_idx"], "left_anti")


def residual_quantiles(rows: DataFrame, column: str, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Exact median and 95th percentile, linear between values."""
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def nearest_point(points: DataFrame, targets: DataFrame) -> DataFrame:
    """The valid point of each frame nearest to the frame's target (tx, ty, tz)."""
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2) + F.pow(F.col("z") - F.col("tz"), 2))
    return points.where(valid_point()).join(targets, "frame_id").withColumn("distance", d).groupBy("frame_id").agg(F.min_by("point_idx", F.struct("distance", "point_idx")).alias("point_idx"), F.min("distance").alias("distance"))


def even_limit(points: DataFrame, n: int) -> DataFrame:
    """Of N points in index order those at floor(i * N / n), i = 0..n-1; all of them if there are no more than n."""
    order = W.partitionBy("frame_id").orderBy("point_idx")
    ranked = points.withColumn("__k", F.row_number().over(order).cast("long") - 1).withColumn("__n", F.count("*").over(W.partitionBy("frame_id")))
    i = F.ceil(F.col("__k") * F.lit(n) / F.col("__n"))
    hit = F.expr(f"(cast(ceil(__k * {n} / __n) as bigint) * __n) div {n}") == F.col("__k")
    return ranked.where((F.col("__n") <= n) | ((i < n) & hit)).drop("__k", "__n")


def stride_limit(points: DataFrame, most: int) -> DataFrame:
    """Every ceil(N / most)-th point in index order."""
    ranked = points.withColumn("__k", F.row_number().over(W.partitionBy("frame_id").orderBy("point_idx")).cast("long") - 1).withColumn("__n", F.count("*").over(W.partitionBy("frame_id")))
    return ranked.where(F.col("__k") % F.ceil(F.col("__n") / most) == 0).drop("__k", "__n")


def spatial_limit(points: DataFrame, n: int, leaf: float) -> DataFrame:
    """At most n points of a frame: all, else the voxel representatives thinned evenly, or filled up: slot i of those left takes
    the point at floor(i * N / slots) of all N, or the next one (from the start after the end) that isn't taken. The slots of a frame
    follow from each other, so frames that need them are a group each, of point numbers alone."""
    sizes = points.groupBy("frame_id").agg(F.count("*").alias("__all"))
    reps = voxel_representatives(points, leaf)
    few = reps.groupBy("frame_id").agg(F.count("*").alias("__reps")).join(sizes, "frame_id")
    small = points.join(few.where(F.col("__all") <= n).select("frame_id"), "frame_id", "left_semi").select(reps.columns)
    thin = even_limit(reps.join(few.where((F.col("__all") > n) & (F.col("__reps") >= n)).select("frame_id"), "frame_id", "left_semi"), n)
    open_ = few.where((F.col("__all") > n) & (F.col("__reps") < n)).select("frame_id")
    marked = points.join(open_, "frame_id", "left_semi").select("frame_id", "point_idx").join(reps.select("frame_id", "point_idx", F.lit(True).alias("rep")).hint("merge"), ["frame_id", "point_idx"], "left")

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_idx")
        taken = frame["rep"].notna().to_numpy().copy()
        slots, size = n - int(taken.sum()), len(taken)
        for slot in range(slots):
            at = slot * size // slots
            free = np.flatnonzero(~taken[at:])
            taken[at + free[0] if len(free) else int(np.flatnonzero(~taken)[0])] = True
        return frame.loc[taken, ["frame_id", "point_idx"]]

    kept = marked.groupBy("frame_id").applyInPandas(fill, "frame_id long, point_idx long")
    filled = points.join(kept.hint("merge"), ["frame_id", "point_idx"], "left_semi").select(reps.columns)
    return small.unionByName(thin).unionByName(filled)


def frame_end_stamp(points: DataFrame, stamps: DataFrame) -> DataFrame:
    """Stamp plus the largest finite offset that isn't negative."""
    ends = points.groupBy("frame_id").agg(F.max(F.when(~F.isnan("offset_s") & (F.col("offset_s") >= 0), F.col("offset_s"))).alias("tail"))
    return stamps.join(ends, "frame_id").select("frame_id", (F.col("stamp_ns") + F.round(F.coalesce("tail", F.lit(0.0)) * 1e9).cast("long")).alias("end_ns"))


def timed_points(points: DataFrame, frames: DataFrame) -> DataFrame:
    """points with their frame's task_id and stamp_ns, usable (finite and not the invalid return) and t, the time of a usable point: null where the
    offset isn't a finite number of seconds from 0 on."""
    offset = F.col("offset_s").cast("double")
    p = points.join(frames.select("frame_id", "task_id", "stamp_ns"), "frame_id").withColumn("usable", valid_point())
    return p.withColumn("t", F.when(F.col("usable") & finite(offset) & (offset >= 0), F.col("stamp_ns") + F.round(offset * 1e9).cast("long")))


def point_poses(timed: DataFrame, frames: DataFrame, poses: DataFrame, max_gap_ns: int) -> DataFrame:
    """The poses at the different times of each frame's points, and at its own stamp: (task_id, frame_id, t, found, px, py, pz, qw, qx, qy, qz, ok). A
    frame has some thousands of points at a few dozen times, so few rows are interpolated."""
    times = timed.where("t IS NOT NULL").select("task_id", "frame_id", "t").union(frames.select("task_id", "frame_id", F.col("stamp_ns").alias("t"))).distinct()
    return interpolate_join(times, poses, max_gap_ns, ["px", "py", "pz"], quaternion=("qw", "qx", "qy", "qz"), flags=("ok",))


def transform_statistics(timed: DataFrame, at: DataFrame, frames: DataFrame, *, min_coverage: float = 0.75, max_step: float = 2.5, translate: bool = True) -> DataFrame:
    """By frame: usable, bad_time, covered and uncovered points, their ratio, the largest translation, the mode of compensation and the reason against
    the frame (NONE if there is none). at: point_poses. A frame is only rotated where its own pose is missing or has no valid place, or where
    a pose of its points has none or lies further than max_step from it."""
    own = at.join(frames.select("frame_id", "stamp_ns").hint("merge"), "frame_id").where("t = stamp_ns").select("frame_id", F.struct(F.col("found").alias("found"), F.col("ok").alias("ok"), *[F.col(c) for c in ("px", "py", "pz")]).alias("ref"))
    step = F.sqrt(sum(F.pow(F.col(c) - F.col(f"ref.{c}"), 2) for c in ("px", "py", "pz")))
    used = timed.where("t IS NOT NULL").select("frame_id", "t").distinct()
    moved = at.join(used.hint("merge"), ["frame_id", "t"], "left_semi").join(own.hint("merge"), "frame_id").where("found")
    shifts = moved.groupBy("frame_id").agg(F.max(step).alias("max_translation"), F.max((~F.col("ok") | ~finite(step) | (step > max_step)).cast("int")).alias("far"))
    counts = timed.join(at.select("frame_id", "t", "found").hint("merge"), ["frame_id", "t"], "left").groupBy("frame_id").agg(
        F.count(F.when(F.col("usable"), 1)).alias("usable"), F.count(F.when(F.col("usable") & F.col("t").isNull(), 1)).alias("bad_time"),
        F.count(F.when(F.col("found"), 1)).alias("covered"), F.count(F.when(F.col("t").isNotNull() & ~F.coalesce("found", F.lit(False)), 1)).alias("uncovered"))
    j = counts.join(own.hint("merge"), "frame_id").join(shifts.hint("merge"), "frame_id", "left")
    full = F.coalesce(F.col("ref.found") & F.col("ref.ok") & (F.coalesce("far", F.lit(0)) == 0), F.lit(False)) & F.lit(translate)
    ratio = F.when(F.col("usable") > 0, F.col("covered") / F.col("usable")).otherwise(0.0)
    reason = F.when(F.col("usable") == 0, "NO_VALID_RAW_POINTS").when(F.col("covered") == 0, "NO_POINT_POSE_COVERED").when(ratio < min_coverage, "INSUFFICIENT_POSE_COVERAGE").otherwise("NONE")
    return j.select("frame_id", "usable", "bad_time", "covered", "uncovered", ratio.alias("ratio"), F.when(F.col("ref.found") & F.col("ref.ok"), F.col("max_translation")).alias("max_translation"), F.when(full, "FULL").otherwise("ROTATION_ONLY").alias("mode"), reason.alias("reason"))


def motion_compensate(points: DataFrame, frames: DataFrame, poses: DataFrame, *, max_gap_ns: int = 15_000_000, **limits) -> tuple[DataFrame, DataFrame]:
    """(points, statistics): points of accepted frames as if all were seen at their frame's stamp: turned by the pose at their own time and shifted
    by how far it lies from the frame's pose (FULL) or turned alone (ROTATION_ONLY). The invalid return stays 0, points without a time or pose are
    NaN. points: frame_id, point_idx, x, y, z, offset_s; frames: frame_id, task_id, stamp_ns; poses: task_id, t, seq, px.., qw.., ok."""
    timed = timed_points(points, frames)
    at = stored(point_poses(timed, frames, poses, max_gap_ns), "poses")
    stats = transform_statistics(timed, at, frames, **limits)
    ref = at.join(frames.select("frame_id", "stamp_ns").hint("merge"), "frame_id").where("t = stamp_ns").select("frame_id", *[F.col(c).alias(f"r{c}") for c in ("px", "py", "pz")])
    j = timed.join(stats.where("reason = 'NONE'").select("frame_id", "mode").hint("merge"), "frame_id").join(ref.hint("merge"), "frame_id").join(at.drop("task_id", "ratio").hint("merge"), ["frame_id", "t"], "left")
    turned = R.rotate(R.quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")), *[F.col(c).cast("double") for c in "xyz"])
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0) & finite(F.col("offset_s")) & (F.col("offset_s") >= 0)
    nan = F.lit(float("nan"))
    placed = [F.when(F.coalesce(zero, F.lit(False)), 0.0).when(F.col("found"), turned[c] + F.when(F.col("mode") == "FULL", F.col(f"p{c}") - F.col(f"rp{c}")).otherwise(0.0)).otherwise(nan).cast("float").alias(c) for c in "xyz"]
    return j.select("task_id", "frame_id", "point_idx", *placed), stats


#: Columns of one plane in plane_search and detect_planes.
PLANE = "nx double, ny double, nz double, d double, tilt double, inliers long, cells long, area double, median double, p95 double, height double, east double, north double"


def plane_search(points: DataFrame, config: PlaneConfig = PlaneConfig()) -> DataFrame:
    """The rows of detect_planes, and for each frame with points in range one row more, whose plane is null: models, how many planes had enough
    inliers, and small, whether one of them has no region of the size asked for. models and small are null in the rows of planes."""
    names = [column.split()[0] for column in PLANE.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_idx")
        frame_id, p = int(frame["frame_id"].iloc[0]), frame[["x", "y", "z"]].to_numpy(float)
        rows, models, small = _planes(p, config, np.random.default_rng(frame_id & 0xFFFFFFFF))
        out = pd.DataFrame([*rows, (None,) * len(names)], columns=names)
        out.insert(0, "plane", pd.array([*range(len(rows)), None], dtype="Int32"))
        out.insert(0, "frame_id", frame_id)
        out["models"] = pd.array([None] * len(rows) + [models], dtype="Int32")
        out["small"] = pd.array([None] * len(rows) + [small], dtype="boolean")
        return out

    return points.where(in_roi(config)).groupBy("frame_id").applyInPandas(run, f"frame_id long, plane int, {PLANE}, models int, small boolean")


def detect_planes(points: DataFrame, config: PlaneConfig = PlaneConfig()) -> DataFrame:
    """Near-horizontal planes of each frame: (frame_id, plane, nx, ny, nz, d, tilt, inliers, cells, area, median, p95, height, east, north).

    Seeded by the frame's number: voxels are searched with random triples until the probability of a better one is small, the best triple is fitted to
    its voxels, and its inliers at full resolution are cut into connected regions of grid cells. Each region of enough cells is fitted again and must
    pass the tilt and residual gates; height is the lowest place of the plane over occupied cells. Inliers leave the search either way.
    """
    return plane_search(points, config).where("plane IS NOT NULL").drop("models", "small")


def plane_frames(points: DataFrame, search: DataFrame, config: PlaneConfig = PlaneConfig()) -> DataFrame:
    """(frame_id, reason, models, valid_ratio) of every frame: why it has no plane (NONE if it has one), the planes found, and its share of points in
    range. search: plane_search of the same points."""
    inside = points.groupBy("frame_id").agg(F.count(F.when(in_roi(config), 1)).alias("n"), F.count("*").alias("all"))
    told = search.groupBy("frame_id").agg(F.count("plane").alias("planes"), F.max("models").alias("models"), F.max("small").alias("small"))
    reason = F.when(F.col("n") < config.min_remaining, "TOO_FEW_VALID_POINTS").when(F.col("planes") > 0, "NONE").when(F.col("small"), "NO_PLANE_PASSED_REGION_SIZE").when(F.col("models") > 0, "NO_PLANE_PASSED_QUALITY_CHECK").otherwise("NO_PLANE_FOUND")
    return inside.join(told.hint("merge"), "frame_id", "left").select("frame_id", reason.alias("reason"), F.coalesce("models", F.lit(0)).alias("models"), (F.col("n") / F.col("all")).alias("valid_ratio"))


def _fit(p: np.ndarray) -> tuple[np.ndarray, float]:
    centre = p.mean(axis=0)
    normal = np.linalg.eigh(np.cov((p - centre).T, bias=True))[1][:, 0]
    normal = normal if normal[2] >= 0 else -normal
    return normal, float(-normal @ centre)


def _model(coarse: np.ndarray, c: PlaneConfig, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """The plane of most voxels among random triples, fitted to those voxels."""
    steep, best, inside, left = np.cos(np.radians(c.max_normal_angle)), 0, None, float(c.iterations)
    for tried in range(1, c.iterations + 1):
        a, b, e = coarse[rng.choice(len(coarse), 3, replace=False)]
        v = np.cross(b - a, e - a)
        size = np.linalg.norm(v)
        if size >= 1e-9 and abs(v[2]) / size >= steep:
            near = np.abs((coarse - a) @ (v / size)) <= c.distance
            if near.sum() > best:
                best, inside = int(near.sum()), near
                hit = (best / len(coarse)) ** 3
                left = np.log(1 - c.probability) / np.log1p(-hit) if hit < 1 else 0.0
        if tried >= left:
            break
    return None if best < 3 else _fit(coarse[inside])


def _planes(left: np.ndarray, c: PlaneConfig, rng: np.random.Generator) -> tuple[list[tuple], int, bool]:
    """(planes, models, small), as plane_search tells them, of one frame's points in range."""
    found, models, small = [], 0, False
    need = max(c.min_inliers, int(np.ceil(c.min_inlier_ratio * len(left))))
    for _ in range(c.max_planes):
        if len(left) < max(c.min_remaining, 3):
            break
        _, place = np.unique(np.floor(left / c.voxel).astype(np.int64), axis=0, return_inverse=True)
        place = place.ravel()
        n = np.bincount(place)
        coarse = np.stack([np.bincount(place, weights=left[:, k]) / n for k in range(3)], axis=1)
        model = _model(coarse, c, rng) if len(coarse) >= 3 else None
        if model is None:
            break
        normal, offset = model
        inside = np.abs(left @ normal + offset) <= c.distance
        if inside.sum() < need:
            break
        models += 1
        points, left = left[inside], left[~inside]
        regions = [] if np.degrees(np.arccos(np.clip(normal[2], -1, 1))) > c.max_normal_angle else _regions(points, c)
        small |= not regions
        for part, own in regions:
            if len(part) < 3:
                continue
            v, d = _fit(part)
            tilt, (median, p95) = float(np.degrees(np.arccos(np.clip(v[2], -1, 1)))), np.quantile(np.abs(part @ v + d), [0.5, 0.95]).tolist()
            if tilt > c.max_normal_angle or p95 > c.residual_p95:
                continue
            middle = (own + 0.5) * c.grid
            heights = -(v[0] * middle[:, 0] + v[1] * middle[:, 1] + d) / v[2]
            k = int(heights.argmin())
            if c.up_min <= heights[k] <= c.up_max:
                found.append((*v.tolist(), d, tilt, len(part), len(own), len(own) * c.grid * c.grid, median, p95, float(heights[k]), *middle[k].tolist()))
    return found, models, small


def _regions(points: np.ndarray, c: PlaneConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """(points, cells) of each connected region that has enough cells and spans enough of them both ways."""
    cells, of = np.unique(np.floor(points[:, :2] / c.grid).astype(np.int64), axis=0, return_inverse=True)
    labels, out = _components(cells), []
    for region in np.unique(labels):
        own = cells[labels == region]
        if len(own) >= c.cells and (own.max(axis=0) - own.min(axis=0) + 1).min() >= c.span_cells:
            out.append((points[labels[of.ravel()] == region], own))
    return out


def lowest_candidate(candidates: DataFrame, confidence: float = 0.55, margin: float = 0.02) -> DataFrame:
    """One candidate for each frame, in detection order: of more than the confidence, lower by more than the margin wins, and
    within the margin a plane wins over a surface. candidates: (frame_id, order, kind, height, confidence)."""
    rows = F.array_sort(F.collect_list(F.struct("order", "kind", "height", "confidence")))
    fold = lambda best, c: F.when(best.isNull() | (c["height"] < best["height"] - margin) | ((F.abs(c["height"] - best["height"]) <= margin) & (c["kind"] == "PLANE") & (best["kind"] != "PLANE")), c).otherwise(best)
    kept = candidates.where(finite(F.col("height"), F.col("confidence")) & (F.col("confidence") > confidence)).groupBy("frame_id").agg(rows.alias("c"))
    return kept.select("frame_id", F.aggregate("c", F.lit(None).cast("struct<order:bigint,kind:string,height:double,confidence:double>"), fold).alias("b")).select("frame_id", "b.*")
