"""How well a scan lies on a map: nearest neighbours through a voxel grid, surface normals, and the information of an alignment.

All but the last step are joins, aggregates and column functions; the 6 x 6 eigenvalues are found on one row a frame.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RegistrationConfig
from ..functions import rotation as R
from ..functions.geodesy import finite
from ..tables import stored
from .cloud import stride_limit, valid_point

XYZ = "xyz"
#: The upper triangle of the 6 x 6 information matrix, by rows.
TRIANGLE = [(a, b) for a in range(6) for b in range(a, 6)]


def nearest_points(queries: DataFrame, targets: DataFrame, k: int, *, cell: float = 0.5, within: float | None = None, other: bool = False) -> DataFrame:
    """(frame_id, point_idx, x, y, z, rank, near_idx, nx, ny, nz, distance): the k nearest targets of each query point in its frame, ties to the smaller number; all,
    if the frame has fewer. within: only for queries whose nearest target is no farther. other: a point's own number is no target of it.

    Queries look into the 27 cells around them. Where the k-th distance reaches beyond these cells, or targets may be missing,
    they look again with cells twice as wide, until the cells hold the frame. Work is linear in points at even density: each round joins only the queries that are
    still open, and the k best are kept before the shuffle.
    """
    targets = stored(targets.where(finite(*[F.col(c) for c in XYZ])).select("frame_id", F.col("point_idx").alias("near_idx"), *[F.col(c).cast("double").alias(f"n{c}") for c in XYZ]), "targets")
    bounds = targets.groupBy("frame_id").agg(*[f(f"n{c}").alias(f"{name}_{c}") for c in XYZ for name, f in (("low", F.min), ("high", F.max))])
    open_ = queries.where(finite(*[F.col(c) for c in XYZ])).select("frame_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ]).join(stored(bounds, "bounds").hint("merge"), "frame_id")
    open_ = stored(open_, "queries")
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for c, v in zip(XYZ, (a, b, d), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]))
    best, done = W.partitionBy("frame_id", "point_idx").orderBy("distance", "near_idx"), []
    while True:
        at = [F.floor(F.col(c) / F.lit(cell)).cast("long") for c in XYZ]
        # how far from the point the 27 cells reach in every direction, and whether they hold all the frame's targets
        reach = F.least(*[F.least(F.col(c) - (v - 1) * cell, (v + 2) * cell - F.col(c)) for c, v in zip(XYZ, at, strict=True)])
        holds = functools.reduce(Column.__and__, [(F.col(f"low_{c}") >= (v - 1) * cell) & (F.col(f"high_{c}") < (v + 2) * cell) for c, v in zip(XYZ, at, strict=True)])
        looking = open_.select("frame_id", "point_idx", *XYZ, *[v.alias(f"v{c}") for c, v in zip(XYZ, at, strict=True)]).select("frame_id", "point_idx", *XYZ, *[f"v{c}" for c in XYZ], steps.alias("s"))
        looking = looking.select("frame_id", "point_idx", *XYZ, *[(F.col(f"v{c}") + F.col(f"s.d{c}")).alias(f"v{c}") for c in XYZ])
        housed = targets.select("*", *[F.floor(F.col(f"n{c}") / F.lit(cell)).cast("long").alias(f"v{c}") for c in XYZ])
        gap = [F.col(c) - F.col(f"n{c}") for c in XYZ]
        met = looking.join(housed.hint("merge"), ["frame_id", *[f"v{c}" for c in XYZ]]).withColumn("distance", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))
        met = met.where("near_idx != point_idx") if other else met
        ranked = stored(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("frame_id", "point_idx", *XYZ, "rank", "near_idx", *[f"n{c}" for c in XYZ], "distance"), "ranked")
        found = ranked.groupBy("frame_id", "point_idx").agg(F.count("*").alias("found"), F.max("distance").alias("far"), F.min("distance").alias("near"))
        state = open_.join(found.hint("merge"), ["frame_id", "point_idx"], "left").withColumn("reach", reach).withColumn("holds", holds)
        state = state.withColumn("sure", F.col("holds") | F.coalesce((F.col("found") == k) & (F.col("far") <= F.col("reach")), F.lit(False)))
        if within is not None:
            state = state.withColumn("lost", (F.coalesce("near", F.lit(float("inf"))) > within) & (F.col("holds") | (F.col("reach") >= within)))
        else:
            state = state.withColumn("lost", F.lit(False))
        state = stored(state, "state")
        done.append(stored(ranked.join(state.where("sure AND NOT lost").select("frame_id", "point_idx").hint("merge"), ["frame_id", "point_idx"]), "near"))
        open_ = state.where("NOT sure AND NOT lost").select(open_.columns)
        if not open_.limit(1).count():
            return functools.reduce(DataFrame.unionByName, done)
        cell *= 2


def least_eigenvalue(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Of the symmetric matrix ((a, d, e), (d, b, f), (e, f, c)), in closed form."""
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    r = F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))
    return F.when(p > 0, q + 2 * p * F.cos(F.acos(r) / 3 + 2 * np.pi / 3)).otherwise(q)


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _square(u: list[Column]) -> Column:
    return u[0] * u[0] + u[1] * u[1] + u[2] * u[2]


def with_normals(rows: DataFrame) -> DataFrame:
    """rows with low (the least eigenvalue of the neighbours' scatter caa, cbb, ccc, cab, cac, cbc) and its unit vector ux, uy, uz. The vector is the largest cross product of two rows
    of the matrix less that eigenvalue; of points on a line, any vector across it."""
    rows = rows.withColumn("low", least_eigenvalue(*[F.col(c) for c in ("caa", "cbb", "ccc", "cab", "cac", "cbc")]))
    a, b, c, d, e, f, v = (F.col(n) for n in ("caa", "cbb", "ccc", "cab", "cac", "cbc", "low"))
    lines = [[a - v, d, e], [d, b - v, f], [e, f, c - v]]
    crosses = [_cross(lines[0], lines[1]), _cross(lines[0], lines[2]), _cross(lines[1], lines[2])]
    named = rows.withColumns({f"k{i}{j}": col for i, k in enumerate(crosses) for j, col in enumerate(k)} | {f"m{i}{j}": col for i, k in enumerate(lines) for j, col in enumerate(k)})
    k = [[F.col(f"k{i}{j}") for j in range(3)] for i in range(3)]
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    most, longest = F.greatest(*[_square(x) for x in k]), F.greatest(*[_square(x) for x in m])
    named = named.withColumn("most", most).withColumn("longest", longest)
    line = [F.when(_square(m[0]) == F.col("longest"), m[0][j]).when(_square(m[1]) == F.col("longest"), m[1][j]).otherwise(m[2][j]) for j in range(3)]
    across = [F.when(F.abs(line[0]) <= F.least(F.abs(line[1]), F.abs(line[2])), x).when(F.abs(line[1]) <= F.abs(line[2]), y).otherwise(z) for x, y, z in ((F.lit(0.0), -line[2], line[1]), (line[2], F.lit(0.0), -line[0]), (-line[1], line[0], F.lit(0.0)))]
    flat = F.col("most") > 1e-24 * F.col("longest") * F.col("longest")
    picked = [F.when(flat, F.when(_square(k[0]) == F.col("most"), k[0][j]).when(_square(k[1]) == F.col("most"), k[1][j]).otherwise(k[2][j])).otherwise(across[j]) for j in range(3)]
    named = named.withColumns({f"w{c}": x for c, x in zip(XYZ, picked, strict=True)})
    length = F.sqrt(_square([F.col(f"w{c}") for c in XYZ]))
    return named.select(*rows.columns, *[(F.col(f"w{c}") / length).alias(f"u{c}") for c in XYZ])


def correspondences(scan: DataFrame, cloud: DataFrame, poses: DataFrame, c: RegistrationConfig = RegistrationConfig()) -> DataFrame:
    """(frame_id, point_idx, ux, uy, uz, gx, gy, gz, residual): the scan points that lie on the map's surface: their normal, the moment of the normal about the scan's origin, and the distance
    from the plane of the nearest map points. scan and cloud: frame_id, point_idx, x, y, z; poses: frame_id, qw, qx, qy, qz, tx, ty, tz, from the scan to the map.

    A point counts if a map point is within max_distance, if it has 5 neighbours at least, and if they are flat: the least eigenvalue of their scatter is max_variation
    of all or less. Points that aren't finite or are (0, 0, 0), and frames without pose or map, have no rows.
    """
    turned = scan.where(valid_point()).join(poses.hint("merge"), "frame_id").withColumn("r", R.rotate(R.quaternion(*[F.col(f"q{k}") for k in "wxyz"]), *[F.col(k).cast("double") for k in XYZ]))
    turned = stored(turned.select("frame_id", "point_idx", *[(F.col(f"r.{k}") + F.col(f"t{k}")).alias(k) for k in XYZ], *[F.col(f"r.{k}").alias(f"r{k}") for k in XYZ]), "turned")
    near = nearest_points(turned, cloud.where(valid_point()), c.neighbours, cell=c.cell, within=c.max_distance)
    # about the query, so that the sums lose no digits
    gaps = near.select("frame_id", "point_idx", *[(F.col(f"n{k}") - F.col(k)).alias(k) for k in XYZ])
    pairs = {"aa": "xx", "bb": "yy", "cc": "zz", "ab": "xy", "ac": "xz", "bc": "yz"}
    sums = gaps.groupBy("frame_id", "point_idx").agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m{k}") for k in XYZ], *[F.sum(F.col(p[0]) * F.col(p[1])).alias(f"s{name}") for name, p in pairs.items()])
    scatter = sums.where("n >= 5").withColumns({f"c{name}": F.col(f"s{name}") - F.col("n") * F.col(f"m{p[0]}") * F.col(f"m{p[1]}") for name, p in pairs.items()})
    total = F.col("caa") + F.col("cbb") + F.col("ccc")
    flat = with_normals(scatter.where(total > 1e-12)).where(F.col("low") / total <= c.max_variation)
    u, r = [F.col(f"u{k}") for k in XYZ], [F.col(f"r{k}") for k in XYZ]
    joined = flat.join(turned.select("frame_id", "point_idx", *[f"r{k}" for k in XYZ]).hint("merge"), ["frame_id", "point_idx"])
    moment = _cross(r, u)
    return joined.select("frame_id", "point_idx", *[f"u{k}" for k in XYZ], *[g.alias(f"g{k}") for k, g in zip(XYZ, moment, strict=True)], (-(u[0] * F.col("mx") + u[1] * F.col("my") + u[2] * F.col("mz"))).alias("residual"))


def information_sums(scan: DataFrame, cloud: DataFrame, poses: DataFrame, c: RegistrationConfig = RegistrationConfig()) -> DataFrame:
    """(frame_id, evaluated, inliers, square_sum, i00 .. i55) of each frame of the scan: points looked at, points on the surface, the sum of their squared residuals and
    the 21 sums of products of (normal, moment). Of frames with more than max_points every so-manieth point is looked at."""
    thinned = stored(stride_limit(scan, c.max_points).select("frame_id", "point_idx", *XYZ), "scan")
    j = [F.col(k) for k in ("ux", "uy", "uz", "gx", "gy", "gz")]
    sums = correspondences(thinned, cloud, poses, c).groupBy("frame_id").agg(F.count("*").alias("inliers"), F.sum(F.col("residual") * F.col("residual")).alias("square_sum"), *[F.sum(j[a] * j[b]).alias(f"i{a}{b}") for a, b in TRIANGLE])
    looked = thinned.where(valid_point()).groupBy("frame_id").agg(F.count("*").alias("evaluated"))
    every = thinned.select("frame_id").distinct().join(looked.hint("merge"), "frame_id", "left").join(sums.hint("merge"), "frame_id", "left")
    return every.select("frame_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("evaluated", "inliers")], *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("square_sum", *[f"i{a}{b}" for a, b in TRIANGLE])])


def _quality(row: dict, c: RegistrationConfig) -> tuple:
    n = row["inliers"]
    none = (False, 0.0, 0.0, [0.0] * 6, 0, 0, np.eye(6).ravel().tolist())
    if n < 6:
        return none
    info = np.zeros((6, 6))
    for a, b in TRIANGLE:
        info[a, b] = info[b, a] = row[f"i{a}{b}"] / n
    fitness = row["square_sum"] / n
    if not (np.isfinite(fitness) and np.isfinite(info).all()):
        return none
    values, vectors = np.linalg.eigh(info)
    seen = values >= max(c.least_eigenvalue, c.least_relative * max(0.0, values[-1]))
    spread = np.where(seen, np.maximum(1e-10, fitness / np.maximum(values, 1e-12)), c.blind_variance)
    covariance = vectors @ np.diag(spread) @ vectors.T
    covariance[range(6), range(6)] += [c.position_noise**2] * 3 + [np.radians(c.attitude_noise_deg) ** 2] * 3
    turning = np.linalg.eigvalsh(info[3:, 3:])
    turns = int((turning >= max(c.least_eigenvalue, c.least_relative * max(0.0, turning[-1]))).sum())
    return bool(np.isfinite(covariance).all()), float(fitness), n / row["evaluated"], values.tolist(), int(seen.sum()), turns, covariance.ravel().tolist()


def alignment_quality(scan: DataFrame, cloud: DataFrame, poses: DataFrame, c: RegistrationConfig = RegistrationConfig()) -> DataFrame:
    """(frame_id, evaluated, inliers, valid, fitness, inlier_ratio, eigenvalues, dof, rotation_dof, covariance) of each frame of the scan.

    fitness is the mean squared distance from the surface; eigenvalues those of the mean information, ascending; dof counts those at or over the threshold of observability, rotation_dof those of
    the turning part alone. covariance (36 values by rows) has blind_variance along unobservable directions, and the noise floors. A frame with fewer than 6 points on the surface is
    not valid: zeros, and the identity as covariance.
    """
    names = ["valid", "fitness", "inlier_ratio", "eigenvalues", "dof", "rotation_dof", "covariance"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([_quality(r, c) for r in b.to_dict("records")], columns=names)
            yield pd.concat([b[["frame_id", "evaluated", "inliers"]].reset_index(drop=True), made], axis=1)

    sums = information_sums(scan, cloud, poses, c)
    kind = sums.schema["frame_id"].dataType.simpleString()
    return sums.mapInPandas(judge, f"frame_id {kind}, evaluated long, inliers long, valid boolean, fitness double, inlier_ratio double, eigenvalues array<double>, dof int, rotation_dof int, covariance array<double>")
