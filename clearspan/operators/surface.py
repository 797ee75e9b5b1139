"""Curved surfaces in point-cloud frames, and the choice among planes and surfaces.

Fits, cells, scores and choices are aggregates by frame or cluster. Normals and region growing look at neighbours inside one frame, which
the adaptive voxel keeps under max_points, so they run as a grouped map of bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PlaneConfig, SurfaceConfig
from ..functions.geodesy import finite
from ..tables import stored
from .cloud import in_roi, lowest_candidate, plane_frames, plane_search, voxel_centroids
from .registration import nearest_points

MOMENTS = ["ee", "en", "nn", "e", "n", "one"]


def quadratic_fit(points: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Coefficients a..f of U = a E^2 + b E N + c N^2 + d E + e N + f about each key's mean place (east0, north0), by least squares; keys whose places don't determine
    all six have no row. Two aggregates: the means, then the sums of 27 products; a 6 x 6 system is solved for each key."""
    means = points.groupBy(*keys).agg(F.avg("x").alias("east0"), F.avg("y").alias("north0"), F.count("*").alias("n"))
    p = points.join(means, list(keys)).withColumns({"e": F.col("x") - F.col("east0"), "n_": F.col("y") - F.col("north0")})
    e, n = F.col("e"), F.col("n_")
    terms = dict(zip(MOMENTS, (e * e, e * n, n * n, e, n, F.lit(1.0)), strict=True))
    pairs = [(a, b) for i, a in enumerate(MOMENTS) for b in MOMENTS[i:]]
    sums = p.groupBy(*keys).agg(F.first("east0").alias("east0"), F.first("north0").alias("north0"), *[F.sum(terms[a] * terms[b]).alias(f"s_{a}_{b}") for a, b in pairs], *[F.sum(terms[a] * F.col("z")).alias(f"t_{a}") for a in MOMENTS])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                m = np.array([[row[f"s_{x}_{y}" if (x, y) in pairs else f"s_{y}_{x}"] for y in MOMENTS] for x in MOMENTS])
                size = np.sqrt(np.maximum(np.diag(m), 1e-300))
                scaled = m / size[:, None] / size[None, :]
                if np.linalg.matrix_rank(scaled, tol=1e-10) == 6:
                    out.append((*[row[k] for k in keys], row["east0"], row["north0"], *(np.linalg.solve(scaled, np.array([row[f"t_{x}"] for x in MOMENTS]) / size) / size).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "east0", "north0", *"abcdef"])

    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, schema + ", east0 double, north0 double, " + ", ".join(f"{c} double" for c in "abcdef"))


def model_height(x: Column, y: Column) -> Column:
    """The fitted surface (columns of quadratic_fit) at a place."""
    e, n = x - F.col("east0"), y - F.col("north0")
    return F.col("a") * e * e + F.col("b") * e * n + F.col("c") * n * n + F.col("d") * e + F.col("e") * n + F.col("f")


def min_over_cells(cells: DataFrame, fits: DataFrame, size: float, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The lowest height of each key's surface at the middle of its occupied cells (keys, cx, cy): east, north, height. Nothing is extrapolated."""
    x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    j = cells.join(fits, list(keys)).withColumns({"__x": x, "__y": y}).withColumn("__h", model_height(F.col("__x"), F.col("__y")))
    best = F.min_by(F.struct(F.col("__x").alias("east"), F.col("__y").alias("north"), F.col("__h").alias("height")), F.struct("__h", "cx", "cy"))
    return j.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def _share(value: Column, most: float) -> Column:
    return F.greatest(F.least(value / most, F.lit(1.0)), F.lit(0.0))


def surface_confidence(c: SurfaceConfig) -> Column:
    """The weighted score of a cluster (columns points, cells, span, p95, curvature, down), each part from 0 to 1. The weights are fixed values."""
    return (0.15 * _share(F.col("points"), 2.0 * c.min_cluster_points) + 0.15 * _share(F.col("cells"), 2.0 * c.min_cells) + 0.10 * _share(F.col("span"), 2.0 * c.min_span)
        + 0.25 * _share(1 - F.col("p95") / c.max_p95, 1.0) + 0.15 * _share(1 - F.col("curvature") / c.max_curvature, 1.0) + 0.20 * _share(F.col("down") - c.min_down, 1.0 - c.min_down))


def candidate_from_plane(planes: DataFrame) -> DataFrame:
    """Planes (nx, ny, nz, d) in the form of surfaces: d, e, f of their height, no curvature, and full confidence, as their checks are behind them."""
    flat = F.abs(F.col("nz")) > 2.220446049250313e-16
    form = {"a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(0.0), "e": F.when(flat, -F.col("ny") / F.col("nz")).otherwise(0.0), "f": F.when(flat, -F.col("d") / F.col("nz")).otherwise(0.0)}
    return planes.withColumns(form).withColumn("d", F.when(flat, -F.col("nx") / F.col("nz")).otherwise(0.0)).withColumns({"kind": F.lit("PLANE"), "confidence": F.lit(1.0)})


def lowest_plane(planes: DataFrame) -> DataFrame:
    """The lowest plane of each frame."""
    best = F.min_by(F.struct("plane", "height", "east", "north"), F.struct("height", "plane"))
    return planes.groupBy("frame_id").agg(best.alias("p")).select("frame_id", "p.*")


def adaptive_voxel(points: DataFrame, leaf: float, most: int, tries: int = 4) -> DataFrame:
    """Voxel centroids (frame_id, point_idx, x, y, z) of each frame, at most so many: frames over the bound get a larger voxel, by the cube root of their excess, up
    to tries times, then a stride. The driver sees the number of frames left over, no points."""
    sizes = stored(points.select("frame_id").distinct().withColumn("leaf", F.lit(float(leaf))), "leaves")
    done, last = None, None
    for k in range(tries):
        cells = [F.floor(F.col(c) / F.col("leaf")).cast("long").alias(f"v{c}") for c in "xyz"]
        made = stored(_with_frames(points, sizes).groupBy("frame_id", "leaf", *cells).agg(*[F.avg(c).alias(c) for c in "xyz"]).drop("vx", "vy", "vz"), "voxels")
        counts = stored(made.groupBy("frame_id", "leaf").agg(F.count("*").alias("n")), "counts")
        over = stored(counts.where(F.col("n") > most), "over")
        fit = _with_frames(made, counts.where(F.col("n") <= most).select("frame_id"))
        done = fit if done is None else done.unionByName(fit)
        last = None if over.isEmpty() else _with_frames(made, over.select("frame_id", "n"))
        if last is None:
            break
        sizes = over.select("frame_id", (F.col("leaf") * F.greatest(F.lit(1.1), F.cbrt(F.col("n") / most) * 1.05)).alias("leaf"))
    place = F.row_number().over(W.partitionBy("frame_id").orderBy("x", "y", "z")).cast("long")
    numbered = done.withColumn("point_idx", place).select("frame_id", "point_idx", "x", "y", "z")
    if last is None:
        return numbered
    strided = _numbered(last).where((F.col("point_idx") - 1) % F.ceil(F.col("n") / most) == 0)
    return numbered.unionByName(strided.select("frame_id", "point_idx", "x", "y", "z"))


#: Tables of a row for each frame are broadcast up to so many rows, counted first.
FEW_FRAMES = 100_000
#: Rows of a range in which a part of a frame is numbered.
RANGE_ROWS = 100_000


def _with_frames(points: DataFrame, frames: DataFrame) -> DataFrame:
    """points joined with a row for each frame (few columns, read from the shared folder); a frame's points stay where they are, so that none lies in one task whole."""
    return points.join(frames.hint("broadcast" if frames.count() <= FEW_FRAMES else "merge"), "frame_id")


def _numbered(points: DataFrame) -> DataFrame:
    """points with point_idx, their number from 1 in their frame by place. Ranges of all points are numbered by themselves, and a window over one row for each frame and range gives what lies before."""
    order = ["frame_id", "x", "y", "z"]
    ranged = stored(points.repartitionByRange(points.count() // RANGE_ROWS + 1, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("own").over(W.partitionBy("frame_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("frame_id", "range").agg(F.count("*").alias("own")).withColumn("before", before).drop("own")
    place = F.row_number().over(W.partitionBy("frame_id", "range").orderBy("x", "y", "z"))
    return ranged.join(sizes.hint("merge"), ["frame_id", "range"]).withColumn("point_idx", F.col("before") + place).drop("range", "before")


def nearest(p: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest points of each point, itself first, in blocks of distances."""
    out = []
    for at in range(0, len(p), 512):
        far = ((p[at : at + 512, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        near = np.argpartition(far, min(k, len(p)) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, axis=1)), axis=1), axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def knn(points: DataFrame, k: int = 20, cell: float = 0.5) -> DataFrame:
    """(frame_id, point_idx, rank, near_idx, distance): the k nearest other points of each point in its frame, ties to the smaller number, through a voxel grid."""
    return nearest_points(points, points, k, cell=cell, other=True).select("frame_id", "point_idx", "rank", "near_idx", "distance")


def normals_of(p: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals that look at the origin, and the share of the least eigenvalue, from each point's neighbours."""
    around = p[near] - p[near].mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", around, around) / near.shape[1])
    normal, total = vectors[:, :, 0], values.sum(axis=1)
    normal = np.where((normal * p).sum(axis=1, keepdims=True) > 0, -normal, normal)
    with np.errstate(invalid="ignore", divide="ignore"):
        return normal, np.where(total > 0, np.abs(values[:, 0] / total), 0.0)


def _regions(normal: np.ndarray, curvature: np.ndarray, near: np.ndarray, c: SurfaceConfig) -> np.ndarray:
    """Region numbers (-1: none): grown from the flattest points over neighbours whose normals turn by no more than the smoothness."""
    label, smooth, number = np.full(len(normal), -1), np.cos(np.radians(c.smoothness)), 0
    for start in np.argsort(curvature, kind="stable"):
        if label[start] >= 0:
            continue
        label[start], todo = number, [start]
        while todo:
            i = todo.pop(0)
            fresh = near[i][label[near[i]] < 0]
            fresh = fresh[np.abs(normal[fresh] @ normal[i]) >= smooth]
            label[fresh] = number
            todo += fresh[curvature[fresh] <= c.curvature].tolist()
        number += 1
    return label


def surface_clusters(points: DataFrame, c: SurfaceConfig = SurfaceConfig()) -> DataFrame:
    """(frame_id, cluster, point_idx, x, y, z, nx, ny, nz, curvature): the points of smooth regions of min_cluster_points or more. points: those of adaptive_voxel."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_idx")
        p = frame[["x", "y", "z"]].to_numpy(float)
        empty = pd.DataFrame(columns=["frame_id", "cluster", "point_idx", "x", "y", "z", "nx", "ny", "nz", "curvature"])
        if len(p) < c.min_cluster_points:
            return empty
        near = nearest(p, min(c.neighbours, len(p) - 1))
        normal, curvature = normals_of(p, near)
        label = _regions(normal, curvature, near, c)
        sizes = np.bincount(label)
        kept = sizes[label] >= c.min_cluster_points
        out = frame.assign(cluster=label, nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], curvature=curvature).loc[kept]
        return out[list(empty.columns)]

    return points.select("frame_id", "point_idx", "x", "y", "z").groupBy("frame_id").applyInPandas(run, "frame_id long, cluster int, point_idx long, x double, y double, z double, nx double, ny double, nz double, curvature double")


def surface_candidates(clusters: DataFrame, c: SurfaceConfig = SurfaceConfig()) -> DataFrame:
    """The clusters that pass their gates (size, span, looking down, cells, residual, curvature, height), with coefficients, lowest place and confidence: aggregates by cluster."""
    keys = ("frame_id", "cluster")
    size = F.sqrt(sum(F.pow(F.avg(a), 2) for a in ("nx", "ny", "nz")))
    shape = clusters.groupBy(*keys).agg(F.count("*").alias("points"), (F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"), (-F.avg("nz") / size).alias("down"), F.percentile("curvature", F.lit(0.95)).alias("curvature"))
    shape = shape.withColumn("span", F.least("sx", "sy")).where((F.col("points") >= c.min_cluster_points) & (F.col("span") >= c.min_span) & (F.col("down") >= c.min_down) & (F.col("curvature") <= c.max_curvature))
    own = clusters.drop("curvature").join(shape.select(*keys), list(keys))
    fits = quadratic_fit(own, keys)
    off = own.join(fits, list(keys)).withColumn("off", F.abs(F.col("z") - model_height(F.col("x"), F.col("y")))).groupBy(*keys).agg(F.percentile("off", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    cells = own.select(*keys, F.floor(F.col("x") / c.grid).cast("long").alias("cx"), F.floor(F.col("y") / c.grid).cast("long").alias("cy")).distinct()
    counts = cells.groupBy(*keys).agg(F.count("*").alias("cells"))
    j = shape.join(fits.hint("merge"), list(keys)).join(off.hint("merge"), list(keys)).join(counts.hint("merge"), list(keys)).join(min_over_cells(cells, fits, c.grid, keys).hint("merge"), list(keys))
    j = j.withColumns({"median": F.col("q")[0], "p95": F.col("q")[1], "area": F.col("cells") * c.grid * c.grid, "tilt": F.degrees(F.acos(F.greatest(F.least("down", F.lit(1.0)), F.lit(-1.0))))})
    passed = j.where((F.col("cells") >= c.min_cells) & (F.col("p95") <= c.max_p95) & F.col("height").between(c.up_min, c.up_max))
    return passed.withColumns({"kind": F.lit("SURFACE"), "confidence": surface_confidence(c)}).select(*keys, "kind", *"abcdef", "east0", "north0", "height", "east", "north", "points", "cells", "area", "tilt", "median", "p95", "curvature", "confidence")


def detect_surfaces(points: DataFrame, c: SurfaceConfig = SurfaceConfig()) -> tuple[DataFrame, DataFrame]:
    """(candidates, frames): curved surfaces of each frame, and by frame the reason if it has none."""
    roi = points.where(in_roi(PlaneConfig(up_min=c.up_min, up_max=c.up_max, half_angle_east=c.half_angle_east, half_angle_north=c.half_angle_north, min_range=c.min_range)))
    small = adaptive_voxel(roi, c.voxel, c.max_points)
    clusters = stored(surface_clusters(small, c), "clusters")
    found = stored(surface_candidates(clusters, c), "surfaces")
    count = lambda df, name: df.groupBy("frame_id").agg(F.count("*").alias(name))
    frames = points.select("frame_id").distinct()
    for df, name in ((roi, "n_roi"), (small, "n_small"), (clusters, "n_clustered"), (found, "n_found")):
        frames = frames.join(count(df, name).hint("merge"), "frame_id", "left")
    n = lambda name: F.coalesce(name, F.lit(0))
    reason = F.when(n("n_roi") < c.min_cluster_points, "TOO_FEW_SURFACE_ROI_POINTS").when(n("n_small") < c.min_cluster_points, "TOO_FEW_SURFACE_DOWNSAMPLED_POINTS").when(n("n_clustered") == 0, "NO_SURFACE_CLUSTER").when(n("n_found") == 0, "NO_SURFACE_PASSED_QUALITY_CHECK").otherwise("NONE")
    return found, frames.select("frame_id", reason.alias("reason"))


def choose_results(planes: DataFrame, plane_frames: DataFrame, surfaces: DataFrame, surface_frames: DataFrame, c: SurfaceConfig = SurfaceConfig(), *, rate_limited: bool = False) -> DataFrame:
    """One row for each frame of plane_frames (frame_id, reason, and columns that are carried): the chosen candidate with its measures, planes before
    surfaces, or the reason there is none. Frames that surface_frames lacks were not searched for surfaces; if that is for a limit of rate, those
    of them without a plane give no row, as their result is left to the next search."""
    measures = ["points", "area", "tilt", "median", "p95", "east", "north"]
    flat = candidate_from_plane(planes).withColumnRenamed("inliers", "points").select("frame_id", F.col("plane").cast("long").alias("order"), "kind", "height", "confidence", *measures)
    curved = surfaces.select("frame_id", (F.lit(1 << 20) + F.col("cluster")).cast("long").alias("order"), "kind", "height", "confidence", *measures)
    every = stored(flat.unionByName(curved).where(finite(F.col("height"), F.col("confidence"))), "candidates")
    chosen = lowest_candidate(every.drop(*measures), c.min_confidence, c.margin).join(every.select("frame_id", "order", *measures).hint("merge"), ["frame_id", "order"])
    accepted = every.where(F.col("confidence") > c.min_confidence).groupBy("frame_id").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("kind") == "SURFACE", 1)).alias("surfaces"))
    carried = [name for name in plane_frames.columns if name not in ("frame_id", "reason")]
    searched = surface_frames.select("frame_id", F.col("reason").alias("s"))
    j = plane_frames.withColumnRenamed("reason", "p").join(searched.hint("merge"), "frame_id", "left").join(chosen.hint("merge"), "frame_id", "left").join(accepted.hint("merge"), "frame_id", "left")
    if rate_limited:
        j = j.where("s IS NOT NULL OR p = 'NONE'")
    reason = F.when(F.col("height").isNotNull(), "NONE").when(F.col("s").isNull(), F.col("p")).when(F.col("s") == "NONE", "NO_CANDIDATE_ABOVE_CONFIDENCE").otherwise(F.concat(F.lit("PLANE:"), "p", F.lit("|SURFACE:"), "s"))
    return j.select("frame_id", F.col("height").isNotNull().alias("valid"), "kind", "height", *measures, F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("surfaces", F.lit(0)).alias("surfaces"), *carried, reason.alias("reason"))


def clearance_results(points: DataFrame, planes: PlaneConfig = PlaneConfig(), surfaces: SurfaceConfig = SurfaceConfig()) -> DataFrame:
    """Both searches of every frame and the choice among what they find."""
    search = stored(plane_search(points, planes), "planes")
    curved, curved_frames = detect_surfaces(points, surfaces)
    found = search.where("plane IS NOT NULL").drop("models", "small")
    return choose_results(found, plane_frames(points, search, planes), curved, curved_frames, surfaces)
