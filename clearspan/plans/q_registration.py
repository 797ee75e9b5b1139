"""Registered queries of alignments and of the inertial filter, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RegistrationConfig
from ..operators import fusion as U
from ..operators import navigation as N
from ..operators import registration as G
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}

#: Sparse points need wider correspondences than a scanner's.
LOOSE = RegistrationConfig(max_points=120, neighbours=8, cell=0.7, max_distance=0.9)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def surfaces(spark, d):
    """(map, scan, poses): a floor in each frame, a wall in two of three, and the same again as a scan that is turned and shifted."""
    e = A.table(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double") * 10
    base = e.select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_idx"), *[at(i).alias(f"e{i}") for i in range(1, 7)], (F.col("label") % 3 > 0).alias("walled"))
    wall = F.col("walled") & (F.col("point_idx") % 2 == 1)

    def face(x, y, z):
        flat = F.col(z) * 0.02
        return F.when(wall, flat + 2).otherwise(F.col(x)).alias("x"), F.col(y).alias("y"), F.when(wall, F.col(x) + 2).otherwise(flat + F.col(x) * 0.1).alias("z")

    cloud, seen = base.select("frame_id", "point_idx", *face("e1", "e2", "e3")), base.select("frame_id", "point_idx", *face("e4", "e5", "e6"))
    yaw = F.radians(F.col("frame_id") * 0.5)
    poses = seen.select("frame_id").distinct().select("frame_id", F.cos(yaw / 2).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz"), (F.col("frame_id") * 0.01).alias("tx"), F.lit(0.02).alias("ty"), F.lit(0.03).alias("tz"))
    return cloud, seen, poses


_ENTRIES = [("ux", "uy", "uz", "gx", "gy", "gz")[k] for k in range(6)]
_SUMS = ", ".join(f"round(coalesce(sum({_ENTRIES[a]} * {_ENTRIES[b]}), 0), 5) AS i{a}{b}" for a, b in G.TRIANGLE)
SURFACES = """base AS (
  SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_idx, label % 3 > 0 AND vec_id % 2 = 1 AS wall, list_transform(embedding[1:6], lambda v: CAST(v AS DOUBLE) * 10) AS e FROM embeddings),
cloud AS (SELECT frame_id, point_idx, CASE WHEN wall THEN e[3] * 0.02 + 2 ELSE e[1] END AS x, e[2] AS y, CASE WHEN wall THEN e[1] + 2 ELSE e[3] * 0.02 + e[1] * 0.1 END AS z FROM base),
placed AS (SELECT frame_id, point_idx, CASE WHEN wall THEN e[6] * 0.02 + 2 ELSE e[4] END AS x, e[5] AS y, CASE WHEN wall THEN e[4] + 2 ELSE e[6] * 0.02 + e[4] * 0.1 END AS z FROM base),
scan AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM placed)
  WHERE k % CASE WHEN n > 120 THEN greatest(1, (n + 119) // 120) ELSE 1 END = 0),
turned AS (
  SELECT frame_id, point_idx, cos(radians(frame_id * 0.5)) * x - sin(radians(frame_id * 0.5)) * y AS rx, sin(radians(frame_id * 0.5)) * x + cos(radians(frame_id * 0.5)) * y AS ry, z AS rz FROM scan),
gaps AS (
  SELECT t.frame_id, t.point_idx, rx, ry, rz, c.point_idx AS near_idx, c.x - (rx + frame_id * 0.01) AS dx, c.y - (ry + 0.02) AS dy, c.z - (rz + 0.03) AS dz FROM turned t JOIN cloud c USING (frame_id)),
ranked AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS far, row_number() OVER (PARTITION BY frame_id, point_idx ORDER BY sqrt(dx * dx + dy * dy + dz * dz), near_idx) AS rank FROM gaps),
sums AS (
  SELECT frame_id, point_idx, min(rx) AS rx, min(ry) AS ry, min(rz) AS rz, min(far) AS near, count(*) AS n, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz,
    sum(dx * dx) - count(*) * avg(dx) * avg(dx) AS a, sum(dy * dy) - count(*) * avg(dy) * avg(dy) AS b, sum(dz * dz) - count(*) * avg(dz) * avg(dz) AS c,
    sum(dx * dy) - count(*) * avg(dx) * avg(dy) AS d, sum(dx * dz) - count(*) * avg(dx) * avg(dz) AS e, sum(dy * dz) - count(*) * avg(dy) * avg(dz) AS f
  FROM ranked WHERE rank <= 8 GROUP BY frame_id, point_idx HAVING count(*) >= 5 AND min(far) <= 0.9),
q AS (SELECT *, (a + b + c) / 3 AS q FROM sums),
p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
l AS (
  SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS low
  FROM p WHERE p > 0),
crosses AS (
  SELECT *, [[d * f - e * (b - low), e * d - (a - low) * f, (a - low) * (b - low) - d * d], [d * (c - low) - e * f, e * e - (a - low) * (c - low), (a - low) * f - d * e],
    [(b - low) * (c - low) - f * f, f * e - d * (c - low), d * f - (b - low) * e]] AS k FROM l WHERE low / (a + b + c) <= 0.2),
picked AS (SELECT *, list_sort(list_transform(k, lambda v: {'s': v[1] * v[1] + v[2] * v[2] + v[3] * v[3], 'v': v}), 'DESC')[1] AS w FROM crosses),
normals AS (SELECT *, w.v[1] / sqrt(w.s) AS ux, w.v[2] / sqrt(w.s) AS uy, w.v[3] / sqrt(w.s) AS uz FROM picked),
rows_ AS (SELECT *, ry * uz - rz * uy AS gx, rz * ux - rx * uz AS gy, rx * uy - ry * ux AS gz, ux * mx + uy * my + uz * mz AS residual FROM normals)"""


@query("a22_information_sums", f"""WITH {SURFACES}
SELECT s.frame_id, evaluated, coalesce(inliers, 0) AS inliers, coalesce(square_sum, 0) AS square_sum, {", ".join(f"coalesce(i{a}{b}, 0) AS i{a}{b}" for a, b in G.TRIANGLE)}
FROM (SELECT frame_id, count(*) AS evaluated FROM scan GROUP BY 1) s
LEFT JOIN (SELECT frame_id, count(*) AS inliers, round(sum(residual * residual), 5) AS square_sum, {_SUMS} FROM rows_ GROUP BY 1) r USING (frame_id)""")
def a22_sums(spark, d):
    sums = G.information_sums(*_ordered(*surfaces(spark, d)), LOOSE)
    return sums.withColumns({k: F.round(k, 5) for k in sums.columns if k[0] == "i" and k != "inliers"} | {"square_sum": F.round("square_sum", 5)})


def _ordered(cloud, scan, poses):
    return scan, cloud, poses


@query("a22_alignment_quality")
def a22(spark, d):
    return G.alignment_quality(*_ordered(*surfaces(spark, d)), LOOSE)


@query("d14_measured_alignment")
def d14(spark, d):
    """The gates over measured alignments, a task for each third frame."""
    cloud, scan, poses = surfaces(spark, d)
    q = G.alignment_quality(scan, cloud, poses, LOOSE).join(poses.hint("merge"), "frame_id")
    rows = q.select((F.col("frame_id") % 3).alias("task_id"), F.col("frame_id").alias("seq"), "fitness", "inlier_ratio", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz")).alias("shift"), "dof",
                    F.degrees(2 * F.acos(F.least(F.abs(F.col("qw")), F.lit(1.0)))).alias("rotation_deg"), "rotation_dof", F.lit(0.2).alias("improvement"), "qw", "qx", "qy", "qz")
    return N.gate_alignment(rows)


@query("d12_fuse_navigation")
def d12(spark, d):
    """Samples as rows 5 ms apart, each eighth a fix; some steps and forces are out of bounds."""
    k, v = F.col("sample_index"), F.col("height")
    fix, yaw = k % 8 == 7, k * 0.002
    late = F.floor(k / 61) * 100_000_000
    zero = F.lit(0.0)
    rows = A.samples(spark, d).select(
        "task_id", (k * 5_000_000 + late + 1_000_000_000).cast("long").alias("t"), F.col("source_sequence").alias("seq"), fix.alias("fix"), F.when(fix, k * 0.01).otherwise(F.when(k % 97 == 50, 80.0).otherwise(v - 1)).alias("x"),
        F.when(fix, v * 0.02).otherwise(zero).alias("y"), F.when(fix, zero).otherwise(9.80665).alias("z"), F.lit(0.04).alias("variance"), F.cos(yaw / 2).alias("qw"), zero.alias("qx"), zero.alias("qy"), F.sin(yaw / 2).alias("qz"))
    return U.fuse_navigation(rows, bucket_ns=400_000_000)
