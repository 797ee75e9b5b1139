"""Quaternions (structs w, x, y, z) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def normalise(q: Column) -> Column:
    n = F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    return quaternion(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n)


def multiply(a: Column, b: Column) -> Column:
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"])


def from_yaw(yaw: Column) -> Column:
    return quaternion(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def yaw_of(q: Column) -> Column:
    return F.atan2(2 * (q["w"] * q["z"] + q["x"] * q["y"]), 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]))


def dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def angular_distance(a: Column, b: Column) -> Column:
    return 2 * F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0)))


def slerp_weights(raw: Column, ratio: Column) -> tuple[Column, Column]:
    """Weights of two quaternions whose dot product is raw, the short way round; nearly equal ones are mixed in a straight line."""
    d, sign = F.abs(raw), F.when(raw < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(d, F.lit(1.0)))
    near = d > 0.9995
    wa = F.when(near, 1 - ratio).otherwise(F.sin((1 - ratio) * angle) / F.sin(angle))
    return wa, F.when(near, ratio).otherwise(F.sin(ratio * angle) / F.sin(angle)) * sign


def slerp(a: Column, b: Column, ratio: Column) -> Column:
    """The short way round between two quaternions."""
    wa, wb = slerp_weights(dot(a, b), ratio)
    return normalise(quaternion(*[a[c] * wa + b[c] * wb for c in "wxyz"]))


def rotate(q: Column, x: Column, y: Column, z: Column) -> Column:
    """A point turned by a unit quaternion."""
    w, i, j, k = q["w"], q["x"], q["y"], q["z"]
    return F.struct(
        ((1 - 2 * (j * j + k * k)) * x + 2 * (i * j - w * k) * y + 2 * (i * k + w * j) * z).alias("x"),
        (2 * (i * j + w * k) * x + (1 - 2 * (i * i + k * k)) * y + 2 * (j * k - w * i) * z).alias("y"),
        (2 * (i * k - w * j) * x + 2 * (j * k + w * i) * y + (1 - 2 * (i * i + j * j)) * z).alias("z"))


def vehicle_angles(q: Column) -> Column:
    """Pitch, roll and heading (clockwise from the y axis, 0..360) in degrees of the rotation of q."""
    w, x, y, z = q["w"], q["x"], q["y"], q["z"]
    r11 = 1 - 2 * (x * x + z * z)
    r01 = 2 * (x * y - w * z)
    r21, r20, r22 = 2 * (y * z + w * x), 2 * (x * z - w * y), 1 - 2 * (x * x + y * y)
    return F.struct(F.degrees(F.asin(F.greatest(F.least(r21, F.lit(1.0)), F.lit(-1.0)))).alias("pitch"), F.degrees(F.atan2(-r20, r22)).alias("roll"), F.pmod(F.degrees(F.atan2(r01, r11)), F.lit(360.0)).alias("heading"))


def project_axis(q: Column, axis: tuple[float, float, float]) -> Column:
    """A body axis on the horizontal plane as a unit vector; null if it is steeper than a horizontal part of 0.2."""
    v = rotate(q, *[F.lit(float(a)) for a in axis])
    n = F.hypot(v["x"], v["y"])
    return F.when(n >= 0.2, F.struct((v["x"] / n).alias("x"), (v["y"] / n).alias("y")))


def proper_rotation(m: list[Column], tolerance: float = 1e-6) -> Column:
    """Whether nine numbers by row are orthonormal rows with determinant 1."""
    rows = [m[0:3], m[3:6], m[6:9]]
    ok = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(sum(a * b for a, b in zip(rows[i], rows[j], strict=True)) - (1.0 if i == j else 0.0)) <= tolerance)
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return ok & (F.abs(det - 1.0) <= tolerance)
