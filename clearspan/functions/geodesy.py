"""Geodetic conversions as column expressions (WGS-84). Places with a non-finite part or a latitude beyond 90 give NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84. Fixed values.
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
B = A * (1.0 - FLATTENING)
E2 = FLATTENING * (2.0 - FLATTENING)
EP2 = E2 / (1.0 - E2)
# Ellipsoid and bounding box of the shifted map datum. Fixed values.
SHIFT_A, SHIFT_E2 = 6378245.0, 0.00669342162296594323
SHIFT_BOX = (0.8293, 55.8271, 72.004, 137.8347)
KNOT = 0.5144444444444445


def finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def _guard(ok: Column, **values: Column) -> Column:
    return F.struct(*[F.when(ok, v).otherwise(F.lit(float("nan"))).alias(n) for n, v in values.items()])


def wrap_degrees(c: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def wrap_radians(c: Column) -> Column:
    """To (-pi, pi]."""
    turned = F.pmod(c + math.pi, F.lit(2 * math.pi))
    return F.when(turned == 0.0, math.pi).otherwise(turned - math.pi)


def wrap_360(c: Column) -> Column:
    return F.pmod(c, F.lit(360.0))


def course_to_yaw(course_deg: Column) -> Column:
    """A course clockwise from north as a yaw from east, counter-clockwise, in radians."""
    return wrap_radians(F.radians(90.0 - course_deg))


def yaw_to_course(yaw: Column) -> Column:
    return wrap_360(90.0 - F.degrees(yaw))


def llh_to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1.0 - E2 * F.sin(phi) * F.sin(phi))
    ok = finite(lat, lon, alt) & (F.abs(lat) <= 90)
    return _guard(ok, x=(n + alt) * F.cos(phi) * F.cos(lam), y=(n + alt) * F.cos(phi) * F.sin(lam), z=(n * (1 - E2) + alt) * F.sin(phi))


def ecef_to_llh(x: Column, y: Column, z: Column) -> Column:
    """The closed form with one auxiliary angle; the earth's centre gives NaN."""
    p = F.hypot(x, y)
    theta = F.atan2(z * A, p * B)
    phi = F.atan2(z + EP2 * B * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    n = A / F.sqrt(1.0 - E2 * F.sin(phi) * F.sin(phi))
    ok = finite(x, y, z) & ~((p <= 1e-9) & (F.abs(z) <= 1e-9))
    return _guard(ok, lat=F.degrees(phi), lon=wrap_degrees(F.degrees(F.atan2(y, x))), alt=p / F.greatest(F.cos(phi), F.lit(1e-15)) - n)


def llh_to_enu(lat0: Column, lon0: Column, alt0: Column, lat: Column, lon: Column, alt: Column) -> Column:
    o, t = llh_to_ecef(lat0, lon0, alt0), llh_to_ecef(lat, lon, alt)
    dx, dy, dz = t["x"] - o["x"], t["y"] - o["y"], t["z"] - o["z"]
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return F.struct((cl * dy - sl * dx).alias("east"), (cp * dz - sp * cl * dx - sp * sl * dy).alias("north"), (cp * cl * dx + cp * sl * dy + sp * dz).alias("up"))


def enu_to_llh(lat0: Column, lon0: Column, alt0: Column, east: Column, north: Column, up: Column) -> Column:
    o = llh_to_ecef(lat0, lon0, alt0)
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return ecef_to_llh(o["x"] - sl * east - sp * cl * north + cp * cl * up, o["y"] + cl * east - sp * sl * north + cp * sl * up, o["z"] + cp * north + sp * up)


def horizontal_norm(east: Column, north: Column) -> Column:
    return F.when(finite(east, north), F.hypot(east, north)).otherwise(F.lit(float("nan")))


def _wave(v: Column, terms: list[tuple[float, float]]) -> Column:
    """2/3 of a sum of weight * sin(v * pi * rate)."""
    return sum(w * F.sin(v * (math.pi * rate)) for w, rate in terms) * (2.0 / 3.0)


def wgs84_to_map(lat: Column, lon: Column) -> Column:
    """The shifted datum of the map tiles; places outside its box stay."""
    lo, hi, west, east = SHIFT_BOX
    x, y = lon - 105.0, lat - 35.0
    ripple = _wave(x, [(20.0, 6.0), (20.0, 2.0)])
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + ripple + _wave(y, [(20.0, 1.0), (40.0, 1 / 3)]) + _wave(y, [(160.0, 1 / 12), (320.0, 1 / 30)])
    side = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + ripple + _wave(x, [(20.0, 1.0), (40.0, 1 / 3)]) + _wave(x, [(150.0, 1 / 12), (300.0, 1 / 30)])
    m = 1 - SHIFT_E2 * F.pow(F.sin(F.radians(lat)), 2)
    dlat = F.degrees(north / (SHIFT_A * (1 - SHIFT_E2) / (m * F.sqrt(m))))
    dlon = F.degrees(side / (SHIFT_A / F.sqrt(m) * F.cos(F.radians(lat))))
    outside = (lon < west) | (lon > east) | (lat < lo) | (lat > hi)
    return F.struct(F.when(outside, lat).otherwise(lat + dlat).alias("lat"), F.when(outside, lon).otherwise(lon + dlon).alias("lon"))


def rigid_2d(x: Column, y: Column, yaw: Column, tx: Column, ty: Column) -> Column:
    """Local to global."""
    return F.struct((F.cos(yaw) * x - F.sin(yaw) * y + tx).alias("x"), (F.sin(yaw) * x + F.cos(yaw) * y + ty).alias("y"))


def rigid_2d_inverse(x: Column, y: Column, yaw: Column, tx: Column, ty: Column) -> Column:
    """Global to local."""
    return F.struct((F.cos(yaw) * (x - tx) + F.sin(yaw) * (y - ty)).alias("x"), (F.cos(yaw) * (y - ty) - F.sin(yaw) * (x - tx)).alias("y"))


def lateral_coordinate(x: Column, y: Column, heading_deg: Column) -> Column:
    """Across the direction of travel; x where there is no heading."""
    h = F.radians(heading_deg)
    return F.when(finite(heading_deg), x * F.cos(h) - y * F.sin(h)).otherwise(x)
