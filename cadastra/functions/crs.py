"""WGS-84, GCJ-02 and BD-09 as column expressions, and the assessment of a record's coordinate system."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the public GCJ-02 offset: axis, eccentricity, domain; terms are (amplitude, divisor of the angle).
AXIS, ECC = 6378245.0, 0.00669342162296594323
DOMAIN = (72.004, 137.8347, 0.8293, 55.8271)
LAT_POLY, LNG_POLY = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2), (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
COMMON_WAVES = ((20.0, 1 / 6), (20.0, 1 / 2))
LAT_WAVES, LNG_WAVES = ((20.0, 1.0), (40.0, 3.0), (160.0, 12.0), (320.0, 30.0)), ((20.0, 1.0), (40.0, 3.0), (150.0, 12.0), (300.0, 30.0))
#: Fixed values of the BD-09 shift.
BD_X, BD_Y, BD_R, BD_T, BD_K = 0.0065, 0.006, 0.00002, 0.000003, math.pi * 3000.0 / 180.0


def out_of_china(lng: Column, lat: Column) -> Column:
    return ~(lng.between(DOMAIN[0], DOMAIN[1]) & lat.between(DOMAIN[2], DOMAIN[3]))


def _wave(v: Column, waves: tuple[tuple[float, float], ...]) -> Column:
    return sum((F.lit(a) * F.sin(v * (math.pi / d)) for a, d in waves), F.lit(0.0)) * (2.0 / 3.0)


def _offset(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - 105.0, lat - 35.0

    def poly(k: tuple[float, ...]) -> Column:
        return F.lit(k[0]) + k[1] * x + k[2] * y + k[3] * x * x + k[4] * y * y + k[5] * x * y + k[6] * F.sqrt(F.abs(x)) + _wave(x, COMMON_WAVES)

    s = F.sin(F.radians(lat))
    m = 1 - ECC * s * s
    dlat = (poly(LAT_POLY) + _wave(y, LAT_WAVES)) * 180.0 / (AXIS * (1 - ECC) / (m * F.sqrt(m)) * math.pi)
    dlng = (poly(LNG_POLY) + _wave(x, LNG_WAVES)) * 180.0 / (AXIS / F.sqrt(m) * F.cos(F.radians(lat)) * math.pi)
    return dlng, dlat


def _shifted(lng: Column, lat: Column, sign: int) -> Column:
    dx, dy = _offset(lng, lat)
    out = out_of_china(lng, lat)
    return F.struct(F.when(out, lng).otherwise(lng + sign * dx).alias("lng"), F.when(out, lat).otherwise(lat + sign * dy).alias("lat"))


def wgs84_to_gcj02(lng: Column, lat: Column) -> Column:
    """struct(lng, lat); the identity outside the domain."""
    return _shifted(lng, lat, 1)


def gcj02_to_wgs84(lng: Column, lat: Column) -> Column:
    """struct(lng, lat), by one step of the inverse; the identity outside the domain."""
    return _shifted(lng, lat, -1)


def bd09_to_gcj02(lng: Column, lat: Column) -> Column:
    x, y = lng - BD_X, lat - BD_Y
    z = F.hypot(x, y) - BD_R * F.sin(y * BD_K)
    t = F.atan2(y, x) - BD_T * F.cos(x * BD_K)
    return F.struct((z * F.cos(t)).alias("lng"), (z * F.sin(t)).alias("lat"))


def bd09_to_wgs84(lng: Column, lat: Column) -> Column:
    g = bd09_to_gcj02(lng, lat)
    return gcj02_to_wgs84(g["lng"], g["lat"])


def transform_ring(ring: Column, to) -> Column:
    """Every vertex (x, y) of an array of points through `to`."""
    def one(p: Column) -> Column:
        q = to(p["x"], p["y"])
        return F.struct(q["lng"].alias("x"), q["lat"].alias("y"))

    return F.transform(ring, one)


def assess(lng: Column, lat: Column, cx: Column, cy: Column, nx: Column, ny: Column) -> Column:
    """struct(status, confidence, lng, lat, delta_lng, delta_lat, transform, note) of a record.

    (cx, cy) is the centroid of the polygon as delivered, (nx, ny) of the polygon transformed to WGS-84, both
    null without a polygon. NaN coordinates count as missing.
    """
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    missing = ~(ok(lng) & ok(lat)) | ((lng == 0) & (lat == 0))
    poly = ok(cx) & ok(nx)
    aligned = (F.abs(cx - lng - 0.006) < 0.003) & (F.abs(cy - lat - 0.001) < 0.003)
    extreme = (F.abs(nx - lng) > 0.05) | (F.abs(ny - lat) > 0.05)

    def row(status: str, conf: float, x: Column, y: Column, dx: Column, dy: Column, transform: str | None, note: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(conf).alias("confidence"), x.cast("double").alias("lng"), y.cast("double").alias("lat"), dx.cast("double").alias("delta_lng"), dy.cast("double").alias("delta_lat"), F.lit(transform).cast("string").alias("transform"), F.lit(note).alias("note"))

    zero = F.lit(0.0)
    return (
        F.when(missing & poly, row("SYSTEMATIC_OFFSET", 0.95, nx, ny, zero, zero, "GCJ02_TO_WGS84", "point rebuilt from polygon"))
        .when(missing, row("CRS_UNKNOWN", 0.1, zero, zero, zero, zero, None, "neither point nor polygon"))
        .when(~poly, row("CONFIRMED_WGS84", 0.85, lng, lat, zero, zero, None, "no polygon"))
        .when(aligned, row("POINT_POLYGON_CRS_CONFLICT", 0.98, lng, lat, nx - lng, ny - lat, "GCJ02_TO_WGS84", "polygon offset aligned"))
        .when(extreme, row("MIXED_CRS", 0.50, lng, lat, nx - lng, ny - lat, "GCJ02_TO_WGS84", "far apart after alignment"))
        .otherwise(row("CONFIRMED_WGS84", 0.90, lng, lat, nx - lng, ny - lat, "GCJ02_TO_WGS84", ""))
    )
