"""Metres from degrees: four conventions, named; each operator says which one it uses.

flat       111 320 (or 111 000) metres a degree, longitude by cosine: quick checks, fallbacks
midlat     fixed values of 40 degrees, longitude by cosine: geometry quality and pair distance
series     ellipsoidal series: boxes, buffers, areas and perimeters
utm        projected transverse Mercator (Krueger series): metric areas and distances
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the conventions and of the WGS-84 ellipsoid.
FLAT_M, FLAT_ROUGH_M = 111_320.0, 111_000.0
MIDLAT_LAT_M, MIDLAT_LNG_M = 111_132.954, 111_412.84
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
UTM_K0, UTM_FALSE_EAST = 0.9996, 500_000.0


def midlat_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance by the midlat convention at the mean latitude."""
    dx = (x1 - x2) * F.lit(MIDLAT_LNG_M) * F.cos(F.radians((y1 + y2) / 2))
    return F.hypot(dx, (y1 - y2) * F.lit(MIDLAT_LAT_M))


def lat_m(lat: Column) -> Column:
    """Metres a degree of latitude by the series."""
    r = F.radians(lat)
    return F.lit(111_132.954) - F.lit(559.822) * F.cos(2 * r) + F.lit(1.175) * F.cos(4 * r)


def lng_m(lat: Column) -> Column:
    """Metres a degree of longitude on the ellipsoid."""
    r = F.radians(lat)
    return F.lit(WGS84_A * math.pi / 180) * F.cos(r) / F.sqrt(1 - F.lit(WGS84_E2) * F.sin(r) * F.sin(r))


def degree_offsets(metres: Column, lat: Column) -> Column:
    """struct(dlat, dlng): the degrees that `metres` span."""
    return F.struct((metres / lat_m(lat)).alias("dlat"), (metres / (lng_m(lat) + F.lit(1e-12))).alias("dlng"))


def buffer_degrees(metres: Column, lat: Column) -> Column:
    """The smaller of both offsets."""
    return F.least(metres / lat_m(lat), metres / (lng_m(lat) + F.lit(1e-12)))


def box_around(lng: Column, lat: Column, half_m: Column) -> Column:
    """struct(x0, y0, x1, y1) around a centre, to six decimals."""
    d = degree_offsets(half_m, lat)
    r = lambda c: F.round(c, 6)
    return F.struct(r(lng - d["dlng"]).alias("x0"), r(lat - d["dlat"]).alias("y0"), r(lng + d["dlng"]).alias("x1"), r(lat + d["dlat"]).alias("y1"))


def series_area(degrees2: Column, lat: Column) -> Column:
    return degrees2 * lat_m(lat) * lng_m(lat)


def series_length(degrees: Column, lat: Column) -> Column:
    return degrees * F.sqrt(lat_m(lat) * lng_m(lat))


def local_plane(lng: Column, lat: Column, lng0: float = 116.40, lat0: float = 39.90) -> Column:
    """struct(x, y): metres on a flat plane around (lng0, lat0)."""
    return F.struct(((lng - lng0) * FLAT_M * math.cos(math.radians(lat0))).alias("x"), ((lat - lat0) * FLAT_M).alias("y"))


def utm_zone(lng: Column) -> Column:
    return F.least(F.lit(60), F.floor((lng + 180) / 6).cast("int") + 1)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and coefficients of the Krueger series to the fourth order in the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, alpha, beta


def utm_forward(lng: Column, lat: Column, zone: Column | None = None) -> Column:
    """struct(east, north) in metres of the northern UTM zone (that of `lng` unless given)."""
    radius, alpha, _ = _series()
    zone = utm_zone(lng) if zone is None else zone
    e = math.sqrt(WGS84_E2)
    lam = F.radians(lng - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((UTM_K0 * radius * east + UTM_FALSE_EAST).alias("east"), (UTM_K0 * radius * north).alias("north"))


def utm_inverse(east: Column, north: Column, zone: Column) -> Column:
    """struct(lng, lat) of a point of a northern UTM zone."""
    radius, _, beta = _series()
    e = math.sqrt(WGS84_E2)
    xi0, eta0 = north / (UTM_K0 * radius), (east - UTM_FALSE_EAST) / (UTM_K0 * radius)
    xi, eta = xi0, eta0
    for k, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    # the latitude from the conformal one, by fixed-point steps (each gains two digits and more)
    phi = chi
    for _ in range(5):
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + e * F.atanh(e * F.sin(phi))))
    return F.struct((F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183)).alias("lng"), F.degrees(phi).alias("lat"))


#: The two extents of the profile whose metric system is selected without asking.
CORE_EXTENT, WIDE_EXTENT = (115.4, 39.4, 117.5, 41.1), (115.0, 39.0, 118.0, 41.5)


def select_crs(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(epsg, valid, method): the projected system for a box. Inside the profile's extent its zone 50; else
    the zone of both edges where they agree; across zones, or outside the globe, none (valid is false, and
    callers must not measure)."""
    inside = (x0 >= CORE_EXTENT[0]) & (y0 >= CORE_EXTENT[1]) & (x1 <= CORE_EXTENT[2]) & (y1 <= CORE_EXTENT[3])
    globe = x0.between(-180, 180) & x1.between(-180, 180) & y0.between(0, 84) & y1.between(0, 84)
    pick = lambda e, v, m: F.struct(e.cast("int").alias("epsg"), F.lit(v).alias("valid"), F.lit(m).alias("method"))
    return F.when(inside, pick(F.lit(32650), True, "PROFILE")).when(globe & (utm_zone(x0) == utm_zone(x1)), pick(F.lit(32600) + utm_zone(x0), True, "AUTO_UTM")).otherwise(pick(F.lit(None), False, "UNRESOLVED"))


def snap_degrees(metres: float, lng: Column, lat: Column, lng0: float = 116.4) -> Column:
    """Degrees that an easting of `metres` spans at longitude lng0 (zone 50); outside the profile's extent
    metres / FLAT_M. It is used on both axes alike."""
    p = utm_forward(F.lit(lng0), lat, F.lit(50))
    moved = utm_inverse(p["east"] + metres, p["north"], F.lit(50))
    inside = lng.between(CORE_EXTENT[0], CORE_EXTENT[2]) & lat.between(CORE_EXTENT[1], CORE_EXTENT[3])
    return F.when(inside, F.abs(moved["lng"] - lng0)).otherwise(F.lit(metres / FLAT_M))
