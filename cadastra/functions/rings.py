"""Polygons as arrays of points: parsing and measures on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _NUMBER, _POLYGON, let
from .metres import MIDLAT_LAT_M, MIDLAT_LNG_M


def ring_of(wkt: Column) -> Column:
    """array<struct<x, y>> of the first (outer) ring of a complete polygon text, else null."""
    numbers = F.regexp_extract_all(F.regexp_extract(wkt, r"\(([^()]+)\)", 1), F.lit(f"(?i)({_NUMBER})"), 1)
    point = lambda n, i: F.struct(n[2 * i].cast("double").alias("x"), n[2 * i + 1].cast("double").alias("y"))
    points = let(numbers, lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: point(n, i)))
    return F.when(wkt.rlike(_POLYGON), points)


def _edges(ring: Column) -> Column:
    """array of struct(a, b) of consecutive vertices."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))


def _sum(a: Column, f) -> Column:
    return F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v)


def measures(ring: Column) -> Column:
    """struct(area, length, cx, cy, vertices) of a ring in degrees; the shoelace runs around the first vertex."""
    def of(r: Column) -> Column:
        o = r[0]
        cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
        es = _edges(r)
        twice = _sum(es, cross)
        mx = _sum(es, lambda e: (e["a"]["x"] + e["b"]["x"] - 2 * o["x"]) * cross(e))
        my = _sum(es, lambda e: (e["a"]["y"] + e["b"]["y"] - 2 * o["y"]) * cross(e))
        length = _sum(es, lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))
        sums = F.struct(twice.alias("t"), mx.alias("mx"), my.alias("my"), length.alias("l"))
        mean = lambda k: F.aggregate(F.transform(r, lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size(r)
        return let(sums, lambda s: F.struct(
            (F.abs(s["t"]) / 2).alias("area"), s["l"].alias("length"),
            F.when(s["t"] != 0, o["x"] + s["mx"] / (3 * s["t"])).otherwise(mean("x")).alias("cx"),
            F.when(s["t"] != 0, o["y"] + s["my"] / (3 * s["t"])).otherwise(mean("y")).alias("cy"), F.size(r).alias("vertices")))

    return let(ring, lambda r: F.when(F.size(r) >= 4, of(r)))


def metric(measure: Column) -> Column:
    """struct(area_m2, perimeter_m, compactness) of `measures`, by the midlat convention at the centroid."""
    def of(m: Column) -> Column:
        lng = F.lit(MIDLAT_LNG_M) * F.cos(F.radians(m["cy"]))
        area, length = m["area"] * lng * MIDLAT_LAT_M, m["length"] * (lng + MIDLAT_LAT_M) / 2
        return F.struct(area.alias("area_m2"), length.alias("perimeter_m"), F.when(length > 0, 4 * F.pi() * area / (length * length)).otherwise(0.0).alias("compactness"))

    return let(measure, of)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """True where a point lies inside a ring (even-odd rule)."""
    up = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
    right = lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) > x
    return F.size(F.filter(_edges(ring), lambda e: up(e) & right(e))) % 2 == 1
