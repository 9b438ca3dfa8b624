"""Column expressions shared by all operators: ids, blanks, usable points and polygons.

Everything here stays on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fillers that stand for "no value" (compared in lower case, outer blanks removed).
FILLERS = ("", "-", "--", "—", "/", "n/a", "na", "nan", "nil", "none", "null", "未知", "无", "暂无", "不详", "空", "?", "？", "0", "。。。", "...", "…")
#: The box of usable coordinates.
LNG_MIN, LNG_MAX, LAT_MIN, LAT_MAX = 73.0, 136.0, 3.0, 54.0
EARTH_M = 6_371_000.0

_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?"


# A complete polygon text in one pass. All repetitions are possessive: they neither back up nor nest calls, so a
# ring of any length is matched in a loop.
_N = r"[-+]?+(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:e[-+]?+[0-9]++)?+"
_RING = rf"\s*+\(\s*+{_N}\s++{_N}\s*+(?:,\s*+{_N}\s++{_N}\s*+){{3,}}+\)\s*+"
_RINGS = rf"{_RING}(?:,{_RING})*+"
_POLYGON = rf"(?i)^{_BLANK}*+(?:srid\s*+=\s*+[0-9]++\s*+;\s*+)?+(?:polygon\s*+\({_RINGS}\)|multipolygon\s*+\(\s*+\({_RINGS}\)\s*+(?:,\s*+\({_RINGS}\)\s*+)*+\)){_BLANK}*+$"


def trimmed(c: Column) -> Column:
    """Text without outer blanks of any script (full-width and zero-width ones included)."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def norm_id(c: Column) -> Column:
    """An id as it is compared and returned: outer blanks removed, upper case; blank ids become null."""
    t = F.upper(trimmed(c))
    return F.when(t != "", t)


def is_blank(c: Column) -> Column:
    """True for null, white space only, or a filler."""
    return c.isNull() | F.lower(trimmed(c)).isin(*FILLERS)


def usable_point(lng: Column, lat: Column) -> Column:
    ok = ~F.isnan(lng) & ~F.isnan(lat) & lng.between(LNG_MIN, LNG_MAX) & lat.between(LAT_MIN, LAT_MAX)
    return F.coalesce(ok, F.lit(False))


def _plain(wkt: Column) -> Column:
    """WKT in lower case without outer blanks and SRID prefix."""
    return F.regexp_replace(F.lower(trimmed(wkt)), r"^srid\s*=\s*[0-9]+\s*;\s*", "")


def wkt_mask(wkt: Column) -> Column:
    """The form of a WKT text: every complete ring (four positions or more) becomes R, other positions p,
    other numbers n. A well-formed polygon has the mask polygon(R), polygon(R,R), multipolygon((R),(R,R)) ..."""
    s = F.regexp_replace(_plain(wkt), _NUMBER, "n")
    s = F.regexp_replace(s, r"n\s+n", "p")
    s = F.regexp_replace(s, r"\s*([(),])\s*", "$1")
    return F.regexp_replace(s, r"\(p(?:,p){3,}+\)", "R")


def is_polygon(mask: Column) -> Column:
    """True where a mask is that of a complete POLYGON or MULTIPOLYGON."""
    return F.coalesce(mask.rlike(r"^(?:polygon\s?\(R(?:,R)*\)|multipolygon\s?\(\(R(?:,R)*\)(?:,\(R(?:,R)*\))*\))$"), F.lit(False))


def wkt_box(wkt: Column) -> Column:
    """struct(x0, x1, y0, y1) of all positions of a WKT text."""
    return _box(_plain(wkt))


def _box(text: Column) -> Column:
    nums = F.regexp_extract_all(text, F.lit(f"({_NUMBER})"), 1)
    xs = F.transform(F.filter(nums, lambda v, i: i % 2 == 0), lambda v: v.cast("double"))
    ys = F.transform(F.filter(nums, lambda v, i: i % 2 == 1), lambda v: v.cast("double"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable is not copied into the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def usable_box(wkt: Column) -> Column:
    """The bounding box of a usable polygon, null for any other text."""
    inside = lambda b: (b["x0"] >= LNG_MIN) & (b["x1"] <= LNG_MAX) & (b["y0"] >= LAT_MIN) & (b["y1"] <= LAT_MAX)
    body = F.substring_index(F.lower(wkt), "n", -1)  # after the last letter of the word, so without the SRID
    return F.when(wkt.rlike(_POLYGON), let(_box(body), lambda b: F.when(inside(b), b)))


def location(lng: Column, lat: Column, box: Column) -> Column:
    """struct(x, y): the usable point, else the middle of the usable polygon's box, else null."""
    middle = lambda b: F.when(b.isNotNull(), F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y")))
    return F.when(usable_point(lng, lat), F.struct(lng.alias("x"), lat.alias("y"))).otherwise(let(box, middle))


def sphere_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres (haversine) on a sphere of radius EARTH_M."""
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # null where a coordinate is
