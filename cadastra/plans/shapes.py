"""Queries of coordinates, shapes and boundaries, each with its SQL. Rectangles have closed forms, so polygon code that knows nothing of
rectangles is compared with plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, kernel, metres, pairs_of_shapes, rings
from ..operators import areas, hypotheses, pipelines
from ..runtime import spread
from ..sources.tables import table
from . import views
from .reference import _ix, _iy, C, q, query, r
from .views import FENCES_SQL, inputs

_D = 111_000.0
_BOX = "greatest(0, least({0}1, {1}1) - greatest({0}0, {1}0))"


def box_wkt(*c: str) -> Column:
    """POLYGON text of a box given by the columns x0, y0, x1, y1, written with all digits."""
    x0, y0, x1, y1 = (F.col(k).cast("string") for k in c)
    p = lambda x, y: F.concat_ws(" ", x, y)
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)), F.lit("))"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return views.fences(spark, d).withColumn("wkt", box_wkt("x0", "y0", "x1", "y1"))


# ---- coordinates

_bx, _by = "(lng - CAST(0.0065 AS DOUBLE))", "(lat - CAST(0.006 AS DOUBLE))"
_BD = f"""p AS (SELECT id, {_bx} AS x, {_by} AS y FROM fences), z AS (SELECT id, sqrt(x * x + y * y) - CAST(0.00002 AS DOUBLE) * sin(y * pi() * 3000 / 180) AS z, atan2(y, x) - CAST(0.000003 AS DOUBLE) * cos(x * pi() * 3000 / 180) AS t FROM p), gcj AS (SELECT id, z * cos(t) AS lng, z * sin(t) AS lat FROM z)"""


@query(f"WITH {FENCES_SQL}, {_BD} SELECT id, {q(_ix, 6, 'w_lng')}, {q(_iy, 6, 'w_lat')} FROM gcj")
def bd09_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    g = crs.bd09_to_wgs84(C("lng"), C("lat"))
    return views.fences(spark, d).select("id", r(g["lng"], 6, "w_lng"), r(g["lat"], 6, "w_lat"))


@query(f"WITH {FENCES_SQL}, c AS (SELECT id, unnest([1, 2, 3, 4]) AS k, unnest([x0, x1, x1, x0]) AS lng, unnest([y0, y0, y1, y1]) AS lat FROM boxes) SELECT id, CAST(k AS INT) AS k, {q(_ix, 6, 'w_lng')}, {q(_iy, 6, 'w_lat')} FROM c")
def polygon_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("id", crs.transform_ring(rings.ring_of(C("wkt")), crs.gcj02_to_wgs84).alias("ring"))
    p = b.select("id", F.posexplode("ring").alias("k", "p")).where("k < 4")
    return p.select("id", (C("k") + 1).alias("k"), r(C("p.x") if "x" in p.schema["p"].dataType.fieldNames() else C("p.lng"), 6, "w_lng"), r(C("p.y") if "y" in p.schema["p"].dataType.fieldNames() else C("p.lat"), 6, "w_lat"))


@query(f"WITH {FENCES_SQL} SELECT id, {q('(lng - CAST(116.40 AS DOUBLE)) * 111320 * cos(radians(CAST(39.90 AS DOUBLE)))', 4, 'px')}, {q('(lat - CAST(39.90 AS DOUBLE)) * 111320', 4, 'py')} FROM fences")
def local_planes(spark: SparkSession, d: str) -> DataFrame:
    z = metres.local_plane(C("lng"), C("lat"))
    f = views.fences(spark, d).select("id", z.alias("z"))
    names = f.schema["z"].dataType.fieldNames()
    return f.select("id", r(C(f"z.{names[0]}"), 4, "px"), r(C(f"z.{names[1]}"), 4, "py"))


@query(f"WITH {FENCES_SQL} SELECT id, {q('lng', 7, 'lng')}, {q('lat', 7, 'lat')} FROM fences")
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Eastings and northings back to degrees."""
    f = views.fences(spark, d).select("id", metres.utm_forward(C("lng"), C("lat")).alias("u"), metres.utm_zone(C("lng")).alias("zone"))
    e, n = f.schema["u"].dataType.fieldNames()[:2]
    g = f.select("id", metres.utm_inverse(C(f"u.{e}"), C(f"u.{n}"), C("zone")).alias("g"))
    x, y = g.schema["g"].dataType.fieldNames()[:2]
    return g.select("id", r(C(f"g.{x}"), 7, "lng"), r(C(f"g.{y}"), 7, "lat"))


# ---- shapes of rectangles

_MX = "(CAST(111412.84 AS DOUBLE) * cos(radians((y0 + y1) / 2)))"


@query(f"WITH {FENCES_SQL}, s AS (SELECT id, x1 - x0 AS w, y1 - y0 AS h FROM boxes) SELECT id, {q('greatest(w, h) / least(w, h)', 3, 'aspect')}, {q('least(w, h) / 2 * 111000', 1, 'radius_m')}, CAST(1 AS DOUBLE) AS hull_ratio, true AS valid, true AS simplified FROM s")
def rectangle_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Smallest rectangle, largest circle, hull, validity and simplification of polygons that happen to be rectangles."""
    b = _boxes(spark, d).select("id", "wkt")
    w = spread(b.select("wkt").distinct())  # equal texts have equal measures
    m = w.select("wkt", r(kernel.wkt_aspect("wkt"), 3, "aspect"), F.round(F.round(kernel.wkt_inscribed("wkt") * _D, 3), 1).alias("radius_m"), F.round(kernel.wkt_hull_ratio("wkt"), 6).alias("hull_ratio"), kernel.wkt_valid("wkt").alias("valid"), (F.abs(pairs_of_shapes.wkt_area(kernel.wkt_simplified("wkt")) - pairs_of_shapes.wkt_area("wkt")) < 1e-9).alias("simplified"))
    return b.join(m, "wkt").drop("wkt")


BOX_PAIRS_SQL = f"""SELECT a.id AS id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, a.x0 + CAST(a.id % 5 AS DOUBLE) / 10000 - CAST(0.0002 AS DOUBLE) AS bx0, a.y0 + CAST(a.id % 3 AS DOUBLE) / 10000 AS by0, a.x1 + CAST(a.id % 5 AS DOUBLE) / 10000 - CAST(0.0002 AS DOUBLE) AS bx1, a.y1 + CAST(a.id % 3 + a.id % 7 AS DOUBLE) / 10000 AS by1 FROM (WITH {FENCES_SQL} SELECT * FROM boxes) a"""
_INTER = f"{_BOX.format('ax', 'bx')} * {_BOX.format('ay', 'by')}"
_AA, _AB = "((ax1 - ax0) * (ay1 - ay0))", "((bx1 - bx0) * (by1 - by0))"


def _box_pairs(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d, BOX_PAIRS_SQL).withColumns({"wa": box_wkt("ax0", "ay0", "ax1", "ay1"), "wb": box_wkt("bx0", "by0", "bx1", "by1")})


_GAP = "sqrt(pow(greatest(0, greatest(ax0, bx0) - least(ax1, bx1)), 2) + pow(greatest(0, greatest(ay0, by0) - least(ay1, by1)), 2))"


@query(f"WITH p AS ({BOX_PAIRS_SQL}), m AS (SELECT id, {_INTER} AS i, {_AA} AS a, {_AB} AS b, {_GAP} AS gap FROM p) SELECT id, {q('i / (a + b - i)', 5, 'iou')}, {q('i / least(a, b)', 5, 'inter_min')}, {q('gap * 111000', 2, 'gap_m')}, {q('(a - i) * 1e8', 4, 'rest')} FROM m")
def polygon_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlap, distance and difference of two polygons."""
    p = _box_pairs(spark, d).withColumn("p", pairs_of_shapes.wkt_pair("wa", "wb"))
    rest = pairs_of_shapes.wkt_area(pairs_of_shapes.wkt_difference("wa", "wb"))
    return p.select("id", r(C("p.inter") / (C("p.area_a") + C("p.area_b") - C("p.inter")), 5, "iou"), r(C("p.inter") / F.least("p.area_a", "p.area_b"), 5, "inter_min"), r(C("p.dist") * _D, 2, "gap_m"), r(rest * 1e8, 4, "rest"))


@query(f"WITH {FENCES_SQL}, l AS (SELECT id, x0, x1, y0, y1, x0 - CAST(0.001 AS DOUBLE) AS a, (x0 + x1) / 2 + CAST(id % 3 AS DOUBLE) / 1000 AS b FROM boxes) SELECT id, {q('greatest(0, least(b, x1) - x0) * 111000', 2, 'inside_m')} FROM l")
def road_length_inside(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    y = ((C("y0") + C("y1")) / 2).cast("string")
    line = F.concat(F.lit("LINESTRING ("), (C("x0") - 0.001).cast("string"), F.lit(" "), y, F.lit(", "), ((C("x0") + C("x1")) / 2 + (C("id") % 3).cast("double") / 1000).cast("string"), F.lit(" "), y, F.lit(")"))
    return b.withColumn("line", line).select("id", r(pairs_of_shapes.line_in_polygon("line", "wkt") * _D, 2, "inside_m"))


@query("SELECT s_suppkey AS id, (1 + s_suppkey % 4) * (1 + s_suppkey % 3) AS faces, " + q("CAST((1 + s_suppkey % 4) * (1 + s_suppkey % 3) AS DOUBLE)", 6, "area") + " FROM supplier")
def block_faces(spark: SparkSession, d: str) -> DataFrame:
    """Polygonize: a grid of roads with dangling ends encloses as many unit blocks as it has cells."""
    s = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), (1 + C("s_suppkey") % 4).cast("int").alias("w"), (1 + C("s_suppkey") % 3).cast("int").alias("h"))
    across = F.transform(F.sequence(F.lit(0), C("h")), lambda k: F.concat(F.lit("LINESTRING (-0.5 "), k.cast("string"), F.lit(", "), (C("w") + 0.5).cast("string"), F.lit(" "), k.cast("string"), F.lit(")")))
    up = F.transform(F.sequence(F.lit(0), C("w")), lambda k: F.concat(F.lit("LINESTRING ("), k.cast("string"), F.lit(" -0.5, "), k.cast("string"), F.lit(" "), (C("h") + 0.5).cast("string"), F.lit(")")))
    f = s.withColumn("f", pairs_of_shapes.line_faces(F.concat(across, up)))
    return f.select("id", F.size("f").cast("bigint").alias("faces"), r(F.aggregate("f", F.lit(0.0), lambda t, x: t + x["area"]), 6, "area"))


@query(f"WITH {FENCES_SQL} SELECT id, CAST(floor(greatest(x1 - x0, y1 - y0) * 111000 / 20 + 1e-9) AS INT) + 1 AS points, {q('CASE WHEN x1 - x0 >= y1 - y0 THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END', 6, 'middle')} FROM boxes WHERE abs((x1 - x0) - (y1 - y0)) > 1e-6")
def centre_lines(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).where("abs((x1 - x0) - (y1 - y0)) > 1e-6").withColumn("c", pairs_of_shapes.centre_line("wkt"))
    wide = C("x1") - C("x0") >= C("y1") - C("y0")
    return b.select("id", F.size("c").alias("points"), r(F.when(wide, C("c")[0]["y"]).otherwise(C("c")[0]["x"]), 6, "middle"))


@query(f"WITH {FENCES_SQL} SELECT id, {q('CAST(32 AS DOUBLE) * sin(2 * pi() / 64) / pi() * width_m * height_m', 3, 'circle_m2')}, {q('CAST(1.035 AS DOUBLE) * width_m * height_m', 3, 'quad_m2')}, {q('width_m * height_m', 3, 'box_m2')} FROM fences")
def hypothesis_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Prior circle (a 64-gon), skewed road block and area box: the areas of the drawn rings."""
    f = views.fences(spark, d)
    a = C("width_m") * C("height_m")
    side = F.sqrt(a) / hypotheses.FLAT
    m2 = lambda ring: rings.measures(ring)["area"] * hypotheses.FLAT**2
    return f.select("id", r(m2(hypotheses.circle(C("lng"), C("lat"), a)), 3, "circle_m2"), r(m2(hypotheses.skewed_quad(C("lng"), C("lat"), a)), 3, "quad_m2"), r(m2(hypotheses.box_ring(C("lng"), C("lat"), side, side)), 3, "box_m2"))


# ---- topology and members

_TOPO = f"""{FENCES_SQL}, t AS (SELECT a.id AS id_a, b.id AS id_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 111000 * 111000 AS overlap_m2,
 sqrt(pow(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)), 2)) * 111000 AS gap_m
 FROM boxes a JOIN boxes b ON a.city = b.city AND a.id < b.id AND a.x0 <= b.x1 + CAST(0.0005 AS DOUBLE) AND b.x0 <= a.x1 + CAST(0.0005 AS DOUBLE) AND a.y0 <= b.y1 + CAST(0.0005 AS DOUBLE) AND b.y0 <= a.y1 + CAST(0.0005 AS DOUBLE))"""
_RELATION = "CASE WHEN overlap_m2 > 100 THEN 'OVERLAP_CONFLICT' WHEN gap_m > 0 AND gap_m < 50 THEN 'GAP_CONFLICT' ELSE 'UNKNOWN' END"


def _topo(spark: SparkSession, d: str) -> DataFrame:
    return areas.topology_pairs(_boxes(spark, d), "id", "city", "wkt", 0.0005, 0.005)


@query(f"WITH {_TOPO} SELECT id_a, id_b, {q('overlap_m2', 1, 'overlap_m2')}, {q('gap_m', 2, 'gap_m')} FROM t")
def topology_join(spark: SparkSession, d: str) -> DataFrame:
    return _topo(spark, d).select("id_a", "id_b", r(C("overlap_m2"), 1, "overlap_m2"), r(C("gap_m"), 2, "gap_m"))


@query(f"WITH {_TOPO} SELECT count(*) FILTER (WHERE overlap_m2 > 100) AS n_overlaps, {q('coalesce(sum(overlap_m2) FILTER (WHERE overlap_m2 > 100), 0)', 0, 'total_overlap_m2')}, count(*) FILTER (WHERE gap_m > 0 AND gap_m <= 50) AS n_gaps, {q('coalesce(sum(gap_m) FILTER (WHERE gap_m > 0 AND gap_m <= 50), 0)', 1, 'total_gap_m')} FROM t")
def topology_summary(spark: SparkSession, d: str) -> DataFrame:
    s = areas.topology_totals(_boxes(spark, d), "id", "city", "wkt", 0.0005, 0.005)
    return s.select("n_overlaps", r(C("total_overlap_m2"), 0, "total_overlap_m2"), "n_gaps", r(C("total_gap_m"), 1, "total_gap_m"))


@query(f"WITH {_TOPO}, a AS (SELECT id AS id_a, (x1 - x0) * (y1 - y0) * 111000 * 111000 AS area_a FROM boxes), b AS (SELECT id AS id_b, (x1 - x0) * (y1 - y0) * 111000 * 111000 AS area_b FROM boxes) SELECT id_a, id_b, CASE WHEN overlap_m2 > 100 THEN 'REMOVE_OVERLAP' ELSE 'REPAIR_GAP' END AS operation, {q('CASE WHEN overlap_m2 > 100 THEN area_a - overlap_m2 ELSE area_a + area_b END', 0, 'area_m2')} FROM t JOIN a USING (id_a) JOIN b USING (id_b) WHERE {_RELATION} <> 'UNKNOWN'")
def topology_repairs(spark: SparkSession, d: str) -> DataFrame:
    forms = areas.shape_forms(_boxes(spark, d), "id", "city", "wkt")
    p = areas.repairs(areas.form_pairs(forms, "id", "city", "wkt", 0.0005, 0.005), F.lit(False)).where("operation IS NOT NULL")
    p = areas.of_members(p.select("form_a", "form_b", "operation", (pairs_of_shapes.wkt_area("geometry") * hypotheses.FLAT**2).alias("area_m2")), forms, "id")
    return p.select("id_a", "id_b", "operation", r(C("area_m2"), 0, "area_m2"))


_WITHIN = "(i >= a * (1 - 1e-9) OR i >= b * (1 - 1e-9))"
_CROSS = "CASE WHEN id % 4 <> 0 THEN CAST(id % 5 AS DOUBLE) / 8 END"
_EV = f"""m AS (SELECT id, {_INTER} AS i, {_AA} AS a, {_AB} AS b, {_GAP} AS gap, {_CROSS} AS crossed FROM p),
 e AS (SELECT id, {_WITHIN} AS s1, CASE WHEN {_WITHIN} THEN 1 ELSE greatest(0, 1 - 10 * gap) END AS c1, crossed IS NOT NULL AS k2, NOT (gap > 0 AND crossed > 0) AS s2, CASE WHEN gap <= 0 THEN CAST(0.5 AS DOUBLE) WHEN crossed > 0 THEN least(1, 2 * crossed) ELSE CAST(0.7 AS DOUBLE) END AS c2, id % 3 = 0 AS s3 FROM m),
 v AS (SELECT id, greatest(0, least(1, (CASE WHEN s1 THEN 0.4 * c1 ELSE -0.2 * c1 END + CASE WHEN k2 AND s2 THEN 0.25 * c2 WHEN k2 THEN -0.125 * c2 ELSE 0 END + CASE WHEN s3 THEN 0.2 ELSE 0 END + CAST(0.12 AS DOUBLE)) / CAST(0.4 + CASE WHEN k2 THEN 0.25 ELSE 0 END + 0.2 + 0.15 AS DOUBLE))) AS v FROM e)"""


@query(f"WITH p AS ({BOX_PAIRS_SQL}), {_EV} SELECT id, {q('v', 5, 'confidence')}, CASE WHEN v + 1e-9 >= 0.8 THEN 'CONFIRMED' WHEN v + 1e-9 >= 0.5 THEN 'LIKELY' WHEN v + 1e-9 >= 0.2 THEN 'UNCERTAIN' ELSE 'EXCLUDED' END AS level FROM v")
def building_membership(spark: SparkSession, d: str) -> DataFrame:
    """Containment, roads, listing and naming of a building beside a compound, from their polygons."""
    p = _box_pairs(spark, d).withColumns({"crossed": F.when(C("id") % 4 != 0, (C("id") % 5).cast("double") / 8), "listed": C("id") % 3 == 0, "building_name": F.lit("翠园3号楼"), "compound_name": F.lit("翠园")})
    m = areas.membership(p, "wa", "wb")
    return m.select("id", r(C("confidence"), 5, "confidence"), "level")


ROADS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'service' WHEN 2 THEN 'residential' WHEN 3 THEN 'footway' WHEN 4 THEN 'trunk_link' ELSE 'service' END AS kind, CASE WHEN o_orderkey % 6 = 1 THEN 'alley' END AS service, o_orderkey % 2 = 0 AS both_sides, o_orderkey % 5 <> 0 AS named_sides, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS c FROM orders"
_ROLE = "CASE WHEN kind IN ('primary', 'trunk_link') THEN 'PUBLIC_SEPARATOR' WHEN kind = 'service' AND service = 'alley' THEN 'INTERNAL' WHEN kind = 'service' THEN 'ACCESS' WHEN kind = 'residential' THEN 'LOCAL' ELSE 'UNKNOWN' END"


@query(f"WITH d AS ({ROADS_SQL}), z AS (SELECT *, {_ROLE} AS role FROM d) SELECT id, role, CASE WHEN role = 'PUBLIC_SEPARATOR' AND both_sides AND named_sides THEN 'SUPPORTS_SPLIT' WHEN role = 'INTERNAL' THEN 'REFUTES_SPLIT' ELSE 'NEUTRAL' END AS support FROM z")
def road_semantics(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d, ROADS_SQL).withColumn("role", hypotheses.road_role(C("kind"), F.coalesce("service", F.lit(""))))
    return x.select("id", "role", hypotheses.road_support(C("both_sides"), C("named_sides"), C("role")).alias("support"))


@query("""WITH l AS (SELECT l_orderkey AS id, sum(CASE WHEN l_linenumber % 3 = 1 THEN 0.15 WHEN l_linenumber % 3 = 2 THEN 0.05 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 0.1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.1 ELSE 0 END) AS s, max(CAST(l_extendedprice AS DOUBLE)) AS a FROM lineitem GROUP BY 1)
 SELECT id, round(CAST(greatest(0, least(1, CAST(0.3 AS DOUBLE) + CASE WHEN a BETWEEN 5000 AND 200000 THEN 0.2 WHEN a >= 1000 AND a < 5000 THEN 0.08 ELSE 0 END + s)) AS DOUBLE) + CAST(1e-9 AS DOUBLE), 4) AS score FROM l""")
def road_semantic_ranking(spark: SparkSession, d: str) -> DataFrame:
    n = C("l_linenumber") % 3
    a = F.struct(F.when(n == 1, "PUBLIC_SEPARATOR").when(n == 2, "WEAK_SEPARATOR").otherwise("LOCAL").alias("role"), F.when(C("l_returnflag") == "N", "THROUGH").otherwise("BROKEN").alias("continuity"), F.when(C("l_linestatus") == "O", "SUPPORT").otherwise("NEUTRAL").alias("support"))
    x = table(spark, d, "lineitem").select(C("l_orderkey").alias("id"), areas.assertion_score(a).alias("s"), C("l_extendedprice").cast("double").alias("area")).groupBy("id").agg(F.sum("s").alias("s"), F.max("area").alias("area"))
    return x.select("id", r(areas.road_rank(C("area"), C("s")), 4, "score"))


@query("WITH p AS (SELECT l_suppkey AS fence, CAST(l_partkey % 300 AS DOUBLE) AS a, CAST((l_partkey * 7) % 300 AS DOUBLE) AS b FROM lineitem), v AS (SELECT fence, count(*) AS n, count(*) FILTER (WHERE least(a, b) <= 200 AND a < b) AS raw_votes, count(*) FILTER (WHERE least(a, b) <= 200 AND b < a) AS shifted_votes FROM p GROUP BY 1) SELECT *, CASE WHEN raw_votes > shifted_votes THEN 'AS_DELIVERED' WHEN raw_votes < shifted_votes THEN 'SHIFTED' ELSE 'UNDECIDED' END AS verdict FROM v")
def point_vote_crs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(C("l_suppkey").alias("fence"), (C("l_partkey") % 300).cast("double").alias("a"), (C("l_partkey") * 7 % 300).cast("double").alias("b"))
    return areas.point_vote(p, "fence", "a", "b")


@query(f"WITH {FENCES_SQL}, a AS (SELECT id, unnest([0, 90, 180, 270]) AS angle, unnest([1.0, 0.0, -1.0, 0.0]) AS c, unnest([0.0, 1.0, 0.0, -1.0]) AS s, x1 - lng AS dx, y1 - lat AS dy, lng, lat FROM boxes) SELECT id, CAST(angle AS INT) AS angle, {q('lng + dx * CAST(c AS DOUBLE) - dy * CAST(s AS DOUBLE)', 6, 'rx')}, {q('lat + dx * CAST(s AS DOUBLE) + dy * CAST(c AS DOUBLE)', 6, 'ry')} FROM a")
def placebo_rotation(spark: SparkSession, d: str) -> DataFrame:
    return areas.rotated(views.fences(spark, d), "x1", "y1", "lng", "lat").select("id", "angle", r(C("rx"), 6, "rx"), r(C("ry"), 6, "ry"))


@query("SELECT l_suppkey AS place, sum(CASE l_linenumber % 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END) AS score FROM lineitem GROUP BY 1 HAVING sum(CASE l_linenumber % 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END) >= 3")
def scenic_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").select(C("l_suppkey").alias("place"), F.when(C("l_linenumber") % 4 == 1, "strong").when(C("l_linenumber") % 4 == 2, "medium").alias("strength"))
    return areas.fingerprint(h, "place", "strength").withColumn("score", C("score").cast("bigint"))


# ---- nearest and priors

_SEEDS = "CAST(116.0 AS DOUBLE) + CAST((s_suppkey * 7907) % 1000 AS DOUBLE) / 2000 AS x, CAST(39.6 AS DOUBLE) + CAST((s_suppkey * 104723) % 1000 AS DOUBLE) / 2000 AS y"


@query(f"""WITH {FENCES_SQL}, s AS (SELECT s_suppkey AS seed_id, {_SEEDS} FROM supplier), d AS (SELECT seed_id, b.width_m * b.height_m AS area, row_number() OVER (PARTITION BY seed_id ORDER BY sqrt(pow(x - b.lng, 2) + pow(y - b.lat, 2)), b.id) AS k FROM s JOIN fences b ON seed_id <> b.id)
 SELECT seed_id, {q('median(area)', 3, 'prior_m2')} FROM d WHERE k <= 5 GROUP BY 1""")
def knn_area_prior(spark: SparkSession, d: str) -> DataFrame:
    """The median area of the five fences nearest to each supplier."""
    f = views.fences(spark, d).select(C("id").alias("seed_id"), C("lng").alias("x"), C("lat").alias("y"), (C("width_m") * C("height_m")).alias("area_m2"))
    return pipelines.knn_prior(inputs(spark, d, f"SELECT s_suppkey AS seed_id, {_SEEDS} FROM supplier"), f, 0.02).select("seed_id", r(C("prior_m2"), 3, "prior_m2"))
