"""Queries of the spatial-integrity operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, metres, text
from ..functions.columns import is_blank
from ..operators import evaluation, gates, graph, hypotheses, landuse, quality, relations, trust
from ..sources.tables import table
from . import views
from .views import FENCES_SQL, LEDGER_SQL, PRED_SQL, RUNS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column, n: int, name: str) -> Column:
    """Rounded to n decimals; the tiny term keeps ties from falling apart between engines."""
    return F.round(c + 1e-9, n).alias(name)


def q(c: str, n: int, name: str) -> str:
    return f"round(({c}) + CAST(1e-9 AS DOUBLE), {n}) AS {name}"


_FILL = "lower(trim({0}))"
_BLANK = "({0} IS NULL OR lower(regexp_replace({0}, '^[\\s\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}\\x{{3000}}\\x{{A0}}]+|[\\s\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}\\x{{3000}}\\x{{A0}}]+$', '', 'g')) IN ('', '-', '--', '—', '/', 'n/a', 'na', 'nan', 'nil', 'none', 'null', '未知', '无', '暂无', '不详', '空', '?', '？', '0', '。。。', '...', '…'))"


# ---- profile

@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE {_BLANK.format('name_raw')}) AS blank_names, count(*) FILTER (WHERE {_BLANK.format('address_raw')}) AS blank_addresses,
 count(*) FILTER (WHERE point_raw_lng IS NULL OR isnan(point_raw_lng)) AS missing_lng, count(*) FILTER (WHERE point_raw_lng = 0 AND point_raw_lat = 0) AS zero_points, count(DISTINCT source_batch_id) AS loads, count(DISTINCT city_raw) AS cities FROM source_records""")
def health_profile(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_records")
    n = lambda c, k: F.count_if(c).alias(k)
    return s.agg(F.count(F.lit(1)).alias("total"), n(is_blank(C("name_raw")), "blank_names"), n(is_blank(C("address_raw")), "blank_addresses"), n(C("point_raw_lng").isNull() | F.isnan("point_raw_lng"), "missing_lng"),
                 n((C("point_raw_lng") == 0) & (C("point_raw_lat") == 0), "zero_points"), F.countDistinct("source_batch_id").alias("loads"), F.countDistinct("city_raw").alias("cities"))


@query("SELECT city_raw AS city, name_raw AS name, count(*) AS n FROM source_records GROUP BY ALL HAVING count(*) > 1")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records").groupBy(C("city_raw").alias("city"), C("name_raw").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT coalesce(city_raw, 'ALL') AS city, count(*) AS n FROM source_records WHERE city_raw IS NOT NULL GROUP BY GROUPING SETS ((city_raw), ())")
def city_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_total(table(spark, d, "source_records").where("city_raw IS NOT NULL").select(C("city_raw").alias("city")), "city", [F.count(F.lit(1)).alias("n")])


@query("SELECT source_system, count(*) AS n, count(DISTINCT source_batch_id) AS loads, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM source_records GROUP BY 1")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records").groupBy("source_system").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_batch_id").alias("loads"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))


@query("SELECT count(*) AS n, " + ", ".join(q(e, 4, a) for e, a in (("avg(d)", "mean_offset"), ("median(d)", "median_offset"), ("stddev_pop(d)", "std_offset"))) + f", abs(median(d) - CAST(0.006 AS DOUBLE)) < 0.002 AS systematic FROM (WITH {FENCES_SQL} SELECT CAST((id * 7) % 13 AS DOUBLE) / 1000 AS d FROM fences)")
def offset_profile(spark: SparkSession, d: str) -> DataFrame:
    o = views.fences(spark, d).select(((C("id") * 7 % 13).cast("double") / 1000).alias("d"))
    med = F.percentile("d", F.lit(0.5))
    return o.agg(F.count(F.lit(1)).alias("n"), r(F.avg("d"), 4, "mean_offset"), r(med, 4, "median_offset"), r(F.stddev_pop("d"), 4, "std_offset"), (F.abs(med - 0.006) < 0.002).alias("systematic"))


# ---- coordinates

def _shift_sql(lng: str, lat: str, sign: str) -> tuple[str, str]:
    """SQL of the GCJ-02 shift with the fixed values of crs."""
    x, y = f"({lng} - 105.0)", f"({lat} - 35.0)"
    num = lambda v: f"CAST({v!r} AS DOUBLE)"
    wave = lambda v, ws: "(" + " + ".join(f"{num(a)} * sin({v} * {num(math.pi / b)})" for a, b in ws) + f") * {num(2 / 3)}"
    poly = lambda k: f"({num(k[0])} + {num(k[1])} * {x} + {num(k[2])} * {y} + {num(k[3])} * {x} * {x} + {num(k[4])} * {y} * {y} + {num(k[5])} * {x} * {y} + {num(k[6])} * sqrt(abs({x})) + {wave(x, crs.COMMON_WAVES)})"
    m = f"(1 - {num(crs.ECC)} * sin(radians({lat})) * sin(radians({lat})))"
    dy = f"({poly(crs.LAT_POLY)} + {wave(y, crs.LAT_WAVES)}) * 180.0 / ({num(crs.AXIS * (1 - crs.ECC))} / ({m} * sqrt({m})) * pi())"
    dx = f"({poly(crs.LNG_POLY)} + {wave(x, crs.LNG_WAVES)}) * 180.0 / ({num(crs.AXIS)} / sqrt({m}) * cos(radians({lat})) * pi())"
    return f"{lng} {sign} {dx}", f"{lat} {sign} {dy}"


_fx, _fy = _shift_sql("lng", "lat", "+")
_ix, _iy = _shift_sql("lng", "lat", "-")


@query(f"WITH {FENCES_SQL} SELECT id, {q(_fx, 6, 'g_lng')}, {q(_fy, 6, 'g_lat')} FROM fences")
def gcj02_forward(spark: SparkSession, d: str) -> DataFrame:
    g = crs.wgs84_to_gcj02(C("lng"), C("lat"))
    return views.fences(spark, d).select("id", r(g["lng"], 6, "g_lng"), r(g["lat"], 6, "g_lat"))


@query(f"WITH {FENCES_SQL} SELECT id, {q(_ix, 6, 'w_lng')}, {q(_iy, 6, 'w_lat')} FROM fences")
def gcj02_inverse(spark: SparkSession, d: str) -> DataFrame:
    g = crs.gcj02_to_wgs84(C("lng"), C("lat"))
    return views.fences(spark, d).select("id", r(g["lng"], 6, "w_lng"), r(g["lat"], 6, "w_lat"))


@query(f"""WITH {FENCES_SQL}, p AS (SELECT id, lng - CAST(0.0065 AS DOUBLE) AS x, lat - CAST(0.006 AS DOUBLE) AS y FROM fences),
 z AS (SELECT id, sqrt(x * x + y * y) - CAST(0.00002 AS DOUBLE) * sin(y * pi() * 3000 / 180) AS z, atan2(y, x) - CAST(0.000003 AS DOUBLE) * cos(x * pi() * 3000 / 180) AS t FROM p)
 SELECT id, {q('z * cos(t)', 6, 'g_lng')}, {q('z * sin(t)', 6, 'g_lat')} FROM z""")
def bd09_inverse(spark: SparkSession, d: str) -> DataFrame:
    g = crs.bd09_to_gcj02(C("lng"), C("lat"))
    return views.fences(spark, d).select("id", r(g["lng"], 6, "g_lng"), r(g["lat"], 6, "g_lat"))


@query(f"""WITH {FENCES_SQL}, p AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 = 1 THEN 0 ELSE lng END AS px, CASE WHEN id % 11 = 1 THEN 0 ELSE lat END AS py,
   CASE WHEN id % 5 = 0 THEN NULL ELSE lng + CAST(id % 4 AS DOUBLE) * 0.003 END AS cx, lat + 0.001 AS cy FROM fences),
 s AS (SELECT *, {_shift_sql('cx', 'cy', '-')[0]} AS nx, {_shift_sql('cx', 'cy', '-')[1]} AS ny FROM p)
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN (px IS NULL OR (px = 0 AND py = 0)) AND cx IS NOT NULL THEN 'SYSTEMATIC_OFFSET' WHEN px IS NULL OR (px = 0 AND py = 0) THEN 'CRS_UNKNOWN' WHEN cx IS NULL THEN 'CONFIRMED_WGS84'
   WHEN abs(cx - px - 0.006) < 0.003 AND abs(cy - py - 0.001) < 0.003 THEN 'POINT_POLYGON_CRS_CONFLICT' WHEN abs(nx - px) > 0.05 OR abs(ny - py) > 0.05 THEN 'MIXED_CRS' ELSE 'CONFIRMED_WGS84' END AS status FROM s) GROUP BY 1""")
def coord_status(spark: SparkSession, d: str) -> DataFrame:
    k = C("id") % 11
    p = views.fences(spark, d).select("id", F.when(k == 0, None).when(k == 1, 0.0).otherwise(C("lng")).alias("px"), F.when(k == 1, 0.0).otherwise(C("lat")).alias("py"),
                                      F.when(C("id") % 5 == 0, None).otherwise(C("lng") + (C("id") % 4).cast("double") * 0.003).alias("cx"), (C("lat") + 0.001).alias("cy"))
    p = p.withColumn("n", crs.gcj02_to_wgs84(C("cx"), C("cy")))
    a = crs.assess(C("px"), C("py"), C("cx"), C("cy"), C("n.lng"), C("n.lat"))
    return p.select(a["status"].alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_LATM = "(CAST(111132.954 AS DOUBLE) - CAST(559.822 AS DOUBLE) * cos(2 * radians(lat)) + CAST(1.175 AS DOUBLE) * cos(4 * radians(lat)))"
_LNGM = f"(CAST({metres.WGS84_A * math.pi / 180!r} AS DOUBLE) * cos(radians(lat)) / sqrt(1 - CAST({metres.WGS84_E2!r} AS DOUBLE) * sin(radians(lat)) * sin(radians(lat))))"


@query(f"WITH {FENCES_SQL} SELECT id, {q(f'lng - 250 / {_LNGM}', 5, 'bx0')}, {q(f'lat - 250 / {_LATM}', 5, 'by0')}, {q(f'lng + 250 / {_LNGM}', 5, 'bx1')}, {q(f'lat + 250 / {_LATM}', 5, 'by1')} FROM fences")
def metre_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = metres.degree_offsets(F.lit(250.0), C("lat"))
    return views.fences(spark, d).select("id", r(C("lng") - o["dlng"], 5, "bx0"), r(C("lat") - o["dlat"], 5, "by0"), r(C("lng") + o["dlng"], 5, "bx1"), r(C("lat") + o["dlat"], 5, "by1"))


def _utm_sql() -> str:
    radius, alpha, _ = metres._series()
    e = math.sqrt(metres.WGS84_E2)
    terms = lambda f, g: " + ".join(f"CAST({a!r} AS DOUBLE) * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, a in enumerate(alpha, 1))
    return f"""WITH {FENCES_SQL}, a AS (SELECT id, radians(lng - 117) AS lam, sinh(atanh(sin(radians(lat))) - CAST({e!r} AS DOUBLE) * atanh(CAST({e!r} AS DOUBLE) * sin(radians(lat)))) AS t FROM fences),
 b AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
 SELECT id, {q(f"CAST({metres.UTM_K0 * radius!r} AS DOUBLE) * (eta + {terms('cos', 'sinh')}) + 500000", 3, 'east')}, {q(f"CAST({metres.UTM_K0 * radius!r} AS DOUBLE) * (xi + {terms('sin', 'cosh')})", 3, 'north')} FROM b"""


@query(_utm_sql())
def utm_forward(spark: SparkSession, d: str) -> DataFrame:
    u = metres.utm_forward(C("lng"), C("lat"), F.lit(50))
    return views.fences(spark, d).select("id", r(u["east"], 3, "east"), r(u["north"], 3, "north"))


@query(f"""WITH {FENCES_SQL} SELECT method, count(*) AS n FROM (SELECT CASE WHEN x0 * 1 + shift >= 115.4 AND y0 >= 39.4 AND x1 + shift <= 117.5 AND y1 <= 41.1 THEN 'PROFILE'
 WHEN floor((x0 + shift + 180) / 6) = floor((x1 + shift + 180) / 6) THEN 'AUTO_UTM' ELSE 'UNRESOLVED' END AS method FROM (SELECT *, CAST(id % 9 AS DOUBLE) - 4 AS shift FROM boxes)) GROUP BY 1""")
def crs_selection(spark: SparkSession, d: str) -> DataFrame:
    s = (C("id") % 9).cast("double") - 4
    c = metres.select_crs(C("x0") + s, C("y0"), C("x1") + s, C("y1"))
    return views.fences(spark, d).select(c["method"].alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


# ---- quality

_QA_SQL = f"""{FENCES_SQL},
m AS (SELECT *, width_m * height_m AS area_m2, 2 * (width_m + height_m) AS per, least(width_m, height_m) AS short, greatest(width_m, height_m) AS long FROM boxes),
qa AS (SELECT *, 4 * pi() * area_m2 / (per * per) AS compactness, area_m2 < 500 AS sliver, area_m2 > 1500000 AS oversized, short < 50 AND long > 100 AS strip, short > 1 AND 2 * area_m2 / per < CAST(0.3 AS DOUBLE) * short AS jagged, long / short > 10 AS elongated FROM m),
scored AS (SELECT *, round(greatest(0, 1 - (CASE WHEN sliver THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN oversized THEN CAST(0.25 AS DOUBLE) ELSE 0 END + CASE WHEN strip THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN jagged THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN compactness < 0.1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)), 6) AS score FROM qa)"""


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return quality.rectangle_qa(views.fences(spark, d))


@query(f"WITH {_QA_SQL} SELECT id, {q('compactness', 5, 'compactness')}, score, CASE WHEN score >= 0.7 THEN 'PASS' WHEN score >= 0.4 THEN 'WARN' ELSE 'REVIEW' END AS decision FROM scored")
def qa_shape_score(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select("id", r(C("compactness"), 5, "compactness"), F.round("score", 6).alias("score"), "decision")


@query(f"WITH {_QA_SQL} SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN sliver THEN 'SLIVER' END, CASE WHEN oversized THEN 'OVERSIZED' END, CASE WHEN strip THEN 'NARROW_STRIP' END, CASE WHEN jagged THEN 'JAGGED' END, CASE WHEN elongated AND NOT strip THEN 'ELONGATED' END, CASE WHEN compactness < 0.1 THEN 'LOW_COMPACTNESS' END], lambda x: x IS NOT NULL)) AS issue FROM scored) GROUP BY 1")
def qa_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_QA_SQL} SELECT coalesce(CASE WHEN id % 13 = 0 THEN 'NO_GEOMETRY' WHEN score < 0.7 THEN 'LOW_QA' WHEN area_m2 < 500 OR area_m2 > 1500000 THEN 'AREA_OUT_OF_RANGE' WHEN strip THEN 'NARROW_STRIP' END, 'KEPT') AS reason, count(*) AS n FROM scored GROUP BY 1")
def silver_funnel(spark: SparkSession, d: str) -> DataFrame:
    why = quality.first_rejection(C("id") % 13 != 0, C("score"), C("area_m2"), C("issues"))
    return _qa(spark, d).select(F.coalesce(why, F.lit("KEPT")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_QA_SQL} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN area_m2 BETWEEN 500 AND 800000 AND NOT strip AND CAST(id % 500 AS DOUBLE) <= 300 AND score >= 0.7 THEN 'ACCEPTED' WHEN id % 3 = 0 THEN 'DEGRADED_FALLBACK' ELSE 'REJECTED_UNRECOVERABLE' END AS verdict FROM scored) GROUP BY 1")
def fence_guard(spark: SparkSession, d: str) -> DataFrame:
    v = quality.fence_guard(C("score"), C("area_m2"), C("issues"), (C("id") % 500).cast("double"), C("id") % 3 == 0)
    return _qa(spark, d).select(v.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# ---- candidates, scores and tiers

#: Half of the 300 m retrieval buffer's easting, as degrees on both axes.
_BUF = 0.00175
_SPATIAL_SQL = f"""{FENCES_SQL}, wide AS (SELECT *, x0 - CAST({_BUF} AS DOUBLE) AS wx0, x1 + CAST({_BUF} AS DOUBLE) AS wx1, y0 - CAST({_BUF} AS DOUBLE) AS wy0, y1 + CAST({_BUF} AS DOUBLE) AS wy1 FROM boxes),
spatial AS (SELECT a.id AS id_a, b.id AS id_b FROM wide a JOIN wide b ON a.city = b.city AND a.id < b.id AND a.wx0 <= b.wx1 AND b.wx0 <= a.wx1 AND a.wy0 <= b.wy1 AND b.wy0 <= a.wy1)"""


def _spatial(spark: SparkSession, d: str) -> DataFrame:
    f = views.fences(spark, d)
    wide = f.select("id", "city", *[(C(c) - _BUF).alias(c) for c in ("x0", "y0")], *[(C(c) + _BUF).alias(c) for c in ("x1", "y1")])
    return relations.box_pairs(wide, "id", "city", 0.01)


@query(f"WITH {_SPATIAL_SQL} SELECT id_a, id_b FROM spatial")
def candidate_pairs_spatial(spark: SparkSession, d: str) -> DataFrame:
    return _spatial(spark, d)


@query(f"WITH {FENCES_SQL}, p AS (SELECT id, city, 'P' || CAST(id % 40 AS VARCHAR) AS prefix FROM fences), n AS (SELECT city, prefix FROM p GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50) SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN n USING (city, prefix) JOIN p b USING (city, prefix) WHERE a.id < b.id")
def candidate_pairs_lexical(spark: SparkSession, d: str) -> DataFrame:
    f = views.fences(spark, d).select("id", "city", F.concat(F.lit("P"), (C("id") % 40).cast("string")).alias("prefix"))
    return relations.lexical_pairs(f, "id", "city", "prefix")


_PAIR_SQL = f"""{_SPATIAL_SQL}, f AS (SELECT s.id_a, s.id_b, a.district = b.district AS same_district,
   greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b,
   sqrt(pow((a.lng - b.lng) * CAST(111412.84 AS DOUBLE) * cos(radians((a.lat + b.lat) / 2)), 2) + pow((a.lat - b.lat) * CAST(111132.954 AS DOUBLE), 2)) AS distance,
   CAST((s.id_a * 31 + s.id_b * 17) % 101 AS DOUBLE) / 100 AS bge, CAST((s.id_a * 7 + s.id_b * 29) % 101 AS DOUBLE) / 100 AS name_sim, (s.id_a + s.id_b) % 6 = 0 AS base_exact, (s.id_a + s.id_b) % 17 = 0 AS exact_name, (s.id_a * s.id_b) % 5 = 0 AS one_number,
   CASE WHEN (s.id_a * 3 + s.id_b) % 8 = 0 THEN 'phase' WHEN (s.id_a * 3 + s.id_b) % 8 = 1 THEN 'court' END AS conflict, (s.id_a + 2 * s.id_b) % 9 = 0 AS hierarchical, s.id_a % 2 = 0 AS a_is_part, (s.id_a + s.id_b) % 10 = 1 AS number_conflict
  FROM spatial s JOIN boxes a ON a.id = s.id_a JOIN boxes b ON b.id = s.id_b),
g AS (SELECT *, CASE WHEN inter > 0 THEN inter / (area_a + area_b - inter) ELSE 0 END AS iou, inter / least(area_a, area_b) AS inter_min, exact_name OR (base_exact AND name_sim >= 0.8 AND bge >= 0.88) AS same FROM f),
scored AS (SELECT *, CASE WHEN distance > 2000 THEN 'NOT_SAME_ENTITY' WHEN conflict IS NOT NULL AND distance <= 1500 THEN CASE conflict WHEN 'phase' THEN 'SIBLING_PHASE' ELSE 'SIBLING_COURTYARD' END
   WHEN hierarchical AND distance <= 1000 THEN CASE WHEN a_is_part THEN 'PHASE_TO_WHOLE' ELSE 'WHOLE_TO_PHASE' END
   WHEN same_district AND NOT number_conflict AND distance <= 200 THEN CASE WHEN same AND one_number THEN 'RELATED_ENTITY' WHEN same AND iou >= 0.85 THEN 'EXACT_DUPLICATE' WHEN same THEN 'SAME_ENTITY_ALT_BOUNDARY' WHEN bge >= 0.82 THEN 'RELATED_ENTITY' WHEN name_sim >= 0.7 OR bge >= 0.7 THEN 'RELATED_ENTITY' ELSE 'NOT_SAME_ENTITY' END
   WHEN (iou >= 0.35 OR inter_min >= 0.5) AND name_sim < 0.45 AND NOT base_exact THEN 'POSSIBLE_MERGE_ERROR' WHEN name_sim >= 0.8 AND NOT same_district THEN 'NOT_SAME_ENTITY'
   WHEN distance <= 300 AND (name_sim >= 0.6 OR bge >= 0.68) THEN 'RELATED_ENTITY' ELSE 'NOT_SAME_ENTITY' END AS relation FROM g)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = views.fences(spark, d).select("id", "district", "lng", "lat", "x0", "x1", "y0", "y1")
    p = _spatial(spark, d).join(f.select(*[C(c).alias(f"{c}_a") for c in f.columns]), "id_a").join(f.select(*[C(c).alias(f"{c}_b") for c in f.columns]), "id_b")
    a, b = C("id_a"), C("id_b")
    over = lambda v: F.greatest(F.lit(0.0), F.least(f"{v}1_a", f"{v}1_b") - F.greatest(f"{v}0_a", f"{v}0_b"))
    area = lambda s: (C(f"x1_{s}") - C(f"x0_{s}")) * (C(f"y1_{s}") - C(f"y0_{s}"))
    p = p.withColumns({"inter": over("x") * over("y"), "area_a": area("a"), "area_b": area("b"), "distance": metres.midlat_m(C("lng_a"), C("lat_a"), C("lng_b"), C("lat_b")),
                       "bge": ((a * 31 + b * 17) % 101).cast("double") / 100, "name_sim": ((a * 7 + b * 29) % 101).cast("double") / 100})
    p = p.withColumns({"iou": F.when(C("inter") > 0, C("inter") / (C("area_a") + C("area_b") - C("inter"))).otherwise(0.0), "inter_min": C("inter") / F.least("area_a", "area_b")})
    k = (a * 3 + b) % 8
    feats = {"distance": C("distance"), "conflict": F.when(k == 0, "phase").when(k == 1, "court"), "hierarchical": (a + 2 * b) % 9 == 0, "a_is_part": a % 2 == 0, "same_district": C("district_a") == C("district_b"), "number_conflict": (a + b) % 10 == 1,
             "exact_name": (a + b) % 17 == 0, "base_exact": (a + b) % 6 == 0, "one_number": (a * b) % 5 == 0, "name_sim": C("name_sim"), "bge": C("bge"), "iou": C("iou"), "inter_min": C("inter_min")}
    return p.withColumn("rule", relations.pair_rule(feats)).select("id_a", "id_b", "distance", "bge", "name_sim", "iou", "rule.relation", "rule.prob", "rule.conf")


@query(f"WITH {_PAIR_SQL} SELECT id_a, id_b, {q('iou', 6, 'iou')}, {q('distance', 3, 'distance')} FROM g")
def pair_iou(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id_a", "id_b", r(C("iou"), 6, "iou"), r(C("distance"), 3, "distance"))


@query(f"WITH {_PAIR_SQL} SELECT id_a, id_b, relation FROM scored")
def pair_rule_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id_a", "id_b", "relation")


_TIER_SQL = "CASE WHEN relation = 'POSSIBLE_MERGE_ERROR' OR coalesce(iou >= 0.15, false) OR coalesce(ce >= 0.85 AND distance < 1500, false) THEN 1 WHEN relation = 'NOT_SAME_ENTITY' OR coalesce(ce < 0.3, false) OR coalesce(bge < 0.6 AND iou = 0, false) THEN 3 ELSE 2 END"


@query(f"WITH {_PAIR_SQL} SELECT relation, {_TIER_SQL.replace('(ce ', '(bge ')} AS tier, count(*) AS n FROM scored GROUP BY ALL")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("relation", relations.work_tier(C("relation"), C("iou"), C("bge"), C("bge"), C("distance")).alias("tier")).groupBy("relation", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT upper(trim(relation_type)) AS relation, CASE WHEN isnan(iou) THEN NULL ELSE iou END AS iou, CASE WHEN isnan(cross_encoder_score) THEN NULL ELSE cross_encoder_score END AS ce, CASE WHEN isnan(bge_sim) THEN NULL ELSE bge_sim END AS bge, CASE WHEN isnan(distance_m) THEN NULL ELSE distance_m END AS distance FROM entity_relations WHERE relation_type IS NOT NULL)
 SELECT relation, {_TIER_SQL} AS tier, count(*) AS n FROM r GROUP BY ALL""")
def work_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_relations").where("relation_type IS NOT NULL").withColumn("relation", F.upper(F.trim("relation_type")))
    return e.select("relation", relations.work_tier(C("relation"), C("iou"), C("cross_encoder_score"), C("bge_sim"), C("distance_m")).alias("tier")).groupBy("relation", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(city, 'ALL') AS city, bin, n FROM (SELECT subject_city AS city, CASE WHEN iou < 0.01 THEN 0 WHEN iou < 0.05 THEN 1 WHEN iou < 0.15 THEN 2 WHEN iou < 0.35 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM entity_relations
 WHERE iou >= 0 AND iou < 1.01 AND NOT isnan(iou) AND subject_city IS NOT NULL GROUP BY GROUPING SETS ((subject_city, bin), (bin)))""")
def iou_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_relations").where("iou >= 0 AND NOT isnan(iou) AND iou < 1.01 AND subject_city IS NOT NULL")
    e = e.select(C("subject_city").alias("city"), evaluation.histogram(C("iou"), (0.0, 0.01, 0.05, 0.15, 0.35, 1.01)).alias("bin"))
    g = e.groupingSets([["city", "bin"], ["bin"]], "city", "bin").agg(F.count(F.lit(1)).alias("n"), F.grouping("city").alias("_g"))
    return g.select(F.when(C("_g") == 1, "ALL").otherwise(C("city")).alias("city"), "bin", "n")


@query(f"WITH {_PAIR_SQL}, p AS (SELECT id_a, id_b, CASE WHEN relation = 'POSSIBLE_MERGE_ERROR' THEN 'COLLISION' WHEN iou >= 0.35 THEN 'HIGH' WHEN iou >= 0.05 THEN 'MEDIUM' WHEN iou > 0 THEN 'LOW' END AS priority FROM scored) SELECT priority, count(*) AS n FROM p WHERE priority IS NOT NULL GROUP BY 1")
def overlap_goals(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(relations.overlap_priority(C("relation"), C("iou")).alias("priority")).where("priority IS NOT NULL").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


_CLUSTER_SQL = f"""RECURSIVE {_SPATIAL_SQL}, e AS (SELECT id_a AS a, id_b AS b FROM spatial UNION SELECT id_b, id_a FROM spatial),
 reach AS (SELECT id AS v, id AS u FROM fences UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.u = e.a), comp AS (SELECT v AS id, min(u) AS component FROM reach GROUP BY v)"""


@query(f"WITH {_CLUSTER_SQL} SELECT id, component FROM comp")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(views.fences(spark, d), _spatial(spark, d).select(C("id_a").alias("a"), C("id_b").alias("b")))


@query(f"WITH {_CLUSTER_SQL}, j AS (SELECT component, id, name, bal FROM comp JOIN fences USING (id)) SELECT component, arg_min(name, (-length(trim(name)), id)) AS canonical_name, arg_min(id, (-bal, id)) AS best_key, count(*) AS member_count, CASE WHEN count(*) > 1 THEN CAST(0.98 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END AS identity_confidence FROM j GROUP BY 1")
def canonical_best(spark: SparkSession, d: str) -> DataFrame:
    f = views.fences(spark, d)
    comp = graph.connected_components(f, _spatial(spark, d).select(C("id_a").alias("a"), C("id_b").alias("b")))
    return graph.canonical_records(comp.join(f, "id"), "component", "id", "name", "bal")


@query()
def place_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_entities").select("canonical_entity_id", "city", "canonical_name").distinct()
    return graph.hierarchy(e.where("canonical_name IS NOT NULL"), "canonical_entity_id", "city", "canonical_name").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))


# ---- names

@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(n, '商业街|商场|超市|批发市场|物流园|产业园|科技园|写字楼|宾馆|酒店|商厦|商务大厦|购物中心') AND NOT dorm AND NOT estate THEN 'NON_RESIDENTIAL_COMMERCIAL'
   WHEN regexp_matches(n, '大厦|广场|中心') AND NOT estate AND NOT dorm AND NOT court THEN 'NON_RESIDENTIAL_COMMERCIAL'
   WHEN (regexp_matches(n, '(研究所|科研所|设计院|公司|厂|医院|中学|小学|幼儿园|大学|学院|局|站)$') OR regexp_matches(n, '(研究所|科研所|设计院|公司|制药厂|化工厂|人民医院|附属医院)')) AND NOT dorm AND NOT court AND NOT estate THEN 'NON_RESIDENTIAL_FACILITY'
   WHEN dorm THEN 'RESIDENTIAL_DORMITORY' WHEN court THEN 'RESIDENTIAL_COURTYARD' ELSE 'RESIDENTIAL_COMMUNITY' END AS kind
 FROM (SELECT trim(canonical_name) AS n, regexp_matches(canonical_name, '宿舍|家属|职工住宅|教师楼|干部楼|家属院|家属区|生活区|生活小区|住宅区') AS dorm, regexp_matches(canonical_name, '([甲乙丙丁]?[0-9]+|[一二三四五六七八九十百]+)号院') AS court, regexp_matches(canonical_name, '小区|家园|花园|苑|里|庄|村|公寓|住宅') AS estate FROM canonical_entities WHERE canonical_name IS NOT NULL)) GROUP BY 1""")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_entities").where("canonical_name IS NOT NULL").select(text.entity_type(C("canonical_name")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT phase, subarea, count(*) AS n FROM (SELECT nullif(regexp_extract(trim(canonical_name), '[一二三四五六七八九十0-9]+期'), '') AS phase, nullif(regexp_extract(trim(canonical_name), '东区|西区|南区|北区|中区|东院|西院|南院|北院|[A-Z]区|[A-Z][0-9]+|[一二三四五六七八九十0-9]+区'), '') AS subarea FROM canonical_entities) GROUP BY ALL""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(C("canonical_name"))
    return table(spark, d, "canonical_entities").select(t["phase"].alias("phase"), t["subarea"].alias("subarea")).groupBy("phase", "subarea").agg(F.count(F.lit(1)).alias("n"))


@query()
def name_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_entities").where("canonical_name IS NOT NULL").select(text.components(C("canonical_name")).alias("c"))
    return e.select(F.explode(F.map_keys("c.parts")).alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT prefix, count(*) AS n FROM (SELECT CASE WHEN length(n) >= 3 THEN substr(n, 1, 3) END AS prefix FROM (SELECT CASE WHEN contains(n, '(') THEN list_extract(string_split(n, ')'), -1) ELSE n END AS n FROM (SELECT translate(replace(name_raw, ' ', ''), '（）', '()') AS n FROM source_records WHERE name_raw IS NOT NULL))) GROUP BY 1""")
def name_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records").where("name_raw IS NOT NULL").select(text.name_prefix(C("name_raw")).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
 g AS (SELECT id, x, y, list_distinct([substr(x, i, 2) FOR i IN range(1, length(x))]) AS gx, list_distinct([substr(y, i, 2) FOR i IN range(1, length(y))]) AS gy FROM p)
 SELECT id, {q('CAST(2 * len(list_intersect(gx, gy)) AS DOUBLE) / greatest(length(x) + length(y) - 2, 1)', 6, 'dice')} FROM g""")
def bigram_dice(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = p.join(p.select((C("p_partkey") - 1).alias("p_partkey"), C("p_name").alias("y")), "p_partkey")
    return j.select(C("p_partkey").alias("id"), r(text.bigram_dice(C("p_name"), C("y")), 6, "dice"))


@query()
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = p.join(p.select((C("p_partkey") - 1).alias("p_partkey"), C("p_name").alias("y")), "p_partkey")
    return j.select(C("p_partkey").alias("id"), F.round(text.sequence_ratio("p_name", "y"), 6).alias("ratio"))


# ---- gates and trust

_FACTS_SQL = """facts AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'RESIDENTIAL_ESTATE' WHEN 'O' THEN 'COMPOUND' ELSE 'UNKNOWN' END AS entity_type, CASE WHEN o_orderkey % 4 = 0 THEN 'PHYSICAL_BOUNDARY' ELSE 'LEGAL_BOUNDARY' END AS boundary_role,
  o_orderkey % 19 = 0 AS geometry_empty, o_orderkey % 23 = 0 AS parse_error, o_orderkey % 17 <> 0 AS geometry_valid, o_totalprice AS area_m2, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS compactness, o_orderkey % 3 AS evidence_n,
  CASE WHEN o_orderkey % 29 = 0 THEN 'fatal explicit_exclusion' ELSE 'survey' END AS content, CASE WHEN o_orderkey % 2 = 0 THEN 'AreaPriorBaseline' ELSE 'OSM' END AS sole_source, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score FROM orders),
gated AS (SELECT *, CASE WHEN entity_type NOT IN ('RESIDENTIAL_ESTATE', 'COMPOUND') THEN 'FAILED' WHEN entity_type = 'RESIDENTIAL_ESTATE' AND boundary_role = 'PHYSICAL_BOUNDARY' THEN 'WARNED' ELSE 'PASSED' END AS onto,
  CASE WHEN geometry_empty OR parse_error OR NOT geometry_valid THEN 'BLOCKED' WHEN area_m2 < 100 OR area_m2 > 5000000 THEN 'FAILED' WHEN compactness < 0.05 THEN 'WARNED' ELSE 'PASSED' END AS geom,
  CASE WHEN evidence_n > 0 AND content LIKE '%explicit_exclusion%' THEN 'BLOCKED' WHEN evidence_n = 0 THEN 'FAILED' WHEN evidence_n = 1 AND sole_source = 'AreaPriorBaseline' THEN 'WARNED' ELSE 'PASSED' END AS evid FROM facts),
final AS (SELECT *, CASE WHEN 'BLOCKED' IN (onto, geom, evid) THEN 'REJECTED' WHEN onto = 'FAILED' OR geom = 'FAILED' THEN 'REJECTED' WHEN evid = 'FAILED' THEN 'UNRESOLVED' WHEN 'WARNED' IN (onto, geom, evid) THEN 'PROVISIONAL' ELSE 'TRUSTED' END AS disposition, 'WARNED' IN (onto, geom, evid) AS warned FROM gated)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    n = k % 3
    content = F.when(k % 29 == 0, "fatal explicit_exclusion").otherwise("survey")
    f = table(spark, d, "orders").select(
        k.alias("id"), F.when(C("o_orderstatus") == "F", "RESIDENTIAL_ESTATE").when(C("o_orderstatus") == "O", "COMPOUND").otherwise("UNKNOWN").alias("entity_type"), F.when(k % 4 == 0, "PHYSICAL_BOUNDARY").otherwise("LEGAL_BOUNDARY").alias("boundary_role"),
        (k % 19 == 0).alias("geometry_empty"), (k % 23 == 0).alias("parse_error"), (k % 17 != 0).alias("geometry_valid"), C("o_totalprice").alias("area_m2"), ((k % 100).cast("double") / 100).alias("compactness"), n.alias("evidence_n"),
        F.array_repeat(content, n.cast("int")).alias("evidence_contents"), F.array_repeat(F.lit("OSM"), n.cast("int")).alias("evidence_sources"), F.when(k % 2 == 0, "AreaPriorBaseline").otherwise("OSM").alias("sole_source"), ((k % 101).cast("double") / 100).alias("score"),
    )
    f = f.withColumns({"onto": gates.gate(gates.ONTOLOGY)["status"], "geom": gates.gate(gates.GEOMETRY)["status"], "evid": gates.gate(gates.EVIDENCE)["status"]})
    warned = (C("onto") == "WARNED") | (C("geom") == "WARNED") | (C("evid") == "WARNED")
    return f.withColumns({"disposition": gates.final_disposition(C("onto"), C("geom"), C("evid")), "warned": warned})


@query(f"WITH {_FACTS_SQL} SELECT onto, geom, evid, count(*) AS n FROM gated GROUP BY ALL")
def gate_spec_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).groupBy("onto", "geom", "evid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FACTS_SQL} SELECT id, disposition FROM final")
def final_disposition(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("id", "disposition")


@query(f"""WITH {_FACTS_SQL}, c(consumer, lo, prov, topo) AS (VALUES ('Visit', CAST(0.5 AS DOUBLE), true, false), ('Territory', CAST(0.7 AS DOUBLE), false, true), ('Strict', CAST(0.85 AS DOUBLE), false, false)),
 x AS (SELECT consumer, CASE WHEN disposition IN ('TRUSTED', 'PROVISIONAL') AND (disposition <> 'PROVISIONAL' OR prov) AND score >= lo AND NOT topo THEN CASE WHEN warned OR disposition = 'PROVISIONAL' THEN 'READY_WITH_WARNING' ELSE 'READY' END ELSE 'NOT_READY' END AS decision FROM final CROSS JOIN c) SELECT consumer, decision, count(*) AS n FROM x GROUP BY ALL""")
def consumer_readiness(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([("Visit", 0.5, True, False), ("Territory", 0.7, False, True), ("Strict", 0.85, False, False)], "consumer string, min_confidence double, allow_provisional boolean, needs_topology boolean")
    return gates.consumer_decisions(_gated(spark, d), c).groupBy("consumer", "decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEDGER_SQL}, live AS (SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger o WHERE o.entity_id = l.entity_id AND o.gone = l.evidence_id)),
 a AS (SELECT entity_id, count(*) AS active, bool_or(kind = 'REFUTING') AS refuted, bool_or(kind = 'SUPPORTING' AND category = 'GEOMETRY') AND bool_or(kind = 'SUPPORTING' AND category = 'AUDIT') AS full_set FROM live GROUP BY 1)
 SELECT entity_id, CASE WHEN refuted THEN 'REJECTED' WHEN full_set THEN 'TRUSTED' ELSE 'UNRESOLVED' END AS disposition, coalesce(active, 0) AS active FROM (SELECT DISTINCT entity_id FROM ledger) LEFT JOIN a USING (entity_id)""")
def ledger_disposition(spark: SparkSession, d: str) -> DataFrame:
    return trust.ledger_disposition(views.ledger(spark, d)).select("entity_id", "disposition", "active")


@query(f"""WITH {LEDGER_SQL}, w AS (SELECT entity_id, seq, kind, CASE WHEN bool_or(kind = 'REFUTING') OVER p THEN 'REJECTED' WHEN bool_or(kind = 'SUPPORTING' AND category = 'GEOMETRY') OVER p AND bool_or(kind = 'SUPPORTING' AND category = 'AUDIT') OVER p THEN 'TRUSTED' ELSE 'UNRESOLVED' END AS disposition FROM ledger WINDOW p AS (PARTITION BY entity_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT *, lag(disposition) OVER (PARTITION BY entity_id ORDER BY seq) AS previous FROM w)
 SELECT disposition, previous, count(*) AS n FROM v GROUP BY ALL""")
def ledger_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return trust.ledger_snapshots(views.ledger(spark, d)).groupBy("disposition", "previous").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEDGER_SQL}, c AS (SELECT entity_id, count(*) FILTER (WHERE kind = 'SUPPORTING') AS s, count(*) FILTER (WHERE kind = 'REFUTING') AS f FROM ledger GROUP BY 1),
 m AS (SELECT entity_id, 1 - pow(CAST(0.4 AS DOUBLE), s) AS hs, pow(CAST(0.4 AS DOUBLE), s) AS us, 1 - pow(CAST(0.4 AS DOUBLE), f) AS nr, pow(CAST(0.4 AS DOUBLE), f) AS ur FROM c)
 SELECT entity_id, {q('hs * ur / (1 - hs * nr)', 6, 'h')}, {q('nr * us / (1 - hs * nr)', 6, 'nn')}, {q('hs * nr', 6, 'conflict')} FROM m""")
def ds_opinion(spark: SparkSession, d: str) -> DataFrame:
    n = views.ledger(spark, d).groupBy("entity_id").agg(F.count_if(C("kind") == "SUPPORTING").alias("s"), F.count_if(C("kind") == "REFUTING").alias("f"))
    m = trust.count_masses(C("s"), C("f"))
    return n.withColumn("m", m).select("entity_id", r(C("m.h"), 6, "h"), r(C("m.n"), 6, "nn"), r(C("m.conflict"), 6, "conflict"))


@query("""WITH d AS (SELECT user_id, event_id % 4 AS a, user_id % 4 AS b FROM events) SELECT jn, mt, count(*) AS n FROM (SELECT ['REJECTED', 'UNRESOLVED', 'PROVISIONAL', 'TRUSTED'][greatest(a, b) + 1] AS jn, ['REJECTED', 'UNRESOLVED', 'PROVISIONAL', 'TRUSTED'][least(a, b) + 1] AS mt FROM d) GROUP BY ALL""")
def lattice_join_meet(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(trust.unrank((C("event_id") % 4).cast("int")).alias("a"), trust.unrank((C("user_id") % 4).cast("int")).alias("b"))
    return e.select(trust.join_(C("a"), C("b")).alias("jn"), trust.meet(C("a"), C("b")).alias("mt")).groupBy("jn", "mt").agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_chain_heads(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(C("user_id").alias("run_id"), C("event_id").alias("seq"), "event_type", C("value").cast("decimal(18,4)").alias("value"))
    return trust.hash_chain(log).groupBy("run_id").agg(F.max_by("event_hash", "seq").alias("head"), F.count(F.lit(1)).alias("events"))


_STATE_SQL = f"""{FENCES_SQL}, state AS (SELECT id AS entity_id, CASE id % 5 WHEN 0 THEN 'VERIFIED_VALID' WHEN 1 THEN 'REPAIRED_AUTO' WHEN 2 THEN 'RECONSTRUCTED' ELSE 'QUARANTINED' END AS status, id % 3 <> 0 AS ready, CASE WHEN id % 7 = 0 THEN NULL ELSE lng END AS lng, lat, width_m * height_m * 20 AS area_m2 FROM fences),
findings AS (SELECT o_custkey AS entity_id, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' ELSE 'MINOR' END AS severity, o_orderstatus = 'O' AS active, o_orderkey % 2 = 0 AS blocks FROM orders)"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = C("id") % 5
    s = views.fences(spark, d).select(C("id").alias("entity_id"), F.when(k == 0, "VERIFIED_VALID").when(k == 1, "REPAIRED_AUTO").when(k == 2, "RECONSTRUCTED").otherwise("QUARANTINED").alias("status"), (C("id") % 3 != 0).alias("ready"), F.when(C("id") % 7 != 0, C("lng")).alias("lng"), "lat", (C("width_m") * C("height_m") * 20).alias("area_m2"))
    o = table(spark, d, "orders").select(C("o_custkey").alias("entity_id"), C("o_orderkey").alias("seq"), F.when(C("o_orderpriority") == "1-URGENT", "CRITICAL").otherwise("MINOR").alias("severity"), (C("o_orderstatus") == "O").alias("active"), F.when(C("o_orderkey") % 2 == 0, F.array(F.lit("market-partition"))).otherwise(F.array(F.lit("visit"))).alias("blocked_consumers"))
    return s, o


@query(f"WITH {_STATE_SQL}, last AS (SELECT entity_id, arg_max(severity, seq) AS severity FROM findings GROUP BY 1) SELECT s.entity_id, s.area_m2 FROM state s LEFT JOIN last USING (entity_id) WHERE status IN ('VERIFIED_VALID', 'REPAIRED_AUTO') AND coalesce(severity, '') <> 'CRITICAL' AND lng IS NOT NULL AND area_m2 <= 2000000")
def territory_adapter(spark: SparkSession, d: str) -> DataFrame:
    return trust.territory_ready(*_state(spark, d))


@query(f"WITH {_STATE_SQL} SELECT entity_id FROM state WHERE ready AND (lng <> 0 OR lat <> 0)")
def visit_adapter(spark: SparkSession, d: str) -> DataFrame:
    return trust.visit_ready(_state(spark, d)[0])


@query(f"WITH {_STATE_SQL} SELECT entity_id FROM state s WHERE ready AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.entity_id = s.entity_id AND f.active AND f.blocks)")
def decision_ready(spark: SparkSession, d: str) -> DataFrame:
    return trust.decision_ready(*_state(spark, d), "market-partition")


@query(f"WITH {_PAIR_SQL} SELECT id AS entity_id FROM fences WHERE id NOT IN (SELECT id_b FROM scored WHERE relation = 'POSSIBLE_MERGE_ERROR' AND iou > 0.3)")
def coverage_adapter(spark: SparkSession, d: str) -> DataFrame:
    return trust.coverage_ready(views.fences(spark, d).select(C("id").alias("entity_id")), _scored(spark, d).select(C("id_b").alias("object_id"), "relation", "iou"))


# ---- land use

_MAP_SQL = "CASE WHEN osm_fclass IN ('park', 'grass', 'scrub', 'recreation_ground') AND coalesce(regexp_matches(name, '体育|运动|球场|场馆|健身|竞技'), false) THEN 'A4' ELSE coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in landuse.LANDUSE["city"].items()) + "}[osm_fclass], 'U') END"


@query(f"SELECT face_id, {_MAP_SQL} AS code FROM (SELECT DISTINCT face_id, name, osm_fclass FROM landuse_faces)")
def landuse_classify(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "landuse_faces").select("face_id", "name", "osm_fclass").distinct()
    return f.select("face_id", landuse.landuse_code(C("osm_fclass"), C("name"), "city").alias("code"))


@query(f"WITH f AS (SELECT {_MAP_SQL} AS code FROM (SELECT DISTINCT face_id, name, osm_fclass FROM landuse_faces)), d AS (SELECT unnest({list(landuse.CLASSES)!r}) AS code) SELECT d.code, count(f.code) AS n, round(CAST(count(f.code) AS DOUBLE) / greatest((SELECT count(*) FROM f), 1), 6) AS share FROM d LEFT JOIN f ON f.code = d.code GROUP BY 1")
def landuse_distribution(spark: SparkSession, d: str) -> DataFrame:
    return landuse.distribution(landuse_classify(spark, d), "code")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND regexp_matches(fclass, '^(park|grass|scrub|recreation_ground|forest)$') AND regexp_matches(name, '体育|运动场$|球[场馆]$|健身|竞技') THEN 'SPORT-PARK' WHEN regexp_matches(name, '医院|卫生院|诊所|卫生服务中心|保健院') THEN 'HOSPITAL-NODE' WHEN regexp_matches(name, '小学$|中学$|幼儿园$|学校$|附中|附小') THEN 'SCHOOL-SUFFIX' WHEN regexp_matches(name, '便利店|^市场$|购物中心|商场|超市$') THEN 'MARKET-NOUN' WHEN regexp_matches(name, '工厂|工业区') THEN 'INDUSTRIAL-NOUN' END AS rule_id
 FROM (SELECT p_partkey, ['park', 'forest', 'residential', 'retail'][p_partkey % 4 + 1] AS fclass, ['体育公园', '镇卫生院', '第一小学', '商场', '工厂', '公园'][p_partkey % 6 + 1] AS name FROM part)""")
def name_rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    k = C("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    rule = landuse.first_rule(F.when(k % 3 == 0, "landuse").otherwise("poi_a"), pick(["park", "forest", "residential", "retail"], 4), pick(["体育公园", "镇卫生院", "第一小学", "商场", "工厂", "公园"], 6))
    return table(spark, d, "part").select(k.alias("id"), rule["rule_id"].alias("rule_id"))


@query("WITH v AS (SELECT c_nationkey AS face, c_mktsegment AS code, count(*) AS n FROM customer GROUP BY ALL) SELECT face, arg_min(code, (-n, code)) AS vote, max(n) AS votes FROM v GROUP BY 1 HAVING max(n) >= 2")
def poi_vote(spark: SparkSession, d: str) -> DataFrame:
    return landuse.majority_vote(table(spark, d, "customer").select(C("c_nationkey").alias("face"), C("c_mktsegment").alias("code")), "face", "code")


# ---- evaluation

@query(f"""WITH {PRED_SQL}, b AS (SELECT CAST(floor(confidence * 10) AS INT) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS INT)) AS a FROM pred WHERE confidence < 1 GROUP BY 1)
 SELECT CAST(d.bin AS INT) AS bin, coalesce(n, 0) AS n, {q('coalesce(c, (d.bin + CAST(0.5 AS DOUBLE)) / 10)', 6, 'mean_confidence')}, {q('coalesce(a, 0)', 6, 'accuracy')}, {q('coalesce(abs(c - a), 0)', 6, 'gap')} FROM (SELECT unnest(range(10)) AS bin) d LEFT JOIN b ON b.bin = d.bin""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration_bins(views.predictions(spark, d), "confidence", "correct").select("bin", "n", r(C("mean_confidence"), 6, "mean_confidence"), r(C("accuracy"), 6, "accuracy"), r(C("gap"), 6, "gap"))


@query(f"""WITH {PRED_SQL}, b AS (SELECT CAST(floor(confidence * 10) AS INT) AS bin, count(*) AS n, abs(avg(confidence) - avg(CAST(correct AS INT))) AS gap FROM pred WHERE confidence < 1 GROUP BY 1) SELECT {q('sum(gap * n) / (SELECT count(*) FROM pred)', 6, 'ece')}, {q('max(gap)', 6, 'mce')} FROM b""")
def ece_mce(spark: SparkSession, d: str) -> DataFrame:
    p = views.predictions(spark, d)
    return evaluation.calibration_error(evaluation.calibration_bins(p, "confidence", "correct"), p.agg(F.count(F.lit(1)).alias("n"))).select(r(C("ece"), 6, "ece"), r(C("mce"), 6, "mce"))


@query(f"""WITH {PRED_SQL}, b AS (SELECT CAST(floor(confidence * 10) AS INT) AS bin, avg(CAST(correct AS INT)) AS a FROM pred WHERE confidence < 1 GROUP BY 1) SELECT id, {q('coalesce(a, confidence)', 6, 'calibrated')} FROM pred LEFT JOIN b ON b.bin = CAST(floor(confidence * 10) AS INT)""")
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = views.predictions(spark, d)
    return evaluation.calibrated(p, evaluation.calibration_bins(p, "confidence", "correct"), "confidence").select("id", r(C("calibrated"), 6, "calibrated"))


@query(f"""WITH {RUNS_SQL} SELECT experiment_id, count(*) AS runs, round(avg(CAST(candidate_count > 0 AS INT)), 6) AS applicability, round(coalesce(avg(top1_iou) FILTER (WHERE candidate_count > 0), 0), 6) AS top1_quality,
 round(avg(CAST(disposition = 'TRUSTED' AS INT)), 6) AS trusted_coverage, round(avg(CAST(disposition = 'UNRESOLVED' AS INT)), 6) AS abstention FROM runs GROUP BY 1""")
def provider_applicability(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.experiment_metrics(views.runs(spark, d))


@query(f"""WITH {RUNS_SQL} SELECT experiment_id, code, count(*) AS n FROM (SELECT experiment_id, CASE WHEN candidate_count = 0 THEN 'NO_CANDIDATE' WHEN oracle_iou + CAST(1e-9 AS DOUBLE) < 0.5 THEN 'GENERATION_CEILING' WHEN top1_iou + CAST(1e-9 AS DOUBLE) < 0.5 THEN 'RANKING_MISS' WHEN disposition = 'REJECTED' THEN 'VALIDATION_REJECT' WHEN disposition = 'UNRESOLVED' THEN 'EVIDENCE_GAP' END AS code FROM runs) WHERE code IS NOT NULL GROUP BY ALL""")
def failure_by_code(spark: SparkSession, d: str) -> DataFrame:
    x = views.runs(spark, d).select("experiment_id", evaluation.failure_code(C("candidate_count"), C("oracle_iou") + 1e-9, C("top1_iou") + 1e-9, C("disposition")).alias("code"))
    return x.where("code IS NOT NULL").groupBy("experiment_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS_SQL} SELECT oracle_iou + CAST(1e-9 AS DOUBLE) >= 0.5 AS oracle_ok, top1_iou + CAST(1e-9 AS DOUBLE) >= 0.5 AS top1_ok, count(*) AS n FROM runs GROUP BY ALL")
def oracle_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quadrants(views.runs(spark, d).withColumns({"oracle_iou": C("oracle_iou") + 1e-9, "top1_iou": C("top1_iou") + 1e-9}))


@query(f"""WITH {FENCES_SQL}, s AS (SELECT id, city, least(1, CAST(0.3 AS DOUBLE) + CASE WHEN a BETWEEN 5000 AND 200000 THEN CAST(0.25 AS DOUBLE) WHEN a BETWEEN 1000 AND 1000000 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN sd < 50 THEN CAST(0.15 AS DOUBLE) WHEN sd < 150 THEN CAST(0.08 AS DOUBLE) ELSE 0 END
  + CASE WHEN id % 2 = 0 THEN CAST(0.05 AS DOUBLE) ELSE 0 END + CASE WHEN id % 150 BETWEEN 3 AND 100 THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS score FROM (SELECT id, city, width_m * height_m AS a, CAST(id % 300 AS DOUBLE) AS sd FROM fences))
 SELECT id, {q('score', 4, 'score')}, rank() OVER (PARTITION BY city ORDER BY round(score, 6) DESC, id) AS rnk FROM s""")
def rank_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = hypotheses.rank_score(C("width_m") * C("height_m"), (C("id") % 300).cast("double"), C("id") % 2 == 0, C("id") % 150, F.lit(False), F.lit(False))
    x = views.fences(spark, d).select("id", "city", s.alias("score"))
    return x.select("id", r(C("score"), 4, "score"), F.rank().over(Window.partitionBy("city").orderBy(F.desc(F.round("score", 6)), "id")).cast("bigint").alias("rnk"))


@query(f"""WITH {FENCES_SQL} SELECT id, {q("CAST(0.3 AS DOUBLE) * CASE WHEN id % 4 <> 0 THEN 1 ELSE CAST(0.4 AS DOUBLE) END + CAST(0.35 AS DOUBLE) * exp(CAST(-0.8 AS DOUBLE) * abs(ln(greatest(width_m * height_m / 25000, CAST(0.01 AS DOUBLE))))) + CAST(0.2 AS DOUBLE) * least(1, pi() * width_m * height_m / ((width_m + height_m) * (width_m + height_m))) + CAST(0.15 AS DOUBLE) * CASE id % 3 WHEN 0 THEN CAST(0.9 AS DOUBLE) WHEN 1 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END", 5, 'score')} FROM fences""")
def fusion_scores(spark: SparkSession, d: str) -> DataFrame:
    m = F.element_at(F.array(*[F.lit(x) for x in ("ROAD_ENCLOSED_BLOCK", "BUILDING_CONCAVE_HULL", "AREA_CALIBRATED_BUFFER")]), (C("id") % 3 + 1).cast("int"))
    a = C("width_m") * C("height_m")
    s = hypotheses.fusion_score(C("id") % 4 != 0, a, F.lit(25000.0), F.pi() * a / ((C("width_m") + C("height_m")) * (C("width_m") + C("height_m"))), m)
    return views.fences(spark, d).select("id", r(s, 5, "score"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) / 100 AS over, CAST(o_orderkey % 90 AS DOUBLE) AS gap, CAST(o_orderkey % 12 AS DOUBLE) AS shared, o_orderkey % 3 = 0 AS sep FROM orders)
 SELECT relation, count(*) AS n FROM (SELECT CASE WHEN over > 2500 THEN 'OVERLAP_CONFLICT' WHEN gap > 0 AND gap < 50 AND sep THEN 'SEPARATED_BY' WHEN gap > 0 AND gap < 50 THEN 'GAP_CONFLICT' WHEN gap = 0 AND shared > 5 THEN 'SHARED_BOUNDARY' ELSE 'UNKNOWN' END AS relation FROM o) GROUP BY 1""")
def topology_relations(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    t = hypotheses.topology(C("o_totalprice") / 100 / 25, (k % 90).cast("double"), (k % 12).cast("double"), k % 3 == 0)
    return table(spark, d, "orders").select(t.alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT l_partkey % 200 AS fence, l_linenumber - 1 AS angle, median(CAST(l_extendedprice AS DOUBLE)) AS m FROM lineitem GROUP BY ALL), raw AS (SELECT fence, m AS raw FROM m WHERE angle = 0)
 SELECT fence, raw, count(*) FILTER (WHERE m < raw) AS better, round(CAST(count(*) FILTER (WHERE m < raw) AS DOUBLE) / (count(*) + 1), 6) AS p FROM m JOIN raw USING (fence) WHERE angle <> 0 GROUP BY ALL""")
def placebo_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((C("l_partkey") % 200).alias("fence"), (C("l_linenumber") - 1).alias("angle"), C("l_extendedprice").cast("double").alias("v"))
    return hypotheses.placebo_p(rows, "fence", "angle", "v").withColumn("p", F.round("p", 6))


@query(f"""WITH {FENCES_SQL} SELECT label, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 0 THEN 'ORPHAN_NO_ROADS' WHEN a > 200 AND b > 200 THEN 'ORPHAN_FAR' WHEN a <= CAST(0.6 AS DOUBLE) * b THEN 'ROAD_ALIGNED' WHEN b <= CAST(0.6 AS DOUBLE) * a THEN 'POLYGON_CRS_WGS84' WHEN b <= CAST(0.8 AS DOUBLE) * a THEN 'POLYGON_CRS_WGS84_PROBABLE' ELSE 'NONE' END AS label FROM (SELECT id, CAST((id * 13) % 260 AS DOUBLE) AS a, CAST((id * 29) % 260 AS DOUBLE) AS b FROM fences)) GROUP BY 1""")
def crs_labels(spark: SparkSession, d: str) -> DataFrame:
    lab = hypotheses.crs_label(C("id") % 10, (C("id") * 13 % 260).cast("double"), (C("id") * 29 % 260).cast("double"))
    return views.fences(spark, d).select(lab.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FENCES_SQL} SELECT id, district FROM (SELECT id, district, row_number() OVER (PARTITION BY district ORDER BY (id * 48271) % 2147483647, id) AS k FROM fences) WHERE k <= 7")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stratified_sample(views.fences(spark, d).select("id", "district"), "district", F.struct(C("id") * 48271 % 2147483647, C("id")), 7)


@query(f"""WITH {FENCES_SQL}, p AS (SELECT s_suppkey AS other, CAST(116.0 AS DOUBLE) + CAST((s_suppkey * 7907) % 1000 AS DOUBLE) / 2000 AS x2, CAST(39.6 AS DOUBLE) + CAST((s_suppkey * 104723) % 1000 AS DOUBLE) / 2000 AS y2 FROM supplier),
 j AS (SELECT id, other, sqrt(pow(lng - x2, 2) + pow(lat - y2, 2)) AS dist FROM fences CROSS JOIN p)
 SELECT id, {q('min(dist)', 6, 'dist')} FROM j GROUP BY 1""")
def nearest_poi(spark: SparkSession, d: str) -> DataFrame:
    k = C("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("other"), (F.lit(116.0) + (k * 7907 % 1000).cast("double") / 2000).alias("x"), (F.lit(39.6) + (k * 104723 % 1000).cast("double") / 2000).alias("y"))
    n = hypotheses.nearest(views.fences(spark, d).select("id", C("lng").alias("x"), C("lat").alias("y")), p, "id", 0.05)
    return n.select("id", r(C("dist"), 6, "dist"))


# ---- vectors

@query(f"WITH e AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nn FROM e) SELECT vec_id, {q('nn', 4, 'norm')}, {q('v[1] / CASE WHEN nn = 0 THEN 1 ELSE nn END', 5, 'first')} FROM n")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    e = table(spark, d, "embeddings").select("vec_id", norm.alias("nn"), v[0].alias("f"))
    return e.select("vec_id", r(C("nn"), 4, "norm"), r(C("f") / F.when(C("nn") == 0, 1.0).otherwise(C("nn")), 5, "first"))


@query(f"""WITH e AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS v FROM embeddings) SELECT a.vec_id AS id_a, b.vec_id AS id_b, {q('list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))', 5, 'cos')} FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.label = a.label AND b.vec_id <> a.vec_id""")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors of the same label."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("n", dot(C("v"), C("v")))
    a = e.where("vec_id % 100 = 0").select(C("vec_id").alias("id_a"), "label", C("v").alias("va"), C("n").alias("na"))
    j = e.join(a, "label").where("vec_id <> id_a")
    return j.select("id_a", C("vec_id").alias("id_b"), r(dot(C("va"), C("v")) / F.sqrt(C("na") * C("n")), 5, "cos"))


# ---- pipelines

@query()
def record_governance(spark: SparkSession, d: str) -> DataFrame:
    """Step 0 to 2 of the batch run over all records: coordinate status and quality decision counts."""
    from ..operators.pipelines import assessed_records

    a = assessed_records(table(spark, d, "source_records"))
    return a.select(C("coord.status").alias("status"), "decision", "entity_type").groupBy("status", "decision", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH g AS (SELECT source_record_id AS id, regexp_replace(lower(trim(geometry_raw_wkt)), '^srid\s*=\s*[0-9]+\s*;\s*', '') AS t FROM (SELECT DISTINCT source_record_id, geometry_raw_wkt FROM source_records)),
 ok AS (SELECT id, [CAST(v AS DOUBLE) FOR v IN regexp_extract_all(regexp_extract(t, '\(([^()]+)\)', 1), '-?[0-9.]+')] AS v FROM g WHERE regexp_full_match(t, 'polygon\s*\(\s*\(\s*-?[0-9.]+\s+-?[0-9.]+\s*(,\s*-?[0-9.]+\s+-?[0-9.]+\s*){3,}\)\s*\)')),
 e AS (SELECT id, v[1] AS ox, v[2] AS oy, unnest(range(1, len(v) - 2, 2)) AS k, v FROM ok)
 SELECT id, round(abs(sum((v[k] - ox) * (v[k + 3] - oy) - (v[k + 2] - ox) * (v[k + 1] - oy))) / 2 * 1e10, 1) AS area_e10 FROM e GROUP BY id""")
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """Shoelace area (in 1e-10 square degrees) of every record whose text is one plain polygon."""
    from ..functions.columns import wkt_mask
    from ..functions.rings import measures, ring_of

    s = table(spark, d, "source_records").select(C("source_record_id").alias("id"), "geometry_raw_wkt").distinct()
    s = s.where(wkt_mask(C("geometry_raw_wkt")).rlike(r"^polygon\s?\(R\)$"))
    return s.select("id", F.round(measures(ring_of(C("geometry_raw_wkt")))["area"] * 1e10, 1).alias("area_e10"))


@query()
def polygon_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Validity, hull ratio and inscribed radius of all entity polygons in Arrow batches, as counts by class."""
    from ..functions import kernel

    g = table(spark, d, "geometry_versions").select("geometry_wkt").distinct()
    g = g.select(kernel.wkt_valid("geometry_wkt").alias("valid"), kernel.wkt_hull_ratio("geometry_wkt").alias("hull"), kernel.wkt_inscribed("geometry_wkt").alias("mic"))
    return g.groupBy("valid", (C("hull") >= 0.9).alias("convexish"), (C("mic") >= 0.0003).alias("wide")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FENCES_SQL}, b AS (SELECT id, name, width_m * height_m AS prior, CASE WHEN width_m * height_m < 12000 THEN 'COURTYARD' WHEN width_m * height_m > 120000 THEN 'ESTATE' ELSE 'COMMUNITY' END AS scale FROM fences)
 SELECT scale, CASE WHEN CAST(1.035 AS DOUBLE) * prior BETWEEN greatest(500, CAST(0.4 AS DOUBLE) * prior) AND CAST(2.5 AS DOUBLE) * prior AND id % 6 <> 0 THEN 'PUBLISHED' ELSE 'FAILED_CLOSED' END AS state, count(*) AS n FROM b GROUP BY ALL""")
def generation_states(spark: SparkSession, d: str) -> DataFrame:
    """Final states of generation runs by scale."""
    from ..operators.pipelines import generation_runs

    f = views.fences(spark, d).select("name", "lng", "lat", (C("width_m") * C("height_m")).alias("prior_m2"), (C("id") % 6 != 0).alias("valid"))
    return generation_runs(f).groupBy("scale", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'named' AS "check", round(avg(CAST(name IS NOT NULL AND name <> '' AS INT)), 6) AS value, CASE WHEN avg(CAST(name IS NOT NULL AND name <> '' AS INT)) >= 0.5 THEN 'PASS' WHEN avg(CAST(name IS NOT NULL AND name <> '' AS INT)) >= 0.4 THEN 'WARN' ELSE 'FAIL' END AS status FROM landuse_faces
 UNION ALL SELECT 'has_class', round(avg(CAST(osm_fclass IS NOT NULL AS INT)), 6), CASE WHEN avg(CAST(osm_fclass IS NOT NULL AS INT)) >= 0.95 THEN 'PASS' WHEN avg(CAST(osm_fclass IS NOT NULL AS INT)) >= 0.85 THEN 'WARN' ELSE 'FAIL' END FROM landuse_faces""")
def city_checks(spark: SparkSession, d: str) -> DataFrame:
    """Shares that a city's layers must reach before classification."""
    from ..operators.pipelines import expectations

    return expectations(table(spark, d, "landuse_faces"), {"named": (C("name").isNotNull() & (C("name") != ""), 0.5), "has_class": (C("osm_fclass").isNotNull(), 0.95)})


@query()
def provider_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of the boundary providers for all fences over all other fences and buildings of suppliers, counted."""
    from ..operators.pipelines import knn_prior, provider_hypotheses

    f = views.fences(spark, d).select(C("id").alias("seed_id"), C("lng").alias("x"), C("lat").alias("y"), (C("width_m") * C("height_m")).alias("area_m2"))
    k = C("s_suppkey")
    b = table(spark, d, "supplier").select((F.lit(116.0) + (k * 7907 % 1000).cast("double") / 2000).alias("x"), (F.lit(39.6) + (k * 104723 % 1000).cast("double") / 2000).alias("y"), (k % 50 * 20 + 100).cast("double").alias("area_m2"))
    seeds = f.join(knn_prior(f, f, 0.02), "seed_id", "left").select("seed_id", "x", "y", "prior_m2")
    return provider_hypotheses(seeds, f.withColumnRenamed("seed_id", "poly_id"), b).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seed_id").alias("seeds"))


@query()
def segment_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Boundary pieces between corners of all entity polygons, counted by their number of edges."""
    from ..functions.rings import ring_of
    from ..operators.pipelines import boundary_segments

    g = table(spark, d, "geometry_versions").select("geometry_version_id", ring_of(C("geometry_wkt")).alias("ring")).where("ring IS NOT NULL").dropDuplicates(["geometry_version_id"])
    s = boundary_segments(g, "geometry_version_id", "ring")
    return s.select((C("last") - C("first")).alias("edges")).groupBy("edges").agg(F.count(F.lit(1)).alias("n"))
