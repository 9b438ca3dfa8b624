"""Queries of readers and sinks: rows are written in a source's format to the shared folder, read back, and compared with SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings
from ..runtime import shared_dir
from ..sources import readers, sinks
from ..sources.tables import table
from . import views
from .reference import C, q, query, r
from .views import FENCES_SQL


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cadastra/io-{uuid.uuid4().hex}"


def _written(df: DataFrame, key: str) -> str:
    """Writes the texts t, one file for each key, and gives the folder."""
    at = _folder(df.sparkSession)
    df.select(key, F.col("t").alias("value")).repartition(key).write.partitionBy(key).text(at)
    return at


def _collections(spark: SparkSession, d: str, geometry: str) -> str:
    """FeatureCollections of fences, one a city."""
    f = views.fences(spark, d)
    ring = F.array(*[F.array(C(a), C(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    coords = {"Polygon": F.array(ring), "MultiPolygon": F.array(F.array(ring)), "Point": F.array("lng", "lat")}[geometry]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(C("id").cast("string").alias("id"), "name").alias("properties"), F.struct(F.lit(geometry).alias("type"), coords.alias("coordinates")).alias("geometry"))
    c = f.groupBy("city").agg(F.collect_list(feature).alias("features"))  # a file holds its whole collection
    return _written(c.select("city", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("t")), "city")


_CENTRES = f"WITH {FENCES_SQL} SELECT id, name, {q('(x0 + x1) / 2', 6, 'x')}, {q('(y0 + y1) / 2', 6, 'y')} FROM boxes"


def _centres(g: DataFrame) -> DataFrame:
    m = rings.measures(rings.ring_of(C("wkt")))
    return g.select(C("properties")["id"].cast("bigint").alias("id"), C("properties")["name"].alias("name"), m.alias("m")).select("id", "name", r(C("m.cx"), 6, "x"), r(C("m.cy"), 6, "y"))


@query(_CENTRES)
def scan_geojson(spark: SparkSession, d: str) -> DataFrame:
    return _centres(readers.read_geojson(spark, _collections(spark, d, "Polygon")))


@query(_CENTRES)
def scan_overture(spark: SparkSession, d: str) -> DataFrame:
    return _centres(readers.read_overture(spark, _collections(spark, d, "MultiPolygon")))


@query(_CENTRES)
def scan_footprints(spark: SparkSession, d: str) -> DataFrame:
    return _centres(readers.read_footprints(spark, _collections(spark, d, "Polygon")))


def _ways(spark: SparkSession, d: str) -> str:
    """Overpass answers: a closed way a customer with an even key, an open one with an odd key."""
    f = views.fences(spark, d).withColumn("k", C("id") % 7)
    p = lambda x, y: F.struct(C(y).alias("lat"), C(x).alias("lon"))
    closed = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y0"))
    element = F.struct(F.lit("way").alias("type"), "id", F.when(C("id") % 2 == 0, closed).otherwise(F.array(p("x0", "y0"), p("x1", "y1"))).alias("geometry"), F.create_map(F.lit("name"), C("name"), F.lit("highway"), F.lit("service")).alias("tags"))
    c = f.groupBy("k").agg(F.collect_list(element).alias("elements"))
    return _written(c.select("k", F.to_json(F.struct("elements")).alias("t")), "k")


@query("SELECT c_custkey AS way_id, CASE WHEN c_custkey % 2 = 0 THEN 'POLYGON' ELSE 'LINESTRING' END AS kind, 'osm/way/' || CAST(c_custkey AS VARCHAR) || ';' || c_name || ';highway=service' AS features FROM customer")
def scan_overpass(spark: SparkSession, d: str) -> DataFrame:
    w = readers.read_overpass(spark, _ways(spark, d))
    return w.select("way_id", F.substring_index("wkt", " ", 1).alias("kind"), F.array_join("features", ";").alias("features"))


@query("SELECT c_custkey AS way_id, c_name AS name FROM customer")
def scan_road_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The same ways in two tiles come once."""
    at = _ways(spark, d)
    spark.read.text(at).withColumn("k", C("k") + 100).repartition("k").write.partitionBy("k").mode("append").text(at)
    return readers.read_road_tiles(spark, at).select("way_id", C("tags")["name"].alias("name"))


@query("SELECT p_partkey AS rule_id, CAST(p_size AS INT) AS priority, p_brand AS code FROM part")
def scan_rules(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    p = table(spark, d, "part").select(C("p_partkey").alias("rule_id"), C("p_size").alias("priority"), F.lit("any").alias("scope"), F.lit('a "b", c').alias("fclass_pattern"), F.lit("").alias("name_pattern"), C("p_brand").alias("gb_code"))
    p.write.option("header", True).option("escape", '"').csv(at)
    x = readers.read_rules(spark, at)
    return x.select(C("rule_id").cast("bigint").alias("rule_id"), "priority", C("gb_code").alias("code"))


@query("""WITH a AS (SELECT s_name AS name, 'D' || CAST(s_nationkey AS VARCHAR) AS district FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_name AS name, '东塘区' AS district FROM supplier) SELECT name, district FROM a UNION ALL SELECT name, district FROM b WHERE name NOT IN (SELECT name FROM a)""")
def scan_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    one, two = _folder(spark), _folder(spark)
    s = table(spark, d, "supplier")
    s.where("s_suppkey % 2 = 0").select(C("s_name").alias("amap_name"), F.concat(F.lit("D"), C("s_nationkey").cast("string")).alias("adname")).write.option("header", True).csv(one)
    s.select(C("s_name").alias("amap_name"), F.lit("1 东塘区 road").alias("amap_address")).write.option("header", True).csv(two)
    return readers.read_gazetteer(spark, one, two)


@query(f"WITH {FENCES_SQL} SELECT name AS label, {q('(x0 + x1) / 2', 6, 'x')}, {q('(y0 + y1) / 2', 6, 'y')} FROM boxes")
def scan_map_pages(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x, y: F.concat(F.lit("["), C(y).cast("string"), F.lit(","), C(x).cast("string"), F.lit("]"))
    f = views.fences(spark, d).withColumn("t", F.concat(F.lit("L.polygon(["), F.concat_ws(",", p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")), F.lit("]).bindTooltip('<b>"), C("name"), F.lit("</b>');")))
    pages = f.groupBy("city").agg(F.concat_ws(" ", F.collect_list("t")).alias("t"))
    g = readers.read_map_pages(spark, _written(pages, "city"))
    m = rings.measures(rings.ring_of(C("wkt")))
    return g.select("label", m.alias("m")).select("label", r(C("m.cx"), 6, "x"), r(C("m.cy"), 6, "y"))


@query(f"WITH {FENCES_SQL} SELECT CAST(id AS VARCHAR) AS business_id, name, city, {q('lng', 6, 'lng')}, CASE WHEN id % 5 <> 0 THEN district END AS district, CAST(bal AS VARCHAR) AS extra FROM fences")
def scan_workbook(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    f = views.fences(spark, d).select(C("id").alias("小区编码"), C("name").alias("小区名称"), C("city").alias("城市"), C("lng").alias("经度"), C("lat").alias("纬度"), F.when(C("id") % 5 != 0, C("district")).otherwise("nan").alias("区[内置]"), C("bal").cast("string").alias("余额"))
    f.write.option("header", True).csv(at)
    w = readers.read_workbook_csv(spark, at, "B1")
    return w.select(C("source_business_id").alias("business_id"), C("name_raw").alias("name"), C("city_raw").alias("city"), r(C("point_raw_lng"), 6, "lng"), C("district_raw").alias("district"), C("attributes_raw")["余额"].alias("extra"))


@query("SELECT 'SRC_' || lpad(CAST(i + 1 AS VARCHAR), 6, '0') AS source_record_id, " + q("CAST(116.3 AS DOUBLE) + CAST((i * 7919) % 1000 AS DOUBLE) / 10000", 4, "lng") + " FROM range(30) t(i)")
def sample_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.sample_records(spark).select("source_record_id", r(C("point_raw_lng"), 4, "lng"))


# ---- sinks

@query("SELECT upper(trim(relation_id)) AS id, CASE WHEN isnan(iou) THEN NULL ELSE round(iou, 6) END AS iou, relation_type FROM entity_relations WHERE relation_id IS NOT NULL AND trim(relation_type) <> ''")
def relations_csv(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    e = table(spark, d, "entity_relations").where("relation_id IS NOT NULL AND trim(relation_type) <> ''")
    sinks.write_relations(e, at)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(at)
    x = C("iou").cast("double")
    return back.select(F.upper(F.trim("relation_id")).alias("id"), F.when(~F.isnan(x), F.round(x, 6)).alias("iou"), "relation_type")


@query("SELECT upper(trim(canonical_entity_id)) AS id, canonical_name AS name, CAST(coalesce(member_count, 1) AS INT) AS members FROM canonical_entities WHERE canonical_name IS NOT NULL")
def entities_csv(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    sinks.write_entities(table(spark, d, "canonical_entities").where("canonical_name IS NOT NULL"), at)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(at)
    return back.select(F.upper(F.trim("canonical_entity_id")).alias("id"), C("canonical_name").alias("name"), C("member_count").cast("int").alias("members"))


@query(f"WITH {FENCES_SQL} SELECT id, {q('(x0 + x1) / 2', 6, 'x')} FROM boxes")
def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    from .shapes import box_wkt

    at = _folder(spark)
    sinks.write_geojson_lines(views.fences(spark, d).select("id", box_wkt("x0", "y0", "x1", "y1").alias("wkt")), "wkt", at)
    back = spark.read.text(at).select(F.get_json_object("value", "$.properties.id").cast("bigint").alias("id"), readers.geojson_geometry(F.get_json_object("value", "$.geometry")).alias("wkt"))
    return back.select("id", rings.measures(rings.ring_of(C("wkt")))["cx"].alias("cx")).select("id", r(C("cx"), 6, "x"))


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A3' WHEN 2 THEN 'MIL' ELSE '_uncategorized' END AS gb_class, count(*) AS n FROM part GROUP BY 1")
def split_by_class(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    k = C("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.when(k % 4 == 0, "[R] home").when(k % 4 == 1, "[A3] school").when(k % 4 == 2, "[MIL]").otherwise("no code").alias("label"))
    sinks.write_by_class(p, "label", at)
    return spark.read.option("header", True).csv(at).groupBy("gb_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FENCES_SQL} SELECT id, round(lng, 3) AS lng, round(lat, 3) AS lat FROM fences WHERE id % 3 <> 1")
def compliant_export(spark: SparkSession, d: str) -> DataFrame:
    k = C("id") % 3
    f = views.fences(spark, d).select("id", "lng", "lat", F.when(k == 0, "R").when(k == 1, "MIL").alias("code"))
    return sinks.compliant(f, "code", "lng", "lat").select("id", "lng", "lat")


@query("SELECT upper(trim(relation_id)) AS id, 1 + length(relation_id) % 3 AS tier FROM entity_relations WHERE relation_id IS NOT NULL")
def work_orders_csv(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    e = table(spark, d, "entity_relations").where("relation_id IS NOT NULL").select("relation_id", (1 + F.length("relation_id") % 3).alias("tier"), "iou", C("cross_encoder_score").alias("ce"), C("bge_sim").alias("bge"))
    sinks.write_work_orders(e, at)
    back = spark.read.option("header", True).csv(at)
    return back.select(F.upper(F.trim("relation_id")).alias("id"), C("tier").cast("int").alias("tier"))


@query("SELECT source_record_id AS object, 'EXCEL' AS source, 'OBSERVED' AS kind FROM source_records WHERE source_record_id IS NOT NULL UNION ALL SELECT geometry_version_id, 'GEOMETRY', 'REPRESENTATION' FROM geometry_versions WHERE geometry_version_id IS NOT NULL")
def version_two(spark: SparkSession, d: str) -> DataFrame:
    """Records and geometry versions under the second contract."""
    o = readers.to_observations(table(spark, d, "source_records")).select(C("observation_id").alias("object"), F.lit("EXCEL").alias("source"), F.lit("OBSERVED").alias("kind"))
    v = readers.to_representations(table(spark, d, "geometry_versions")).select(C("representation_id").alias("object"), F.lit("GEOMETRY").alias("source"), F.lit("REPRESENTATION").alias("kind"))
    return o.where("object IS NOT NULL").unionByName(v.where("object IS NOT NULL"))
