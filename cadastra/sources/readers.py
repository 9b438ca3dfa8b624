"""Scans of the formats places come in; each gives a typed DataFrame and reads files in parallel."""

from __future__ import annotations

import html
import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The workbook contract (column, alternatives -> field).
WORKBOOK = {
    "source_business_id": ("小区编码",), "name_raw": ("小区名称",), "address_raw": ("小区地址",), "province_raw": ("省份名称", "省[内置]"), "city_raw": ("城市", "市[内置]"), "district_raw": ("区[内置]",),
    "street_raw": ("街道[内置]",), "point_raw_lng": ("经度",), "point_raw_lat": ("纬度",), "geometry_raw_wkt": ("坐标面[内置]",), "area_raw": ("面积[内置]",),
}
_NUMERIC = ("point_raw_lng", "point_raw_lat", "area_raw")
_RING = "array<array<double>>"


def clean_text(c: Column) -> Column:
    """Null for the texts that stand for nothing in an export."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def from_workbook(rows: DataFrame, batch_id: str, system: str = "excel_import", order: list[str] | None = None) -> DataFrame:
    """Source records of workbook rows by the column contract; other columns go to attributes_raw. Ids are numbered in
    the order of `order` (all columns unless given)."""
    have = set(rows.columns)
    field = lambda name: F.coalesce(*[clean_text(F.col(f"`{c}`")) for c in WORKBOOK[name] if c in have], F.lit(None).cast("string"))
    used = {c for cs in WORKBOOK.values() for c in cs}
    extra = [c for c in rows.columns if c not in used]
    attrs = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), clean_text(F.col(f"`{c}`")))]), lambda k, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    n = F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in (order or rows.columns)]))
    cols = {k: field(k) if k not in _NUMERIC else F.when(~F.isnan(field(k).try_cast("double")), field(k).try_cast("double")) for k in WORKBOOK}
    return rows.select(F.format_string("SRC_%06d", n).alias("source_record_id"), F.lit(system).alias("source_system"), F.lit(batch_id).alias("source_batch_id"), *[v.alias(k) for k, v in cols.items()], attrs.alias("attributes_raw"))


def read_excel(spark: SparkSession, path: str, batch_id: str, sheet: str = "sheet1") -> DataFrame:
    """A workbook through pandas on the driver (a workbook has a million rows at most); needs an xlsx engine."""
    return from_workbook(spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str)), batch_id)


def read_workbook_csv(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """The same contract from CSV files."""
    return from_workbook(spark.read.option("header", True).csv(path), batch_id)


def _positions(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", ")


def polygon_wkt(rings: Column) -> Column:
    """POLYGON text of GeoJSON rings."""
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _positions(r), F.lit(")"))), ", "), F.lit(")"))


def geojson_geometry(geometry: Column, outer_only: bool = False) -> Column:
    """WKT of a GeoJSON geometry text: Polygon, MultiPolygon (all parts, or the first's outer ring) or Point; else null."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    rings, parts, point = F.from_json(coords, "array<array<array<double>>>"), F.from_json(coords, "array<array<array<array<double>>>>"), F.from_json(coords, "array<double>")
    multi = polygon_wkt(F.slice(parts[0], 1, 1)) if outer_only else F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: F.concat(F.lit("("), _positions(r), F.lit(")"))), ", "), F.lit(")"))), ", "), F.lit(")"))
    return F.when(kind == "Polygon", polygon_wkt(F.slice(rings, 1, 1) if outer_only else rings)).when(kind == "MultiPolygon", multi).when(kind == "Point", F.concat(F.lit("POINT ("), point[0].cast("string"), F.lit(" "), point[1].cast("string"), F.lit(")")))


def read_geojson(spark: SparkSession, path: str, outer_only: bool = False) -> DataFrame:
    """(properties map, wkt) of the features of FeatureCollections, one or many files."""
    raw = spark.read.option("wholetext", True).text(path)
    feats = F.from_json(F.get_json_object("value", "$.features"), "array<struct<properties:string,geometry:string>>")
    f = raw.select(F.explode(feats).alias("f"))
    return f.select(F.from_json("f.properties", "map<string,string>").alias("properties"), geojson_geometry(F.col("f.geometry"), outer_only).alias("wkt"))


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, tags, wkt, features) of the ways of Overpass answers: closed ways of four points or more are polygons,
    others lines; ways without geometry are the line of their bounds."""
    schema = "elements array<struct<type:string,id:bigint,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
    e = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("elements").alias("e")).select("e.*").where("type = 'way'")
    pts = F.coalesce(F.col("geometry"), F.array(F.struct(F.col("bounds.minlat").alias("lat"), F.col("bounds.minlon").alias("lon")), F.struct(F.col("bounds.maxlat").alias("lat"), F.col("bounds.maxlon").alias("lon"))))
    text = F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    closed = (F.size(pts) >= 4) & (pts[0] == F.element_at(pts, -1))
    feats = F.array_compact(F.array(F.concat(F.lit("osm/way/"), F.col("id").cast("string")), F.element_at("tags", "name"), F.concat(F.lit("highway="), F.element_at("tags", "highway"))))
    return e.select(F.col("id").alias("way_id"), "tags", F.when(closed, F.concat(F.lit("POLYGON (("), text, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING ("), text, F.lit(")"))).alias("wkt"), feats.alias("features"))


def read_road_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a folder of tiles, each way once: that of the first file by name."""
    ways = spark.read.option("multiLine", True).schema("elements array<struct<type:string,id:bigint,tags:map<string,string>>>").json(path).select(F.input_file_name().alias("file"), F.explode("elements").alias("e"))
    return ways.groupBy(F.col("e.id").alias("way_id")).agg(F.min_by("e.tags", "file").alias("tags"), F.min("file").alias("file"))


def read_overture(spark: SparkSession, path: str) -> DataFrame:
    """Features of the open map layer: outer rings and points only."""
    return read_geojson(spark, path, outer_only=True).where("wkt IS NOT NULL")


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Building footprints: the polygons of FeatureCollections in a folder or file."""
    return read_geojson(spark, path).where("startswith(wkt, 'POLYGON') OR startswith(wkt, 'MULTIPOLYGON')")


def shape_records(shp: bytes, dbf: bytes | None = None) -> list[tuple[dict[str, str], str | None]]:
    """(attributes, wkt) of a polygon, line or point shapefile; outer rings are clockwise there, holes the other way; null
    shapes and other kinds have no text."""
    rows: list[str | None] = []
    at = 100
    while at + 8 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
        if kind == 1:
            rows.append("POINT ({:.17g} {:.17g})".format(*struct.unpack("<2d", body[4:20])))
            continue
        if kind not in (3, 5):
            rows.append(None)
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        rings = [[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        text = lambda r: "(" + ", ".join(f"{x:.17g} {y:.17g}" for x, y in r) + ")"
        if kind == 3:
            rows.append("LINESTRING " + text(rings[0]) if parts == 1 else "MULTILINESTRING (" + ", ".join(map(text, rings)) + ")")
            continue
        polygons: list[list[str]] = []
        for r in rings:
            turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(r, r[1:], strict=False))
            if turn > 0 or not polygons:
                polygons.append([])
            polygons[-1].append(text(r))
        rows.append("POLYGON (" + ", ".join(polygons[0]) + ")" if len(polygons) == 1 else "MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in polygons) + ")")
    attrs: list[dict[str, str]] = [{} for _ in rows]
    if dbf:
        n, head, width = struct.unpack("<IHH", dbf[4:12])
        fields = [(dbf[k : k + 11].split(b"\0")[0].decode("utf-8", "replace"), dbf[k + 16]) for k in range(32, head - 1, 32)]
        for i in range(min(n, len(rows))):
            pos = head + i * width + 1
            for name, w in fields:
                attrs[i][name] = dbf[pos : pos + w].decode("utf-8", "replace").strip()
                pos += w
    return list(zip(attrs, rows, strict=True))


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """(layer, properties map, wkt) of the shapefiles of a folder (.shp with .dbf beside it), a task for each layer; coordinates are taken as
    degrees of WGS-84. A missing folder raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select("path", "content")
    layers = files.groupBy(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("layer")).agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf")).where("shp IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, a, w) for n, s, b in zip(f["layer"], f["shp"], f["dbf"], strict=True) for a, w in shape_records(bytes(s), bytes(b) if b is not None else None)]
            yield pd.DataFrame(rows, columns=["layer", "properties", "wkt"])

    return layers.mapInPandas(run, "layer string, properties map<string,string>, wkt string")


def to_observations(records: DataFrame) -> DataFrame:
    """Records under the second contract: (observation_id, source, observed_features, geometry_wkt, observed_at)."""
    c = F.col
    feats = F.array_compact(F.array(c("name_raw"), c("address_raw"), F.concat(F.lit("city="), c("city_raw"))))
    return records.select(c("source_record_id").alias("observation_id"), c("source_system").alias("source"), feats.alias("observed_features"), "geometry_raw_wkt", c("ingested_at").alias("observed_at")).withColumnRenamed("geometry_raw_wkt", "geometry_wkt")


def to_representations(versions: DataFrame) -> DataFrame:
    """Geometry versions under the second contract: (representation_id, entity_id, geometry_wkt, coordinate_reference, confidence, parent_id)."""
    c = F.col
    return versions.select(c("geometry_version_id").alias("representation_id"), c("canonical_entity_id").alias("entity_id"), "geometry_wkt", F.coalesce("coordinate_reference", F.lit("EPSG:4326")).alias("coordinate_reference"), c("geometry_confidence").alias("confidence"), c("parent_geometry_version_id").alias("parent_id"))


#: Relation types of the first contract and the spatial relations of the second.
SPATIAL = {"EXACT_DUPLICATE": "EQUALS", "SAME_ENTITY_ALT_BOUNDARY": "OVERLAPS", "WHOLE_TO_PHASE": "CONTAINS", "PHASE_TO_WHOLE": "WITHIN", "POSSIBLE_MERGE_ERROR": "OVERLAPS"}


def spatial_relation(relation: Column) -> Column:
    """The spatial relation of a relation type; RELATED for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPATIAL.items() for x in kv]), relation), F.lit("RELATED"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table of land use (rule_id, priority, scope, fclass_pattern, name_pattern, gb_code), by priority."""
    return spark.read.option("header", True).option("escape", '"').csv(path).withColumn("priority", F.col("priority").cast("int")).orderBy("priority")


def read_gazetteer(spark: SparkSession, admin: str, base: str | None = None) -> DataFrame:
    """(name, district): the administrative gazetteer, and for names it lacks the base one."""
    a = spark.read.option("header", True).csv(admin).select(F.col("amap_name").alias("name"), F.col("adname").alias("district"))
    if base is None:
        return a
    b = spark.read.option("header", True).csv(base)
    district = F.regexp_extract("amap_address", r"([一-鿿]{1,3}[区县])", 1)
    return a.unionByName(b.select(F.col("amap_name").alias("name"), F.nullif(district, F.lit("")).alias("district")).join(a.select("name"), "name", "left_anti"))


def gazetteer_verdict(names: DataFrame, gazetteer: DataFrame, left: str, right: str) -> DataFrame:
    """Adds same_district of two names: true, false, or null where one is missing or in several districts."""
    g = gazetteer.where("district IS NOT NULL").groupBy("name").agg(F.min("district").alias("lo"), F.max("district").alias("hi")).where("lo = hi").select("name", F.col("lo").alias("district"))
    j = names.join(g.select(F.col("name").alias(left), F.col("district").alias("_a")), left, "left").join(g.select(F.col("name").alias(right), F.col("district").alias("_b")), right, "left")
    return j.withColumn("same_district", F.col("_a") == F.col("_b")).drop("_a", "_b")


_CALL = re.compile(r"L\.polygon\(\s*(\[)")
_TIP = re.compile(r"bindTooltip\(\s*(['\"`])(.*?)\1", re.S)


def html_polygons(page: str) -> list[tuple[str, str]]:
    """(label, wkt) of the polygons drawn on a map page: latitude comes first there, rings are closed, and shapes of
    fewer than three corners are left out."""
    out = []
    calls = list(_CALL.finditer(page))
    for k, m in enumerate(calls):
        depth, at = 0, m.start(1)
        for at in range(m.start(1), len(page)):
            depth += {"[": 1, "]": -1}.get(page[at], 0)
            if not depth:
                break
        try:
            ring = json.loads(page[m.start(1) : at + 1])
        except ValueError:
            continue
        while ring and isinstance(ring[0][0], list):
            ring = ring[0]
        if len(ring) >= 2 and ring[0] == ring[-1]:
            ring = ring[:-1]
        if len(ring) < 3:
            continue
        tip = _TIP.search(page, at, calls[k + 1].start() if k + 1 < len(calls) else len(page))
        label = html.unescape(re.sub(r"<[^>]*>", "", tip[2])).strip() if tip else ""
        out.append((label, "POLYGON ((" + ", ".join(f"{p[1]} {p[0]}" for p in [*ring, ring[0]]) + "))"))
    return out


def read_map_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, wkt) of the polygons of map pages."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, *p) for n, v in zip(f["file"], f["value"], strict=True) for p in html_polygons(v)]
            yield pd.DataFrame(rows, columns=["file", "label", "wkt"])

    pages = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    return pages.mapInPandas(run, "file string, label string, wkt string")


def sample_records(spark: SparkSession, n: int = 30) -> DataFrame:
    """Synthetic records with rectangles, the same at every call."""
    h = lambda salt, m: F.col("id") * (7919, 104729, 31)[salt - 1] % m
    d = spark.range(n).select("id", (F.lit(116.3) + h(1, 1000) / 10_000).alias("x"), (F.lit(39.9) + h(2, 1000) / 10_000).alias("y"), (F.lit(0.0008) + h(3, 20) / 10_000).alias("w"))
    corner = lambda a, b: F.concat_ws(" ", F.round(F.col("x") + a * F.col("w") / 2, 6).cast("string"), F.round(F.col("y") + b * F.col("w") / 2, 6).cast("string"))
    ring = F.concat_ws(", ", corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return d.select(F.format_string("SRC_%06d", F.col("id") + 1).alias("source_record_id"), F.format_string("示例小区%02d区", F.col("id") + 1).alias("name_raw"), F.col("x").alias("point_raw_lng"), F.col("y").alias("point_raw_lat"), F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry_raw_wkt"))


class Registry:
    """Named sources and operators: functions from a session or DataFrame to a DataFrame."""

    def __init__(self) -> None:
        self._items: dict[str, object] = {}

    def register(self, name: str, item: object) -> None:
        if name in self._items:
            raise ValueError(f"{name} is registered already")
        self._items[name] = item

    def get(self, name: str) -> object:
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


SOURCES = Registry()
for _name, _f in (("excel", read_excel), ("workbook_csv", read_workbook_csv), ("geojson", read_geojson), ("overpass", read_overpass), ("overture", read_overture), ("road_tiles", read_road_tiles), ("rules", read_rules), ("gazetteer", read_gazetteer), ("map_pages", read_map_pages), ("footprints", read_footprints), ("shapefiles", read_shapefiles)):
    SOURCES.register(_name, _f)
