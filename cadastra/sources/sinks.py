"""Exports: CSV and JSON reports, GeoJSON features, files split by class, and what may leave the house."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rings import ring_of


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by semicolons, maps and structs as JSON, for text formats."""
    def one(f) -> Column:
        kind = f.dataType.typeName()
        if kind == "array":
            return F.concat_ws(";", F.transform(F.col(f.name), lambda x: x.cast("string"))).alias(f.name)
        return F.to_json(f.name).alias(f.name) if kind in ("map", "struct") else F.col(f.name)

    return df.select(*[one(f) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Columns of the entity, relation and issue reports.
ENTITY_COLUMNS = ("canonical_entity_id", "canonical_name", "entity_type", "is_non_residential", "province", "city", "district", "street", "base_name", "court_no", "house_no", "phase", "subarea", "member_count", "identity_confidence", "active_geometry_version_id", "best_geometry_score", "member_source_record_ids")
RELATION_COLUMNS = ("relation_id", "subject_record_id", "subject_name", "subject_type", "subject_city", "object_record_id", "object_name", "object_type", "object_city", "relation_type", "same_entity_probability", "relation_confidence", "distance_m", "iou", "bge_sim", "cross_encoder_score", "intersection_over_min", "explain", "decision_status")
ISSUE_COLUMNS = ("source_record_id", "name", "entity_type", "city", "district", "coord_status", "delta_lng", "delta_lat", "geom_qa_score", "geom_decision", "area_m2", "compactness", "aspect_ratio", "qa_issues", "coord_notes")


def _report(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a report in their order, null where `df` has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_entities(entities: DataFrame, path: str) -> None:
    """The report of entities: tokens come from the name, the member count from the list is 1 where it is null."""
    t = text.tokens(F.col("canonical_name"))
    e = entities.withColumns({"t": t, "member_count": F.coalesce("member_count", F.lit(1)), "active_geometry_version_id": F.col("canonical_geometry_version_id"), "is_non_residential": F.coalesce(F.col("entity_type").startswith("NON_RESIDENTIAL"), F.lit(False))}).select("*", "t.*")
    write_csv(_report(e, ENTITY_COLUMNS), path)


def write_relations(relations: DataFrame, path: str) -> None:
    """The report of relations."""
    write_csv(_report(relations, RELATION_COLUMNS), path)


def write_issues(assessed: DataFrame, path: str) -> None:
    """The report of records with an issue, a note, a score below 1 or a type other than a residential community."""
    c = F.col
    a = assessed.where((F.size("qa.issues") > 0) | (F.size("coord.notes") > 0) | (c("qa.score") < 1) | c("qa.score").isNull() | (c("entity_type") != "RESIDENTIAL_COMMUNITY"))
    rows = a.select("source_record_id", c("name_raw").alias("name"), "entity_type", c("city_raw").alias("city"), c("district_raw").alias("district"), c("coord.status").alias("coord_status"), c("qa.score").alias("geom_qa_score"), c("decision").alias("geom_decision"), F.concat_ws("; ", "qa.issues").alias("qa_issues"), F.concat_ws("; ", "coord.notes").alias("coord_notes"))
    write_csv(_report(rows, ISSUE_COLUMNS), path)


def write_work_orders(orders: DataFrame, path: str) -> None:
    """Work orders by tier, then by overlap and both scores downwards."""
    write_csv(orders.orderBy("tier", F.desc_nulls_last("iou"), F.desc_nulls_last("ce"), F.desc_nulls_last("bge")), path)


def feature(wkt: Column, properties: Column, most: int = 400) -> Column:
    """GeoJSON feature of a polygon's outer ring; rings of more than `most` corners are thinned evenly, as the format's
    readers ask; null for texts that are no polygon."""
    ring = ring_of(wkt)
    step = F.greatest(F.lit(1), F.ceil(F.size(ring) / most)).cast("int")
    thin = F.concat(F.filter(F.slice(ring, 1, F.size(ring) - 1), lambda p, i: i % step == 0), F.array(ring[0]))
    pos = F.transform(thin, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(pos).alias("coordinates"))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))))


def write_geojson_lines(df: DataFrame, wkt: str, path: str) -> None:
    """One feature a line, the other columns as properties."""
    props = F.struct(*[c for c in df.columns if c != wkt])
    df.select(feature(F.col(wkt), props).alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def write_by_class(df: DataFrame, label: str, path: str) -> None:
    """One folder a class; the class stands in brackets in the label, others go to _uncategorized."""
    code = F.regexp_extract(label, r"\[([A-Z0-9]+)\]", 1)
    flat(df.withColumn("gb_class", F.when(code != "", code).otherwise("_uncategorized"))).write.mode("overwrite").partitionBy("gb_class").option("header", True).csv(path)


def compliant(df: DataFrame, code: str, lng: str, lat: str) -> DataFrame:
    """Rows that may be handed out: no military land (rows without a code stay), coordinates to three decimals."""
    return df.where(~F.col(code).eqNullSafe("MIL")).withColumns({lng: F.round(lng, 3), lat: F.round(lat, 3)})
