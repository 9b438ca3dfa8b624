"""Best representative of each duplicate group (problem 2).

Window ordering with a limit: Spark keeps only the first two rows of a group in every input task before
the shuffle, so a group with a third of all rows reaches the final window as a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_blank, norm_id, trimmed, usable_box, usable_point


def best_of_group(rows: DataFrame, group: str, key: str, merits: list[str], strict: bool = True) -> DataFrame:
    """(group, key) of the best row of each group by `merits`, first merit first, greater is better.

    The order is made deterministic by the smallest key. With `strict`, a group comes out only if it has
    two rows or more and its first row is as good as every other row in all merits and better than each
    in at least one: it then has the greatest value of every merit, and no second row has all of them.
    Null merits are worse than any value. `rows` must be one row per (group, key); empty gives empty.
    """
    order = [F.desc_nulls_last(m) for m in merits] + [F.asc(key)]
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("rn <= 2")
    top = first.groupBy(group).agg(
        F.max(F.when(F.col("rn") == 1, F.struct(*merits, key))).alias("t"), F.max(F.when(F.col("rn") == 2, F.struct(*merits))).alias("u"), F.count(F.lit(1)).alias("n")
    )
    if not strict:
        return top.select(group, F.col(f"t.{key}").alias(key))
    most = rows.groupBy(group).agg(*[F.max(m).alias(f"max_{m}") for m in merits])
    full = F.col("n") >= 2
    tied = F.lit(True)
    for m in merits:
        full &= F.col(f"t.{m}").eqNullSafe(F.col(f"max_{m}"))
        tied &= F.col(f"t.{m}").eqNullSafe(F.col(f"u.{m}"))
    return top.join(most, group).where(full & ~tied).select(group, F.col(f"t.{key}").alias(key))


def completeness(name: Column, address: Column, street: Column, lng: Column, lat: Column, box: Column, area: Column) -> Column:
    """Number of filled fields: name, address and street not blank, usable point, usable polygon, area above 0."""
    area_ok = F.coalesce(~F.isnan(area) & (area > 0), F.lit(False))
    return sum((x.cast("int") for x in (~is_blank(name), ~is_blank(address), ~is_blank(street), usable_point(lng, lat), box.isNotNull(), area_ok)), F.lit(0))


def record_merits(records: DataFrame, systems: DataFrame) -> DataFrame:
    """(rid, filled, trust, latest), one row per record: of repeated deliveries the fullest and the latest date count."""
    c = F.col
    trust = systems.groupBy(F.upper(trimmed(c("source_system"))).alias("sys")).agg(F.max("trust").alias("trust"))
    r = records.select(
        norm_id(c("source_record_id")).alias("rid"), F.upper(trimmed(c("source_system"))).alias("sys"), c("ingested_at").alias("latest"),
        completeness(c("name_raw"), c("address_raw"), c("street_raw"), c("point_raw_lng"), c("point_raw_lat"), usable_box(c("geometry_raw_wkt")), c("area_raw")).alias("filled"),
    ).where("rid is not null")
    r = r.groupBy("rid").agg(F.max("filled").alias("filled"), F.max("sys").alias("sys"), F.max("latest").alias("latest"))
    return r.join(F.broadcast(trust), "sys", "left").select("rid", "filled", "trust", "latest")  # source_systems has four rows, fixed


def latest_entities(entities: DataFrame) -> DataFrame:
    """One row per entity: the repeat with the latest updated_at (then the greatest name)."""
    cols = [x for x in entities.columns if x not in ("canonical_entity_id", "updated_at")]
    e = entities.withColumn("eid", norm_id(F.col("canonical_entity_id"))).where("eid is not null")
    z = e.groupBy("eid").agg(F.max_by(F.struct(*cols), F.struct("updated_at", F.coalesce("canonical_name", F.lit("")))).alias("z"))
    return z.select("eid", "z.*")


def entity_choices(entities: DataFrame, records: DataFrame, systems: DataFrame, versions: DataFrame) -> DataFrame:
    """(canonical_entity_id, choice_kind, chosen_id): the one best listed record and geometry version of each entity.

    Listed ids that name no record count for nothing, repeated ids count once. Versions count when ACTIVE
    and with a usable polygon; of repeated version rows the latest counts. Entities without an undisputed
    best candidate among two or more give no row.
    """
    ents = latest_entities(entities)
    listed = ents.select("eid", F.explode("member_source_record_ids").alias("m")).select("eid", norm_id(F.col("m")).alias("rid")).where("rid is not null").distinct()
    by_record = best_of_group(listed.join(record_merits(records, systems), "rid"), "eid", "rid", ["filled", "trust", "latest"])
    v = versions.select(
        norm_id(F.col("canonical_entity_id")).alias("eid"), norm_id(F.col("geometry_version_id")).alias("gid"), F.upper(trimmed(F.col("geometry_status"))).alias("status"),
        F.when(~F.isnan("geometry_confidence"), F.col("geometry_confidence")).alias("confidence"), F.col("created_at").alias("made"), usable_box(F.col("geometry_wkt")).isNotNull().alias("ok"),
    ).where("eid is not null and gid is not null")
    v = v.groupBy("eid", "gid").agg(F.max(F.struct("made", "confidence", "status", "ok")).alias("z")).select("eid", "gid", "z.*").where("status = 'ACTIVE' and ok")
    by_shape = best_of_group(v.join(ents.select("eid"), "eid", "left_semi"), "eid", "gid", ["confidence", "made"])
    out = lambda d, kind, k: d.select(F.col("eid").alias("canonical_entity_id"), F.lit(kind).alias("choice_kind"), F.col(k).alias("chosen_id"))
    return out(by_record, "record", "rid").unionByName(out(by_shape, "geometry", "gid"))
