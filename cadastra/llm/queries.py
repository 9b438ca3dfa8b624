"""Registered queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import FILLERS
from ..sources.tables import table
from . import addresses, components, matching, mixing, subjects, survivors, tokens, variants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.relation_groups(table(spark, d, "entity_relations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.entity_choices(table(spark, d, "canonical_entities"), table(spark, d, "source_records"), table(spark, d, "source_systems"), table(spark, d, "geometry_versions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.address_pairs(table(spark, d, "source_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.link_variants(table(spark, d, "source_records"), table(spark, d, "canonical_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("record_id_a", "record_id_b")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_records(table(spark, d, "source_records"), table(spark, d, "canonical_entities"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_plans"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.classify(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p6_found, p6_matches, p8_ids, p9_mix, p10_found)}


_BLANKS = r"[\s\x{{200B}}-\x{{200F}}\x{{FEFF}}\x{{3000}}\x{{A0}}]"
_ID = "nullif(upper(regexp_replace({0}, '^" + _BLANKS + "+|" + _BLANKS + "+$', '', 'g')), '')"


def oracle_sql() -> dict[str, str]:
    rid, a, b, kind = (_ID.format(x) for x in ("relation_id", "subject_record_id", "object_record_id", "relation_type"))
    p1 = f"""
WITH RECURSIVE r AS (SELECT {rid} AS rid, {a} AS a, {b} AS b, {kind} AS kind, created_at AS t FROM entity_relations),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(rid, '|' || a || '|' || b) ORDER BY t DESC NULLS LAST, kind DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST) AS k FROM r) WHERE k = 1),
e AS (SELECT a, b FROM last WHERE kind IN ('EXACT_DUPLICATE', 'SAME_ENTITY_ALT_BOUNDARY') AND a <> b),
g AS (SELECT a AS v, b AS u FROM e UNION SELECT b, a FROM e),
reach AS (SELECT v, v AS u FROM g UNION SELECT reach.v, g.u FROM reach JOIN g ON reach.u = g.v)
SELECT v AS source_record_id, min(u) AS group_id FROM reach GROUP BY v"""
    return {"p1_found": p1, "p2_found": _p2()}


def _p2() -> str:
    num = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?"
    ring = rf"\s*\(\s*{num}\s+{num}\s*(?:,\s*{num}\s+{num}\s*){{3,}}\)\s*"
    rings = f"{ring}(?:,{ring})*"
    shape = rf"(?:polygon\s*\({rings}\)|multipolygon\s*\(\s*\({rings}\)\s*(?:,\s*\({rings}\)\s*)*\))"
    edge = _BLANKS.format()  # the braces of the class are written for format
    bare = lambda c: f"regexp_replace(lower({c}), '^{edge}+|{edge}+$', '', 'g')"
    body = lambda c: rf"regexp_replace({bare(c)}, '^srid\s*=\s*[0-9]+\s*;\s*', '')"
    nums = lambda c: f"list_transform(regexp_extract_all({body(c)}, '{num}'), lambda v: CAST(v AS DOUBLE))"
    inside = lambda n: f"list_min(list_filter({n}, lambda v, i: i % 2 = 1)) >= 73 AND list_max(list_filter({n}, lambda v, i: i % 2 = 1)) <= 136 AND list_min(list_filter({n}, lambda v, i: i % 2 = 0)) >= 3 AND list_max(list_filter({n}, lambda v, i: i % 2 = 0)) <= 54"
    usable = lambda c: f"CASE WHEN regexp_full_match({body(c)}, '{shape}') THEN {inside(nums(c))} ELSE false END"
    fillers = ", ".join(f"'{x}'" for x in FILLERS)
    filled = lambda c: f"CAST({c} IS NOT NULL AND {bare(c)} NOT IN ({fillers}) AS INT)"
    point = "coalesce(NOT isnan(point_raw_lng) AND NOT isnan(point_raw_lat) AND point_raw_lng BETWEEN 73 AND 136 AND point_raw_lat BETWEEN 3 AND 54, false)"
    best = lambda t, k, m: f"""(SELECT a.eid, a.{k} AS id FROM {t} a JOIN {t} b ON a.eid = b.eid AND a.{k} <> b.{k} GROUP BY ALL HAVING bool_and({' AND '.join(f"(a.{x} IS NOT DISTINCT FROM b.{x} OR coalesce(a.{x} > b.{x}, b.{x} IS NULL))" for x in m)}) AND bool_and({' OR '.join(f"coalesce(a.{x} > b.{x}, a.{x} IS NOT NULL AND b.{x} IS NULL)" for x in m)}))"""
    return f"""
WITH sys AS (SELECT upper(trim(source_system)) AS sys, max(trust) AS trust FROM source_systems GROUP BY 1),
r AS (SELECT {_ID.format("source_record_id")} AS rid, max({" + ".join(filled(c) for c in ("name_raw", "address_raw", "street_raw"))} + CAST({point} AS INT) + CAST({usable("geometry_raw_wkt")} AS INT) + CAST(coalesce(NOT isnan(area_raw) AND area_raw > 0, false) AS INT)) AS filled, max(upper(trim(source_system))) AS sys, max(ingested_at) AS latest FROM source_records GROUP BY 1),
e AS (SELECT {_ID.format("canonical_entity_id")} AS eid, arg_max(member_source_record_ids, (updated_at, coalesce(canonical_name, ''))) AS members FROM canonical_entities GROUP BY 1),
l AS (SELECT DISTINCT eid, {_ID.format("m")} AS rid FROM (SELECT eid, unnest(members) AS m FROM e WHERE eid IS NOT NULL)),
c AS (SELECT l.eid, l.rid, filled, trust, latest FROM l JOIN r ON l.rid = r.rid LEFT JOIN sys ON r.sys = sys.sys),
g AS (SELECT {_ID.format("canonical_entity_id")} AS eid, {_ID.format("geometry_version_id")} AS gid, arg_max(struct_pack(s := upper(trim(geometry_status)), f := CASE WHEN isnan(geometry_confidence) THEN NULL ELSE geometry_confidence END, t := created_at, ok := {usable("geometry_wkt")}), created_at) AS z FROM geometry_versions GROUP BY ALL),
v AS (SELECT g.eid, gid, z.f AS confidence, z.t AS made FROM g JOIN e ON e.eid = g.eid WHERE gid IS NOT NULL AND z.s = 'ACTIVE' AND z.ok)
SELECT eid AS canonical_entity_id, 'record' AS choice_kind, id AS chosen_id FROM {best("c", "rid", ("filled", "trust", "latest"))} UNION ALL SELECT eid, 'geometry', id FROM {best("v", "gid", ("confidence", "made"))}"""
