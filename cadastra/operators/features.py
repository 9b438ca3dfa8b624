"""Features of a pair of place records: names, numbers, hierarchy, distance and overlap; and what a shared name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metres, text
from ..functions.columns import let
from ..functions.text import SIBLING


def _number_key(token: Column) -> Column:
    """The prefix and digits of a number as they are compared: 甲2 is not 2; null for Chinese numerals."""
    return F.nullif(F.regexp_extract(token, "^([甲乙丙丁]?[0-9]+)", 1), F.lit(""))


def number_conflicts(a: Column, b: Column) -> dict[str, Column]:
    """The conflicts of two names' tokens (see `text.tokens`). A house number against a courtyard's conflicts where prefix
    and digits differ; two numbers without digits don't."""
    differ = lambda k: F.coalesce(a[k] != b[k], F.lit(False))
    cross = lambda x, y: ~_number_key(x).eqNullSafe(_number_key(y))
    ab, ba = a["house_no"].isNotNull() & b["court_no"].isNotNull(), b["house_no"].isNotNull() & a["court_no"].isNotNull()
    out = {"court_conflict": differ("court_no"), "house_conflict": differ("house_no"),
           "cross_num_conflict": F.when(ab, cross(a["house_no"], b["court_no"])).when(ba, cross(b["house_no"], a["court_no"])).otherwise(False),
           "phase_conflict": differ("phase"), "subarea_conflict": differ("subarea")}
    any_ = F.lit(False)
    for c in out.values():
        any_ = any_ | c
    return {**out, "has_number_or_sub_conflict": any_}


def pair_features(pairs: DataFrame) -> DataFrame:
    """`pairs` (name_a, name_b, district_a, district_b, lng_a, lat_a, lng_b, lat_b, inter, area_a, area_b, bge_sim) with the
    feature vector of the pair scorer.

    Null names are empty ones. Missing districts match any. A missing overlap or area gives an overlap of 0, a missing
    coordinate a null distance. Name similarities are Ratcliff-Obershelp ratios, which only Python computes.
    """
    c = F.col
    name = {s: F.coalesce(c(f"name_{s}"), F.lit("")) for s in "ab"}
    p = pairs.withColumns({f"sem_{s}": text.tokens(name[s]) for s in "ab"} | {f"comp_{s}": text.components(name[s]) for s in "ab"})
    a, b = c("sem_a"), c("sem_b")
    p = p.withColumns({"exact_name_match": F.trim(name["a"]) == F.trim(name["b"]), "base_exact": (a["base_name"] == b["base_name"]) & (F.length(a["base_name"]) >= 2), **number_conflicts(a, b)})
    p = p.withColumns({"name_sim": text.sequence_ratio(name["a"], name["b"]), "base_sim": text.sequence_ratio(a["base_name"], b["base_name"]), "comp_base_sim": text.sequence_ratio(c("comp_a.base"), c("comp_b.base"))})
    one_sided = lambda k: a[k].isNull() != b[k].isNull()
    conflicts = text.component_conflicts(c("comp_a.parts"), c("comp_b.parts"))
    over = (c("inter") > 0) & (c("area_a") > 0) & (c("area_b") > 0)
    p = p.withColumns({
        "is_hierarchical_phase": (c("base_exact") | (c("base_sim") >= 0.85)) & (one_sided("phase") | one_sided("subarea")), "comp_conflicts": conflicts,
        "centroid_dist_meters": metres.midlat_m(c("lng_a"), c("lat_a"), c("lng_b"), c("lat_b")),
        "iou": F.when(over, c("inter") / (c("area_a") + c("area_b") - c("inter"))).otherwise(0.0), "intersection_over_min": F.when(over, c("inter") / F.least("area_a", "area_b")).otherwise(0.0),
        "district_match": F.coalesce(F.nullif(c("district_a"), F.lit("")) == F.nullif(c("district_b"), F.lit("")), F.lit(True)),
    })
    sibling = F.create_map(*[F.lit(x) for kv in SIBLING.items() for x in kv])
    p = p.withColumns({"comp_conflict_type": F.try_element_at("comp_conflicts", F.lit(1)), "comp_scores": text.component_scores(c("comp_a.parts"), c("comp_b.parts"))})
    return p.withColumn("comp_sibling_rel", F.element_at(sibling, c("comp_conflict_type")))


def rule_features(one_number: Column | None = None) -> dict[str, Column]:
    """The columns of `pair_features` under the names that the pair scorer asks for."""
    c = F.col
    lone = one_number if one_number is not None else (c("sem_a.house_no").isNull() & c("sem_a.court_no").isNull()) != (c("sem_b.house_no").isNull() & c("sem_b.court_no").isNull())
    return {"distance": c("centroid_dist_meters"), "conflict": c("comp_conflict_type"), "hierarchical": c("is_hierarchical_phase"), "a_is_part": c("sem_a.phase").isNotNull() | c("sem_a.subarea").isNotNull(), "same_district": c("district_match"),
            "number_conflict": c("has_number_or_sub_conflict"), "exact_name": c("exact_name_match"), "base_exact": c("base_exact"), "one_number": lone, "name_sim": c("name_sim"), "bge": c("bge_sim"), "iou": c("iou"), "inter_min": c("intersection_over_min")}


def same_name(verdict: Column, districts_a: Column, districts_b: Column, dist_deg: Column) -> Column:
    """struct(relation, confidence) of two places of one name: the gazetteer's verdict (true, false or null) first, then names
    known in several districts each, then the distance in degrees (111 000 m each): below 50 m one place, below 500 m neighbours."""
    out = lambda r, v: F.struct(F.lit(r).alias("relation"), F.lit(v).alias("confidence"))
    twins = (F.coalesce(districts_a, F.lit(0)) > 1) & (F.coalesce(districts_b, F.lit(0)) > 1)
    far = lambda m: F.when(m < 50, out("SAME_ENTITY", 0.85)).when(m < 500, out("SIBLING", 0.60)).otherwise(out("DISTINCT", 0.90))
    return F.when(verdict, out("SIBLING", 0.85)).when(~verdict, out("DISTINCT", 0.90)).when(twins, out("DISTINCT", 0.75)).otherwise(let(dist_deg * 111_000, far))


#: Endings of phases and parts that a base name goes without, and name marks of the roles.
PART_ENDINGS = ("一期", "二期", "三期", "四期", "五期", "东区", "西区", "南区", "北区")
COMPOUND_MARKS, ESTATE_MARKS = "院|里|巷|号", "花园|家园|新城|城|庄|苑"


def structure(places: DataFrame, name: str, group: list[str]) -> DataFrame:
    """(group, base, name, role, parent, confidence): places grouped by their base name. A base of several places is an estate
    that stands for all, and they are its phases or compounds; a lone place has the role its name tells (or is ambiguous).
    Null names are left out; repeated names of a group count once."""
    base = F.col(name)
    for e in PART_ENDINGS:
        base = F.replace(base, F.lit(e), F.lit(""))
    d = places.where(F.col(name).isNotNull()).select(*group, F.col(name).alias("name"), F.trim(base).alias("base")).distinct()
    n = d.groupBy(*group, "base").agg(F.count(F.lit(1)).alias("n"))
    d = d.join(n, [*group, "base"])
    several = F.col("n") > 1
    alone = F.when(F.col("name") != F.col("base"), "RESIDENTIAL_PHASE").when(F.col("name").rlike(COMPOUND_MARKS), "RESIDENTIAL_COMPOUND").when(F.col("name").rlike(ESTATE_MARKS), "RESIDENTIAL_ESTATE").otherwise("AMBIGUOUS")
    role = F.when(several, F.when(F.col("name").rlike("[一二三四五六七八九十0-9]+期"), "RESIDENTIAL_PHASE").otherwise("RESIDENTIAL_COMPOUND")).otherwise(alone)
    child = d.select(*group, "base", "name", role.alias("role"), F.when(several, F.col("base")).alias("parent"), F.when(several, 0.75).when(role == "AMBIGUOUS", 0.3).otherwise(0.7).alias("confidence"))
    estate = n.where("n > 1").select(*group, "base", F.col("base").alias("name"), F.lit("RESIDENTIAL_ESTATE").alias("role"), F.lit(None).cast("string").alias("parent"), F.lit(0.8).alias("confidence"))
    return child.unionByName(estate)
