"""Land-use classification from tags, names, rules, outside sources and facilities nearby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, and the tag maps of both profiles.
CLASSES = ("R", "B1", "B2", "M", "S", "A3", "A4", "A5", "G", "MIL", "AGR", "U")
LANDUSE = {
    "library": {"residential": "R", "retail": "B1", "commercial": "B2", "industrial": "M", "park": "G", "forest": "G", "grass": "G", "meadow": "G", "scrub": "G", "orchard": "G", "recreation_ground": "G", "village_green": "G", "cemetery": "U"},
    "city": {"residential": "R", "retail": "B1", "commercial": "B2", "industrial": "M", "park": "G", "forest": "G", "grass": "G", "meadow": "G", "scrub": "G", "orchard": "G", "recreation_ground": "G", "village_green": "G", "heath": "G", "military": "MIL",
             "farmland": "AGR", "farmyard": "AGR", "quarry": "M", "cemetery": "U", "landfill": "U", "vineyard": "AGR", "allotments": "AGR", "railway": "S", "education": "A3", "hospital": "A5"},
}
POI = {
    "A3": "school kindergarten university college", "A5": "hospital clinic dentist doctors", "A4": "stadium pitch track sports_centre library museum theatre community_centre",
    "B1": "mall supermarket marketplace department_store clothes bakery beverages beauty_shop furniture_shop computer_shop mobile_phone_shop gift_shop travel_agent laundry photo_shop kiosk outdoor_shop shoes_shop jewelry_shop sports_shop stationery bookshop florist hairdresser optician chemist toy_shop charity",
    "B2": "office company estate_agent insurance bank atm post_office courthouse", "S": "bus_station railway_station subway_station airport ferry_terminal", "U": "police fire_station townhall government place_of_worship public_building",
}
PARK_FAMILY = ("park", "grass", "scrub", "recreation_ground")
SPORTY = "体育|运动|球场|场馆|健身|竞技"
TRANSPORT_KEEP = ("bus_station", "railway_station", "airport", "ferry_terminal")
#: Rules as (id, priority, scope, tag pattern, name pattern, class).
RULES = (
    ("SPORT-PARK", 10, "landuse", "^(park|grass|scrub|recreation_ground|forest)$", "体育|运动场$|球[场馆]$|健身|竞技", "A4"), ("HOSPITAL-NODE", 20, "any", "", "医院|卫生院|诊所|卫生服务中心|保健院", "A5"),
    ("SCHOOL-SUFFIX", 25, "any", "", "小学$|中学$|幼儿园$|学校$|附中|附小", "A3"), ("MARKET-NOUN", 30, "any", "", "便利店|^市场$|购物中心|商场|超市$", "B1"), ("INDUSTRIAL-NOUN", 35, "any", "", "工厂|工业区", "M"),
)
FAMILY_DEFAULT = {"stadium": "A4", "pitch": "A4", "track": "A4", "sports_centre": "A4", "supermarket": "B1", "mall": "B1"}
#: Entity types that cannot have a land use.
ILLEGAL = (("ROAD", "R"), ("ROAD", "G"), ("BUILDING", "AGR"), ("COURTYARD", "MIL"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def poi_code(tag: Column) -> Column:
    """The class of a facility's tag, null where it is not mapped."""
    return _lookup(tag, {t: c for c, ts in POI.items() for t in ts.split()})


def landuse_code(tag: Column, name: Column, profile: str = "library") -> Column:
    """The class of a land-use face: a sporting name outranks the park family's tag; unmapped tags are U."""
    sporty = tag.isin(*PARK_FAMILY) & F.coalesce(name.rlike(SPORTY), F.lit(False))
    return F.when(sporty, "A4").otherwise(F.coalesce(_lookup(tag, LANDUSE[profile]), F.lit("U")))


def first_rule(layer: Column, tag: Column, name: Column, rules: tuple = RULES) -> Column:
    """struct(rule_id, code) of the first rule by priority whose scope, tag and name patterns fit; else null."""
    out = F.lit(None).cast("struct<rule_id:string,code:string>")
    for rid, _, scope, tags, names, code in sorted(rules, key=lambda r: -r[1]):
        fits = F.coalesce(name, F.lit("")).rlike(names)
        fits = fits & (layer == scope) if scope != "any" else fits
        fits = fits & F.coalesce(tag, F.lit("")).rlike(tags) if tags else fits
        out = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(rid).alias("rule_id"), F.lit(code).alias("code"))).otherwise(out)
    return out


def hygiene(layer: Column, tag: Column, name: Column, gov: Column, outside: Column, vote: Column) -> Column:
    """struct(code, status): government record, applicable outside type, name rule, family default, facility vote, tag."""
    mapped = F.when(layer == "landuse", _lookup(tag, LANDUSE["library"])).otherwise(poi_code(tag))
    base = F.coalesce(mapped, F.lit("U"))
    rule = first_rule(layer, tag, name)
    family = _lookup(tag, FAMILY_DEFAULT)
    applicable = (layer == "landuse") | ((layer == "poi_a") & (mapped == "A3")) | (base == "U")
    named = F.coalesce(name, F.lit("")) != ""
    say = lambda c, s: F.struct(c.alias("code"), F.lit(s).alias("status"))
    return F.coalesce(
        F.when(gov.isNotNull(), say(gov, "GOV_DEFINED")), F.when(applicable & (base != "U") & (outside != base), say(outside, "EXTERNAL_CONFIRM")), F.when(rule["code"] != base, say(rule["code"], "NAME_OVERRIDE")),
        F.when((base == "U") & family.isNotNull(), say(family, "TRUSTED_TAG")), F.when(tag.isin(*PARK_FAMILY, "forest") & ~named & (vote != base), say(vote, "POI_VOTE")), say(base, "TRUSTED_TAG"),
    )


def majority_vote(inside: DataFrame, key: str, code: str, least: int = 2) -> DataFrame:
    """(key, vote, votes): the most frequent code of each key, smallest code on ties, with `least` votes or more."""
    n = inside.groupBy(key, code).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(F.struct(F.col(code).alias("vote"), "n"), F.struct(-F.col("n"), F.col(code))).alias("z")).where(F.col("z.n") >= least).select(key, "z.vote", F.col("z.n").alias("votes"))


def distribution(faces: DataFrame, code: str) -> DataFrame:
    """(code, n, share) of every class, those without a face too."""
    spark = faces.sparkSession
    dim = spark.createDataFrame([(c,) for c in CLASSES], f"{code} string")
    n = faces.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    total = faces.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(dim).join(n, code, "left").crossJoin(F.broadcast(total)).select(code, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.greatest(F.col("total"), F.lit(1)), 6).alias("share"))


def legal(entity: Column, code: Column) -> Column:
    out = F.lit(True)
    for e, c in ILLEGAL:
        out = out & ~((entity == e) & (code == c))
    return out


def illegal_sql(entity: str, code: str) -> str:
    """The same as a condition in SQL text, negated."""
    return " OR ".join(f"({entity} = '{e}' AND {code} = '{c}')" for e, c in ILLEGAL)
