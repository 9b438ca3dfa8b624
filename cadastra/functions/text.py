"""Scalar operators on place names, addresses and model answers, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .columns import let

#: Word lists of the entity-type classifier.
DORM = "宿舍|家属|职工住宅|教师楼|干部楼|家属院|家属区|生活区|生活小区|住宅区"
COURT = "([甲乙丙丁]?[0-9]+|[一二三四五六七八九十百]+)号院"
ESTATE = "小区|家园|花园|苑|里|庄|村|公寓|住宅"
COMMERCIAL = "商业街|商场|超市|批发市场|物流园|产业园|科技园|写字楼|宾馆|酒店|商厦|商务大厦|购物中心"
BUILDING = "大厦|广场|中心"
INSTITUTION_END = "(研究所|科研所|设计院|公司|厂|医院|中学|小学|幼儿园|大学|学院|局|站)$"
INSTITUTION_ANY = "(研究所|科研所|设计院|公司|制药厂|化工厂|人民医院|附属医院)"
CITY_PREFIXES = ("北京市", "北京城区", "北京", "石家庄市", "石家庄")
_NUM = "(?:[甲乙丙丁]?[0-9]+|[一二三四五六七八九十百]+)"
#: Discriminators in order of priority; the last match counts and is cut out of the name.
COMPONENTS = (
    ("court", f"({_NUM})号院"), ("building", f"({_NUM})号楼"), ("house", f"({_NUM})号(?!院|楼)"), ("phase", "([一二三四五六七八九十百0-9]+)期"),
    ("subarea", "((?:东|西|南|北|中)(?:区|院)|[A-Za-z][0-9]*区|[一二三四五六七八九十百0-9]+区)"), ("block", f"({_NUM})街坊$"), ("lane", f"({_NUM})(?:里|条)$"),
    ("yard", f"({_NUM})场(?!景|广|市)"), ("comm_num", f"({_NUM})小区$"), ("court2", f"({_NUM})院"),
)
#: The sibling relation of a conflict in each discriminator; the order settles which conflict is told.
SIBLING = {"court": "SIBLING_COURTYARD", "building": "SIBLING_COURTYARD", "house": "SIBLING_COURTYARD", "phase": "SIBLING_PHASE", "subarea": "SIBLING_SUBAREA",
           "block": "SIBLING_SUBAREA", "lane": "SIBLING_SUBAREA", "yard": "SIBLING_SUBAREA", "comm_num": "SIBLING_SUBAREA"}
#: Name marks of building functions, ontology types and default radii, first match wins.
FUNCTION_WORDS = (("SCHOOL", "学校|小学|中学|幼儿园|大学"), ("MEDICAL", "医院|卫生院|诊所"), ("COMMERCIAL", "商场|超市|酒店|宾馆|商厦"), ("OFFICE", "写字楼|办公"), ("RESIDENTIAL", "住宅|公寓|小区|家园|花园|宿舍"))
ONTOLOGY_WORDS = (("SCHOOL", "学校"), ("SCHOOL", "大学"), ("HOSPITAL", "医院"), ("PARK", "公园"), ("COURTYARD", "号院"), ("DORMITORY", "宿舍"), ("COMPOUND", "大院"), ("RESIDENTIAL_ESTATE", "小区"), ("RESIDENTIAL_ESTATE", "花园"), ("RESIDENTIAL_ESTATE", "家园"))
RADIUS_WORDS = ((1500.0, "森林公园"), (500.0, "公园"), (120.0, "寺"), (1000.0, "山"), (800.0, "湖"), (150.0, "博物馆"), (200.0, "广场"))


def entity_type(name: Column, building: Column | None = None, property_kind: Column | None = None) -> Column:
    """The type of a place by its name; null names are residential communities like any unmarked one."""
    n = F.coalesce(F.trim(name), F.lit(""))
    has = n.rlike
    dorm, court, estate = has(DORM), has(COURT), has(ESTATE)
    mixed = F.coalesce((building if building is not None else F.lit("")).contains("住宅"), F.lit(False)) | F.coalesce((property_kind if property_kind is not None else F.lit("")).contains("商品房"), F.lit(False))
    return (
        F.when(has(COMMERCIAL) & ~dorm & ~estate, "NON_RESIDENTIAL_COMMERCIAL")
        .when(has(BUILDING) & ~estate & ~dorm & ~court, F.when(mixed, "MIXED_COMMERCIAL_RESIDENTIAL").otherwise("NON_RESIDENTIAL_COMMERCIAL"))
        .when((has(INSTITUTION_END) | has(INSTITUTION_ANY)) & ~dorm & ~court & ~estate, "NON_RESIDENTIAL_FACILITY")
        .when(dorm, "RESIDENTIAL_DORMITORY").when(court, "RESIDENTIAL_COURTYARD").otherwise("RESIDENTIAL_COMMUNITY")
    )


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def strip_city(text: Column, prefixes: tuple[str, ...] = CITY_PREFIXES) -> Column:
    """The text without the first of `prefixes` it starts with, if two characters or more remain."""
    def of(t: Column) -> Column:
        out = t
        for p in reversed(prefixes):
            out = F.when(t.startswith(p) & (F.length(t) - len(p) >= 2), F.substring(t, len(p) + 1, 1 << 30)).otherwise(out)
        return out

    return let(text, of)


def tokens(name: Column) -> Column:
    """struct(court_no, house_no, phase, subarea, base_name): the first match of each token; the base is the name
    without brackets, tokens and city, or the name itself where nothing is left."""
    n = F.coalesce(F.trim(name), F.lit(""))
    num = "([甲乙丙丁]?[0-9]+|[一二三四五六七八九十]+)"
    court, house, phase = _found(n, num + "号院"), _found(n, num + "号(?![院楼])"), _found(n, "[一二三四五六七八九十0-9]+期")
    sub = _found(n, "东区|西区|南区|北区|中区|东院|西院|南院|北院|[A-Z]区|[A-Z][0-9]+|[一二三四五六七八九十0-9]+区")
    base = F.regexp_replace(n, r"\(.*?\)|（.*?）", "")
    for t in (court, house, phase, sub):
        base = F.replace(base, F.coalesce(t, F.lit("\u0000")), F.lit(""))
    base = let(strip_city(F.regexp_replace(base, "^[ _#-]+|[ _#-]+$", "")), lambda b: F.when(b == "", n).otherwise(b))
    return F.struct(court.alias("court_no"), house.alias("house_no"), phase.alias("phase"), sub.alias("subarea"), base.alias("base_name"))


def numeral(text: Column) -> Column:
    """Chinese numerals up to 999, or digits, as int; null for anything else."""
    digit = lambda c: F.coalesce(F.element_at(F.create_map(*[x for k, v in zip("零一二两三四五六七八九", (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True) for x in (F.lit(k), F.lit(v))]), c), F.lit(0))
    part = lambda p: F.regexp_extract(text, p, 1)
    lead = lambda p: F.when(part(p) == "", 1).otherwise(digit(part(p)))
    hundreds = F.when(text.contains("百"), lead("([一二两三四五六七八九]?)百") * 100).otherwise(0)
    tens = F.when(text.contains("十"), lead("([一二两三四五六七八九]?)十") * 10).otherwise(0)
    ones = digit(part("([零一二两三四五六七八九])$"))
    return F.when(text.rlike("^[0-9]+$"), F.expr("1") * text.try_cast("int")).when(text.rlike("^[零一二两三四五六七八九十百]+$"), hundreds + tens + ones).cast("int")


def normal_token(token: Column) -> Column:
    """The comparable form of a discriminator: 甲2 stays 甲2, 十三 is 13, A1区 is A1, B区 is B, 南区 is 南."""
    head = F.regexp_extract(token, "^([甲乙丙丁]?)", 1)
    rest = F.regexp_replace(F.regexp_replace(token, "^[甲乙丙丁]", ""), "(区|院|里|条|街坊|小区)$", "")
    return F.concat(head, F.when(rest.rlike("^[东西南北中]$"), rest).when(rest.rlike("^[A-Za-z][0-9]*$"), F.upper(rest)).otherwise(F.coalesce(numeral(rest).cast("string"), rest)))


def components(name: Column) -> Column:
    """struct(base, parts map): the discriminators of a name and what is left of it. Each pattern takes its last
    match in what the earlier ones left; the state is carried through a fold, so it is computed once."""
    state = F.struct(F.coalesce(F.trim(name), F.lit("")).alias("rest"), F.create_map().cast("map<string,string>").alias("parts"))
    steps = F.array(*[F.struct(F.lit(k.removesuffix("2")).alias("k"), F.lit(p).alias("p")) for k, p in COMPONENTS])

    def step(s: Column, t: Column) -> Column:
        hits = F.call_function("regexp_extract_all", s["rest"], t["p"], F.lit(1))
        last = F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(-1)))
        whole = F.try_element_at(F.call_function("regexp_extract_all", s["rest"], t["p"], F.lit(0)), F.lit(-1))
        after = F.call_function("substring_index", s["rest"], whole, F.lit(-1))
        cut = F.concat(F.call_function("left", s["rest"], F.length(s["rest"]) - F.length(whole) - F.length(after)), after)
        fresh = last.isNotNull() & ~F.map_contains_key(s["parts"], t["k"])
        return F.struct(F.when(last.isNotNull(), cut).otherwise(s["rest"]).alias("rest"), F.when(fresh, F.map_concat(s["parts"], F.map_from_arrays(F.array(t["k"]), F.array(normal_token(last))))).otherwise(s["parts"]).alias("parts"))

    def finish(s: Column) -> Column:
        base = F.regexp_replace(strip_city(F.regexp_replace(s["rest"], r"\(.*?\)|（.*?）", "")), "^[ _#-]+|[ _#-]+$", "")
        return F.struct(F.when(base == "", F.coalesce(F.trim(name), F.lit(""))).otherwise(base).alias("base"), s["parts"].alias("parts"))

    return F.aggregate(steps, state, step, finish)


def component_conflicts(a: Column, b: Column) -> Column:
    """Discriminators present in both maps with different values, in order of priority."""
    return F.filter(F.array(*[F.lit(k) for k in SIBLING]), lambda k: F.coalesce(F.element_at(a, k) != F.element_at(b, k), F.lit(False)))


def component_scores(a: Column, b: Column) -> Column:
    """map: 1 for equal values, 0 for different, 0.5 for one-sided discriminators."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).otherwise(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts; 0 where one is null or empty. No JVM function computes it."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def name_prefix(name: Column) -> Column:
    """The blocking prefix of a name: three characters after the last closing bracket, if there are as many."""
    n = F.translate(F.replace(name, F.lit(" "), F.lit("")), "（）", "()")
    n = F.when(n.contains("("), F.substring_index(n, ")", -1)).otherwise(n)
    return F.when(F.length(n) >= 3, F.substring(n, 1, 3))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))))


def bigram_dice(a: Column, b: Column) -> Column:
    """2 x common bigrams / (both lengths - 2), at least 1 below the line."""
    return 2.0 * F.size(F.array_intersect(bigrams(a), bigrams(b))) / F.greatest(F.length(a) + F.length(b) - 2, F.lit(1))


def name_ladder(a: Column, b: Column, same_district: Column) -> Column:
    """Score of two names: equal 100, one in the other 90, else 100 x bigram similarity; 50 less in another district."""
    s = F.when(a == b, 100.0).when(a.contains(b) | b.contains(a), 90.0).otherwise(100 * bigram_dice(a, b))
    return s - F.when(same_district, 0.0).otherwise(50.0)


def first_word(text: Column, words: tuple[tuple[object, str], ...], default: object = None) -> Column:
    """The value of the first pattern that a text has."""
    out = F.lit(default)
    for v, p in reversed(words):
        out = F.when(text.rlike(p), F.lit(v)).otherwise(out)
    return out


def building_function(overture: Column, tags: Column, name: Column) -> Column:
    """Function of a building: the class of the open map layer, else its tag, else words of its name."""
    known = F.when(F.lower(overture).isin("residential", "apartments", "house"), "RESIDENTIAL").when(F.lower(overture).isin("education", "school"), "SCHOOL").when(F.lower(overture).isin("medical", "hospital"), "MEDICAL").when(F.lower(overture).isin("commercial", "retail"), "COMMERCIAL").when(F.lower(overture) == "office", "OFFICE")
    tagged = F.when(F.lower(tags).isin("apartments", "residential", "dormitory"), "RESIDENTIAL").when(F.lower(tags).isin("school", "university", "kindergarten"), "SCHOOL").when(F.lower(tags).isin("hospital", "clinic"), "MEDICAL").when(F.lower(tags).isin("retail", "commercial", "hotel"), "COMMERCIAL").when(F.lower(tags) == "office", "OFFICE")
    return F.coalesce(known, tagged, first_word(F.coalesce(name, F.lit("")), FUNCTION_WORDS), F.lit("UNKNOWN"))


def scale_level(name: Column, area: Column) -> Column:
    """COURTYARD, COMMUNITY or ESTATE by name marks, else by area (12 000 and 120 000 m2)."""
    return F.when(name.rlike("号院|大院|胡同"), "COURTYARD").when(name.rlike("期|城|片区"), "ESTATE").when(area < 12_000, "COURTYARD").when(area > 120_000, "ESTATE").otherwise("COMMUNITY")


def aliases(base: Column, phase: Column, subarea: Column) -> Column:
    """Distinct other writings of a name: base, base with each part, and with all."""
    forms = F.array(base, F.concat(base, phase), F.concat(base, subarea), F.concat(base, F.lit("("), subarea, F.lit(")")), F.concat(base, phase, subarea))
    return F.array_distinct(F.array_compact(forms))


def rerank_text(*parts: Column) -> Column:
    """The non-empty parts joined by bars."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def lenient_json(text: Column, schema: str) -> Column:
    """An answer's JSON: the whole text, else a fenced block, else from the first to the last brace; else null.
    A reading counts only if it has at least one field of the schema."""
    tries = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    full = lambda j: F.coalesce(F.size(F.json_object_keys(F.when(j.rlike(r"(?s)^\s*\{.*\}\s*$"), j))) > 0, F.lit(False))
    return F.coalesce(*[F.when(full(t), F.from_json(t, schema)) for t in tries])


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def mojibake(text: Column) -> Column:
    """True for replacement characters and typical remains of a wrong decoding."""
    return F.coalesce(text.rlike("\\ufffd|[ÃÂ][\\u0080-\\u00bf]|锟斤拷|烫烫"), F.lit(False))


def phase_split(name: Column) -> Column:
    """struct(estate, phase): a name cut before its phase."""
    p = r"(第?[一二三四五六七八九十0-9]+期)"
    return F.struct(F.trim(F.regexp_replace(name, p, "")).alias("estate"), _found(name, p[1:-1]).alias("phase"))
