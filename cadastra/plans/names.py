"""Queries of names, pair features, identity and reports, each with its SQL. Inputs are written once, as SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, hypotheses, landuse, pipelines, relations, reports
from ..sources.tables import table
from . import views
from .reference import C, q, query, r
from .views import FENCES_SQL, inputs

#: Names, tags and texts of every kind, derived from the parts.
WORDS = ("翠园小区", "第一中学", "省人民医院", "万达商场", "写字楼A座", "森林公园", "博物馆", "东风号院", "北里宿舍", "锦绣花园", "中山寺", "月亮湖", "人民广场", "滨河大院", "阳光家园", "大学城")
_WORD = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"
NAMED_SQL = f"SELECT p_partkey AS id, {_WORD} AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Residential' WHEN p_partkey % 5 = 1 THEN 'school' WHEN p_partkey % 5 = 2 THEN 'other' END AS overture, CASE WHEN p_partkey % 7 = 0 THEN 'hotel' WHEN p_partkey % 7 = 1 THEN 'clinic' WHEN p_partkey % 7 = 2 THEN 'office' END AS tag FROM part"


def _first(words: tuple, expr: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr.format(w)} THEN {v!r}" for v, w in words) + f" ELSE {default} END"


@query(f"""WITH n AS ({NAMED_SQL}) SELECT id, CASE WHEN lower(overture) = 'residential' THEN 'RESIDENTIAL' WHEN lower(overture) = 'school' THEN 'SCHOOL' WHEN tag = 'hotel' THEN 'COMMERCIAL' WHEN tag = 'clinic' THEN 'MEDICAL' WHEN tag = 'office' THEN 'OFFICE'
 ELSE {_first(text.FUNCTION_WORDS, "regexp_matches(name, '{0}')", "'UNKNOWN'")} END AS function FROM n""")
def building_functions(spark: SparkSession, d: str) -> DataFrame:
    n = inputs(spark, d, NAMED_SQL)
    return n.select("id", text.building_function(C("overture"), C("tag"), C("name")).alias("function"))


@query(f"WITH n AS ({NAMED_SQL}) SELECT id, {_first(text.ONTOLOGY_WORDS, chr(34) + 'name' + chr(34) + ' LIKE ' + chr(39) + '%{0}%' + chr(39), 'NULL')} AS ontology, CAST({_first(text.RADIUS_WORDS, chr(34) + 'name' + chr(34) + ' LIKE ' + chr(39) + '%{0}%' + chr(39), '200.0')} AS DOUBLE) AS radius_m FROM n")
def ontology_and_radius(spark: SparkSession, d: str) -> DataFrame:
    n = inputs(spark, d, NAMED_SQL)
    return n.select("id", text.first_word(C("name"), text.ONTOLOGY_WORDS).alias("ontology"), text.first_word(C("name"), text.RADIUS_WORDS, 200.0).cast("double").alias("radius_m"))


PAIRED_SQL = "SELECT a.p_partkey AS id, a.p_name AS x, CASE WHEN a.p_partkey % 7 = 0 THEN a.p_name WHEN a.p_partkey % 7 = 1 THEN a.p_name || ' east' ELSE b.p_name END AS y, a.p_size = b.p_size AS same_district FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
_DICE = "CAST(2 * len(list_intersect(list_distinct([substr(x, i, 2) FOR i IN range(1, length(x))]), list_distinct([substr(y, i, 2) FOR i IN range(1, length(y))]))) AS DOUBLE) / greatest(length(x) + length(y) - 2, 1)"


@query(f"WITH p AS ({PAIRED_SQL}) SELECT id, {q(f'CASE WHEN x = y THEN 100 WHEN contains(x, y) OR contains(y, x) THEN 90 ELSE 100 * {_DICE} END - CASE WHEN same_district THEN 0 ELSE 50 END', 5, 'score')} FROM p")
def name_ladder(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d, PAIRED_SQL).select("id", r(text.name_ladder(C("x"), C("y"), C("same_district")), 5, "score"))


PHASED_SQL = "SELECT c_custkey AS id, c_mktsegment || ' estate' AS base, CASE WHEN c_custkey % 3 = 0 THEN '一期' WHEN c_custkey % 3 = 1 THEN '第2期' END AS phase, CASE WHEN c_custkey % 4 < 2 THEN '东区' END AS subarea FROM customer"


@query(f"""WITH p AS ({PHASED_SQL}) SELECT id, base AS estate, phase AS found, len(list_distinct(list_filter([base, base || phase, base || subarea, base || '(' || subarea || ')', base || phase || subarea], lambda v: v IS NOT NULL))) AS n_aliases,
 concat_ws(' | ', base, nullif(trim(coalesce(subarea, '')), ''), nullif(trim(coalesce(phase, '')), '')) AS rerank FROM p""")
def aliases_and_texts(spark: SparkSession, d: str) -> DataFrame:
    p = inputs(spark, d, PHASED_SQL).withColumn("s", text.phase_split(F.concat("base", F.coalesce("phase", F.lit("")))))
    return p.select("id", C("s.estate").alias("estate"), C("s.phase").alias("found"), F.size(text.aliases(C("base"), C("phase"), C("subarea"))).alias("n_aliases"), text.rerank_text(C("base"), F.coalesce("subarea", F.lit("")), F.coalesce("phase", F.lit(""))).alias("rerank"))


ANSWERS_SQL = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '{"label": "A", "score": ' || CAST(o_orderkey % 10 AS VARCHAR(10)) || '}' WHEN 1 THEN 'Sure: ```json {"label": "B", "score": 3} ```' WHEN 2 THEN 'I think {"label": "C", "score": 4} fits' WHEN 3 THEN 'no answer' ELSE '{"other": 1}' END AS answer FROM orders"""


@query(f"WITH a AS ({ANSWERS_SQL}) SELECT id, CASE id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS label, CASE id % 5 WHEN 0 THEN CAST(id % 10 AS DOUBLE) WHEN 1 THEN 3 WHEN 2 THEN 4 END AS score FROM a")
def lenient_answers(spark: SparkSession, d: str) -> DataFrame:
    a = inputs(spark, d, ANSWERS_SQL).withColumn("j", text.lenient_json(C("answer"), "label string, score double"))
    return a.select("id", C("j.label").alias("label"), C("j.score").alias("score"))


@query("SELECT count(*) AS texts, count(*) FILTER (WHERE regexp_matches(text, '[一-鿿]')) AS cjk, count(*) FILTER (WHERE contains(text, chr(65533)) OR contains(text, '锟斤拷') OR contains(text, '烫烫') OR regexp_matches(text, '[ÃÂ][\\x{80}-\\x{bf}]')) AS mojibake FROM documents WHERE text IS NOT NULL")
def text_hygiene(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.agg(F.count(F.lit(1)).alias("texts"), F.count_if(text.has_cjk(C("text"))).alias("cjk"), F.count_if(text.mojibake(C("text"))).alias("mojibake"))


NUMERALS_SQL = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '十' WHEN 1 THEN '十三' WHEN 2 THEN '二十' WHEN 3 THEN '三十五' WHEN 4 THEN '一百零二' WHEN 5 THEN '两百一十' WHEN 6 THEN '七' WHEN 7 THEN '48' ELSE '甲二' END AS t, CASE p_partkey % 5 WHEN 0 THEN '甲2号院' WHEN 1 THEN '十三区' WHEN 2 THEN 'a1区' WHEN 3 THEN '南区' ELSE 'B区' END AS token FROM part"


@query("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 10 WHEN 1 THEN 13 WHEN 2 THEN 20 WHEN 3 THEN 35 WHEN 4 THEN 102 WHEN 5 THEN 210 WHEN 6 THEN 7 WHEN 7 THEN 48 END AS value, CASE p_partkey % 5 WHEN 0 THEN '甲2号' WHEN 1 THEN '13' WHEN 2 THEN 'A1' WHEN 3 THEN '南' ELSE 'B' END AS normal FROM part")
def numerals_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d, NUMERALS_SQL).select("id", text.numeral(C("t")).alias("value"), text.normal_token(C("token")).alias("normal"))


# ---- pairs

#: Pairs of named records from the relations, each with names, districts and points as delivered.
RELATED_SQL = """SELECT DISTINCT upper(trim(e.subject_record_id)) AS ida, upper(trim(e.object_record_id)) AS idb FROM entity_relations e WHERE e.subject_record_id IS NOT NULL AND e.object_record_id IS NOT NULL"""
ONE_RECORD_SQL = """SELECT upper(trim(source_record_id)) AS id, max(coalesce(name_raw, '')) AS name, max(district_raw) AS district, max(CASE WHEN point_raw_lng BETWEEN 73 AND 136 AND point_raw_lat BETWEEN 3 AND 54 THEN point_raw_lng END) AS lng, max(CASE WHEN point_raw_lng BETWEEN 73 AND 136 AND point_raw_lat BETWEEN 3 AND 54 THEN point_raw_lat END) AS lat FROM source_records GROUP BY 1"""
PAIRS_SQL = f"""SELECT p.ida AS id_a, p.idb AS id_b, a.name AS name_a, b.name AS name_b, a.district AS district_a, b.district AS district_b, a.lng AS lng_a, a.lat AS lat_a, b.lng AS lng_b, b.lat AS lat_b
 FROM ({RELATED_SQL}) p JOIN ({ONE_RECORD_SQL}) a ON a.id = p.ida JOIN ({ONE_RECORD_SQL}) b ON b.id = p.idb WHERE p.ida < p.idb"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    p = inputs(spark, d, PAIRS_SQL).withColumns({"inter": F.lit(0.0), "area_a": F.lit(1.0), "area_b": F.lit(1.0)})
    return features.pair_features(p.withColumn("bge_sim", text.bigram_dice(C("name_a"), C("name_b"))))


_N = "([甲乙丙丁]?[0-9]+|[一二三四五六七八九十]+)"
_TRIMMED = "trim({0})"
_TOK = {"court_no": f"nullif(regexp_extract(n, '{_N}号院', 1), '')", "house_no": f"nullif(regexp_extract(replace(replace(n, '号院', '#'), '号楼', '#'), '{_N}号', 1), '')",
        "phase": "nullif(regexp_extract(n, '[一二三四五六七八九十0-9]+期'), '')", "subarea": "nullif(regexp_extract(n, '东区|西区|南区|北区|中区|东院|西院|南院|北院|[A-Z]区|[A-Z][0-9]+|[一二三四五六七八九十0-9]+区'), '')"}
_COURT = {"court_no": f"nullif(regexp_extract(n, '({_N[1:-1]})号院'), '')", "house_no": f"nullif(regexp_extract(replace(replace(n, '号院', '#'), '号楼', '#'), '({_N[1:-1]})号'), '')"}
_TOKENS_SQL = "SELECT id, n, " + ", ".join(f"{(_COURT | {k: v for k, v in _TOK.items() if k not in _COURT})[k]} AS {k}" for k in _TOK) + " FROM (SELECT id, trim(name, ' ') AS n FROM one)"
_KEY = "nullif(regexp_extract({0}, '^[甲乙丙丁]?[0-9]+'), '')"


@query(f"""WITH one AS ({ONE_RECORD_SQL}), t AS ({_TOKENS_SQL}), p AS ({RELATED_SQL}) SELECT p.ida AS id_a, p.idb AS id_b, a.n = b.n AS exact_name_match, coalesce(a.court_no <> b.court_no, false) AS court_conflict, coalesce(a.house_no <> b.house_no, false) AS house_conflict,
 CASE WHEN a.house_no IS NOT NULL AND b.court_no IS NOT NULL THEN {_KEY.format('a.house_no')} IS DISTINCT FROM {_KEY.format('b.court_no')} WHEN b.house_no IS NOT NULL AND a.court_no IS NOT NULL THEN {_KEY.format('b.house_no')} IS DISTINCT FROM {_KEY.format('a.court_no')} ELSE false END AS cross_num_conflict,
 coalesce(a.phase <> b.phase, false) AS phase_conflict, coalesce(a.subarea <> b.subarea, false) AS subarea_conflict, coalesce(nullif(oa.district, '') = nullif(ob.district, ''), true) AS district_match,
 {q('sqrt(pow((oa.lng - ob.lng) * CAST(111412.84 AS DOUBLE) * cos(radians((oa.lat + ob.lat) / 2)), 2) + pow((oa.lat - ob.lat) * CAST(111132.954 AS DOUBLE), 2))', 3, 'metres')}
 FROM p JOIN t a ON a.id = p.ida JOIN t b ON b.id = p.idb JOIN one oa ON oa.id = p.ida JOIN one ob ON ob.id = p.idb WHERE p.ida < p.idb""")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    flags = ("exact_name_match", "court_conflict", "house_conflict", "cross_num_conflict", "phase_conflict", "subarea_conflict", "district_match")
    return f.select("id_a", "id_b", *flags, r(C("centroid_dist_meters"), 3, "metres"))


@query()
def pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The pair scorer, review status and tiers on the features of real records (their name ratios are Python's)."""
    f = _features(spark, d).withColumn("rule", relations.pair_rule(features.rule_features()))
    f = f.select("id_a", "id_b", C("rule.relation").alias("relation"), relations.review_status(C("rule.conf")).alias("status"), "iou", "bge_sim", C("centroid_dist_meters").alias("metres"))
    return f.select("relation", "status", relations.work_tier(C("relation"), C("iou"), F.lit(None).cast("double"), C("bge_sim"), C("metres")).alias("tier")).groupBy("relation", "status", "tier").agg(F.count(F.lit(1)).alias("n"))


TWINS_SQL = """SELECT a.c_custkey AS id, CASE WHEN a.c_custkey % 7 = 0 THEN true WHEN a.c_custkey % 7 = 1 THEN false END AS verdict, CAST(a.c_custkey % 3 AS INT) AS da, CAST((a.c_custkey * 5) % 4 AS INT) AS db, CAST((a.c_custkey * 37) % 1000 AS DOUBLE) / 100000 AS dist FROM customer a"""


@query(f"""WITH t AS ({TWINS_SQL}) SELECT id, CASE WHEN verdict THEN 'SIBLING' WHEN NOT verdict THEN 'DISTINCT' WHEN da > 1 AND db > 1 THEN 'DISTINCT' WHEN dist * 111000 < 50 THEN 'SAME_ENTITY' WHEN dist * 111000 < 500 THEN 'SIBLING' ELSE 'DISTINCT' END AS relation,
 CAST(CASE WHEN verdict THEN 0.85 WHEN NOT verdict THEN 0.9 WHEN da > 1 AND db > 1 THEN 0.75 WHEN dist * 111000 < 50 THEN 0.85 WHEN dist * 111000 < 500 THEN 0.6 ELSE 0.9 END AS DOUBLE) AS confidence FROM t""")
def same_name_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    t = inputs(spark, d, TWINS_SQL).withColumn("z", features.same_name(C("verdict"), C("da"), C("db"), C("dist")))
    return t.select("id", "z.relation", "z.confidence")


_BASE = "canonical_name"
for _e in features.PART_ENDINGS:
    _BASE = f"replace({_BASE}, '{_e}', '')"


@query(f"""WITH d AS (SELECT DISTINCT city, canonical_name AS name, trim({_BASE}) AS base FROM canonical_entities WHERE canonical_name IS NOT NULL AND city IS NOT NULL), n AS (SELECT city, base, count(*) AS n FROM d GROUP BY ALL), j AS (SELECT d.*, n.n FROM d JOIN n USING (city, base))
 SELECT city, base, name, CASE WHEN n > 1 THEN CASE WHEN regexp_matches(name, '[一二三四五六七八九十0-9]+期') THEN 'RESIDENTIAL_PHASE' ELSE 'RESIDENTIAL_COMPOUND' END WHEN name <> base THEN 'RESIDENTIAL_PHASE' WHEN regexp_matches(name, '院|里|巷|号') THEN 'RESIDENTIAL_COMPOUND' WHEN regexp_matches(name, '花园|家园|新城|城|庄|苑') THEN 'RESIDENTIAL_ESTATE' ELSE 'AMBIGUOUS' END AS role, CASE WHEN n > 1 THEN base END AS parent FROM j
 UNION ALL SELECT city, base, base, 'RESIDENTIAL_ESTATE', NULL FROM n WHERE n > 1""")
def place_structure(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "canonical_entities").where("city IS NOT NULL")
    return features.structure(e, "canonical_name", ["city"]).drop("confidence")


_SOFT = "CASE WHEN relation_type = 'RELATED_ENTITY' AND ce < 0.3 THEN 'NOT_SAME_ENTITY' WHEN relation_type = 'RELATED_ENTITY' AND ce >= 0.85 THEN 'ALIAS_CONFIRMED' ELSE relation_type END"


@query(f"SELECT relation_type AS before, {_SOFT} AS after, count(*) AS n FROM (SELECT relation_type, CASE WHEN isnan(cross_encoder_score) THEN NULL ELSE cross_encoder_score END AS ce FROM entity_relations WHERE relation_type IS NOT NULL) GROUP BY ALL")
def rerank_moves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_relations").where("relation_type IS NOT NULL")
    ce = F.when(F.isnan("cross_encoder_score"), None).otherwise(C("cross_encoder_score"))
    return e.select(C("relation_type").alias("before"), relations.rerank(C("relation_type"), ce).alias("after")).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


_GOALS_SQL = """b AS (SELECT id, CASE WHEN bal < 0 THEN 'REVIEW' WHEN bal < 2000 THEN 'WARN' ELSE 'PASS' END AS decision, id % 11 = 0 AS mixed, id % 6 = 0 AS flagged FROM fences),
 a AS (SELECT id, CASE WHEN decision IN ('WARN', 'REVIEW') OR mixed THEN 'HARD' ELSE 'FLAGGED' END AS priority FROM b WHERE flagged OR mixed OR decision IN ('WARN', 'REVIEW'))"""


@query(f"WITH {FENCES_SQL}, {_GOALS_SQL}, r AS (SELECT upper(trim(subject_record_id)) AS s, upper(trim(object_record_id)) AS o FROM entity_relations WHERE iou > 0 AND NOT isnan(iou)), i AS (SELECT s AS k FROM r UNION SELECT o FROM r), x AS (SELECT 'SRC_' || lpad(CAST(id AS VARCHAR), 9, '0') AS k, priority FROM a) SELECT x.k AS id, priority FROM x SEMI JOIN i USING (k)")
def dual_goal_cross(spark: SparkSession, d: str) -> DataFrame:
    b = views.fences(spark, d).select(F.concat(F.lit("SRC_"), F.lpad(C("id").cast("string"), 9, "0")).alias("id"), F.when(C("bal") < 0, "REVIEW").when(C("bal") < 2000, "WARN").otherwise("PASS").alias("decision"), F.when(C("id") % 11 == 0, "MIXED_CRS").otherwise("CONFIRMED_WGS84").alias("coord"), F.when(C("id") % 6 == 0, F.array(F.lit("JAGGED"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    a = b.select("id", reports.problem_priority(C("decision"), C("coord"), C("issues")).alias("priority")).where("priority IS NOT NULL")
    return reports.both_goals(a, "id", table(spark, d, "entity_relations"))


# ---- reports

@query("""SELECT count(*) AS total_relations, count(DISTINCT relation_type) AS kinds, count(*) FILTER (WHERE relation_type = 'RELATED_ENTITY') AS soft_pairs, count(*) FILTER (WHERE relation_type = 'RELATED_ENTITY' AND cross_encoder_score < 0.3 AND NOT isnan(cross_encoder_score)) AS downgraded, count(*) FILTER (WHERE relation_type = 'RELATED_ENTITY' AND cross_encoder_score >= 0.85 AND NOT isnan(cross_encoder_score)) AS alias_confirmed,
 (SELECT count(*) FROM source_records) AS total_records, (SELECT count(DISTINCT canonical_entity_id) FROM canonical_entities) AS entities, (SELECT count(DISTINCT canonical_entity_id) FROM canonical_entities WHERE coalesce(member_count, 1) > 1) AS merged_clusters, (SELECT count(DISTINCT geometry_version_id) FROM geometry_versions) AS geometry_versions FROM entity_relations""")
def pipeline_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.pipeline_summary(table(spark, d, "source_records"), table(spark, d, "entity_relations"), table(spark, d, "canonical_entities"), table(spark, d, "geometry_versions"))


_SHAPE_SQL = f"SELECT id, greatest(width_m, height_m) / least(width_m, height_m) AS aspect, id % 9 = 0 AS truly_long, least(width_m, height_m) / 2 AS mic FROM (WITH {FENCES_SQL} SELECT * FROM fences)"


@query(f"WITH s AS ({_SHAPE_SQL}) SELECT CASE WHEN mic < 12.5 THEN 'THIN' WHEN mic < 25 THEN 'NARROW' ELSE 'WIDE' END AS mic_class, count(*) AS n, count(*) FILTER (WHERE aspect > 10 AND truly_long) AS true_positive, count(*) FILTER (WHERE aspect > 10 AND NOT truly_long) AS false_positive, count(*) FILTER (WHERE NOT aspect > 10 AND truly_long) AS missed FROM s GROUP BY 1")
def aspect_confusion(spark: SparkSession, d: str) -> DataFrame:
    s = views.fences(spark, d).select((F.greatest("width_m", "height_m") / F.least("width_m", "height_m")).alias("aspect"), (C("id") % 9 == 0).alias("truth"), (F.least("width_m", "height_m") / 2).alias("mic"))
    return reports.confusion(s.select(reports.mic_class(C("mic")).alias("mic_class"), (C("aspect") > 10).alias("flag"), "truth"), "mic_class", "flag", "truth")


@query(f"""SELECT city, {', '.join(q(f'quantile_cont(width_m, {p})', 4, f'p{int(p * 100)}') for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, count(*) FILTER (WHERE district = 'BUILDING') AS building, count(*) FILTER (WHERE district <> 'BUILDING') AS other, round(avg(CAST(width_m <= 100 AS INT)), 6) AS pass_100 FROM (WITH {FENCES_SQL} SELECT * FROM fences) GROUP BY city""")
def width_percentiles(spark: SparkSession, d: str) -> DataFrame:
    f = views.fences(spark, d)
    return f.groupBy("city").agg(*[r(F.percentile("width_m", F.lit(p)), 4, f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)], F.count_if(C("district") == "BUILDING").alias("building"), F.count_if(C("district") != "BUILDING").alias("other"), F.round(F.avg((C("width_m") <= 100).cast("int")), 6).alias("pass_100"))


EVIDENCE_SQL = "SELECT o_orderkey AS id, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS c1, o_orderkey % 3 = 0 AS s1, CAST(o_orderkey % 7 AS DOUBLE) / 6 AS c2, o_orderkey % 4 <> 0 AS s2, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS s3 FROM orders"
_SUP, _REF, _TOT = "CASE WHEN s1 THEN 0.4 * c1 ELSE 0 END + CASE WHEN s2 THEN 0.25 * c2 ELSE 0 END + CASE WHEN s3 THEN 0.2 ELSE 0 END", "CASE WHEN s1 THEN 0 ELSE 0.4 * c1 END + CASE WHEN s2 THEN 0 ELSE 0.25 * c2 END", "0.65 + CASE WHEN s3 IS NOT NULL THEN 0.2 ELSE 0 END"
_MEMBER = f"greatest(0, least(1, (CAST({_SUP} AS DOUBLE) - 0.5 * CAST({_REF} AS DOUBLE)) / CAST({_TOT} AS DOUBLE)))"


@query(f"WITH e AS ({EVIDENCE_SQL}), m AS (SELECT id, {_MEMBER} AS v FROM e) SELECT id, {q('v', 6, 'confidence')}, CASE WHEN v + 1e-9 >= 0.8 THEN 'CONFIRMED' WHEN v + 1e-9 >= 0.5 THEN 'LIKELY' WHEN v + 1e-9 >= 0.2 THEN 'UNCERTAIN' ELSE 'EXCLUDED' END AS level FROM m")
def weighted_evidence(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import areas

    item = lambda m, s, c: F.struct(F.lit(m).alias("method"), s.alias("supports"), c.cast("double").alias("confidence"))
    e = inputs(spark, d, EVIDENCE_SQL).select("id", F.array_compact(F.array(item("containment", C("s1"), C("c1")), item("road", C("s2"), C("c2")), F.when(C("s3").isNotNull(), item("cluster", C("s3"), F.when(C("s3"), 1.0).otherwise(0.0))))).alias("ev"))
    v = areas.member_confidence(C("ev"))
    return e.select("id", r(v, 6, "confidence"), areas.member_level(v).alias("level"))


@query("WITH s AS (SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS sup, CAST(o_orderkey % 4 AS DOUBLE) / 10 AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'RESIDENTIAL' WHEN 1 THEN 'SCHOOL' ELSE 'UNKNOWN' END AS fn, o_orderkey % 5 = 0 AS mixed FROM orders) SELECT id, CASE WHEN fn = 'SCHOOL' AND NOT mixed THEN 'EXCLUDED' WHEN greatest(0, sup - ref) + 1e-9 >= 0.75 THEN 'DEFINITE' WHEN greatest(0, sup - ref) + 1e-9 >= 0.5 THEN 'PROBABLE' WHEN greatest(0, sup - ref) + 1e-9 >= 0.25 THEN 'POSSIBLE' ELSE 'UNLIKELY' END AS level FROM s")
def membership_by_function(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    s = table(spark, d, "orders").select(k.alias("id"), ((k % 10).cast("double") / 10).alias("sup"), ((k % 4).cast("double") / 10).alias("ref"), F.when(k % 3 == 0, "RESIDENTIAL").when(k % 3 == 1, "SCHOOL").otherwise("UNKNOWN").alias("fn"), (k % 5 == 0).alias("mixed"))
    return s.select("id", hypotheses.membership_v2(C("sup") + 1e-9, C("ref"), C("fn"), C("mixed"))["level"].alias("level"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'NAME' WHEN o_orderkey % 3 = 0 THEN 'CONTAINED' WHEN o_orderkey % 400 <= 150 THEN 'NEAR' ELSE 'OUTSIDE' END AS tier FROM orders")
def campus_tiers(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), hypotheses.campus_member(k % 7 == 0, k % 3 == 0, (k % 400).cast("double")).alias("tier"))


_LEGAL_IN = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'SCHOOL' WHEN 1 THEN 'HOSPITAL' WHEN 2 THEN 'PARK' WHEN 3 THEN 'RESIDENTIAL_ESTATE' ELSE 'COURTYARD' END AS entity, CASE (p_partkey // 5) % 6 WHEN 0 THEN 'R' WHEN 1 THEN 'A3' WHEN 2 THEN 'A5' WHEN 3 THEN 'G' WHEN 4 THEN 'M' ELSE 'U' END AS code FROM part"


@query("WITH v AS (" + _LEGAL_IN + ") SELECT entity, code, count(*) AS n, NOT (" + landuse.illegal_sql("entity", "code") + ") AS ok FROM v GROUP BY ALL")
def entity_use_legality(spark: SparkSession, d: str) -> DataFrame:
    v = inputs(spark, d, _LEGAL_IN.replace("(p_partkey // 5)", "CAST(FLOOR(p_partkey / 5) AS BIGINT)"))
    return v.select("entity", "code", landuse.legal(C("entity"), C("code")).alias("ok")).groupBy("entity", "code", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT s_suppkey AS id, s_name AS prefix FROM supplier), c AS (SELECT c_custkey AS id, 'Supplier#' || lpad(CAST(c_custkey % 90 AS VARCHAR), 9, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' east' ELSE '' END AS name FROM customer)
 SELECT c.id, min(k.id) AS source, CASE WHEN bool_or(k.prefix = c.name) THEN 'EXACT' ELSE 'PREFIX' END AS how FROM c JOIN k ON starts_with(c.name, k.prefix) GROUP BY 1""")
def attribute_enrichment(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "supplier").select(C("s_suppkey").alias("source"), C("s_name").alias("known"))
    c = C("c_custkey")
    names = table(spark, d, "customer").select(c.alias("id"), F.concat(F.lit("Supplier#"), F.lpad((c % 90).cast("string"), 9, "0"), F.when(c % 2 == 0, " east").otherwise("")).alias("name"))
    return reports.enrich(names, "id", "name", k, "source", "known")


@query("""SELECT 'null_names' AS "check", count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT DISTINCT * FROM landuse_faces) WHERE name IS NULL
 UNION ALL SELECT 'null_geometry', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT DISTINCT * FROM landuse_faces) WHERE geometry_wkt IS NULL OR trim(geometry_wkt) = ''
 UNION ALL SELECT 'repeated_rows', (SELECT count(*) FROM landuse_faces) - (SELECT count(*) FROM (SELECT DISTINCT * FROM landuse_faces)), CASE WHEN (SELECT count(*) FROM landuse_faces) = (SELECT count(*) FROM (SELECT DISTINCT * FROM landuse_faces)) THEN 'PASS' ELSE 'WARN' END
 UNION ALL SELECT 'layers', count(DISTINCT source_layer), CASE WHEN count(DISTINCT source_layer) > 0 THEN 'PASS' ELSE 'FAIL' END FROM landuse_faces""")
def city_input_checks(spark: SparkSession, d: str) -> DataFrame:
    return reports.layer_checks(table(spark, d, "landuse_faces"))


@query("SELECT source_system AS dataset, count(*) AS rows, min(CASE WHEN source_record_id IS NULL OR trim(source_record_id) = '' THEN 0 ELSE 1 END) = 1 AS keyed, count(DISTINCT source_batch_id) >= 2 AS several_loads, min(CASE WHEN source_record_id IS NULL OR trim(source_record_id) = '' THEN 0 ELSE 1 END) = 1 AND count(*) > 0 AND count(DISTINCT source_batch_id) >= 2 AS ready FROM source_records GROUP BY 1")
def dataset_readiness(spark: SparkSession, d: str) -> DataFrame:
    return reports.readiness(table(spark, d, "source_records"), "source_system", "source_record_id", "source_batch_id")


_WORKED = "ROW_NUMBER() OVER (ORDER BY tier, iou DESC NULLS LAST, bge DESC NULLS LAST, relation_id)"
_ORDERS_SQL = "SELECT relation_id, 1 + length(relation_id) % 3 AS tier, CASE WHEN isnan(iou) THEN NULL ELSE iou END AS iou, CASE WHEN isnan(bge_sim) THEN NULL ELSE bge_sim END AS bge FROM entity_relations WHERE relation_id IS NOT NULL"


@query(f"SELECT relation_id, tier FROM (SELECT DISTINCT * FROM ({_ORDERS_SQL})) ORDER BY tier, iou DESC NULLS LAST, bge DESC NULLS LAST, relation_id LIMIT 50")
def top_work_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 work orders: a top-k report."""
    o = inputs(spark, d, _ORDERS_SQL).distinct()
    return o.orderBy("tier", F.desc_nulls_last("iou"), F.desc_nulls_last("bge"), "relation_id").limit(50).select("relation_id", "tier")


ROSTER_SQL = f"SELECT id AS roster_id, name, lng + CAST(id % 7 AS DOUBLE) / 400 AS x, lat AS y FROM (WITH {FENCES_SQL} SELECT * FROM fences)"
POLY_SQL = f"SELECT id AS poly_id, CASE WHEN id % 3 = 0 THEN name || ' east' ELSE name END AS name, lng AS x, lat AS y FROM (WITH {FENCES_SQL} SELECT * FROM fences)"


@query(f"""WITH a AS ({ROSTER_SQL}), b AS ({POLY_SQL}), g AS (SELECT roster_id, poly_id, sqrt(pow((a.x - b.x) * cos(radians(a.y)), 2) + pow(a.y - b.y, 2)) * CAST(111.32 AS DOUBLE) AS km, CASE WHEN a.name = b.name THEN 1.0 ELSE 0.9 END AS s FROM a JOIN b ON a.name = b.name OR b.name = a.name || ' east'),
 f AS (SELECT roster_id, poly_id, CAST(s AS DOUBLE) * (1 - least(km / 3, CAST(0.5 AS DOUBLE))) AS final FROM g WHERE km <= 3) SELECT roster_id, {q('max(final)', 6, 'final')} FROM f GROUP BY 1""")
def roster_own_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Roster entries against polygons; names of equal length differ in digits only, so an entry's own polygon (equal or longer name)
    is compared with SQL, while others fall below it."""
    a, b = inputs(spark, d, ROSTER_SQL), inputs(spark, d, POLY_SQL)
    m = pipelines.roster_match(a, b.join(a.select(C("roster_id").alias("poly_id")), "poly_id"), own_only=True)
    return m.select("roster_id", r(C("final"), 6, "final"))
