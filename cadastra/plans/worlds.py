"""Queries of trust, state machines, benchmark, gold and city classification, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, gates, landuse, pipelines, reports, states, trust
from ..sources.tables import table
from . import views
from .reference import C, q, query, r
from .views import FENCES_SQL, LEDGER_SQL, RUNS_SQL, inputs

# ---- trust

STATUS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'QUARANTINED' WHEN 2 THEN 'RECONSTRUCTED' WHEN 3 THEN 'VERIFIED_VALID' WHEN 4 THEN 'REPAIRED_AUTO' ELSE 'NEW' END AS status, o_orderkey % 7 <> 0 AS ready, CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MINOR' ELSE 'NONE' END AS severity FROM orders"


@query(f"WITH s AS ({STATUS_SQL}) SELECT id, CASE WHEN status IN ('REJECTED', 'QUARANTINED') OR NOT ready OR severity = 'CRITICAL' THEN 'REJECTED' WHEN status = 'RECONSTRUCTED' THEN 'PROVISIONAL' WHEN status IN ('VERIFIED_VALID', 'REPAIRED_AUTO') THEN 'TRUSTED' ELSE 'UNRESOLVED' END AS disposition FROM s")
def status_bridges(spark: SparkSession, d: str) -> DataFrame:
    s = inputs(spark, d, STATUS_SQL)
    return s.select("id", trust.status_bridge(C("status"), C("ready"), C("severity")).alias("disposition"))


@query(f"""WITH {LEDGER_SQL}, o AS (SELECT entity_id, CAST(count(*) FILTER (WHERE kind = 'SUPPORTING') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE kind = 'REFUTING') AS DOUBLE) AS r FROM ledger GROUP BY 1), p AS (SELECT a.entity_id, a.s AS s1, a.r AS r1, b.s AS s2, b.r AS r2 FROM o a JOIN o b ON b.entity_id = a.entity_id + 1)
 SELECT entity_id, {q('(s1 + s2) / greatest(s1 + s2 + r1 + r2, 1)', 6, 'belief')}, {q('1 - (r1 + r2) / greatest(s1 + s2 + r1 + r2, 1)', 6, 'plausibility')}, {q('2 * least(s1 + s2, r1 + r2) / greatest(s1 + s2 + r1 + r2, 1)', 6, 'conflict')}, CASE WHEN s1 > s2 THEN s1 WHEN s2 > s1 THEN s2 ELSE s1 END AS kept_support, CASE WHEN s1 > s2 THEN r1 WHEN s2 > s1 THEN r2 ELSE least(r1, r2) END AS kept_refute FROM p""")
def opinion_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Combination and arbitration of two entities' opinions."""
    o = states.opinions(views.ledger(spark, d), "entity_id")
    p = o.select("entity_id", C("opinion").alias("a")).join(o.select((C("entity_id") - 1).alias("entity_id"), C("opinion").alias("b")), "entity_id")
    both, kept = states.combine(C("a"), C("b")), states.arbitrate(C("a"), C("b"))
    p = p.select("entity_id", both.alias("z"), kept.alias("k"))
    return p.select("entity_id", r(states.belief(C("z")), 6, "belief"), r(states.plausibility(C("z")), 6, "plausibility"), r(states.conflict(C("z")), 6, "conflict"), C("k.support").alias("kept_support"), C("k.refute").alias("kept_refute"))


#: A log of events as runs: states and transitions by their number within the run, some of them illegal or unproven.
LOG_SQL = """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS seq, event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || CAST(event_id AS VARCHAR(20)) END AS evidence, CASE WHEN event_id % 4 <> 0 THEN 'd' || CAST(event_id AS VARCHAR(20)) END AS digest FROM events"""


@query(f"""WITH l AS ({LOG_SQL}), f AS (SELECT run_id, count(*) AS n, max(CASE WHEN seq = 4 THEN CASE WHEN run_id % 2 = 1 THEN 'FAILED_CLOSED' WHEN evidence IS NOT NULL AND digest IS NOT NULL THEN 'PUBLISHED' ELSE 'BLOCKED' END END) AS last FROM l GROUP BY 1)
 SELECT run_id, CASE WHEN n < 5 THEN ['BRIEFED', 'RESOLVED', 'REASONED', 'GENERATED', 'AUDITED'][n + 1] WHEN last = 'BLOCKED' THEN 'AUDITED' ELSE last END AS state, CASE WHEN last = 'BLOCKED' THEN 4 WHEN n > 5 THEN 5 END AS broken_at FROM f""")
def replayed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Logs replayed: legality, the publish gate and the state that each run ends in."""
    log = inputs(spark, d, LOG_SQL)
    steps = F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(t).alias("transition"), F.lit(b).alias("to_state")) for a, t, b in trust.TRANSITIONS[:4]])
    even = C("run_id") % 2 == 0
    last = F.struct(F.lit("AUDITED").alias("from_state"), F.when(even, "PUBLISH").otherwise("FAIL_CLOSE").alias("transition"), F.when(even, "PUBLISHED").otherwise("FAILED_CLOSED").alias("to_state"))
    log = log.withColumn("z", F.when(C("seq") < 4, F.get(steps, C("seq"))).otherwise(last)).select("run_id", "seq", "z.*", "evidence", "digest")
    return states.replay(log, "run_id", "seq")


@query(f"WITH l AS ({LOG_SQL}) SELECT run_id, count(*) AS events, 0 AS broken FROM l GROUP BY 1")
def verified_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every event hashed with the hash before it, then all links and hashes verified again."""
    log = inputs(spark, d, LOG_SQL).select("run_id", "seq", "evidence", "digest")
    return states.verify(log, trust.hash_chain(log), "run_id", "seq").withColumn("broken", C("broken").cast("int"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS named, o_orderkey % 4 <> 1 AS provider, CAST(o_orderkey % 500 AS DOUBLE) AS poi FROM orders) SELECT id, CASE WHEN named THEN 'PASSED' WHEN NOT provider THEN 'WARNED' WHEN poi <= 200 THEN 'WARNED' ELSE 'BLOCKED' END AS status FROM o""")
def coverage_gates(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), (k % 3 != 0).alias("named"), (k % 4 != 1).alias("provider"), (k % 500).cast("double").alias("poi"))
    return o.select("id", gates.coverage_gate(C("named"), C("provider"), C("poi")).alias("status"))


@query(f"WITH {FENCES_SQL} SELECT id, [1, 1, CASE WHEN bal > 0 THEN 1 ELSE 0 END][1] + 1 + CASE WHEN bal > 0 THEN 1 ELSE 0 END AS steps, CASE WHEN width_m > 100 THEN 0 ELSE 1 END AS reports FROM fences")
def perception_steps(spark: SparkSession, d: str) -> DataFrame:
    """A generator, a refiner with a carrier that some rows lack, one without, and a verifier that reports and deletes nothing."""
    obs = views.fences(spark, d).select("id", "width_m", F.when(C("bal") > 0, C("bal")).alias("imagery"))
    steps = [pipelines.Step("generate_box", "generate", lambda o: o.select("*")), pipelines.Step("refine_edges", "refine", lambda o: o, "imagery"), pipelines.Step("refine_corners", "refine", lambda o: o),
             pipelines.Step("verify_width", "verify", lambda o: o.withColumn("reports", pipelines.report(C("width_m") > 100, "narrow")))]
    h = pipelines.perceive(obs, steps)
    return h.select("id", F.size("lineage").alias("steps"), F.size("reports").alias("reports"))


# ---- benchmark and gold

POOL_SQL = "SELECT c_custkey AS id, c_mktsegment AS morphology, (c_custkey * 48271) % 2147483647 AS ord, c_acctbal > 0 AS q1, c_custkey % 7 <> 0 AS q2, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 5 <> 0 END AS q3 FROM customer"


@query(f"""WITH p AS ({POOL_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY morphology ORDER BY ord) AS rn, dense_rank() OVER (ORDER BY morphology) AS place FROM p)
 SELECT id, morphology, rn > 5 AS reserve, CASE WHEN rn > 5 THEN 'RES-' || lpad(CAST((place - 1) * 2 + rn - 5 AS VARCHAR), 4, '0') ELSE 'CASE-' || lpad(CAST((place - 1) * 5 + rn AS VARCHAR), 4, '0') END AS case_id FROM k WHERE rn <= 7""")
def case_selection(spark: SparkSession, d: str) -> DataFrame:
    return reports.select_cases(inputs(spark, d, POOL_SQL), "morphology", C("ord")).select("id", "morphology", "reserve", "case_id")


@query(f"WITH p AS ({POOL_SQL}) SELECT id, q1 AND q2 AND coalesce(q3, false) AS approved, CASE WHEN NOT q1 THEN 'q1' WHEN NOT q2 THEN 'q2' WHEN NOT coalesce(q3, false) THEN 'q3' END AS failed FROM p")
def blind_reviews(spark: SparkSession, d: str) -> DataFrame:
    return reports.blind_review(inputs(spark, d, POOL_SQL), ["q1", "q2", "q3"]).select("id", "approved", "failed")


PROPOSALS_SQL = "SELECT l_orderkey AS case_id, CASE l_linenumber WHEN 1 THEN 'AREA_PRIOR' WHEN 2 THEN 'EXISTING' WHEN 3 THEN 'ROAD_BLOCK' WHEN 4 THEN 'CLUSTER_OSM' WHEN 5 THEN 'CLUSTER_OVERTURE' WHEN 6 THEN 'CLUSTER_MICROSOFT' ELSE 'CLUSTER_MULTI' END AS provider, l_orderkey * 10 + l_linenumber AS hypothesis_id, CAST(l_quantity AS DOUBLE) / 50 AS score FROM lineitem"
_USES = """u(experiment_id, provider) AS (VALUES ('B0', 'AREA_PRIOR'), ('B1', 'EXISTING'), ('B2', 'ROAD_BLOCK'), ('B3-OSM', 'CLUSTER_OSM'), ('B3-OVERTURE', 'CLUSTER_OVERTURE'), ('B3-MICROSOFT', 'CLUSTER_MICROSOFT'), ('B4-OSM', 'CLUSTER_OSM'), ('B4-OSM', 'ROAD_BLOCK'), ('B4-OVERTURE', 'CLUSTER_OVERTURE'), ('B4-OVERTURE', 'ROAD_BLOCK'),
 ('B4-MICROSOFT', 'CLUSTER_MICROSOFT'), ('B4-MICROSOFT', 'ROAD_BLOCK'), ('B5', 'CLUSTER_MULTI'), ('B6', 'CLUSTER_MULTI'), ('B6', 'ROAD_BLOCK'), ('B6', 'EXISTING'), ('B7', 'CLUSTER_MULTI'), ('B7', 'ROAD_BLOCK'), ('B7', 'EXISTING'))"""


@query(f"WITH p AS ({PROPOSALS_SQL}), {_USES}, g AS (SELECT case_id, experiment_id, count(*) AS candidates, arg_max(hypothesis_id, score * 1000000000 + hypothesis_id) AS top_id FROM p JOIN u USING (provider) GROUP BY ALL), e AS (SELECT DISTINCT experiment_id FROM u), c AS (SELECT DISTINCT case_id FROM p) SELECT experiment_id, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates, count(*) AS cases, sum(coalesce(top_id, 0)) AS tops FROM c CROSS JOIN e LEFT JOIN g USING (case_id, experiment_id) GROUP BY ALL")
def benchmark_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = inputs(spark, d, PROPOSALS_SQL)
    m = reports.run_matrix(p.select("case_id").distinct(), p)
    return m.groupBy("experiment_id", C("candidates").cast("bigint").alias("candidates")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.coalesce("top_id", F.lit(0))).alias("tops"))


REVIEWS_SQL = "SELECT l_orderkey AS case_id, 'R' || CAST(l_linenumber AS VARCHAR(4)) AS reviewer, l_linenumber % 5 <> 0 AS entity_sufficient, l_returnflag <> 'R' AS boundary_sufficient, l_quantity < 3 AS conflict FROM lineitem"
_GOLD = f"""w AS ({REVIEWS_SQL}), g AS (SELECT case_id, bool_and(entity_sufficient) AS e, bool_and(boundary_sufficient) AS b, count(*) FILTER (WHERE boundary_sufficient) AS boundaries, count(*) FILTER (WHERE conflict) AS conflicts,
 substr(sha256(string_agg(reviewer || '|' || CAST(entity_sufficient AS VARCHAR) || '|' || CAST(boundary_sufficient AS VARCHAR) || '|' || CAST(conflict AS VARCHAR), ';' ORDER BY reviewer || '|' || CAST(entity_sufficient AS VARCHAR) || '|' || CAST(boundary_sufficient AS VARCHAR) || '|' || CAST(conflict AS VARCHAR))), 1, 16) AS content_hash FROM w GROUP BY 1),
 s AS (SELECT case_id, CASE WHEN e AND b AND conflicts = 0 THEN 'GOLD_RESOLVED' WHEN e THEN 'GOLD_PARTIAL' ELSE 'GOLD_UNRESOLVED' END AS gold_state, boundaries, conflicts, content_hash FROM g)"""


@query(f"WITH {_GOLD} SELECT * FROM s")
def gold_cases(spark: SparkSession, d: str) -> DataFrame:
    return reports.freeze_gold(inputs(spark, d, REVIEWS_SQL))


@query(f"WITH {_GOLD}, o AS (SELECT s.*, o_orderpriority AS density FROM s JOIN orders ON o_orderkey = case_id) SELECT density, count(*) AS cases, count(*) FILTER (WHERE gold_state = 'GOLD_RESOLVED') AS resolved, count(*) FILTER (WHERE gold_state = 'GOLD_PARTIAL') AS partial, count(*) FILTER (WHERE gold_state = 'GOLD_UNRESOLVED') AS unresolved, round(avg(CAST(gold_state = 'GOLD_RESOLVED' AS INT)), 6) AS resolved_share FROM o GROUP BY 1")
def ceiling_report(spark: SparkSession, d: str) -> DataFrame:
    g = reports.freeze_gold(inputs(spark, d, REVIEWS_SQL)).join(table(spark, d, "orders").select(C("o_orderkey").alias("case_id"), C("o_orderpriority").alias("density")), "case_id")
    return reports.ceiling_report(g, "density")


@query(f"WITH {RUNS_SQL}, p AS (SELECT case_id, max(top1_iou) FILTER (WHERE experiment_id = 'B6') AS b6, max(top1_iou) FILTER (WHERE experiment_id = 'B7') AS b7 FROM runs GROUP BY 1) SELECT {q('avg(b6 - b7)', 6, 'mean_delta')}, CASE WHEN avg(b6 - b7) <= -0.05 THEN 'ADOPT' WHEN avg(b6 - b7) > 0.01 THEN 'REJECT' ELSE 'KEEP' END AS verdict FROM p WHERE b6 IS NOT NULL AND b7 IS NOT NULL")
def experiment_decision(spark: SparkSession, d: str) -> DataFrame:
    """Regret of B7 against B6 by case, and the verdict on it."""
    x = views.runs(spark, d).groupBy("case_id").agg(F.max(F.when(C("experiment_id") == "B6", C("top1_iou"))).alias("b6"), F.max(F.when(C("experiment_id") == "B7", C("top1_iou"))).alias("b7")).where("b6 IS NOT NULL AND b7 IS NOT NULL")
    v = evaluation.decision_rule(x.select((C("b6") - C("b7")).alias("delta")))
    return v.select(r(C("mean_delta"), 6, "mean_delta"), "verdict")


@query("WITH l AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT o_orderkey AS k, CAST(o_custkey % 100 AS DOUBLE) / 100 AS score FROM orders WHERE o_orderkey % 4 <> 1) SELECT count(*) AS n, " + q("avg(score)", 6, "score") + ", (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM a)) AS missing FROM a SEMI JOIN l USING (k)")
def locked_answers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(C("o_orderkey").alias("k"), ((C("o_custkey") % 100).cast("double") / 100).alias("score"))
    mean, missing = reports.locked_subset(o.where("k % 4 <> 1"), o.where("k % 3 = 0"), "k")
    m = missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("_", F.lit(1))
    return mean.withColumn("_", F.lit(1)).join(m, "_").select("n", r(C("score"), 6, "score"), "missing")


@query("SELECT l_orderkey AS id, " + q("sum(CAST(l_discount AS DOUBLE) * CAST(l_quantity AS DOUBLE)) / sum(CAST(l_quantity AS DOUBLE))", 6, "confidence") + " FROM lineitem GROUP BY 1")
def length_weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(C("l_orderkey").alias("id"), C("l_discount").cast("double").alias("c"), C("l_quantity").cast("double").alias("len"))
    return evaluation.weighted_mean(s, "id", "c", "len").select("id", r(C("mean"), 6, "confidence"))


_PRED = "SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 1000 AS bge, (o_orderkey * 48271) % 2147483647 AS ord FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey * 37) % 1001 < 500"


@query(f"""WITH p AS ({_PRED}), b AS (SELECT *, least(9, CAST(floor(bge * 10) AS INT)) AS bin FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ord, id) AS rn FROM b), t AS (SELECT *, rn <= 12 AS own FROM k), x AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY ord, id) AS up, count(*) FILTER (WHERE own) OVER () AS taken FROM t)
 SELECT id, bin FROM x WHERE own OR up <= 120 - taken""")
def binned_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 120 over ten score bins, topped up from what is left where bins are short; the sample is the feature."""
    return evaluation.binned_sample(inputs(spark, d, _PRED), "bge", ["ord", "id"], 120).select("id", "bin")


# ---- city

LAYERS_SQL = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'poi' WHEN 1 THEN 'transport' ELSE 'landuse' END AS layer, CASE p_partkey % 12 WHEN 0 THEN 'school' WHEN 1 THEN 'bus_station' WHEN 2 THEN 'residential' WHEN 3 THEN 'park' WHEN 4 THEN 'bench' WHEN 5 THEN 'bus_stop' WHEN 6 THEN 'quarry' WHEN 7 THEN 'mystery' WHEN 8 THEN 'hospital' WHEN 9 THEN 'airport' WHEN 10 THEN 'farmland' ELSE 'retail' END AS fclass, CAST(116 AS DOUBLE) + CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 1000 AS lng, CAST(39 AS DOUBLE) + CAST((p_partkey * 104729) % 1000 AS DOUBLE) / 1000 AS lat FROM part"


@query(f"""WITH l AS ({LAYERS_SQL}), c AS (SELECT id, layer, CASE layer WHEN 'landuse' THEN CASE fclass WHEN 'residential' THEN 'R' WHEN 'park' THEN 'G' WHEN 'quarry' THEN 'M' WHEN 'farmland' THEN 'AGR' WHEN 'retail' THEN 'B1' ELSE 'U' END WHEN 'poi' THEN CASE fclass WHEN 'school' THEN 'A3' WHEN 'hospital' THEN 'A5' END ELSE CASE WHEN fclass IN ('bus_station', 'railway_station', 'airport') THEN 'S' END END AS code FROM l WHERE lat BETWEEN 39.2 AND 39.8 AND lng BETWEEN 116.1 AND 116.9)
 SELECT code, CASE layer WHEN 'poi' THEN 'poi_area' ELSE layer END AS src_layer, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL""")
def city_classification(spark: SparkSession, d: str) -> DataFrame:
    """Land use, mapped points of interest and kept transport of a city, cut by a box, in one table."""
    layers = inputs(spark, d, LAYERS_SQL)
    faces = reports.city_faces(layers, landuse.landuse_code(C("fclass"), F.lit(None).cast("string"), "city"), landuse.poi_code(C("fclass")), ("bus_station", "railway_station", "airport"), (39.2, 116.1, 39.8, 116.9))
    return faces.groupBy("code", "src_layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS ({LAYERS_SQL}) SELECT id, CASE WHEN fclass = 'mystery' AND id % 5 = 0 THEN 'GOV_DEFINED' ELSE 'TRUSTED_TAG' END AS status, CASE WHEN fclass = 'mystery' AND id % 5 = 0 THEN 'M' ELSE CASE fclass WHEN 'residential' THEN 'R' WHEN 'park' THEN 'G' WHEN 'retail' THEN 'B1' ELSE 'U' END END AS code FROM l WHERE layer = 'landuse'""")
def label_hygiene(spark: SparkSession, d: str) -> DataFrame:
    x = inputs(spark, d, LAYERS_SQL).where("layer = 'landuse'")
    none = F.lit(None).cast("string")
    gov = F.when((C("fclass") == "mystery") & (C("id") % 5 == 0), "M")
    return x.select("id", landuse.hygiene(C("layer"), C("fclass"), none, gov, none, none).alias("h")).select("id", C("h.status").alias("status"), C("h.code").alias("code"))


SUMMARY = ("name_raw", "address_raw", "city_raw")


@query("""WITH s AS (SELECT * FROM source_records) SELECT count(*) AS total, round(avg(CAST(name_raw IS NULL OR name_raw = '' AS INT)), 6) AS name_null_rate, round(avg(CAST(address_raw IS NULL OR address_raw = '' AS INT)), 6) AS address_null_rate, round(avg(CAST(point_raw_lng IS NULL OR isnan(point_raw_lng) OR point_raw_lat IS NULL OR isnan(point_raw_lat) AS INT)), 6) AS point_null_rate,
 count(*) FILTER (WHERE point_raw_lng = 0 OR point_raw_lat = 0) AS zero_points, round(avg(CAST(geometry_raw_wkt IS NULL OR geometry_raw_wkt = '' AS INT)), 6) AS geometry_null_rate, round(avg(CAST(city_raw IS NULL OR city_raw = '' OR district_raw IS NULL OR district_raw = '' AS INT)), 6) AS admin_null_rate,
 (SELECT count(*) FROM (SELECT 1 FROM source_records GROUP BY city_raw, name_raw HAVING count(*) > 1)) AS name_groups, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM source_records GROUP BY city_raw, name_raw HAVING count(*) > 1)) AS name_records,
 (SELECT count(*) FROM (SELECT 1 FROM source_records WHERE NOT isnan(point_raw_lng) AND NOT isnan(point_raw_lat) GROUP BY round(point_raw_lng, 6) + 0.0, round(point_raw_lat, 6) + 0.0 HAVING count(*) > 1)) AS point_groups, (SELECT count(*) FROM (SELECT 1 FROM source_records WHERE geometry_raw_wkt <> '' GROUP BY geometry_raw_wkt HAVING count(*) > 1)) AS wkt_groups FROM s""")
def full_health_profile(spark: SparkSession, d: str) -> DataFrame:
    return reports.health(table(spark, d, "source_records"))
