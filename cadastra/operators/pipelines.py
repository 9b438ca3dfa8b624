"""Pipelines made of DataFrame functions: batch governance of records, generation runs, perception steps, onboarding checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs, kernel, rings, text
from ..functions.columns import let, usable_point
from ..runtime import Cut, small
from . import hypotheses, quality


# ---- record governance

def assessed_records(records: DataFrame) -> DataFrame:
    """Records with their type, coordinate assessment (coord), shape measures (g) and quality (qa) of the polygon.

    The polygon's centroid is that of its outer ring; the transformed one moves with it. Records without a readable
    polygon have null measures and the decision REJECT; a polygon's exact validity is computed in Arrow batches.
    """
    m = rings.measures(rings.ring_of(F.col("geometry_raw_wkt")))
    whole = lambda m: F.struct(m.alias("m"), crs.gcj02_to_wgs84(m["cx"], m["cy"]).alias("w"), rings.metric(m).alias("shape"))
    mean = lambda g: 2 * g["area_m2"] / F.when(g["perimeter_m"] > 0, g["perimeter_m"])
    tested = kernel.wkt_tested(F.col("geometry_raw_wkt"), mean(F.col("g.shape")), (quality.STRIP_W, quality.STRIP_L), quality.JAGGED)
    r = records.withColumn("g", let(m, whole)).withColumn("_p", tested).withColumn("valid", F.coalesce("_p.valid", F.lit(False)))
    coord = let(F.col("g"), lambda g: crs.assess(F.col("point_raw_lng"), F.col("point_raw_lat"), g["m"]["cx"], g["m"]["cy"], g["w"]["lng"], g["w"]["lat"]))

    def judged(g: Column) -> Column:
        mean = 2 * g["area_m2"] / g["perimeter_m"]
        issues = quality.shape_issues(g["area_m2"], F.col("_p.length_m"), F.col("_p.width_m"), mean, F.col("_p.aspect"), g["compactness"], F.coalesce(F.col("_p.valid"), F.lit(False)))
        return let(issues, lambda i: F.struct(i.alias("issues"), quality.shape_score(i).alias("score")))

    none = F.struct(F.array(F.lit("UNPARSEABLE_WKT")).alias("issues"), F.lit(None).cast("double").alias("score"))
    r = r.withColumns({"coord": coord, "qa": F.when(F.col("g.m").isNotNull(), let(F.col("g.shape"), judged)).otherwise(none), "entity_type": text.entity_type(F.col("name_raw"))})
    return r.withColumn("decision", F.when(F.col("qa.score").isNull(), "REJECT").otherwise(quality.decision(F.col("qa.score")))).drop("_p")


# ---- perception

@dataclass(frozen=True)
class Step:
    """One operator: kind generate, refine or verify; carrier is the column it needs; run maps a DataFrame to one."""

    name: str
    kind: str
    run: Callable[[DataFrame], DataFrame]
    carrier: str | None = None


def perceive(observations: DataFrame, steps: list[Step]) -> DataFrame:
    """Hypotheses of all generators, refined in order, then verified. `lineage` grows by each step; a refiner without
    its carrier is skipped for the row; verifiers append to `reports` and delete nothing. A generator without its
    carrier column, or an unknown kind, raises before anything runs."""
    out: DataFrame | None = None
    for s in steps:
        if s.kind == "generate":
            if s.carrier and s.carrier not in observations.columns:
                raise ValueError(f"{s.name} needs {s.carrier}")
            g = s.run(observations).withColumn("lineage", F.array(F.lit(s.name)))
            out = g if out is None else out.unionByName(g, allowMissingColumns=True)
        elif s.kind not in ("refine", "verify"):
            raise ValueError(f"unknown kind {s.kind}")
    if out is None:
        raise ValueError("no generator")
    out = out.withColumn("reports", F.array().cast("array<string>"))
    for s in steps:
        if s.kind == "refine":
            has = F.col(s.carrier).isNotNull() if s.carrier else F.lit(True)
            done = s.run(out.where(has)).withColumn("lineage", F.array_append("lineage", F.lit(s.name)))
            out = done.unionByName(out.where(~has)) if s.carrier else done
        elif s.kind == "verify":
            out = s.run(out)
    return out


def report(test: Column, word: str) -> Column:
    """The reports of a row with `word` appended where `test` fails."""
    return F.when(F.coalesce(test, F.lit(False)), F.col("reports")).otherwise(F.array_append("reports", F.lit(word)))


# ---- providers of boundary hypotheses

def provider_hypotheses(seeds: DataFrame, polygons: DataFrame, buildings: DataFrame, cell: float = 0.005) -> DataFrame:
    """(seed_id, provider, area_m2, seed_m, count) proposals for seeds (seed_id, x, y, prior_m2): existing polygons
    (poly_id, x, y, area_m2) of another id than the seed's whose centre is within 500 m, clusters of three or more buildings (b_id, x, y, area_m2)
    in the seed's neighbourhood, and the prior circle. Providers without a proposal give no row."""
    at = lambda c: F.floor(F.col(c) / cell)
    wide = F.ceil(F.lit(500 / hypotheses.FLAT / cell) / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("y") + 0.01)))).cast("int")
    high = math.ceil(500 / hypotheses.FLAT / cell)
    places = seeds.select("x", "y").distinct()
    near = places.select("x", "y", F.explode(F.sequence(at("x") - wide, at("x") + wide)).alias("cx")).select("*", F.explode(F.sequence(at("y") - high, at("y") + high)).alias("cy"))

    def meet(d: DataFrame) -> DataFrame:
        """Places meet places, then the rows at both: what lies at one place is searched and measured once."""
        own = [c for c in d.columns if c == "poly_id"]
        d = d.select(*own, F.col("x").alias("px"), F.col("y").alias("py"), "area_m2")
        m = near.join(d.select("px", "py", at("px").alias("cx"), at("py").alias("cy")).distinct(), ["cx", "cy"])
        m = m.withColumn("seed_m", F.hypot((F.col("x") - F.col("px")) * F.cos(F.radians("y")), F.col("y") - F.col("py")) * hypotheses.FLAT).where("seed_m <= 500")
        m = seeds.select("seed_id", "x", "y").join(small(Cut(m.select("x", "y", "px", "py", "seed_m"), "places")), ["x", "y"]).join(d, ["px", "py"])
        return m.where("seed_id <> poly_id") if own else m

    b0 = meet(polygons).select("seed_id", F.lit("EXISTING").alias("provider"), "area_m2", "seed_m", F.lit(1).cast("bigint").alias("count"))
    b2 = meet(buildings).groupBy("seed_id").agg(F.sum("area_m2").alias("area_m2"), F.min("seed_m").alias("seed_m"), F.count(F.lit(1)).alias("count")).where("count >= 3").select("seed_id", F.lit("CLUSTER").alias("provider"), "area_m2", "seed_m", "count")
    b3 = seeds.where("prior_m2 IS NOT NULL").select("seed_id", F.lit("AREA_PRIOR").alias("provider"), F.col("prior_m2").alias("area_m2"), F.lit(0.0).alias("seed_m"), F.lit(0).cast("bigint").alias("count"))
    return b0.unionByName(b2).unionByName(b3)


def knn_prior(left: DataFrame, known: DataFrame, cell: float, k: int = 5) -> DataFrame:
    """(seed_id, prior_m2): the median area of the k nearest known places of a seed, itself left out; of all where there
    are fewer. Ties go to the smaller id."""
    near = hypotheses.k_nearest(left, known.select(F.col("seed_id").alias("other"), "x", "y", "area_m2"), "seed_id", cell, k, apart=True)
    return near.groupBy("seed_id").agg(F.percentile("area_m2", F.lit(0.5)).alias("prior_m2"))


# ---- generate and govern

def generation_runs(briefs: DataFrame) -> DataFrame:
    """One row per brief (name, lng, lat, prior_m2, valid): resolved scale, constraints, best of three proposals, audit
    and final state. Runs are named by the hash of their brief, clocks take no part; only PUBLISHED ones may enter a state."""
    b = briefs.withColumn("run_id", F.concat(F.lit("RUN_"), F.substring(F.sha2(F.concat_ws("|", "name", F.col("lng").cast("string"), F.col("lat").cast("string"), F.col("prior_m2").cast("string")), 256), 1, 12)))
    b = b.withColumn("scale", text.scale_level(F.col("name"), F.col("prior_m2"))).withColumn("c", hypotheses.constraints(F.col("scale"), F.col("prior_m2")))
    shape = {"ROAD_ENCLOSED_BLOCK": (1.15 * 0.90, 0.77), "BUILDING_CONCAVE_HULL": (0.8, 0.70), "AREA_CALIBRATED_BUFFER": (1.0, 0.785)}
    props = F.array(*[F.struct(hypotheses.fusion_score(F.lit(True), F.col("c.target") * k, F.col("c.target"), F.lit(q), F.lit(m)).alias("score"), F.lit(m).alias("method"), (F.col("c.target") * k).alias("area_m2")) for m, (k, q) in shape.items()])
    b = b.withColumn("best", F.array_max(props))
    point = usable_point(F.col("lng"), F.col("lat"))
    fits = F.col("best.area_m2").between(F.col("c.least"), F.col("c.most")) & F.col("valid") & point
    return b.select("run_id", "name", "scale", F.col("best.method").alias("method"), F.col("best.area_m2").alias("area_m2"), F.col("best.score").alias("score"), F.when(F.coalesce(fits, F.lit(False)), "PUBLISHED").otherwise("FAILED_CLOSED").alias("state"))


# ---- onboarding

def expectations(df: DataFrame, tests: dict[str, tuple[Column, float]]) -> DataFrame:
    """(check, value, status) of shares of rows that must hold: PASS at or above the bound, WARN within a tenth, else FAIL."""
    agg = df.agg(*[F.avg(F.coalesce(t, F.lit(False)).cast("int")).alias(k) for k, (t, _) in tests.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k), F.lit(0.0)).alias("value"), F.lit(float(b)).alias("bound")) for k, (_, b) in tests.items()])
    x = agg.select(F.explode(rows).alias("r")).select("r.*")
    return x.select("check", F.round("value", 6).alias("value"), F.when(F.col("value") >= F.col("bound"), "PASS").when(F.col("value") >= F.col("bound") - 0.1, "WARN").otherwise("FAIL").alias("status"))


def roster_match(roster: DataFrame, polygons: DataFrame, cell: float = 0.03, own_only: bool = False) -> DataFrame:
    """(roster_id, poly_id, final): the best polygon of each roster entry by name score x (1 - min(km / 3, .5)), scores of
    .55 and distances of 3 km bound the candidates; ties by the smallest polygon. An entry looks into all cells that 3 km reach
    at its latitude. `own_only` keeps polygons whose name is, holds or is held by the entry's."""
    at = lambda c: F.floor(F.col(c) / cell)
    wide = F.ceil(F.lit(3 / 111.32 / cell) / F.greatest(F.lit(0.05), F.cos(F.radians(F.abs("y") + 0.03)))).cast("int")
    high = math.ceil(3 / 111.32 / cell)
    a = roster.select("roster_id", "name", "x", "y", F.explode(F.sequence(at("x") - wide, at("x") + wide)).alias("cx")).select("*", F.explode(F.sequence(at("y") - high, at("y") + high)).alias("cy"))
    b = polygons.select("poly_id", F.col("name").alias("pname"), F.col("x").alias("px"), F.col("y").alias("py"), at("x").alias("cx"), at("y").alias("cy"))
    km = F.hypot((F.col("x") - F.col("px")) * F.cos(F.radians("y")), F.col("y") - F.col("py")) * 111.32
    other = F.lit(0.0) if own_only else text.bigram_dice(F.col("name"), F.col("pname"))
    score = F.when(F.col("name") == F.col("pname"), 1.0).when(F.contains(F.col("pname"), F.col("name")) | F.contains(F.col("name"), F.col("pname")), 0.9).otherwise(other)
    j = a.join(b, ["cx", "cy"]).withColumns({"km": km, "s": score}).where("s >= 0.55 AND km <= 3")
    j = j.withColumn("final", F.col("s") * (1 - F.least(F.col("km") / 3, F.lit(0.5))))
    return j.groupBy("roster_id").agg(F.min_by(F.struct("poly_id", "final"), F.struct(-F.col("final"), F.col("poly_id"))).alias("z")).select("roster_id", "z.poly_id", "z.final")


def snap_to_roads(vertices: DataFrame, roads: DataFrame, reach: float) -> DataFrame:
    """(poly_id, idx, x, y): vertices moved to the nearest road point within `reach` (degrees), others as they are."""
    v = vertices.withColumn("vid", F.concat_ws("/", F.col("poly_id").cast("string"), F.col("idx").cast("string")))
    near = hypotheses.nearest(v.select("vid", "x", "y"), roads.select(F.col("road_pt").alias("other"), "x", "y"), "vid", reach)
    to = near.where(F.col("dist") <= reach).join(roads.select(F.col("road_pt").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry")), "other")
    return v.join(to.select("vid", "rx", "ry"), "vid", "left").select("poly_id", "idx", F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))


def boundary_segments(polygons: DataFrame, key: str, ring: str, corner: float = -0.707) -> DataFrame:
    """(key, segment, first, last, length) of the pieces of each ring (array of points) between its corners, by windows
    over its vertices."""
    v = polygons.select(key, F.posexplode(F.slice(F.col(ring), 1, F.size(ring) - 1)).alias("i", "p"), F.size(ring).alias("n")).select(key, "i", F.col("n") - 1, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    w = Window.partitionBy(key).orderBy("i")
    whole = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    v = v.withColumns({"ax": before("x") - F.col("x"), "ay": before("y") - F.col("y"), "bx": after("x") - F.col("x"), "by": after("y") - F.col("y")})
    cos = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / F.greatest(F.hypot("ax", "ay") * F.hypot("bx", "by"), F.lit(1e-300))
    v = v.withColumn("cut", ((F.col("i") == 0) | (cos > corner)).cast("int")).withColumn("segment", F.sum("cut").over(w))
    return v.groupBy(key, "segment").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"), F.sum(F.hypot("bx", "by")).alias("length"))
