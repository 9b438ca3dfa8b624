"""Boundary hypotheses: constraints, generators, ranking, fusion scores, membership, topology and roads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Cut, small

#: Scale priors as (target, least, most m2, radius m, zoom); method priors; membership weights and levels.
SCALES = {"COURTYARD": (3500.0, 500.0, 12000.0, 150.0, 18), "COMMUNITY": (25000.0, 5000.0, 120000.0, 350.0, 17), "ESTATE": (120000.0, 40000.0, 500000.0, 700.0, 16)}
METHODS = {"ROAD_ENCLOSED_BLOCK": 0.90, "BUILDING_CONCAVE_HULL": 0.85, "AREA_CALIBRATED_BUFFER": 0.75}
WEIGHTS = {"containment": 0.40, "road": 0.25, "cluster": 0.20, "naming": 0.15}
LEVELS_V1, LEVELS_V2 = (0.80, 0.50, 0.20), (0.75, 0.50, 0.25)
SEPARATING = tuple(f"{r}{s}" for r in ("primary", "secondary", "tertiary", "trunk", "motorway") for s in ("", "_link"))
FLAT = 111_000.0


def constraints(scale: Column, prior: Column) -> Column:
    """struct(target, least, most, radius, zoom) of a boundary: from a known area above 100 m2, else from the scale."""
    def of(t, lo, hi, r, z) -> Column:
        return F.struct(t.cast("double").alias("target"), lo.cast("double").alias("least"), hi.cast("double").alias("most"), r.cast("double").alias("radius"), z.cast("int").alias("zoom"))

    out = of(*[F.lit(v) for v in SCALES["COMMUNITY"]])
    for k, v in SCALES.items():
        out = F.when(scale == k, of(*[F.lit(x) for x in v])).otherwise(out)
    zoom = F.when(prior < 12_000, 18).when(prior < 120_000, 17).otherwise(16)
    return F.when(prior > 100, of(prior, F.greatest(F.lit(500.0), 0.4 * prior), 2.5 * prior, 1.6 * F.sqrt(prior / math.pi), zoom)).otherwise(out)


def rank_score(area: Column, seed_m: Column, named: Column, buildings: Column, semantic: Column, strong_roads: Column) -> Column:
    """Geometric (and semantic) score of a hypothesis; missing features add nothing."""
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    s = F.lit(0.3) + F.when(area.between(5000, 200_000), 0.25).when(area.between(1000, 1_000_000), 0.10).otherwise(0.0) + F.when(seed_m < 50, 0.15).when(seed_m < 150, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), s + add(named, 0.05) + add(buildings.between(3, 100), 0.10) + add(semantic, 0.10) + add(strong_roads, 0.03))


def fusion_score(holds_seed: Column, area: Column, target: Column, compactness: Column, method: Column) -> Column:
    """.30 containment + .35 area alignment + .20 shape + .15 method prior."""
    ratio = F.greatest(area / F.greatest(target, F.lit(1.0)), F.lit(0.01))
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), method), F.lit(0.70))
    return 0.30 * F.when(holds_seed, 1.0).otherwise(0.4) + 0.35 * F.exp(-0.8 * F.abs(F.log(ratio))) + 0.20 * F.least(F.lit(1.0), compactness) + 0.15 * prior


def circle(x: Column, y: Column, area: Column, per_degree: float = FLAT, points: int = 64) -> Column:
    """Closed ring of a circle of an area in m2 around a point."""
    r = F.sqrt(area / math.pi) / per_degree
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct((x + r * F.cos(2 * math.pi * (i % points) / points)).alias("x"), (y + r * F.sin(2 * math.pi * (i % points) / points)).alias("y")))


def box_ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Closed ring of a rectangle around a point, sizes in degrees."""
    corner = lambda a, b: F.struct((x + a * w / 2).alias("x"), (y + b * h / 2).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def skewed_quad(x: Column, y: Column, area: Column, per_degree: float = FLAT) -> Column:
    """Ring of a road block: sides 1.15 and 0.90 of the square's, sheared by a tenth."""
    side = F.sqrt(area) / per_degree
    p = lambda a, b: F.struct((x + side * (1.15 * a / 2 + 0.1 * b / 2)).alias("x"), (y + side * 0.90 * b / 2).alias("y"))
    return F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))


def membership_v1(evidence: Column) -> Column:
    """struct(confidence, level) of array<struct<method, supports, confidence>>: the weighted mean, refuting items count against."""
    w = lambda e: F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), e["method"])
    add = lambda f: F.aggregate(evidence, F.lit(0.0), lambda s, e: s + f(e))
    total = add(w)
    c = F.when(total > 0, add(lambda e: w(e) * F.when(e["supports"], e["confidence"]).otherwise(1 - e["confidence"])) / total).otherwise(0.0)
    return F.struct(c.alias("confidence"), level(c, LEVELS_V1).alias("level"))


def membership_v2(support: Column, refute: Column, function: Column, mixed_use: Column) -> Column:
    """struct(net, level): net support; buildings of another function are out, unless the compound is mixed."""
    net = F.greatest(F.lit(0.0), support - refute)
    other = ~function.isin("RESIDENTIAL", "UNKNOWN") & ~mixed_use
    return F.struct(net.alias("net"), F.when(other, "EXCLUDED").otherwise(level(net, LEVELS_V2)).alias("level"))


def level(c: Column, bounds: tuple[float, float, float]) -> Column:
    return F.when(c >= bounds[0], "DEFINITE").when(c >= bounds[1], "PROBABLE").when(c >= bounds[2], "POSSIBLE").otherwise("UNLIKELY")


def campus_member(name_match: Column, inside: Column, metres: Column) -> Column:
    """Three tiers: by name, by containment, by distance (150 m)."""
    return F.when(name_match, "NAME").when(inside, "CONTAINED").when(metres <= 150, "NEAR").otherwise("OUTSIDE")


def topology(overlap_m2: Column, gap_m: Column, shared_m: Column, separator: Column) -> Column:
    """The relation of two boundaries: overlap above 100 m2, gap below 50 m (explained by a through public road or
    not), shared boundary above 5 m, else unknown."""
    gap = (gap_m > 0) & (gap_m < 50)
    return F.when(overlap_m2 > 100, "OVERLAP_CONFLICT").when(gap & F.coalesce(separator, F.lit(False)), "SEPARATED_BY").when(gap, "GAP_CONFLICT").when((gap_m == 0) & (shared_m > 5), "SHARED_BOUNDARY").otherwise("UNKNOWN")


def road_role(kind: Column, service: Column) -> Column:
    return F.when(kind.isin(*SEPARATING), "PUBLIC_SEPARATOR").when((kind == "service") & service.isin("driveway", "parking_aisle", "alley"), "INTERNAL").when(kind == "service", "ACCESS").when(kind.isin("residential", "living_street", "unclassified"), "LOCAL").otherwise("UNKNOWN")


def road_support(both_sides: Column, named_sides: Column, role: Column) -> Column:
    """Whether a road speaks for splitting: a separator with buildings on both sides of different names."""
    return F.when((role == "PUBLIC_SEPARATOR") & both_sides & named_sides, "SUPPORTS_SPLIT").when(role == "INTERNAL", "REFUTES_SPLIT").otherwise("NEUTRAL")


def crs_label(n: Column, med_raw: Column, med_shifted: Column) -> Column:
    """Which of two hypotheses the distances to roads support: as delivered, or shifted to WGS-84."""
    return F.when(n == 0, "ORPHAN_NO_ROADS").when((med_raw > 200) & (med_shifted > 200), "ORPHAN_FAR").when(med_raw <= 0.6 * med_shifted, "ROAD_ALIGNED").when(med_shifted <= 0.6 * med_raw, "POLYGON_CRS_WGS84").when(med_shifted <= 0.8 * med_raw, "POLYGON_CRS_WGS84_PROBABLE").otherwise("NONE")


def placebo_p(rows: DataFrame, key: str, angle: str, value: str) -> DataFrame:
    """(key, raw, better, p): the share of rotated medians below the unrotated one, add-one smoothed."""
    med = rows.groupBy(key, angle).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    raw = med.where(F.col(angle) == 0).select(key, F.col("m").alias("raw"))
    rot = med.where(F.col(angle) != 0).join(raw, key).groupBy(key).agg(F.first("raw").alias("raw"), F.count_if(F.col("m") < F.col("raw")).alias("better"), F.count(F.lit(1)).alias("n"))
    return rot.select(key, "raw", "better", (F.col("better") / (F.col("n") + 1)).alias("p"))


def k_nearest(left: DataFrame, right: DataFrame, key: str, cell: float, k: int = 1, apart: bool = False) -> DataFrame:
    """(key, columns of right but x and y, dist): the k nearest `right` points (other, x, y, ...) of each `left` one (key, x, y), ties by
    the smallest other, all of them where there are fewer; `apart` leaves out the point of the same id. Points without numbers take no part.

    Rows at one place have the same neighbours, so places are searched, and of the rows at one place only those with the smallest
    ids can be among the nearest. Places look into the cells around them, of a side that fits their density (`cell` at most); those for
    which that is not sure to hold enough (fewer found, or the last farther than the window) look again on a grid twice as
    coarse, until the window spans all points.
    """
    some = lambda d: d.where(~(F.isnan("x") | F.isnan("y")))
    l, r = some(left.select(key, "x", "y")), some(right)  # noqa: E741
    rest = [c for c in r.columns if c not in ("x", "y", "other")]
    most = k + ((r.groupBy("other").count().agg(F.max("count")).first()[0] or 0) if apart else 0)
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("x", "y").orderBy("other"))).where(F.col("rn") <= most)
    r = Cut(r.select("other", *rest, F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("rn") == 1).cast("int").alias("first")), "places").df
    box = r.agg(*[f(c) for c in ("x2", "y2") for f in (F.min, F.max)], F.sum("first")).join(l.agg(*[f(c).alias(f"l{i}{c}") for c in "xy" for i, f in enumerate((F.min, F.max))]), how="cross").first()  # one row
    if box is None or box[0] is None or box[5] is None:
        return l.join(r.select("other", *rest).limit(0), how="cross").select(key, "other", *rest, F.lit(0.0).alias("dist")).limit(0)
    span = max(box[1], box[6]) - min(box[0], box[5]), max(box[3], box[8]) - min(box[2], box[7])
    fit = max(math.sqrt(span[0] * span[1] * most / box[4]), max(span) * most / box[4])
    found: DataFrame | None = None
    todo, size = l.select("x", "y").distinct(), min(cell, fit) if fit > 0 else cell
    near = F.struct("dist", "other", *rest)
    while True:
        last = size >= max(*span, cell)
        at = lambda c, s=size: F.floor(F.col(c) / s)
        offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        a = todo.select("x", "y", F.explode(offsets).alias("o")).select("x", "y", (at("x") + F.col("o.i")).alias("cx"), (at("y") + F.col("o.j")).alias("cy"))
        d = a.join(r.withColumns({"cx": at("x2"), "cy": at("y2")}), ["cx", "cy"]).withColumn("dist", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
        top = d.withColumn("rn", F.row_number().over(Window.partitionBy("x", "y").orderBy("dist", "other"))).where(F.col("rn") <= most)
        top = Cut(top.groupBy("x", "y").agg(F.sort_array(F.collect_list(near)).alias("near")), "nearest").df  # most at most
        sure = top if last else top.where((F.size("near") == most) & (F.element_at("near", -1)["dist"] <= size))
        found = sure if found is None else found.unionByName(sure)
        if last:
            break
        todo = Cut(todo.join(sure.select("x", "y"), ["x", "y"], "left_anti"), "unsure").df
        if todo.isEmpty():
            break
        size *= 2
    out = l.join(small(Cut(found, "found")), ["x", "y"])
    out = out.withColumn("near", F.slice(F.filter("near", lambda z: z["other"] != F.col(key)) if apart else F.col("near"), 1, k))
    return out.select(key, F.explode("near").alias("z")).select(key, *[f"z.{c}" for c in right.columns if c not in ("x", "y")], "z.dist")


def nearest(left: DataFrame, right: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, other, dist): the nearest `right` point (other, x, y) of each `left` one (key, x, y), ties by the smallest other; no row
    where there is no right point at all."""
    return k_nearest(left, right.select("other", "x", "y"), key, cell).select(key, "other", "dist")
