"""Membership of buildings, topology of boundaries with its repairs, and road evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs_of_shapes import wkt_difference, wkt_pair
from ..runtime import Cut, spread
from .hypotheses import FLAT, WEIGHTS, topology
from .relations import box_pairs

#: Levels of the membership analysis, by least confidence.
MEMBER_LEVELS = (("CONFIRMED", 0.80), ("LIKELY", 0.50), ("UNCERTAIN", 0.20))


def name_support(building: Column, compound: Column) -> Column:
    """struct(method, supports, confidence) of a building's name beside the compound's; null where one is blank. (A common beginning
    as long as the shorter name is one name within the other, which counts before.)"""
    item = lambda s, c: F.struct(F.lit("naming").alias("method"), F.lit(s).alias("supports"), F.lit(c).alias("confidence"))
    named = (F.coalesce(building, F.lit("")) != "") & (F.coalesce(compound, F.lit("")) != "")
    return F.when(named, F.when(F.contains(building, compound), item(True, 0.8)).when(F.contains(compound, building), item(True, 0.6)).otherwise(item(False, 0.0)))


def membership(pairs: DataFrame, building: str, compound: str) -> DataFrame:
    """`pairs` of building and compound (columns of their WKT, `building_name`, `compound_name`, `listed` or null, `crossed`: the share of
    the line between both that roads take, null where no roads are known) with `evidence`, `confidence` and `level`.

    Evidence: containment (wholly inside, or the compound inside the building; else refuting with 1 less ten times the
    distance in degrees), roads (a crossed gap refutes with twice the share, at most 1), listing, naming. Confidence is the
    weighted support less half of the weighted refutation, over the weights of what is known. Texts that are no polygon
    refute with 0.
    """
    c = F.col
    p = pairs.withColumn("_p", wkt_pair(building, compound))
    item = lambda m, s, v: F.struct(F.lit(m).alias("method"), s.alias("supports"), v.cast("double").alias("confidence"))
    within = (c("_p.inter") >= c("_p.area_a") * (1 - 1e-9)) | (c("_p.inter") >= c("_p.area_b") * (1 - 1e-9))
    contain = item("containment", F.coalesce(within, F.lit(False)), F.when(within, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - 10 * c("_p.dist")), F.lit(0.0))))
    apart = F.coalesce(c("_p.dist") > 0, F.lit(False))
    road = F.when(c("crossed").isNotNull(), F.when(~apart, item("road", F.lit(True), F.lit(0.5))).when(c("crossed") > 0, item("road", F.lit(False), F.least(F.lit(1.0), 2 * c("crossed")))).otherwise(item("road", F.lit(True), F.lit(0.7))))
    cluster = F.when(c("listed").isNotNull(), item("cluster", c("listed"), F.when(c("listed"), 1.0).otherwise(0.0)))
    p = p.withColumn("evidence", F.array_compact(F.array(contain, road, cluster, name_support(c("building_name"), c("compound_name"))))).drop("_p")
    return p.withColumn("confidence", member_confidence(c("evidence"))).withColumn("level", member_level(c("confidence")))


def member_confidence(evidence: Column) -> Column:
    """Weighted support less half of the weighted refutation, within 0 and 1; no evidence gives 0."""
    w = lambda e: F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), e["method"])
    add = lambda f: F.aggregate(evidence, F.lit(0.0), lambda s, e: s + f(e))
    total = add(w)
    c = (add(lambda e: F.when(e["supports"], w(e) * e["confidence"]).otherwise(0.0)) - 0.5 * add(lambda e: F.when(e["supports"], 0.0).otherwise(w(e) * e["confidence"]))) / total
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)


def member_level(confidence: Column) -> Column:
    out = F.lit("EXCLUDED")
    for name, least in reversed(MEMBER_LEVELS):
        out = F.when(confidence + 1e-9 >= least, name).otherwise(out)
    return out


_BOX = ("x0", "y0", "x1", "y1")


def shape_forms(shapes: DataFrame, key: str, group: str, wkt: str) -> DataFrame:
    """`shapes` with `form`: the smallest key among the equal polygons (text and box) of a group."""
    return Cut(shapes.select(key, group, wkt, *_BOX, F.min(key).over(Window.partitionBy(group, wkt, *_BOX)).alias("form")), "forms").df


def form_pairs(forms: DataFrame, key: str, group: str, wkt: str, reach: float, cell: float, once: bool = False) -> DataFrame:
    """(form_a, form_b, wkt_a, wkt_b, overlap_m2, gap_m, shared_m) of the `shape_forms` of one group whose boxes come within `reach` degrees;
    111 000 m a degree. A form meets itself too, and comes first and second, as far as its members do; with `once` two forms meet once."""
    c = F.col
    one = forms.groupBy("form").agg(F.max(key).alias("hi")).join(forms.where(c(key) == c("form")).drop(key), "form")
    p = box_pairs(one.select("form", group, (c("x0") - reach / 2).alias("x0"), (c("y0") - reach / 2).alias("y0"), (c("x1") + reach / 2).alias("x1"), (c("y1") + reach / 2).alias("y1")), "form", group, cell)
    itself = one.where("hi > form").where(c(group).isNotNull() & c("x0").isNotNull() & c("y0").isNotNull() & c("x1").isNotNull() & c("y1").isNotNull())
    p = (p if once else p.unionByName(p.select(c("form_b").alias("form_a"), c("form_a").alias("form_b")))).select("form_a", "form_b").unionByName(itself.select(c("form").alias("form_a"), c("form").alias("form_b")))
    side = lambda s: one.select(c("form").alias(f"form_{s}"), c(wkt).alias(f"wkt_{s}"), c("hi").alias(f"hi_{s}"))
    p = spread(p.join(side("a"), "form_a").join(side("b"), "form_b").where("form_a < hi_b")).withColumn("p", wkt_pair("wkt_a", "wkt_b")).where("p.inter IS NOT NULL")
    return p.select("form_a", "form_b", "wkt_a", "wkt_b", (c("p.inter") * FLAT * FLAT).alias("overlap_m2"), (c("p.dist") * FLAT).alias("gap_m"), F.when(c("p.inter") * FLAT * FLAT < 1e-6, c("p.shared") * FLAT).otherwise(0.0).alias("shared_m"))


def of_members(pairs: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """`pairs` of forms for each two of their members: key_a and key_b, the smaller first, instead of form_a and form_b."""
    side = lambda s: spread(forms.select(F.col(key).alias(f"{key}_{s}"), F.col("form").alias(f"form_{s}")), f"form_{s}")
    j = spread(Cut(pairs, "form-pairs").df, "form_a").join(side("a"), "form_a").drop("form_a")
    j = spread(j, "form_b").join(side("b"), "form_b").where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return j.select(f"{key}_a", f"{key}_b", *[c for c in pairs.columns if c not in ("form_a", "form_b")])


def topology_pairs(shapes: DataFrame, key: str, group: str, wkt: str, reach: float, cell: float) -> DataFrame:
    """(key_a, key_b, wkt_a, wkt_b, overlap_m2, gap_m, shared_m) of the polygons of one group whose boxes (x0, y0, x1, y1) come within `reach`
    degrees; 111 000 m a degree. Only such pairs are measured, never all, and equal polygons once."""
    forms = shape_forms(shapes, key, group, wkt)
    return of_members(form_pairs(forms, key, group, wkt, reach, cell), forms, key)


def topology_report(pairs: DataFrame, least_m2: float = 100.0, most_gap_m: float = 50.0, times: Column | None = None) -> DataFrame:
    """One row: numbers and sums of overlaps, gaps and shared boundaries of `topology_pairs`; a row stands for `times` pairs."""
    c, n = F.col, F.lit(1).cast("bigint") if times is None else times
    over, gap, shared = c("overlap_m2") > least_m2, (c("gap_m") > 0) & (c("gap_m") <= most_gap_m), c("shared_m") > 0
    k = lambda t: F.coalesce(F.sum(F.when(t, n)), F.lit(0).cast("bigint"))
    s = lambda t, v: F.coalesce(F.sum(F.when(t, c(v) * n)), F.lit(0.0))
    return pairs.agg(k(over).alias("n_overlaps"), s(over, "overlap_m2").alias("total_overlap_m2"), k(gap).alias("n_gaps"), s(gap, "gap_m").alias("total_gap_m"), k(shared).alias("n_shared"), s(shared, "shared_m").alias("total_shared_m"))


def topology_totals(shapes: DataFrame, key: str, group: str, wkt: str, reach: float, cell: float) -> DataFrame:
    """`topology_report` of `topology_pairs` without a row for each pair: two equal polygons are one, and the pairs of their members are
    counted. Keys are unique."""
    c = F.col
    forms = shape_forms(shapes, key, group, wkt)
    n = forms.groupBy("form").agg(F.count(key).alias("n"))
    side = lambda s: n.select(c("form").alias(f"form_{s}"), c("n").alias(f"n_{s}"))
    p = Cut(form_pairs(forms, key, group, wkt, reach, cell, once=True).select("form_a", "form_b", "overlap_m2", "gap_m", "shared_m"), "form-pairs").df
    p = p.join(side("a"), "form_a").join(side("b"), "form_b")
    return topology_report(p, times=F.when(c("form_a") == c("form_b"), (c("n_a") * (c("n_a") - 1) / 2).cast("bigint")).otherwise(c("n_a") * c("n_b")))


def repairs(pairs: DataFrame, separator: Column) -> DataFrame:
    """`topology_pairs` or `form_pairs` with `relation`, `operation` and the repaired `geometry`: an overlap is taken from the first polygon; a
    gap (boxes grown by half of it are left to the caller) and a shared boundary join both as one MULTIPOLYGON of pieces
    that don't overlap. Other pairs have neither."""
    c = F.col
    p = pairs.withColumn("relation", topology(c("overlap_m2"), c("gap_m"), c("shared_m"), separator))
    p = p.withColumn("operation", F.when(c("relation") == "OVERLAP_CONFLICT", "REMOVE_OVERLAP").when(c("relation") == "GAP_CONFLICT", "REPAIR_GAP").when(c("relation") == "SHARED_BOUNDARY", "SNAP"))
    cut = wkt_difference("wkt_a", "wkt_b")
    inner = lambda w: F.regexp_replace(F.regexp_replace(w, r"^\s*POLYGON\s*", ""), r"\s*$", "")
    both = F.concat(F.lit("MULTIPOLYGON ("), inner(c("wkt_a")), F.lit(", "), inner(c("wkt_b")), F.lit(")"))
    return p.withColumn("geometry", F.when(c("operation") == "REMOVE_OVERLAP", cut).when(c("operation").isNotNull(), both))


def assertion_score(a: Column) -> Column:
    """What a road assertion (struct(role, continuity, support)) adds to a hypothesis: .15 for a public separator or .05 for a weak
    one, .10 for a through road, .10 for a supported split."""
    return F.when(a["role"] == "PUBLIC_SEPARATOR", 0.15).when(a["role"] == "WEAK_SEPARATOR", 0.05).otherwise(0.0) + F.when(a["continuity"] == "THROUGH", 0.10).otherwise(0.0) + F.when(a["support"] == "SUPPORT", 0.10).otherwise(0.0)


def road_rank(area: Column, assertions: Column) -> Column:
    """Score of a hypothesis from its area and the sum of its road assertions, within 0 and 1."""
    base = 0.3 + F.when(area.between(5000, 200_000), 0.20).when((area >= 1000) & (area < 5000), 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + assertions))


def point_vote(points: DataFrame, key: str, raw: str, shifted: str, reach: float = 200.0) -> DataFrame:
    """(key, n, raw_votes, shifted_votes, verdict): each point votes for the hypothesis under which it lies nearer, points farther than `reach`
    under both don't vote; ties and keys without votes are UNDECIDED."""
    a, b = F.col(raw), F.col(shifted)
    near = F.least(a, b) <= reach
    v = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(near & (a < b)).alias("raw_votes"), F.count_if(near & (b < a)).alias("shifted_votes"))
    return v.withColumn("verdict", F.when(F.col("raw_votes") > F.col("shifted_votes"), "AS_DELIVERED").when(F.col("raw_votes") < F.col("shifted_votes"), "SHIFTED").otherwise("UNDECIDED"))


def rotated(points: DataFrame, x: str, y: str, cx: str, cy: str, angles: tuple[int, ...] = (0, 90, 180, 270)) -> DataFrame:
    """`points` turned around (cx, cy) by each angle: one row per point and angle (rx, ry, angle)."""
    a = F.explode(F.array(*[F.lit(k) for k in angles])).alias("angle")
    dx, dy, t = F.col(x) - F.col(cx), F.col(y) - F.col(cy), F.radians(F.col("angle"))
    return points.select("*", a).withColumns({"rx": F.col(cx) + dx * F.cos(t) - dy * F.sin(t), "ry": F.col(cy) + dx * F.sin(t) + dy * F.cos(t)})


def fingerprint(hits: DataFrame, key: str, strength: str, least: int = 3) -> DataFrame:
    """(key, score): places whose points of interest make a fingerprint: three for a strong mark, one for a medium one."""
    score = F.sum(F.when(F.col(strength) == "strong", 3).when(F.col(strength) == "medium", 1).otherwise(0))
    return hits.groupBy(key).agg(score.alias("score")).where(F.col("score") >= least)
