"""Candidate retrieval, pair scoring, work-order tiers and report goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SIBLING

#: Names shared by more records than this give no lexical candidates (a parameter of the blocking itself).
LEXICAL_MAX = 50


def box_pairs(boxes: DataFrame, key: str, group: str, cell: float) -> DataFrame:
    """(key_a, key_b) of rows of one `group` whose boxes (x0, y0, x1, y1) meet, each pair once.

    Boxes go to the grid cells they touch; a pair is taken in the cell that holds the lower left corner of the
    common part only, so no distinct is needed. A box of more cells than 1,024 meets on a grid 64 times coarser, both ways.
    """
    c = lambda v, s: F.floor(F.col(v) / s)

    def gridded(d: DataFrame, s: float) -> DataFrame:
        xs, ys = F.sequence(c("x0", s), c("x1", s)), F.sequence(c("y0", s), c("y1", s))
        return d.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))

    d = boxes.select(key, group, "x0", "y0", "x1", "y1").withColumn("cells", (c("x1", cell) - c("x0", cell) + 1) * (c("y1", cell) - c("y0", cell) + 1))
    small, large = d.where("cells <= 1024"), d.where("cells > 1024")

    def meet(a: DataFrame, b: DataFrame, s: float, ordered: bool) -> DataFrame:
        a = gridded(a, s).select(group, "cx", "cy", *[F.col(k).alias(f"a_{k}") for k in (key, "x0", "y0", "x1", "y1")])
        b = gridded(b, s).select(group, "cx", "cy", *[F.col(k).alias(f"b_{k}") for k in (key, "x0", "y0", "x1", "y1")])
        home = (F.floor(F.greatest("a_x0", "b_x0") / s) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / s) == F.col("cy"))
        over = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
        j = a.join(b, [group, "cx", "cy"]).where(home & over & ((F.col(f"a_{key}") < F.col(f"b_{key}")) if ordered else F.lit(True)))
        return j.select(F.least(f"a_{key}", f"b_{key}").alias(f"{key}_a"), F.greatest(f"a_{key}", f"b_{key}").alias(f"{key}_b"))

    coarse = cell * 64
    return meet(small, small, cell, True).unionByName(meet(large, small, coarse, False)).unionByName(meet(large, large, coarse, True))


def lexical_pairs(names: DataFrame, key: str, group: str, prefix: str, most: int = LEXICAL_MAX) -> DataFrame:
    """(key_a, key_b) of rows of one group with one name prefix, prefixes of 2 to `most` rows only."""
    d = names.where(F.col(prefix).isNotNull()).select(key, group, prefix)
    n = d.groupBy(group, prefix).count().where(F.col("count").between(2, most)).select(group, prefix)
    a = d.join(n, [group, prefix])
    b = a.select(group, prefix, F.col(key).alias(f"{key}_b"))
    return a.withColumnRenamed(key, f"{key}_a").join(b, [group, prefix]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def pair_rule(f: dict[str, Column]) -> Column:
    """struct(relation, prob, conf) of a pair by ordered rules; the first that holds decides.

    Features: distance, conflict (first component conflict or null), hierarchical, a_is_part, same_district,
    number_conflict, exact_name, base_exact, one_number, name_sim, bge, iou, inter_min.
    """
    out = lambda r, p, c: F.struct(F.lit(r).alias("relation") if isinstance(r, str) else r.alias("relation"), F.lit(float(p)).alias("prob"), F.lit(float(c)).alias("conf"))
    sibling = F.element_at(F.create_map(*[F.lit(x) for kv in SIBLING.items() for x in kv]), f["conflict"])
    same = f["exact_name"] | (f["base_exact"] & (f["name_sim"] >= 0.80) & (f["bge"] >= 0.88))
    near = (  # rule 3 has its own end: a pair that enters it is not tried further
        F.when(same & f["one_number"], out("RELATED_ENTITY", 0.50, 0.60)).when(same & (f["iou"] >= 0.85), out("EXACT_DUPLICATE", 0.99, 0.98)).when(same, out("SAME_ENTITY_ALT_BOUNDARY", 0.95, 0.92))
        .when(f["bge"] >= 0.82, out("RELATED_ENTITY", 0.70, 0.75)).when((f["name_sim"] >= 0.70) | (f["bge"] >= 0.70), out("RELATED_ENTITY", 0.50, 0.75)).otherwise(out("NOT_SAME_ENTITY", 0, 0.95))
    )
    far = f["distance"]
    return (
        F.when(far > 2000, out("NOT_SAME_ENTITY", 0, 0.99))
        .when(f["conflict"].isNotNull() & (far <= 1500), out(sibling, 0, 0.99))
        .when(f["hierarchical"] & (far <= 1000), out(F.when(f["a_is_part"], "PHASE_TO_WHOLE").otherwise("WHOLE_TO_PHASE"), 0, 0.92))
        .when(f["same_district"] & ~f["number_conflict"] & (far <= 200), near)
        .when(((f["iou"] >= 0.35) | (f["inter_min"] >= 0.50)) & (f["name_sim"] < 0.45) & ~f["base_exact"], out("POSSIBLE_MERGE_ERROR", 0, 0.92))
        .when((f["name_sim"] >= 0.80) & ~f["same_district"], out("NOT_SAME_ENTITY", 0, 0.99))
        .when((far <= 300) & ((f["name_sim"] >= 0.60) | (f["bge"] >= 0.68)), F.when(f["bge"] >= 0.80, out("RELATED_ENTITY", 0.65, 0.70)).otherwise(out("RELATED_ENTITY", 0.30, 0.70)))
        .otherwise(out("NOT_SAME_ENTITY", 0, 0.95))
    )


def review_status(conf: Column) -> Column:
    return F.when(conf >= 0.90, "AUTO_DECIDED").otherwise("REVIEW_REQUIRED")


def rerank(relation: Column, score: Column) -> Column:
    """Only related entities are reranked: below .30 not the same, from .85 a confirmed alias (still for review)."""
    soft = (relation == "RELATED_ENTITY") & score.isNotNull()
    return F.when(soft & (score < 0.30), "NOT_SAME_ENTITY").when(soft & (score >= 0.85), "ALIAS_CONFIRMED").otherwise(relation)


def work_tier(relation: Column, iou: Column, ce: Column, bge: Column, distance: Column, literal_zero: bool = False) -> Column:
    """Tier of a work order. A null (or NaN) cross-encoder score is not a low score, unless `literal_zero`."""
    clean = lambda c: F.when(F.isnan(c), None).otherwise(c)
    ce, bge, iou, distance = clean(ce), clean(bge), clean(iou), clean(distance)
    ce = F.coalesce(ce, F.lit(0.0)) if literal_zero else ce
    yes = lambda c: F.coalesce(c, F.lit(False))
    first = (relation == "POSSIBLE_MERGE_ERROR") | yes(iou >= 0.15) | yes((ce >= 0.85) & (distance < 1500))
    third = (relation == "NOT_SAME_ENTITY") | yes(ce < 0.30) | yes((bge < 0.60) & (iou == 0))
    return F.when(first, 1).when(third, 3).otherwise(2)


def overlap_priority(relation: Column, iou: Column) -> Column:
    """Goal B: COLLISION, then by overlap."""
    return F.when(relation == "POSSIBLE_MERGE_ERROR", "COLLISION").when(iou >= 0.35, "HIGH").when(iou >= 0.05, "MEDIUM").when(iou > 0, "LOW")
