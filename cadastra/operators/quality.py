"""Geometry quality: shape scores, guards and the extraction of clean fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the scoring: (issue, penalty) and limits in m and m2.
SLIVER_M2, OVERSIZED_M2, STRIP_W, STRIP_L, JAGGED, ELONGATED, COMPACT = 500.0, 1_500_000.0, 50.0, 100.0, 0.3, 10.0, 0.10
PENALTY = {"INVALID": 0.20, "SLIVER": 0.30, "OVERSIZED": 0.25, "NARROW_STRIP": 0.15, "JAGGED": 0.10, "ELONGATED": 0.0, "LOW_COMPACTNESS": 0.10}
PASS, WARN = 0.70, 0.40
GUARD_AREA, GUARD_SEED_M = (500.0, 800_000.0), 300.0


def shape_issues(area: Column, length: Column, max_width: Column, mean_width: Column, aspect: Column, compactness: Column, valid: Column) -> Column:
    """array of the issues of a shape, in the order of PENALTY."""
    strip = (max_width < STRIP_W) & (length > STRIP_L)
    tests = {"INVALID": ~valid, "SLIVER": area < SLIVER_M2, "OVERSIZED": area > OVERSIZED_M2, "NARROW_STRIP": strip, "JAGGED": (max_width > 1) & (mean_width < JAGGED * max_width), "ELONGATED": (aspect > ELONGATED) & ~strip, "LOW_COMPACTNESS": compactness < COMPACT}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))


def shape_score(issues: Column) -> Column:
    """1 less the penalties of the issues, within 0 and 1."""
    lost = sum((F.when(F.array_contains(issues, k), p).otherwise(0.0) for k, p in PENALTY.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost))


def decision(score: Column) -> Column:
    s = F.round(score, 6)
    return F.when(s >= PASS, "PASS").when(s >= WARN, "WARN").otherwise("REVIEW")


def fence_guard(score: Column, area: Column, issues: Column, seed_m: Column, fallback_ok: Column) -> Column:
    """ACCEPTED, DEGRADED_FALLBACK or REJECTED_UNRECOVERABLE for a proposed fence (null score: it could not be read)."""
    hard = score.isNull() | ~area.between(*GUARD_AREA) | F.array_contains(issues, "NARROW_STRIP") | (seed_m > GUARD_SEED_M)
    return F.when(~F.coalesce(hard, F.lit(True)) & (F.round(score, 6) >= PASS), "ACCEPTED").when(F.coalesce(fallback_ok, F.lit(False)), "DEGRADED_FALLBACK").otherwise("REJECTED_UNRECOVERABLE")


def first_rejection(has_geometry: Column, score: Column, area: Column, issues: Column) -> Column:
    """The first reason a fence is left out of the clean set; null for survivors."""
    return (
        F.when(~has_geometry, "NO_GEOMETRY").when(F.round(score, 6) < PASS, "LOW_QA").when(~area.between(SLIVER_M2, OVERSIZED_M2), "AREA_OUT_OF_RANGE")
        .when(F.array_contains(issues, "NARROW_STRIP"), "NARROW_STRIP")
    )


def rectangle_qa(fences: DataFrame, width: str = "width_m", height: str = "height_m") -> DataFrame:
    """Quality columns of axis-aligned rectangles given in metres; their widths have closed forms."""
    w, h = F.col(width), F.col(height)
    short, long = F.least(w, h), F.greatest(w, h)
    area, per = w * h, 2 * (w + h)
    d = fences.withColumns({"area_m2": area, "perimeter_m": per, "compactness": 4 * F.pi() * area / (per * per), "aspect": long / short, "max_width": short, "mean_width": 2 * area / per})
    d = d.withColumn("issues", shape_issues(F.col("area_m2"), long, F.col("max_width"), F.col("mean_width"), F.col("aspect"), F.col("compactness"), F.lit(True)))
    d = d.withColumn("score", shape_score(F.col("issues")))
    return d.withColumn("decision", decision(F.col("score")))
