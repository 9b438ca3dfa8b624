"""Column-level data quality profile by character-class masks (problem 5).

Every value is generalised to a mask (runs of digits become d<length>, letters become words of the WKT
grammar, R stands for a complete ring). Masks of a column are mined over the loads of a system: those that
hold a fair share in the median load are dominant, others are rare. A load's departure is told by the share
of each kind of mask against the system's median, and by the divergence of its mask distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LAT_MAX, LAT_MIN, LNG_MAX, LNG_MIN, is_blank, is_polygon, let, norm_id, wkt_box, wkt_mask

COLUMNS = ("point_raw_lng", "area_raw", "geometry_raw_wkt")
#: An area in m2 of a place outside these bounds is in another unit.
AREA_MIN, AREA_MAX = 100.0, 500_000.0
#: A value that fills more than this share of a load repeats.
REPEAT_SHARE = 0.1
#: A mask with less than this median share over the loads of a system is rare.
RARE_SHARE = 0.02


def number_mask(v: Column, scale: int = 15) -> Column:
    """Mask of a double: null, NaN, or sign, digits before and after the point, as -d3.d6."""
    s = F.regexp_replace(F.format_string("%.10f", v), r"\.?0+$", "")
    return (
        F.when(v.isNull(), "null").when(F.isnan(v), "NaN").when(v == 0, "zero")
        .otherwise(F.concat(F.when(v < 0, "-").otherwise(""), F.lit("d"), F.length(F.regexp_extract(s, r"^-?([0-9]*)", 1)).cast("string"),
                            F.when(s.contains("."), F.concat(F.lit(".d"), F.length(F.regexp_extract(s, r"\.([0-9]+)$", 1)).cast("string"))).otherwise("")))
    )


def _value(column: str) -> tuple[Column, Column]:
    """(struct(mask, kind), the value): kind is missing, range, format or sound."""
    c = F.col(column)
    if column == "point_raw_lng":
        mask = number_mask(c)
        coarse = ~mask.rlike(r"\.d([3-9]|1[0-9])$")
        kind = F.when(c.isNull() | F.isnan(c) | (c == 0), "missing").when(~c.between(LNG_MIN, LNG_MAX), "range").when(coarse, "format").otherwise("sound")
        return F.struct(mask.alias("mask"), kind.alias("kind")), c
    if column == "area_raw":
        mask = number_mask(c)
        kind = F.when(c.isNull() | F.isnan(c) | (c <= 0), "missing").when(~c.between(AREA_MIN, AREA_MAX), "range").otherwise("sound")
        return F.struct(mask.alias("mask"), kind.alias("kind")), c
    outside = lambda b: (b["x0"] < LNG_MIN) | (b["x1"] > LNG_MAX) | (b["y0"] < LAT_MIN) | (b["y1"] > LAT_MAX)
    # foreign and broken texts are as long as their polygons: their masks fold runs of numbers and positions
    short = lambda m: F.regexp_replace(F.regexp_replace(m, r"[np](?:[^a-z]+[np])+", "n+"), r"R(?:,R)+", "R+")
    sound = let(wkt_box(c), lambda b: F.when(outside(b), "range").otherwise("sound"))
    kind = lambda m: F.when(m.rlike(r"^\w+\s*empty$"), "missing").when(~is_polygon(m), "format").otherwise(sound)
    both = let(wkt_mask(c), lambda m: F.struct(short(m).alias("mask"), kind(m).alias("kind")))
    return F.when(is_blank(c), F.struct(F.lit("blank").alias("mask"), F.lit("missing").alias("kind"))).otherwise(both), c


def masked(records: DataFrame) -> DataFrame:
    """(system, load, column_name, mask, kind, value): one row per delivered row and profiled column."""
    load = F.coalesce(norm_id(F.col("source_batch_id")), F.lit(""))
    system = F.coalesce(norm_id(F.col("source_system")), F.lit(""))
    def cell(name: str) -> Column:
        z, v = _value(name)
        full = lambda w: F.struct(F.lit(name).alias("column_name"), F.concat(w["mask"], F.when(w["kind"] == "range", "!").otherwise("")).alias("mask"), w["kind"].alias("kind"), F.when(w["kind"] == "sound", F.xxhash64(v)).alias("value"))
        return let(z, full)

    cells = F.array(*map(cell, COLUMNS))
    return records.select(system.alias("system"), load.alias("load"), F.explode(cells).alias("z")).select("system", "load", "z.*")


def mask_counts(records: DataFrame) -> DataFrame:
    """(system, load, column_name, mask, kind, n, top): rows by mask, and those of the most frequent sound value."""
    m = masked(records)
    by_value = m.groupBy("system", "load", "column_name", "mask", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("system", "load", "column_name", "mask", "kind").agg(F.sum("n").alias("n"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"))


def load_shares(records: DataFrame) -> DataFrame:
    """(system, load, column_name, rows, change_kind, share, usual): the share of a load's rows with each
    trait, and the median share over all loads of its system."""
    per = mask_counts(records).groupBy("system", "load", "column_name").agg(
        F.sum("n").alias("rows"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("missing", "range", "format")], F.coalesce(F.max("top"), F.lit(0)).alias("top")
    )
    per = per.withColumn("repeat", F.when(F.col("top") > REPEAT_SHARE * F.col("rows"), F.col("top")).otherwise(0))
    kinds = F.array(*[F.struct(F.lit(k).alias("change_kind"), (F.col(k) / F.col("rows")).alias("share")) for k in ("missing", "range", "format", "repeat")])
    long = per.select("system", "load", "column_name", "rows", F.explode(kinds).alias("z")).select("system", "load", "column_name", "rows", "z.*")
    usual = long.groupBy("system", "column_name", "change_kind").agg(F.percentile("share", F.lit(0.5)).alias("usual"))
    return long.join(usual, ["system", "column_name", "change_kind"])


def departures(records: DataFrame, least_rows: int = 30, excess: float = 0.15) -> DataFrame:
    """(source_batch_id, column_name, change_kind): loads of `least_rows` rows or more in which a trait holds a
    share at least `excess` above the median of the system's loads. All delivered rows count, repeats too; a
    null load or system is a load or system of its own; an empty table gives no row. Areas have no format."""
    s = load_shares(records).where((F.col("rows") >= least_rows) & (F.col("share") - F.col("usual") >= excess - 1e-9))
    return s.select(F.col("load").alias("source_batch_id"), "column_name", "change_kind")


def mask_profile(records: DataFrame) -> DataFrame:
    """The mask profile of every load and column: rows, masks, dominant_mask of the system, rare_share (rows
    whose mask is rare in the system) and divergence (Jensen-Shannon, base 2, of the load's mask
    distribution against the system's median one, 0 to 1)."""
    n = mask_counts(records).groupBy("system", "load", "column_name", "mask").agg(F.sum("n").alias("n"))
    loads = n.groupBy("system", "load", "column_name").agg(F.sum("n").alias("rows"))
    masks = n.select("system", "column_name", "mask").distinct()
    grid = loads.join(masks, ["system", "column_name"]).join(n, ["system", "load", "column_name", "mask"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.col("rows"))
    usual = grid.groupBy("system", "column_name", "mask").agg(F.percentile("p", F.lit(0.5)).alias("med"), F.avg("p").alias("q"))
    top = usual.groupBy("system", "column_name").agg(F.max_by("mask", F.struct("med", "q", "mask")).alias("dominant_mask"))
    g = grid.join(usual, ["system", "column_name", "mask"]).withColumn("mix", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("mix"))).otherwise(0.0) / 2
    out = g.groupBy("system", "load", "column_name").agg(
        F.max("rows").alias("rows"), F.count(F.when(F.col("p") > 0, 1)).alias("masks"), F.round(F.sum(F.when(F.col("med") < RARE_SHARE, F.col("p")).otherwise(0.0)), 6).alias("rare_share"),
        F.round(F.sum(part("p") + part("q")), 6).alias("divergence"),
    )
    return out.join(top, ["system", "column_name"]).select(F.col("system").alias("source_system"), F.col("load").alias("source_batch_id"), "column_name", "rows", "masks", "dominant_mask", "rare_share", "divergence")
