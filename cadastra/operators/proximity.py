"""Points near other points or inside regions (problem 7).

Near pairs: an equi-join on grid cells not smaller than the distance. A row meets its own cell and the four
cells ahead of it, so every pair of cells is tried once. Cells with many rows are cut into pieces: one side
takes one piece, the other goes to all pieces.

Regions: every region is covered by square cells, large ones wholly inside it and small ones along its
boundary. A point in an inside cell is a hit by the equi-join alone; only points in boundary cells are
tested, against the few edges to the right of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_M, location, norm_id, sphere_m, usable_box
from ..functions.polygons import parse_polygons
from ..runtime import Cut, small

#: Rows of one cell that one task piece takes.
PIECE_ROWS = 2_000
#: Points of one cell that one task piece takes when they meet regions.
PIECE_POINTS = 50_000
#: Cells per degree of the covering's levels, coarse to fine (the finest are about 860, 215 and 54 m of latitude).
LEVELS = (2, 8, 32, 128, 512, 2048)
#: A covering starts at the level of usual regions, or at the finest coarser one on which the region's box has at most so many cells.
START, START_CELLS = 3, 4096


def located(records: DataFrame, key: str = "source_record_id") -> DataFrame:
    """(id, x, y): one row per record with a location. Deliveries of one record have the same content; should
    they differ, the one with the greatest (x, y) counts. Records without usable point and polygon give no row."""
    c = F.col
    p = records.select(norm_id(c(key)).alias("id"), location(c("point_raw_lng"), c("point_raw_lat"), usable_box(c("geometry_raw_wkt"))).alias("p")).where("id is not null and p is not null")
    return p.groupBy("id").agg(F.max("p").alias("p")).select("id", "p.x", "p.y")


def near_pairs(points: DataFrame, metres: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of rows of `points` (id, x, y) at most `metres` apart on the sphere.

    Ids must be unique. Points exactly at the distance and points at the same place are near. Rows with a
    null or NaN coordinate are near nothing; points across the 180th meridian are not joined. No pair is
    left out, however many rows share a place.
    """
    reach = math.degrees(metres / EARTH_M) * (1 + 1e-9)  # in latitude
    side = 2 * reach
    stretch = lambda r: F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(89.9), (F.abs(r) + 2) * side))))
    # a point (x, y) has cell (r, c): rows of equal latitude, columns whose width is a function of the row
    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumn("r", F.floor(F.col("y") / side))
    p = p.select("id", "x", "y", "r", F.floor(F.col("x") * stretch(F.col("r")) / side).alias("c"))
    wide = F.lit(reach) / stretch(F.col("r") + 1)  # the longitude that `metres` span hereabouts, at most
    up, scale_up = F.col("r") + 1, stretch(F.col("r") + 1) / side
    target = lambda r, c, ahead: F.struct(r.alias("r"), c.alias("c"), F.lit(ahead).alias("ahead"))
    beside = F.floor((F.col("x") + wide) * stretch(F.col("r")) / side)
    # a point goes to its own cell, to the next one where that is in reach, and to the cells in reach of the row above
    targets = F.concat(
        F.array(target(F.col("r"), F.col("c"), 0)),
        F.when(beside > F.col("c"), F.transform(F.sequence(F.col("c") + 1, beside), lambda k: target(F.col("r"), k, 1))).otherwise(F.array()),
        F.when(F.floor((F.col("y") + reach) / side) > F.col("r"), F.transform(F.sequence(F.floor((F.col("x") - wide) * scale_up), F.floor((F.col("x") + wide) * scale_up)), lambda k: target(up, k, 1))).otherwise(F.array()),
    )
    hot = p.groupBy("r", "c").count().where(F.col("count") > PIECE_ROWS).select("r", "c", F.ceil(F.col("count") / PIECE_ROWS).cast("int").alias("pieces"))
    hot = small(Cut(hot, "hot-cells"))
    left = p.join(hot, ["r", "c"], "left").select("r", "c", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"), "id", "x", "y")
    right = p.select(F.explode(targets).alias("t"), "id", "x", "y").select("t.*", "id", "x", "y")
    right = right.join(hot, ["r", "c"], "left").select("r", "c", "ahead", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    box = (F.abs(F.col("y") - F.col("y2")) <= reach) & (F.abs(F.col("x") - F.col("x2")) * F.cos(F.radians(F.abs(F.col("y")) + side)) <= reach)
    once = (F.col("ahead") == 1) | (F.col("id") < F.col("id2"))
    j = left.join(right.hint("merge"), ["r", "c", "piece"]).where(once & (F.col("id") != F.col("id2")) & box & (sphere_m(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= metres))
    return j.select(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"))


def cover_polygon(parts: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[float]] | None]]:
    """Cells of a region: (level, columns, rows, edges), the edges (x1, y1, x2, y2 ...) in or right of each cell, or
    None where the cells are wholly inside. A cell of several parts comes once for each."""
    for rings in parts:
        e = np.concatenate([np.hstack((r[:-1], r[1:])) for r in rings])
        x0, x1, y0, y1 = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        first = START
        while first and (x1.max() - x0.min() + 2 / LEVELS[first]) * (y1.max() - y0.min() + 2 / LEVELS[first]) * LEVELS[first] ** 2 > START_CELLS:
            first -= 1
        s = LEVELS[first]
        i, j = (g.ravel() for g in np.meshgrid(np.arange(math.floor(x0.min() * s), math.floor(x1.max() * s) + 1), np.arange(math.floor(y0.min() * s), math.floor(y1.max() * s) + 1)))
        for lv in range(first, len(LEVELS)):
            s = LEVELS[lv]
            cx, cy, h = ((i + 0.5) / s)[:, None], ((j + 0.5) / s)[:, None], 0.5 / s + 1e-12
            near = (y1 >= cy - h) & (y0 <= cy + h) & (x1 >= cx - h)  # edges that can lie right of a point of the cell
            off = dx * (cy - e[:, 1]) - dy * (cx - e[:, 0])
            cut = near & (x0 <= cx + h) & (np.abs(off) <= h * (np.abs(dx) + np.abs(dy)))  # the edge's line meets the cell
            bound = cut.any(1)
            k = np.flatnonzero(~bound)
            if len(k):
                up = (e[:, 1] > cy[k]) != (e[:, 3] > cy[k])
                with np.errstate(divide="ignore", invalid="ignore"):
                    right = up & (e[:, 0] + (cy[k] - e[:, 1]) / dy * dx > cx[k])
                k = k[right.sum(1) % 2 == 1]
                if len(k):
                    yield lv, i[k], j[k], None
            k = np.flatnonzero(bound)
            if not len(k):
                break
            if lv + 1 == len(LEVELS):
                yield lv, i[k], j[k], [e[near[q]].ravel().tolist() for q in k]
            else:
                f = LEVELS[lv + 1] // s
                a, b = (g.ravel() for g in np.meshgrid(np.arange(f), np.arange(f)))
                i, j = (i[k][:, None] * f + a).ravel(), (j[k][:, None] * f + b).ravel()


def covering(regions: DataFrame, pieces: int = 32) -> DataFrame:
    """(id, lv, i, j, edges) of the regions (id, wkt), the texts being usable polygons; edges are null inside."""
    kind = regions.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lvs, cols, rows, edges = [], [], [], [], []
            for rid, wkt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for lv, i, j, e in cover_polygon(parse_polygons(wkt)):
                    ids += [rid] * len(i)
                    lvs += [lv] * len(i)
                    cols.append(i)
                    rows.append(j)
                    edges += e or [None] * len(i)
            n = lambda xs: pa.array(np.concatenate(xs).astype(np.int32)) if xs else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(lvs, pa.int32()), n(cols), n(rows), pa.array(edges, pa.list_(pa.float64()))], names=["id", "lv", "i", "j", "edges"])

    return regions.select("id", "wkt").repartition(pieces).mapInArrow(run, f"id {kind}, lv int, i int, j int, edges array<double>")


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """How many of the edges (x1, y1, x2, y2 ...) a ray from (x, y) to the right crosses."""
    at = lambda k, o: F.element_at(edges, k * 4 + o)
    up = lambda k: (at(k, 2) > y) != (at(k, 4) > y)
    right = lambda k: at(k, 1) + (y - at(k, 2)) / (at(k, 4) - at(k, 2)) * (at(k, 3) - at(k, 1)) > x
    return F.size(F.filter(F.sequence(F.lit(0), (F.size(edges) / 4).cast("int") - 1), lambda k: up(k) & right(k)))


def points_within(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, id): points (id, x, y) inside the regions (id, wkt); holes are outside.

    Regions without a usable polygon hold nothing; of regions with one id each shape counts, and a hit comes
    once. Self-crossing rings count by the even-odd rule, multipolygons by any of their parts.
    """
    cells = Cut(covering(regions.where(usable_box(F.col("wkt")).isNotNull()).distinct()).withColumnRenamed("id", "region_id"), "covering").df
    used = sorted(r[0] for r in cells.select("lv").distinct().collect())  # of six levels
    if not used:
        return cells.select("region_id").limit(0).join(points.select("id").limit(0), how="cross")
    pts = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = F.array(*[F.struct(F.lit(lv).alias("lv"), F.floor(F.col("x") * LEVELS[lv]).cast("int").alias("i"), F.floor(F.col("y") * LEVELS[lv]).cast("int").alias("j")) for lv in used])
    p = pts.select("id", "x", "y", F.explode(at).alias("k")).select("id", "x", "y", "k.lv", "k.i", "k.j")
    # cells with many points are cut into pieces, and the regions there go to all of them
    hot = p.groupBy("lv", "i", "j").count().where(F.col("count") > PIECE_POINTS).select("lv", "i", "j", F.ceil(F.col("count") / PIECE_POINTS).cast("int").alias("pieces"))
    hot = small(Cut(hot, "hot-cells"))
    p = p.join(hot, ["lv", "i", "j"], "left").withColumn("piece", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    c = cells.join(hot, ["lv", "i", "j"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    j = c.join(p, ["lv", "i", "j", "piece"])
    hit = F.col("edges").isNull() | (crossings(F.col("x"), F.col("y"), F.col("edges")) % 2 == 1)
    return j.where(hit).select("region_id", "id").distinct()


def location_hits(records: DataFrame, faces: DataFrame, metres: float = 25.0) -> DataFrame:
    """(hit_kind, id_a, id_b): near pairs of records, and records within land-use faces."""
    pts = located(records)
    near = near_pairs(pts, metres).select(F.lit("near").alias("hit_kind"), "id_a", "id_b")
    shapes = faces.where("face_id is not null").groupBy("face_id").agg(F.max_by("geometry_wkt", F.struct("loaded_at", "geometry_wkt")).alias("wkt")).select(F.col("face_id").cast("string").alias("id"), "wkt")
    within = points_within(pts, shapes).select(F.lit("within").alias("hit_kind"), F.col("region_id").alias("id_a"), F.col("id").alias("id_b"))
    return near.unionByName(within)
