"""Parsed source records: name parts, address parts and location, one row per record (problems 3, 4 and 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank, norm_id, sphere_m, trimmed, usable_box, usable_point
from ..runtime import Cut, small
from .address_parts import parse_address
from .name_parts import parse_name

#: Widths of the cells whose usual district fills in for a missing one, in degrees; the finer ones are asked first.
CELLS = (0.002, 0.008)
#: Share of a cell's or street office's records that must agree on a district.
AGREE = 0.98
_NAME = ("kind", "core", "sound", "bag", "ends", "parts")


@lru_cache(maxsize=100_000)
def syllable_mask(bag: str) -> int:
    """The syllables as bits of a signed 64-bit number; all bits for no syllable, so that a blank name shares with any."""
    m = 0
    for y in bag.split():
        m |= 1 << zlib.crc32(y.encode()) % 64
    return (m if m < 1 << 63 else m - (1 << 64)) if m else -1



_ADDRESS = ("city", "district", "office", "road", "door")


def parsed(records: DataFrame, names: bool = True, addresses: bool = True, raw: bool = False, boxes: bool = True, typed: bool = False) -> DataFrame:
    """(rid, sys, x, y, bx, by, kind, core, sound, bag, ends, parts, mask, ckey, city, district, office, road, door), a row per delivery.

    ckey is the characters of the name's core in order of their codes (empty for names in Latin letters).
    (x, y) is the location, (bx, by) the middle of the usable polygon
    (without `boxes` only where the point is not usable). With `raw` the typed name comes too, with `typed` the road's characters are those typed. Fields that a text leaves out, or all of a blank text, are empty strings; rows without an id are left out.
    """
    c = F.col
    base = records.select(
        norm_id(c("source_record_id")).alias("rid"), F.upper(trimmed(c("source_system"))).alias("sys"),
        F.when(usable_point(c("point_raw_lng"), c("point_raw_lat")), c("point_raw_lng")).alias("px"), F.when(usable_point(c("point_raw_lng"), c("point_raw_lat")), c("point_raw_lat")).alias("py"),
        (usable_box(c("geometry_raw_wkt")) if boxes else F.when(~usable_point(c("point_raw_lng"), c("point_raw_lat")), usable_box(c("geometry_raw_wkt")))).alias("box"), "name_raw", "address_raw", "province_raw", "city_raw", "district_raw", "street_raw",
    ).where("rid is not null")
    middle = {"bx": (c("box.x0") + c("box.x1")) / 2, "by": (c("box.y0") + c("box.y1")) / 2}
    base = base.select("rid", "sys", F.coalesce("px", middle["bx"]).alias("x"), F.coalesce("py", middle["by"]).alias("y"), *[v.alias(k) for k, v in middle.items()], "name_raw", "address_raw", "province_raw", "city_raw", "district_raw", "street_raw")
    fields = [*(_NAME if names else ()), *_ADDRESS]
    head = ["rid", "sys", "x", "y", "bx", "by", *(["name_raw"] if raw else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, addr, prov, city, dist, street = (b.column(k).to_pylist() for k in range(6, 12))
            cols: list[list[str]] = [[] for _ in fields]
            adds = [col.append for col in cols]
            for n, a, p, c, d, s in zip(name, addr, prov, city, dist, street, strict=True):
                q = parse_address(a if addresses else None, p, c, d, s, typed)
                district = q.district
                if names:
                    m = parse_name(n, p, c, d)
                    district = district or m.district[:-1]
                    row = (m.kind, m.core, m.sound, m.bag, m.ends, m.parts, q.city, district, q.office, q.road, q.door)
                else:
                    row = (q.city, district, q.office, q.road, q.door)
                for add, v in zip(adds, row, strict=True):
                    add(v)
            mask = [pa.array(map(syllable_mask, cols[3]), pa.int64())] if names else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(head)], *(pa.array(col, pa.string()) for col in cols), *mask], names=[*head, *fields, *(["mask"] if names else [])])

    out = base.mapInArrow(run, "rid string, sys string, x double, y double, bx double, by double, " + ", ".join(f"{f} string" for f in (*head[6:], *fields)) + (", mask bigint" if names else ""))
    return out.withColumn("ckey", F.array_join(F.array_sort(F.split("core", "")), "")) if names else out


def metres_apart(a: str, b: str) -> Column:
    """The least distance between the locations and polygons of two parsed records (column suffixes a and b)."""
    c = F.col
    ways = [sphere_m(c(p[0] + a), c(p[1] + a), c(q[0] + b), c(q[1] + b)) for p in (("x", "y"), ("bx", "by")) for q in (("x", "y"), ("bx", "by"))]
    return F.least(*ways)


def one_per_record(rows: DataFrame) -> DataFrame:
    """One row per rid: deliveries of a record have the same content; should they differ, one of them counts."""
    return rows.repartition("rid").dropDuplicates(["rid"])


def _district_keys() -> list[Column]:
    """The hashed keys under which a record asks for its district and tells it, the most telling first: its street office in
    its city, then its location cells; null where it has none."""
    c = F.col
    office = F.when((c("office") != "") & (c("city") != ""), F.xxhash64(F.lit("o"), "city", "office"))
    return [office, *[F.when(c("x").isNotNull(), F.xxhash64(F.lit(n), F.floor(c("x") / w), F.floor(c("y") / w))) for n, w in enumerate(CELLS)]]


def fill_districts(rows: DataFrame) -> DataFrame:
    """`rows` (a cut table with city, district, office, x, y, rid) with an empty district, or city, filled by the usual one of the street
    office, then of the location cell; where none tells, it stays empty. Only the keys of rows that lack one are counted."""
    c = F.col
    lacks = (c("district") == "") | (c("city") == "")
    asked = rows.where(lacks).select("rid", c("city").alias("own"), F.posexplode(F.array(*_district_keys())).alias("n", "k")).where("k is not null")
    keys = small(Cut(asked.select("k").distinct(), "asked"))
    told = rows.where(~lacks).select("city", "district", F.explode(F.array(*_district_keys())).alias("k")).join(keys, "k", "left_semi")
    votes = told.groupBy("k", "city", "district").count()
    best = votes.groupBy("k").agg(F.max_by(F.struct("city", "district"), F.struct("count", "city", "district")).alias("best"), (F.max("count") / F.sum("count")).alias("share"), F.sum("count").alias("n_told"))
    best = best.where((c("share") >= AGREE) & (c("n_told") >= 3)).select("k", "best")
    answer = asked.join(best, "k").where((c("own") == "") | (c("own") == c("best.city"))).groupBy("rid").agg(F.min_by("best", "n").alias("best"))
    filled = rows.where(lacks).join(answer, "rid", "left").withColumns({
        "district": F.when(c("district") != "", c("district")).otherwise(F.coalesce("best.district", F.lit(""))), "city": F.when(c("city") != "", c("city")).otherwise(F.coalesce("best.city", F.lit("")))})
    return rows.where(~lacks).unionByName(Cut(filled.select(*rows.columns), "filled").df)
