"""Variant spellings of names typed by people (problem 4).

Names and the addresses written beside them are vectors of weighted n-grams. Records listed in no entity meet entities,
and each other, in a sparse join: on the first terms of their joint vectors, rare ones first, so many that a pair which
shares none of them stays below the threshold; and on all syllables of the name, road and door, or a location cell together
with half the syllables, whose pairs count for averages below it too. Candidates get their cosines, and average-linkage clustering joins the
records to the groups of names: the least average cosine at which two groups are one is THRESHOLD.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_id
from ..runtime import Cut, small
from .grams import ADDRESS, NAME, cells_around, idf_of, reaches, with_cosines, with_prefixes
from .pairs import group_join
from .places import fill_districts, one_per_record, parsed
from .survivors import latest_entities

#: Least average cosine of two groups that are one.
THRESHOLD = 0.5
#: Share of the address in the squared length of a vector that has both parts.
BESIDE = 0.4
#: From this average on, a record whose nearest group is an entity beyond a tie joins it at once; only the others meet each other.
SURE = 0.7
#: Two entities whose averages differ by no more than this are equally likely.
TIE = 0.01
#: Side of the cells in which locations meet, and the reach of a record, in degrees.
CELL, REACH = 0.0006, 0.0004


def entity_names(entities: DataFrame) -> DataFrame:
    """The parsed canonical name of each entity: eid, canonical_name and the columns of a parsed record."""
    c = F.col
    as_records = entities.select(
        c("eid").alias("source_record_id"), F.lit("").alias("source_system"), c("canonical_name").alias("name_raw"), F.lit(None).cast("string").alias("address_raw"), c("province").alias("province_raw"),
        c("city").alias("city_raw"), c("district").alias("district_raw"), c("street").alias("street_raw"), F.lit(None).cast("double").alias("point_raw_lng"), F.lit(None).cast("double").alias("point_raw_lat"), F.lit(None).cast("string").alias("geometry_raw_wkt"),
    )
    return parsed(as_records, raw=True).drop("bx", "by", "ckey").withColumnRenamed("rid", "eid").withColumnRenamed("name_raw", "canonical_name").drop("sys")


def _hash(tag: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(tag), *cols)


def rare_terms(probe: bool) -> Column:
    """The hashed rare n-grams of a mention, null ones among them: all syllables within its district, road and door (odd numbers),
    location cells (even ones; a probe reaches into the cells around)."""
    c = F.col
    named = c("kind") != ""
    sure = lambda k: k.bitwiseOR(F.lit(1))
    one = F.array(
        F.when(named, sure(_hash("w", c("city"), c("district"), c("kind"), c("parts"), c("bag")))),
        F.when(named & (c("door") != "") & (c("road") != ""), sure(_hash("d", c("city"), c("parts"), F.translate("road", "大", ""), c("door")))))
    near = named & c("x").isNotNull()
    if not probe:
        return F.concat(one, F.array(F.when(near, cells_around(c("x"), c("y"), CELL, None, c("parts"))[0].bitwiseAND(F.lit(-2)))))
    cells = F.transform(cells_around(c("x"), c("y"), CELL, F.lit(REACH), c("parts")), lambda k: k.bitwiseAND(F.lit(-2)))
    return F.concat(one, F.when(near, cells).otherwise(F.array().cast("array<bigint>")))


def fits(a: str = "_a", b: str = "_b") -> Column:
    """Whether two mentions can name one place at all: same kind and parts, no other ending, no other district. Phases,
    sub-areas and courtyards are places of their own."""
    l, r = (lambda k: F.col(k + a)), (lambda k: F.col(k + b))  # noqa: E741
    district = (l("district") == "") | (r("district") == "") | (l("district") == r("district"))
    return (l("kind") == r("kind")) & (l("parts") == r("parts")) & _overlap("ends" + a, "ends" + b) & district & (l("city") == r("city"))


def similarity(name: Column, address: Column) -> Column:
    """Cosine of two vectors of a name part and an address part from the cosines of the parts."""
    return F.when(address.isNotNull(), (1 - BESIDE) * name + BESIDE * address).otherwise((1 - BESIDE) ** 0.5 * name)


def average_linkage(edges: DataFrame, threshold: float) -> DataFrame:
    """(a, root): the group that each cluster `a` was joined to, by average linkage.

    `edges` are rows (a, b, sum, n, m): the sum of the similarities of all pairs between the clusters a and b of n and m
    mentions (pairs without row count 0); `a` is a free cluster, `b` a free one (each such edge in both directions) or a fixed one,
    whose id starts with "=". In a round every free cluster whose nearest one (by average, at least `threshold`) is fixed, or
    the smaller of two that are nearest to each other, joins it, and averages are taken anew; it ends when nothing
    joins. Fixed clusters are never joined; a cluster as near to two fixed ones joins neither.
    """
    now = Cut(edges.select("a", "b", "sum", "n", "m"), "edges")
    joined: list[Cut] = []
    while True:
        e = now.df.withColumn("avg", F.col("sum") / (F.col("n") * F.col("m"))).where(F.col("avg") >= threshold)
        w = Window.partitionBy("a")
        fixed = F.col("b").startswith("=")
        best = e.withColumns({"top": F.max(F.when(fixed, F.col("avg"))).over(w)}).groupBy("a").agg(
            F.max_by("b", F.struct(F.round("avg", 9), fixed.cast("int"), F.hash("b"))).alias("b"), F.max("n").alias("n"), F.max("avg").alias("avg"),
            F.count(F.when(fixed & (F.col("avg") >= F.col("top") - TIE), 1)).alias("ties"))
        best = Cut(best.where(~(F.col("b").startswith("=") & (F.col("ties") > 1))).select("a", "b", "n"), "nearest").df
        mutual = best.alias("p").join(best.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).select(F.least("p.a", "p.b").alias("b")).distinct()
        moves = best.where(F.col("b").startswith("=")).unionByName(best.join(mutual, "b").where("a <> b").join(mutual.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b", "n"))
        seen = Observation()
        step = Cut(moves.select("a", F.col("b").alias("root"), "n").observe(seen, F.count(F.lit(1)).alias("n")), "moves")
        if not seen.get["n"]:
            break
        joined.append(step)
        move = step.df.select("a", "root")
        grown = step.df.groupBy("root").agg(F.sum("n").alias("more"))
        # both ends of the edges move; edges from a cluster that joined a fixed one are gone
        e = now.df.join(move, "a", "left").withColumn("a2", F.coalesce("root", "a")).drop("root").join(move.withColumnRenamed("a", "b"), "b", "left").withColumn("b2", F.coalesce("root", "b")).drop("root")
        e = e.where("not startswith(a2, '=') and a2 <> b2").groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.sum("sum").alias("sum"), F.max(F.when(F.col("a") == F.col("a2"), F.col("n"))).alias("n"), F.max(F.when(F.col("b") == F.col("b2"), F.col("m"))).alias("m"))
        e = e.join(grown.select(F.col("root").alias("a"), F.col("more").alias("na")), "a", "left").join(grown.select(F.col("root").alias("b"), F.col("more").alias("mb")), "b", "left")
        e = e.select("a", "b", "sum", (F.coalesce("n", F.lit(1)) + F.coalesce("na", F.lit(0))).alias("n"), (F.coalesce("m", F.lit(1)) + F.coalesce("mb", F.lit(0))).alias("m"))
        old, now = now, Cut(e, "edges")
        old.drop()
    if not joined:
        return now.df.select("a", F.col("b").alias("root")).limit(0)
    out = joined[-1].df.select("a", "root")
    for c in reversed(joined[:-1]):  # a root of an earlier round may have joined another later
        earlier = c.df.select("a", F.col("root").alias("r")).join(out.select(F.col("a").alias("r"), "root"), "r", "left").select("a", F.coalesce("root", "r").alias("root"))
        out = Cut(out.unionByName(earlier), "joined").df
    return out


def _asks(free: DataFrame, known: DataFrame) -> DataFrame:
    """`free` with a row for each district of its city where a record's district is unknown."""
    districts = small(Cut(known.where("district <> ''").groupBy("city").agg(F.collect_set("district").alias("ds")), "city-districts"))
    return free.join(districts, "city", "left").withColumn("district", F.explode(F.when((F.col("district") == "") & F.col("ds").isNotNull(), F.col("ds")).otherwise(F.array("district")))).drop("ds")


def _overlap(a: str, b: str) -> Column:
    """Whether two columns of endings don't contradict each other."""
    l, r = F.col(a), F.col(b)  # noqa: E741
    return (l == "") | (r == "") | F.arrays_overlap(F.split(l, r"\|"), F.split(r, r"\|"))


def candidates(asks: DataFrame, known: DataFrame, key: str, idf: np.ndarray) -> DataFrame:
    """Pairs (rid, key) of records (`asks`) that can reach the threshold with one of the rows of `known` that `key` names, and those that share
    a rare n-gram with one. Mentions whose cosine is THRESHOLD or more share a term of the beginnings of their vectors."""
    side = lambda d, k, probe, s: d.select(k, F.col("mask").alias(f"mask{s}"), F.explode(rare_terms(probe)).alias("k")).where("k is not null").distinct()
    shared = 2 * F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b"))) >= F.least(F.bit_count("mask_a"), F.bit_count("mask_b"))
    alike = (F.col("k").bitwiseAND(F.lit(1)) == 1) | shared
    rare = group_join(side(known, key, False, "_b"), side(asks, "rid", True, "_a"), ["k"], key).where(alike).select("rid", key)
    within = ["city", "district", "kind", "parts"]
    # endings as bits: those that don't contradict share one, a blank has all
    bits = F.when(F.col("ends") == "", F.lit(-1).cast("bigint")).otherwise(F.aggregate(F.split("ends", r"\|"), F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(F.pow(F.lit(2.0), F.crc32(e.cast("binary")) % 62).cast("bigint"))))
    begin = lambda d, k, s: with_prefixes(d, idf, [k, "ends", *within], BESIDE, THRESHOLD).select(k, bits.alias(f"ends{s}"), F.inline("terms"), *within).select(k, f"ends{s}", F.col("w").alias(f"w{s}"), F.col("rest").alias(f"rest{s}"), F.xxhash64(*within, "t").alias("k"))
    near = group_join(Cut(begin(known, key, "_b"), "index").df, begin(asks, "rid", "_a"), ["k"], key).where((F.col("ends_a").bitwiseAND(F.col("ends_b")) != 0) & reaches(THRESHOLD)).select("rid", key)
    return rare.unionByName(near).distinct()


def link_variants(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(canonical_entity_id, source_record_id): records listed in no entity whose name is a variant of an entity's.

    Names equal to the canonical one as strings and blank names give no row. Phases, sub-areas, courtyards and districts
    must be the same and endings must not contradict each other; else the average cosine of the clustering decides. A record
    that is equally near to two entities gives no row. Deliveries of one record are one; empty tables give no row.
    """
    ents = Cut(latest_entities(entities).select("eid", "canonical_name", "province", "city", "district", "street", "member_source_record_ids"), "entities").df
    members = ents.select("eid", F.explode("member_source_record_ids").alias("m")).select("eid", norm_id(F.col("m")).alias("rid")).where("rid is not null").distinct()
    rows = one_per_record(parsed(records, raw=True, boxes=False).drop("sys", "bx", "by", "ckey"))
    rows = fill_districts(Cut(rows.join(members.dropDuplicates(["rid"]), "rid", "left"), "places").df)
    canon = Cut(entity_names(ents).where("kind <> ''"), "canonical").df
    free = rows.where("eid IS NULL AND kind <> ''").drop("eid")
    listed = rows.where("eid IS NOT NULL AND kind <> ''").drop("name_raw", "rid")
    known = Cut(listed.unionByName(canon.drop("canonical_name")), "mentions").df
    idf = idf_of(canon)
    cols = ["kind", "parts", "district", "bag", *NAME, *ADDRESS]
    side = lambda d, s, *keys: d.select(*keys, *[F.col(c).alias(f"{c}{s}") for c in cols])

    def scored(pairs: DataFrame) -> DataFrame:
        """The pairs (rid, eid) with the averages over the entity's mentions, as an edge of the clustering."""
        facing = pairs.join(side(free, "_a", "rid"), "rid").join(side(known, "_b", "eid"), "eid").withColumn("ok", fits())
        cos = with_cosines(facing, idf, ["rid", "eid", "ok"])
        s = cos.groupBy("rid", "eid").agg(F.count(F.lit(1)).alias("m"), F.avg("name_cos").alias("name"), F.avg("addr_cos").alias("addr"), F.count_if(F.col("ok")).alias("ok"))
        return s.where("ok * 2 > m").select("rid", "eid", F.concat(F.lit("="), "eid").alias("b"), (similarity(F.col("name"), F.col("addr")) * F.col("m")).alias("sum"), F.lit(1).alias("n"), "m")

    asks = _asks(free, known)
    first = Cut(scored(Cut(candidates(asks, _asks(known, known), "eid", idf), "candidates").df).where(F.col("sum") >= F.col("m") * THRESHOLD / 2), "scored").df
    avg = F.col("sum") / F.col("m")
    best = first.groupBy("rid").agg(F.max(F.struct(avg.alias("avg"), "b")).alias("z"), F.sort_array(F.collect_list(avg), False).alias("all"))  # as many as a record has candidates
    sure = best.where((F.col("z.avg") >= SURE) & (F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)) < F.col("z.avg") - TIE)).select("rid", F.col("z.b").alias("root"))
    sure = Cut(sure, "sure").df
    # the others meet all records; one that has joined an entity counts for it
    rest = asks.join(sure, "rid", "left_anti")
    own = asks.withColumnRenamed("rid", "rid2")
    each = Cut(candidates(rest, own, "rid2", idf).where("rid <> rid2"), "candidates").df
    facing = each.join(side(free, "_a", "rid"), "rid").join(side(free.withColumnRenamed("rid", "rid2"), "_b", "rid2"), "rid2").where(fits())
    between = with_cosines(facing, idf, ["rid", "rid2"]).select("rid", "rid2", similarity(F.col("name_cos"), F.col("addr_cos")).alias("sum")).where(F.col("sum") >= THRESHOLD / 2)
    between = between.join(sure.select(F.col("rid").alias("rid2"), "root"), "rid2", "left").select(F.col("rid").alias("a"), F.coalesce("root", "rid2").alias("b"), "sum", F.lit(0).alias("m"))
    more = sure.groupBy(F.col("root").alias("b")).agg(F.count(F.lit(1)).alias("more"))
    size = known.groupBy(F.concat(F.lit("="), "eid").alias("b")).agg(F.count(F.lit(1)).alias("m0"))
    edges = first.join(sure, "rid", "left_anti").select(F.col("rid").alias("a"), "b", "sum", "m").unionByName(between).groupBy("a", "b").agg(F.sum("sum").alias("sum"))
    edges = edges.join(size, "b", "left").join(more, "b", "left").select("a", "b", "sum", F.lit(1).alias("n"), (F.coalesce("m0", F.lit(1)) + F.coalesce("more", F.lit(0))).cast("int").alias("m"))
    groups = average_linkage(edges, THRESHOLD)
    chosen = groups.unionByName(sure.withColumnRenamed("rid", "a")).where("startswith(root, '=')").select(F.col("a").alias("rid"), F.expr("substring(root, 2)").alias("eid"))
    names = chosen.join(free.select("rid", "name_raw"), "rid").join(canon.select("eid", "canonical_name"), "eid")
    return names.where("name_raw <> canonical_name").select(F.col("eid").alias("canonical_entity_id"), F.col("rid").alias("source_record_id")).distinct()
