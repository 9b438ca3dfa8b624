"""Connected components, canonical records and hierarchies of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut

#: Endings taken off to find the estate of a phase or compound.
ESTATE_SUFFIXES = ("一期", "二期", "三期", "四期", "东区", "西区", "南区", "北区", "号院")


def connected_components(vertices: DataFrame, edges: DataFrame, key: str = "id", max_rounds: int = 60) -> DataFrame:
    """(key, component): every vertex with the smallest key it is connected to; vertices without an edge are alone.

    Alternating large-star and small-star steps: every step points neighbours at the smallest of them, so the
    longest chain shrinks by half and no vertex gathers its neighbours in one row.
    """
    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = Cut(directed(edges.where("a is not null and b is not null")), "edges")
    seen = None
    for _ in range(max_rounds):
        e = now.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = directed(large)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = Cut(directed(small), "edges")
        mark = tuple(new.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        now.drop()
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"connected_components: not stable after {max_rounds} rounds")
    roots = now.df.groupBy(F.col("a").alias(key)).agg(F.min("b").alias("root"))
    return vertices.select(key).distinct().join(roots, key, "left").select(key, F.coalesce("root", key).alias("component"))


def canonical_records(members: DataFrame, group: str, key: str, name: str, score: str) -> DataFrame:
    """One canonical row per group: the longest name (smallest key on ties), the key with the best score (smallest
    key on ties), members and confidence (.98 for several members, .92 for one)."""
    m = members.where(F.col(group).isNotNull())
    return m.groupBy(group).agg(
        F.min_by(name, F.struct(-F.length(F.trim(name)), F.col(key))).alias("canonical_name"),
        F.min_by(key, F.struct(-F.coalesce(score, F.lit(-1.0)), F.col(key))).alias("best_key"), F.count(F.lit(1)).alias("member_count"),
    ).withColumn("identity_confidence", F.when(F.col("member_count") > 1, 0.98).otherwise(0.92))


def hierarchy(places: DataFrame, key: str, city: str, name: str) -> DataFrame:
    """(key, base, role, group_id): places grouped by the name without an estate's endings; groups of several have
    an estate (the place named like the base, or the group itself) and its phases or compounds."""
    cut = F.regexp_replace(F.col(name), "[甲乙丙丁]?[0-9一二三四五六七八九十]*(" + "|".join(ESTATE_SUFFIXES) + ")$", "")
    base = F.when(F.length(cut) >= 2, cut).otherwise(F.col(name))
    d = places.select(key, city, name, base.alias("base"))
    n = d.groupBy(city, "base").agg(F.count(F.lit(1)).alias("n"))
    role = F.when(F.col(name) == F.col("base"), "ESTATE").when(F.col(name).rlike("期$"), "PHASE").otherwise("COMPOUND")
    return d.join(n, [city, "base"]).where("n > 1").select(key, "base", role.alias("role"), F.xxhash64(city, "base").alias("group_id"))
