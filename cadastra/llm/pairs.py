"""Pairs of members of groups, with hot groups cut into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, small

#: Members of one group that one task piece takes.
PIECE = 1_000


def group_pairs(members: DataFrame, keys: list[str], key: str, keep: Column | None = None) -> DataFrame:
    """All pairs of members of one group, the smaller `key` first: columns keys, then every other column of
    `members` with the suffixes _a and _b. `keep` may use these columns; it is applied inside the join.

    A group with more than PIECE members is cut by the hash of the key on one side and repeated on the other,
    so that no task meets the whole group.
    """
    rest = [c for c in members.columns if c not in keys]
    hot = members.groupBy(*keys).count().where(F.col("count") > PIECE).select(*keys, F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    hot = small(Cut(hot, "hot-groups"))
    m = members.join(hot, keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    a = m.select(*keys, F.pmod(F.xxhash64(key), F.col("pieces")).cast("int").alias("piece"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = m.select(*keys, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), *[F.col(c).alias(f"{c}_b") for c in rest])
    cond = F.col(f"{key}_a") < F.col(f"{key}_b")
    return a.join(b.hint("merge"), [*keys, "piece"]).where(cond if keep is None else cond & keep).drop("piece")


def group_join(big: DataFrame, other: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Inner equi-join of `big` with `other` on `keys`; the rows of a key that is hot in `big` are cut into
    pieces by the hash of `key`, and the key's rows of `other` go to all its pieces."""
    hot = big.groupBy(*keys).count().where(F.col("count") > PIECE).select(*keys, F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    hot = small(Cut(hot, "hot-keys"))
    a = big.join(hot, keys, "left").withColumn("piece", F.pmod(F.xxhash64(key), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    b = other.join(hot, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return a.join(b, [*keys, "piece"]).drop("piece")
