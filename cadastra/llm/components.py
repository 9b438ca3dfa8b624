"""Consolidating pairwise matches into groups (problem 1).

Hash-to-min on rows: the cluster set of vertex v is the rows (v, u). In a round every vertex sends its set to its
smallest member and that member to all others. After a round the sets are symmetrical, so they are kept as links
(u, m) with m < u. A star (a smallest member whose neighbours have no other link) is a whole group and leaves the
rounds; they end when no link is left. The sets are rows, never arrays, and the rows of a vertex with many links are
spread over as many pieces as the number of its links asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import norm_id, trimmed
from ..runtime import Cut

#: Links of one vertex that one task piece takes in a join.
PIECE = 20_000
LINK_TYPES = ("EXACT_DUPLICATE", "SAME_ENTITY_ALT_BOUNDARY")


def accepted_links(relations: DataFrame) -> DataFrame:
    """Rows (a, b) of the relations whose latest row links its records.

    Ids and types are compared without outer blanks and regardless of case. A revision replaces the
    earlier rows of its relation_id; of rows with equal created_at the greatest (type, subject, object)
    counts, a null created_at is the oldest; a row without relation_id is a relation of its own two
    records. Self links, links with a blank end and mirrored copies give nothing more.
    """
    r = relations.select(
        norm_id(F.col("relation_id")).alias("rid"), norm_id(F.col("subject_record_id")).alias("a"), norm_id(F.col("object_record_id")).alias("b"),
        F.upper(trimmed(F.col("relation_type"))).alias("kind"), F.col("created_at").alias("at"),
    )
    r = r.withColumn("rid", F.coalesce("rid", F.concat_ws("|", F.lit(""), "a", "b")))
    last = r.groupBy("rid").agg(F.max(F.struct("at", "kind", "a", "b")).alias("z")).select("z.*")
    return last.where(F.col("kind").isin(*LINK_TYPES) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")


def _ends(links: DataFrame) -> DataFrame:
    """Both directions (v, u) of the links (u, m)."""
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("u").alias("u")))).alias("e")).select("e.*")


def _round(links: DataFrame, pieces: int) -> DataFrame:
    """One round over the links (u, m): the new links."""
    rows = _ends(links).withColumn("s", F.pmod(F.hash("u"), F.lit(pieces)).cast("int"))
    sets = rows.groupBy("v").agg(F.min("u").alias("low"), F.collect_set("s").alias("ss"))  # ss has at most `pieces` values
    sets = sets.select("v", F.least("v", "low").alias("m"), "ss")
    spread = rows.join(sets.select("v", "m", F.explode("ss").alias("s")), ["v", "s"]).select("u", "m") if pieces > 1 else rows.join(sets.select("v", "m"), "v").select("u", "m")
    return spread.unionByName(sets.select(F.col("v").alias("u"), "m")).where("u <> m").repartition("u").distinct()


def _marked(links: DataFrame) -> DataFrame:
    """The links with `done`, whether they belong to a star, and `n`, the number of links of their smaller end."""
    at = _ends(links).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low"))
    up = links.join(at.select(F.col("v").alias("u"), (F.col("n") == 1).alias("leaf")), "u")
    hubs = up.groupBy("m").agg(F.min("leaf").alias("star"))
    hubs = hubs.join(at.select(F.col("v").alias("m"), "n", "low"), "m").select("m", "n", (F.col("star") & (F.col("low") > F.col("m"))).alias("done"))
    return links.join(hubs, "m").select("u", "m", "n", "done")


def hash_to_min(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (id, group_id): every end of `links` (a, b) with the smallest id linked with it directly or in chains.

    An empty table gives no row; null ends and self links are dropped, repeated and mirrored links count once. Links
    that are not consolidated after `max_rounds` rounds raise an error.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct()
    out: list[Cut] = []

    def write(df: DataFrame) -> tuple[int, int]:
        """Writes a round; (links not yet done, most links of one of their vertices) are counted in the write."""
        seen = Observation()
        left = ~F.col("done")
        out.append(Cut(df.observe(seen, F.count(F.when(left, 1)).alias("left"), F.max(F.when(left, F.col("n"))).alias("most")), "clusters"))
        return seen.get["left"] or 0, seen.get["most"] or 0

    left, most = write(_marked(links))
    rounds = 0
    while left:
        if rounds == max_rounds:
            raise RuntimeError(f"hash_to_min: {left} links not consolidated after {max_rounds} rounds")
        left, most = write(_marked(_round(out[-1].df.where("not done").select("u", "m"), max(1, math.ceil(most / PIECE)))))
        rounds += 1
    done = [c.df.where("done").select("u", "m") for c in out]
    for d in done[1:]:
        done[0] = done[0].unionByName(d)
    each = done[0].select(F.col("u").alias("id"), F.col("m").alias("group_id"))
    return each.unionByName(done[0].select(F.col("m").alias("id"), F.col("m").alias("group_id")).distinct())


def relation_groups(relations: DataFrame) -> DataFrame:
    """(source_record_id, group_id) of every record in a group of two or more."""
    return hash_to_min(accepted_links(relations)).select(F.col("id").alias("source_record_id"), "group_id")
