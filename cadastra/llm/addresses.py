"""Same postal address written differently (problem 3).

Addresses are cut into tokens (city, district, characters of the road, side, kind, door). The roads of a city, as typed, meet
by MinHash bands over token and q-gram shingles and are verified by an affine-gap alignment of their tokens in which
abbreviations and look-alike characters of the dictionaries cost little. Records of one door on one road, or on roads that
the alignment links, denote the same location.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sphere_m
from ..runtime import Cut, small
from .hanzi import CONFUSED_ROAD
from .pairs import group_join, group_pairs
from .places import fill_districts, one_per_record, parsed

#: Bands of so many MinHash rows: roads with a similarity of 3/11 (one other character) meet with a probability above 0.99.
BANDS, ROWS = 64, 2
#: Costs of the alignment: a gap and its continuation, another character, one of a misspelt road, a kind of the dictionary or a
#: "great" before it, and a look-alike.
GAP_OPEN, GAP_MORE, SUBSTITUTE, RARE, DICTIONARY, LOOKALIKE = 0.8, 0.3, 1.0, 0.45, 0.4, 0.2
#: Roads up to SAME_COST apart are one road; up to MAX_COST if the places say so.
SAME_COST, MAX_COST = 0.2, 0.5
#: A road with less than this share of the other's records in its city may be a misspelling of it.
RARE_SHARE = 0.1
#: Records on roads that only the places can tell must lie this near, unless more than this share of the two roads' located pairs does.
NEAR_M, ONE_ROAD = 80.0, 0.5
#: Kinds of road that are written for one another.
ALIKE = frozenset({("路", "道"), ("道", "路"), ("街", "道"), ("道", "街")})


def _tokens(road: str) -> tuple[list[str], int]:
    """The characters of base, side and kind of a road (base|side|kind), and the length of the base."""
    base, side, kind = road.split("|")
    return [*base, *side, *kind], len(base)


@lru_cache(maxsize=100_000)
def align(a: str, b: str, rare: bool) -> float:
    """Affine-gap alignment cost of two roads (base|side|kind); a misspelt one (`rare`) may differ cheaply in one character of its base."""
    (xs, nx), (ys, ny) = _tokens(a), _tokens(b)
    far = float("inf")
    n, m = len(xs), len(ys)
    best = [[far] * (m + 1) for _ in range(n + 1)]
    up, left = [row[:] for row in best], [row[:] for row in best]
    best[0][0] = 0.0
    gap = lambda c, inside: DICTIONARY if c == "大" and not inside else GAP_OPEN
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = min(best[i - 1][j] + gap(xs[i - 1], i <= nx), up[i - 1][j] + GAP_MORE)
            if j:
                left[i][j] = min(best[i][j - 1] + gap(ys[j - 1], j <= ny), left[i][j - 1] + GAP_MORE)
            if i and j:
                x, y = xs[i - 1], ys[j - 1]
                inside = i <= nx and j <= ny
                if x == y:
                    cost = 0.0
                elif inside:
                    fold = lambda c: CONFUSED_ROAD.get(ord(c), c)
                    cost = LOOKALIKE if fold(x) == fold(y) else RARE if rare else SUBSTITUTE
                else:
                    cost = DICTIONARY if (x, y) in ALIKE else SUBSTITUTE
                best[i][j] = best[i - 1][j - 1] + cost
            best[i][j] = min(best[i][j], up[i][j], left[i][j])
    return best[n][m]


def _verified(pairs: DataFrame) -> DataFrame:
    """The columns of `pairs` (road_a, road_b, rare, ...) with the alignment's cost."""
    names = pairs.columns
    at = [names.index(k) for k in ("road_a", "road_b", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [align(*x) for x in zip(*(b.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cost, pa.float64())], names=[*names, "cost"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", cost double")


def shingles() -> Column:
    """Token and q-gram shingles of a road (base|side|kind): the characters of the base with their places, the base, and each
    character with the side and with the kind without "great". Roads that share no character of the base share none."""
    base, side, kind = (F.element_at(F.split("road", r"\|"), k) for k in (1, 2, 3))
    one, two, k = F.substring(base, 1, 1), F.substring(base, 2, 1), F.translate(kind, "大", "")
    return F.array(F.concat(F.lit("1"), one), F.concat(F.lit("2"), two), F.concat(F.lit("b"), base), F.concat(F.lit("x"), one, k), F.concat(F.lit("y"), two, k), F.concat(F.lit("v"), one, side), F.concat(F.lit("w"), two, side))


def _minhash(tokens: Column, seed: int) -> Column:
    return F.array_min(F.transform(tokens, lambda s: F.xxhash64(s, F.lit(seed))))


def candidate_roads(roads: DataFrame) -> DataFrame:
    """(city, road_a, n_a, road_b, n_b) of the roads (city, road, n) of a city that share a band and that the alignment can accept; pairs come once."""
    mins = [_minhash(F.col("sh"), k) for k in range(BANDS * ROWS)]
    bands = F.array(*[F.xxhash64(F.lit(k), *mins[k * ROWS : (k + 1) * ROWS]) for k in range(BANDS)])
    fold = F.translate(F.element_at(F.split("road", r"\|"), 1), "".join(map(chr, CONFUSED_ROAD)), "".join(CONFUSED_ROAD.values()))
    banded = roads.withColumns({"sh": shingles(), "fold": fold}).select("city", "road", "n", "fold", F.explode(bands).alias("band"))
    # another base that is no look-alike costs little only for a rare road: no other pair can be accepted
    fits = (F.col("fold_a") == F.col("fold_b")) | _rare()
    return group_pairs(banded, ["city", "band"], "road", fits).select("city", "road_a", "n_a", "road_b", "n_b").distinct()


def _rare() -> Column:
    return F.least("n_a", "n_b") < RARE_SHARE * F.greatest("n_a", "n_b")


def road_links(roads: DataFrame) -> DataFrame:
    """(city, road_a, road_b, cost) of different roads (city, road, n records) of a city that may be one."""
    p = candidate_roads(roads).withColumn("rare", _rare())
    return _verified(p).where(F.col("cost") <= MAX_COST)


def usual_writing(links: DataFrame) -> DataFrame:
    """(city, road, usual): roads that the alignment takes for a writing of a more frequent one; of several such, the
    cheapest, then the most frequent. A usual writing has no other one: chains of look-alikes are followed by one step only
    after those of the step before, so that no road is left between two writings."""
    near = links.where(F.col("cost") <= SAME_COST)
    both = near.select("city", F.col("road_a").alias("road"), "n_a", F.col("road_b").alias("usual"), "n_b", "cost").unionByName(near.select("city", F.col("road_b").alias("road"), F.col("n_b").alias("n_a"), F.col("road_a").alias("usual"), F.col("n_a").alias("n_b"), "cost"))
    up = both.where((F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("usual") < F.col("road"))))
    w = Window.partitionBy("city", "road").orderBy("cost", F.desc("n_b"), "usual")
    one = up.withColumn("k", F.row_number().over(w)).where("k = 1").select("city", "road", "usual")
    step = one.select("city", F.col("road").alias("usual"), F.col("usual").alias("next"))
    return one.join(step, ["city", "usual"], "left").select("city", "road", F.coalesce("next", "usual").alias("usual"))


def address_pairs(records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): records whose addresses name the same door.

    Blank addresses and those without house number denote no door. A missing district is taken from the
    street office or the location; if it stays unknown, the record joins the only district of its city, road and
    door. Roads that the alignment takes for writings of one are one; roads that only the places can tell are joined for
    records that lie near each other, or for all their records where most located pairs do. Every pair comes once, however many records share a door.
    """
    rows = parsed(records, names=False, boxes=False, typed=True).where("door <> '' and city <> ''")
    a = fill_districts(Cut(one_per_record(rows.select("rid", "city", "district", "office", "road", "door", "x", "y")), "doors").df).drop("office")
    links = Cut(road_links(a.groupBy("city", "road").agg(F.count(F.lit(1)).alias("n"))), "road-links").df
    writing = small(Cut(usual_writing(links), "writings"))
    a = a.join(writing, ["city", "road"], "left").withColumn("road", F.coalesce("usual", "road")).drop("usual")
    a = Cut(a, "places").df
    same = group_pairs(a.select("city", "district", "road", "door", "rid").where("district <> ''"), ["city", "district", "road", "door"], "rid").select("rid_a", "rid_b")
    lone = small(Cut(a.where("district = ''").select("city", "road", "door").distinct(), "lone"))
    met = a.select("city", "road", "door", "rid", "district").join(lone, ["city", "road", "door"], "left_semi")
    unknown = group_pairs(met, ["city", "road", "door"], "rid", (F.col("district_a") == "") | (F.col("district_b") == ""))
    several = met.where("district <> ''").groupBy("city", "road", "door").agg(F.min("district").alias("lo"), F.max("district").alias("hi")).where("lo <> hi").select("city", "road", "door")
    unknown = unknown.join(several, ["city", "road", "door"], "left_anti").select("rid_a", "rid_b")
    # roads that only the places can tell, by the writings that stand for them
    w = [writing.select("city", F.col("road").alias(f"road_{s}"), F.col("usual").alias(f"u_{s}")) for s in "ab"]
    unsure = links.join(w[0], ["city", "road_a"], "left").join(w[1], ["city", "road_b"], "left").select("city", F.coalesce("u_a", "road_a").alias("p"), F.coalesce("u_b", "road_b").alias("q"))
    unsure = small(Cut(unsure.where("p <> q").select("city", F.least("p", "q").alias("road_a"), F.greatest("p", "q").alias("road_b")).distinct(), "unsure"))
    side = lambda s: a.select("city", "door", *[F.col(c).alias(f"{c}_{s}") for c in ("district", "road", "rid", "x", "y")])
    one_side = side("a").join(unsure, ["city", "road_a"])
    cross = group_join(side("b").join(unsure.select("city", "road_b").distinct(), ["city", "road_b"], "left_semi"), one_side, ["city", "door", "road_b"], "rid_b")
    cross = cross.where((F.col("district_a") == F.col("district_b")) | (F.col("district_a") == "") | (F.col("district_b") == ""))
    dist = sphere_m(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    roads = ["city", "road_a", "road_b"]
    cross = Cut(cross.select(*roads, "district_a", "district_b", F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b"), (dist <= NEAR_M).alias("near")), "cross").df
    # two roads most of whose located pairs are near are one, for records without or with a coarse location too
    classes = [*roads, "district_a", "district_b"]
    one = cross.where("near IS NOT NULL").groupBy(*classes).agg((F.avg(F.col("near").cast("int")) > ONE_ROAD).alias("one"))
    cross = cross.join(one, classes, "left").where("near OR one").select("rid_a", "rid_b")
    return same.unionByName(unknown).unionByName(cross.distinct()).select(F.col("rid_a").alias("record_id_a"), F.col("rid_b").alias("record_id_b"))
