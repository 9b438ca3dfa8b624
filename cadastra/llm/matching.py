"""Matching entities across sources without keys (problem 6).

Records meet within their district, in numpy (`blocks`): a pair is not shuffled, and only one that may match is written, the others are
counted by their similarities. Candidate pairs share a key: a term of the beginnings of the names' n-gram vectors (all names of a cosine of NAME_ALONE
do), all syllables, road and door or a cell around the location together with a syllable (or a blank name). Each pair has a vector of continuous similarities; what one of the two does
not tell is missing from it. A regularised mixture of two Gaussians is fitted without labels by expectation-maximisation. Every
E-step is held to transitivity: a pair is at least as likely a match as the chain of two matches over a third record, and a
record without a name cannot match two places whose names differ: only the likelier one keeps its posterior. The posterior
is the confidence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_M, norm_id
from ..runtime import Cut, small
from .blocks import Postings, Rows, cells, coded, cosines_of, meeting, row_pairs, tables, term_keys, with_blocks, with_districts
from .grams import NAME, idf_of, name_units
from .pairs import group_join
from .places import fill_districts, one_per_record, parsed
from .survivors import latest_entities

#: The similarities, 0 to 1, and the number of steps to which they are rounded before they are counted: the driver gets the
#: counts of at most 51 x 51 x 3 x 4 x 3 x 3 vectors (each value may be missing), and of those times the bounds that transitivity sets, however many pairs there are.
DIMS = {"name": 50, "near": 50, "ends": 1, "road": 2, "door": 1, "office": 1}
#: Added to the variance of every similarity (regularisation of the mixture).
RIDGE = 0.02
#: Steps of one fit, and rounds of fit and chains; a fit ends when no posterior moves, the rounds when no
#: mean or variance moves by more than the tolerance.
STEPS, ROUNDS, TOLERANCE = 500, 8, 0.02
#: A pair with a smaller posterior than this in the first fit can become no match by transitivity (which asks for 1 - STRONG).
FAR = 0.02
#: A pair is a match from this posterior on, and strong enough to carry a chain from the second.
MATCH, STRONG = 0.5, 0.9
#: Side of the cells in which locations meet and how far a record reaches, in degrees; distance at which nearness is 1/e, in metres.
CELL, REACH, NEAR_M = 0.0006, 0.0004, 150.0
#: Cosine from which on names are compared whatever else the records tell; below it, a pair that shares neither door nor location cell is
#: not compared.
NAME_ALONE = 0.4
#: Mean similarity from which on pairs are written one by one before the mixture is fitted.
LIKELY = 0.35
#: Steepness of the start of the fit around a mean similarity of 0.7: the pairs that don't match grow as the square of a district, and with a flat
#: start their tails outweigh the matches (at 12, on check_l, 636,651 pairs were likelier matches than not, at 40 286,027).
STEEP = 40
#: A point held by records of so many names is a default or coarse one and proposes no pair.
SHARED_NAMES = 3


def posterior(x: np.ndarray, mix: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Posterior of a match for the rows of x (NaN where a similarity is missing) under (weights, means, variances)."""
    w, mu, var = mix
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    dens = [np.log(w[k]) - 0.5 * (seen * (np.log(var[k]) + (z - mu[k]) ** 2 / var[k])).sum(1) for k in (0, 1)]
    return 1 / (1 + np.exp(np.clip(dens[1] - dens[0], -500, 500)))


def fit_mixture(x: np.ndarray, counts: np.ndarray, floor: np.ndarray | None = None, start: np.ndarray | None = None, cap: np.ndarray | None = None) -> tuple[tuple, np.ndarray]:
    """(mixture, posteriors) of the similarity vectors x (rows, NaN where missing; `counts` pairs each).

    Two Gaussians with diagonal covariances and a ridge; missing values are left out of both steps. The matched one starts with the vectors
    of high mean similarity. `floor` and `cap` bound the posteriors in every E-step (transitivity).
    """
    weight = counts / counts.sum()
    seen = ~np.isnan(x)
    z = np.where(seen, x, 0.0)
    p = start if start is not None else 1 / (1 + np.exp(-STEEP * (z.sum(1) / np.maximum(seen.sum(1), 1) - 0.7)))
    for _ in range(STEPS):
        w, mu, var = np.zeros(2), np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1]))
        for k, g in enumerate((p, 1 - p)):
            gw = weight * g
            w[k] = max(gw.sum(), 1e-9)
            n = np.maximum(gw @ seen, 1e-9)
            mu[k] = (gw @ z) / n
            var[k] = (gw[:, None] * seen * (z - mu[k]) ** 2).sum(0) / n + RIDGE
        new = posterior(x, (w, mu, var))
        if floor is not None:
            new = np.maximum(new, floor)
        if cap is not None:
            new = np.minimum(new, cap)
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-4:
            break
    return (w, mu, var), p


def _distances(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least distance in metres between the locations and polygons of the rows i and j; NaN where one has neither, infinite beyond all nearness."""
    p = {k: t[k].to_numpy() for k in ("x", "y", "bx", "by")}
    out = np.full(len(i), np.nan)
    for a in (("x", "y"), ("bx", "by")):
        for b in (("x", "y"), ("bx", "by")):
            x1, y1, x2, y2 = p[a[0]][i], p[a[1]][i], p[b[0]][j], p[b[1]][j]
            d = np.where(np.isnan(x1 + y1 + x2 + y2), np.nan, np.inf)
            k = np.flatnonzero(np.abs(y2 - y1) < 10 * NEAR_M / 111_000)  # exp(-10) is no step
            y1, y2, dx = np.radians(y1[k]), np.radians(y2[k]), np.radians(x2[k] - x1[k])
            h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin(dx / 2) ** 2
            d[k] = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
            out = np.fmin(out, d)
    return out


@lru_cache(maxsize=100_000)
def _half_alike(a: str, b: str) -> bool:
    """Whether at most half the characters of two roads' names are edited."""
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return 2 * d[-1] <= max(len(a), len(b))


class Similarities:
    """The similarities of pairs of rows of a block but the name's, in steps of DIMS; -1 for a missing one."""

    def __init__(self, t: pa.Table):
        self.t = t
        text = {k: t[k].combine_chunks().dictionary_encode() for k in ("ends", "road", "door", "office")}
        self.codes = {k: v.indices.to_numpy() for k, v in text.items()}
        self.blank = {k: np.array([x == "" for x in v.dictionary.to_pylist()], bool)[self.codes[k]] for k, v in text.items()}
        ends, roads = (text[k].dictionary.to_pylist() for k in ("ends", "road"))
        sets = [set(e.split("|")) for e in ends]
        self.overlap = np.array([[bool(x & y) for y in sets] for x in sets], bool)
        number = lambda xs: np.unique(np.array(xs, object), return_inverse=True)[1]
        self.way, self.base = number([r.replace("大", "") for r in roads]), number([r.split("|")[0] for r in roads])
        self.bases = sorted({r.split("|")[0] for r in roads})
        self.two = np.array([len(b) == 2 for b in self.bases], bool)
        self.chars = np.array([(ord(b[0]), ord(b[1])) if len(b) == 2 else (0, 0) for b in self.bases], np.int64).reshape(-1, 2)

    def _bases_alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (self.chars[a] == self.chars[b]).any(1)  # of two characters, one may be edited
        for k in np.flatnonzero(~(self.two[a] & self.two[b])).tolist():
            out[k] = _half_alike(self.bases[a[k]], self.bases[b[k]])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        both = {k: ~(v[i] | v[j]) for k, v in self.blank.items()}
        c = self.codes
        near = _distances(self.t, i, j)
        steps = np.floor(np.exp(-np.where(np.isnan(near), 0.0, near) / NEAR_M) * DIMS["near"] + 0.5)
        ra, rb = c["road"][i], c["road"][j]
        road = np.where(self.way[ra] == self.way[rb], 2, 0)
        k = np.flatnonzero(both["road"] & (road == 0))
        road[k] = self._bases_alike(self.base[ra[k]], self.base[rb[k]])
        out = {"near": np.where(np.isnan(near), -1, steps), "ends": np.where(both["ends"], self.overlap[c["ends"][i], c["ends"][j]], -1), "road": np.where(both["road"], road, -1)}
        out |= {k: np.where(both[k], c[k][i] == c[k][j], -1) for k in ("door", "office")}
        return {k: v.astype(np.int8) for k, v in out.items()}


def _block_pairs(t: pa.Table, by_keys: bool, table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows that ask, rows that answer, steps of the names' cosines) in runs; each pair once.
    With `table` names meet by terms, with `by_keys` records by all syllables, door or cell."""
    col = lambda k: t[k].to_numpy(zero_copy_only=False)
    asks, answers = np.flatnonzero(col("ask")), np.flatnonzero(col("answer"))
    n, sh, listed, own, first = (col(k) for k in ("n", "sh", "listed", "own", "first"))
    form = coded(t, "kind", "parts", *NAME)
    forms, row = np.unique(form, return_index=True)
    m = len(forms)
    named = (col("kind") != "")[row]
    part = coded(t, "parts")
    left, right = Rows(form[asks], asks, m), Rows(form[answers], answers, m)
    u = name_units(zip(*(t[k].take(row).to_pylist() for k in NAME), strict=True), table) if table is not None else None

    def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (sh[i] != sh[j]) & (listed[j] | (n[i] < n[j])) & (own[i] | own[j] | first[i])

    def steps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        cos = cosines_of(u, p, q)
        return np.where(np.isnan(cos), -1, np.floor(np.where(np.isnan(cos), 0.0, cos) * DIMS["name"] + 0.5)).astype(np.int8)

    met = np.zeros(0, np.int64)
    if u is not None:
        o, terms, _, _ = u.beginnings(NAME_ALONE)
        o, terms = o[named[o]], terms[named[o]]
        k = term_keys(part[row[o]], terms)
        lo, ro = left.size[o] > 0, right.size[o] > 0
        runs = list(meeting(k[lo], o[lo], Postings(k[ro], o[ro]), m))
        met = np.concatenate(runs) if runs else met
        p, q = np.divmod(met, m)
        near = steps(p, q)
        for at, i, j in row_pairs(p, q, left, right):
            ok = kept(i, j)
            yield i[ok], j[ok], near[at[ok]]
    if by_keys:
        mask = col("mask")
        free = ~col("shared")
        blank = ~named[form]
        door = ~((col("road") == "") | (col("door") == ""))
        bag = coded(t, "parts", "bag")
        way = coded(t.append_column("way", pc.replace_substring(t["road"], "大", "")), "way", "door")
        kinds = 4  # keys of four kinds: syllables, door, cells
        at = lambda rows, c: (np.arange(t.num_rows)[rows], c[rows])
        points = lambda reach: [cells(np.where(free, col("x"), np.nan), np.where(free, col("y"), np.nan), CELL, reach), cells(col("bx"), col("by"), CELL, reach)]

        def keyed(which: np.ndarray, reach: float | None) -> tuple[np.ndarray, np.ndarray]:
            parts = [(at(which & ~blank, bag), 0), (at(which & door, way), 1), *((x, 2) for x in points(reach))]
            r = np.concatenate([x[0] for x, _ in parts])
            k = np.concatenate([x[1] * kinds + kind for x, kind in parts])
            r, k = r[which[r]], k[which[r]]
            once = np.unique(np.stack((r, k)), axis=1)
            return once[0], once[1]

        r, k = keyed(col("ask"), REACH)
        r2, k2 = keyed(col("answer"), None)
        index = Postings(k2, r2)

        def check(of: np.ndarray, hit: np.ndarray) -> np.ndarray:
            i, j = r[of], index.rows[hit]
            same_parts = blank[i] | blank[j] | (part[i] == part[j])
            return kept(i, j) & same_parts & ((k[of] % kinds == 0) | ((mask[i] & mask[j]) != 0))

        for code in meeting(k, r, index, t.num_rows, check):
            i, j = np.divmod(code, t.num_rows)
            f = form[i] * m + form[j]
            hit = np.searchsorted(met, f)
            new = np.ones(len(f), bool) if not len(met) else met[np.minimum(hit, len(met) - 1)] != f
            i, j, f = i[new], j[new], f[new]
            if u is None:
                yield i, j, np.full(len(i), -1, np.int8)
                continue
            each, back = np.unique(f, return_inverse=True)
            yield i, j, steps(*np.divmod(each, m))[back]


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    d = with_districts(rows, rows)
    d = d.withColumn("sh", F.hash("sys"))
    d = with_blocks(d, ~F.col("listed"), F.lit(True), "n")
    return d.select("block", "ask", "answer", "own", "first", "n", "sh", "listed", *columns)


def _met(rows: DataFrame, columns: list[str], by_keys: bool, idf: np.ndarray | None) -> DataFrame:
    weights = None if idf is None else rows.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            n = t["n"].to_numpy()
            for i, j, _ in _block_pairs(t, by_keys, weights and weights.value):
                yield pa.RecordBatch.from_arrays([pa.array(n[i]), pa.array(n[j])], names=["n_a", "n_b"])

    return _blocks(rows, columns).mapInArrow(run, "n_a bigint, n_b bigint").distinct()


_BY_NAME = ["kind", "parts", *NAME]
_BY_KEYS = ["mask", "bag", "road", "door", "x", "y", "bx", "by", "shared"]


def name_candidates(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(n_a, n_b) as in `candidates`: the pairs of one district whose names have a cosine of NAME_ALONE or more, and some others, whatever
    their locations and doors; such names share a term of the beginnings of their vectors."""
    return _met(rows, _BY_NAME, False, idf)


def _with_shared(rows: DataFrame) -> DataFrame:
    """`rows` with `shared`: whether the point is held by SHARED_NAMES names or more."""
    named = rows.where("x is not null and kind <> ''")
    crowded = named.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.hash("bag")).alias("lo"), F.max(F.hash("bag")).alias("hi")).where((F.col("n") >= SHARED_NAMES) & (F.col("lo") < F.col("hi")))
    # names are counted only where a point has more than one
    shared = named.join(small(Cut(crowded.select("x", "y"), "crowded-points")), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.countDistinct("bag").alias("names")).where(F.col("names") >= SHARED_NAMES)
    return rows.join(small(Cut(shared.select("x", "y", F.lit(True).alias("s")), "shared-points")), ["x", "y"], "left").withColumn("shared", F.coalesce("s", F.lit(False))).drop("s")


def candidates(rows: DataFrame) -> DataFrame:
    """(n_a, n_b): candidate pairs of records of different systems, the first of them listed in no entity. `rows` is a cut
    table with one row and number n per record. Names with other phases, sub-areas or courtyards are other places and
    don't meet; a location or door brings names together that share
    a syllable, or a blank one with any. Pairs come once.
    """
    d = _with_shared(rows)
    for k in NAME:
        d = d if k in d.columns else d.withColumn(k, F.col("bag"))
    return _met(d, [*_BY_NAME, *_BY_KEYS], True, None)


def likely(v: np.ndarray) -> np.ndarray:
    """Whether pairs with these steps (columns as DIMS, -1 for a missing one) are written one by one at once; the others are counted by vector, and looked for
    again only where the mixture says that they may match."""
    seen = v >= 0
    return np.where(seen, v / np.array(list(DIMS.values())), 0.0).sum(1) >= LIKELY * np.maximum(seen.sum(1), 1)


def compared(rows: DataFrame, idf: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """The candidate pairs (rid_a, rid_b: the numbers n, place_a, place_b, steps of the similarities, count 1) that are `likely`, and the other vectors
    with the number of their pairs and no rid; with `wanted` (vectors) the pairs of these alone."""
    dims, codes = list(DIMS), math.prod(m + 2 for m in DIMS.values())
    every = np.arange(codes)
    weights = rows.sparkSession.sparkContext.broadcast((idf, likely(_vectors(every)) if wanted is None else np.isin(every, _code(wanted))))
    schema = "rid_a bigint, rid_b bigint, place_a int, place_b int, " + ", ".join(f"{k} byte" for k in dims) + ", count bigint"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one = weights.value
        counted = np.zeros(codes, np.int64)
        for t in tables(batches):
            n, place = t["n"].to_numpy(), t["place"].to_numpy()
            sims = Similarities(t)
            for i, j, name in _block_pairs(t, True, table):
                s = sims.of(i, j) | {"name": name}
                v = np.stack([s[k] for k in dims], axis=1)
                code = _code(v)
                take = np.flatnonzero(one[code])
                if wanted is None:
                    counted += np.bincount(code, minlength=codes)
                a, b = i[take], j[take]
                a, b = np.where(n[a] < n[b], a, b), np.where(n[a] < n[b], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n[a], n[b], place[a], place[b], *v[take].T, np.ones(len(take), np.int64))], names=names)
        rest = np.flatnonzero((counted > 0) & ~one)
        if len(rest):
            none = [pa.nulls(len(rest), x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(x) for x in _vectors(rest).T), pa.array(counted[rest])], names=names)

    return _blocks(rows, [*_BY_NAME, *_BY_KEYS, "office", "place"]).mapInArrow(run, schema)


def _code(v: np.ndarray) -> np.ndarray:
    """Vectors of steps as one number each."""
    out = np.zeros(len(v), np.int64)
    for k, m in enumerate(DIMS.values()):
        out = out * (m + 2) + v[:, k] + 1
    return out


def _vectors(code: np.ndarray) -> np.ndarray:
    cols = []
    for m in reversed(DIMS.values()):
        code, v = np.divmod(code, m + 2)
        cols.append((v - 1).astype(np.int8))
    return np.stack(cols[::-1], axis=1)


def match_records(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b, confidence): matches between records of different systems, at least one of
    which no entity lists; confidence is the posterior of the mixture.

    Records with a blank name meet others by their door or location; records with neither name, door nor
    location match nothing; those of unknown district meet within the city. Repeated deliveries are one record. Where there is no candidate pair, there is no row.
    """
    listed = latest_entities(entities).select(F.explode("member_source_record_ids").alias("m")).select(norm_id(F.col("m")).alias("rid")).where("rid is not null").distinct().withColumn("l", F.lit(True))
    rows = one_per_record(parsed(records, boxes=False).drop("ckey")).join(listed, "rid", "left")
    rows = fill_districts(Cut(rows.withColumn("listed", F.coalesce("l", F.lit(False))).drop("l").withColumn("n", F.monotonically_increasing_id()), "places").df)
    idf = idf_of(rows.where("kind <> ''"))
    rows = rows.withColumn("place", F.when(F.col("kind") == "", 0).otherwise(F.hash("parts", "bag")))  # the name as one number, 0 for a blank one
    d = _with_shared(rows)
    pairs = Cut(compared(d, idf), "candidates").df
    got = posteriors(pairs, again=lambda v: Cut(compared(d, idf, v), "candidates").df).where(F.col("p") >= MATCH)
    ids = rows.select("rid", "n")
    got = got.join(ids.select(F.col("n").alias("rid_a"), F.col("rid").alias("a")), "rid_a").join(ids.select(F.col("n").alias("rid_b"), F.col("rid").alias("b")), "rid_b")
    return got.select(F.least("a", "b").alias("record_id_a"), F.greatest("a", "b").alias("record_id_b"), F.col("p").alias("confidence"))


def _caps(now: DataFrame) -> DataFrame:
    """(rid_a, rid_b, cap) of the pairs of a record without a name whose other record's place (name and parts) is not the
    likeliest among the places that it matches."""
    blank = (F.col("place_a") == 0) != (F.col("place_b") == 0)
    first = F.col("place_a") == 0
    b = now.where(blank & (F.col("p") >= MATCH)).select("rid_a", "rid_b", "p", "near", F.when(first, F.col("rid_a")).otherwise(F.col("rid_b")).alias("rid"), F.when(first, F.col("place_b")).otherwise(F.col("place_a")).alias("place"))
    # posteriors near 1 are alike: then the nearer place is the likelier
    places = b.groupBy("rid", "place").agg(F.struct(F.round(F.avg("p"), 3).alias("mean"), F.avg("near").alias("near")).alias("z"))
    top = places.groupBy("rid").agg(F.max("z").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("rid", "top")
    lower = group_join(places, top, ["rid"], "place").where("z < top").select("rid", "place", F.floor((1 - F.col("top.mean")) * 100).cast("byte").alias("cap"))
    return b.join(lower, ["rid", "place"]).groupBy("rid_a", "rid_b").agg(F.min("cap").alias("cap"))


def posteriors(pairs: DataFrame, transitive: bool = True, again: Callable[[np.ndarray], DataFrame] | None = None) -> DataFrame:
    """`pairs` (rid_a, rid_b, place_a, place_b: hashes of the name, 0 for a blank one; steps of each similarity) with the
    posterior p of the mixture fitted to them; `transitive` holds every E-step to chains of two strong matches and to one
    place for a record without a name. Where `pairs` has a column count, its rows without rid_a stand for so many pairs of a vector; `again` gives the
    pairs of such vectors that may match."""
    spark = pairs.sparkSession
    dims = list(DIMS)

    def vectors(df: DataFrame, more: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        got = df.groupBy(*dims, *more).agg((F.sum("count") if "count" in df.columns else F.count(F.lit(1))).alias("count")).collect()  # bounded by the steps of DIMS
        x = np.array([[np.nan if r[k] < 0 else r[k] / DIMS[k] for k in dims] for r in got], float).reshape(-1, len(dims))
        return x, np.array([r["count"] for r in got], float), got

    x, n, got = vectors(pairs, [])
    if not got:
        return pairs.withColumn("p", F.lit(0.0)).limit(0)
    mix, _ = fit_mixture(x, n)
    if "count" in pairs.columns:
        late = pairs.where("rid_a is null").select(*dims).distinct().collect()  # vectors, bounded likewise
        v = np.array([tuple(r) for r in late], np.int64).reshape(-1, len(dims))
        v = v[posterior(np.where(v < 0, np.nan, v / np.array(list(DIMS.values()))), mix) >= FAR]
        pairs = pairs.where("rid_a is not null")
        if len(v) and again:
            pairs = pairs.unionByName(again(v))
        pairs = pairs.drop("count")

    def scored(df: DataFrame) -> DataFrame:
        known = spark.createDataFrame([(*[r[k] for k in dims], float(v)) for r, v in zip(got, posterior(x, mix), strict=True)], ", ".join(f"{k} byte" for k in dims) + ", p double")
        return df.join(small(Cut(known, "posteriors")), dims)

    if not transitive:
        return scored(pairs)
    # pairs below FAR are far from a match and take part by their vectors only; the rounds work on the others
    held = F.least(F.greatest("p", F.col("chain") / 100), F.col("cap") / 100)
    bound = scored(pairs).where(F.col("p") >= FAR).drop("p").withColumns({"chain": F.lit(0).cast("byte"), "cap": F.lit(100).cast("byte")})
    far = posterior(x, mix) < FAR
    old: list[Cut] = []
    for _ in range(ROUNDS):
        step = Cut(scored(bound).withColumn("p", held), "scored")
        now = step.df
        # two strong matches over a third record bound an unsure pair from below
        unsure = now.where(F.col("p").between(1 - STRONG, STRONG)).select("rid_a", "rid_b")
        strong = now.where(F.col("p") >= STRONG).select("rid_a", "rid_b", "p")
        both = strong.select(F.explode(F.array(F.struct(F.col("rid_a").alias("u"), F.col("rid_b").alias("v")), F.struct(F.col("rid_b").alias("u"), F.col("rid_a").alias("v")))).alias("e"), "p").select("e.*", "p")
        one = group_join(unsure, both.select(F.col("u").alias("rid_a"), F.col("v").alias("via"), F.col("p").alias("p1")), ["rid_a"], "rid_b")
        two = one.join(both.select(F.col("u").alias("rid_b"), F.col("v").alias("via"), F.col("p").alias("p2")), ["rid_b", "via"])
        chains = two.groupBy("rid_a", "rid_b").agg(F.floor(F.max(F.col("p1") * F.col("p2")) * 100).cast("byte").alias("chain"))
        moves = chains.withColumn("cap", F.lit(None).cast("byte")).unionByName(_caps(now).withColumn("chain", F.lit(None).cast("byte"))).groupBy("rid_a", "rid_b").agg(F.max("chain").alias("c"), F.min("cap").alias("d"))
        bound = now.drop("p").join(moves, ["rid_a", "rid_b"], "left")
        kept = Cut(bound.withColumns({"chain": F.greatest("chain", F.coalesce("c", "chain")), "cap": F.least("cap", F.coalesce("d", "cap"))}).drop("c", "d"), "bound")
        bound = kept.df
        for c in (*old, step):
            c.drop()
        old = [kept]
        cx, cn, cgot = vectors(bound, ["chain", "cap"])
        floor, cap = np.array([r["chain"] / 100 for r in cgot]), np.array([r["cap"] / 100 for r in cgot])
        cx, cn, floor, cap = np.vstack((cx, x[far])), np.append(cn, n[far]), np.append(floor, np.zeros(far.sum())), np.append(cap, np.ones(far.sum()))
        new, _ = fit_mixture(cx, cn, floor, posterior(cx, mix), cap)
        moved = max(np.abs(a - b).max() for a, b in zip(new, mix, strict=True))
        mix = new
        if moved < TOLERANCE:
            break
    return scored(bound).withColumn("p", held).drop("chain", "cap")
