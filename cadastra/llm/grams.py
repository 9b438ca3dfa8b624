"""Weighted n-gram vectors of names and addresses, and cosines of many pairs at once (problems 4 and 6)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-grams are hashed into so many buckets; their document frequencies are the only thing the driver gathers.
BUCKETS = 4096
#: Weight of an ending before its inverse document frequency: it is the only n-gram that tells the kind of a place.
ENDING = 3.0
#: Sides of the location cells of an address vector, in degrees; each grid comes a second time, shifted by half a cell.
GRIDS = (0.002, 0.008)


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def name_terms(core: str, sound: str, ends: str) -> list[tuple[int, float]]:
    """The n-grams of a name as (bucket, weight before idf): syllables, pairs of syllables in any order, characters, pairs of
    characters next to each other, and the endings it may have."""
    y = sound.split(" ") if sound else []
    out = [("s" + a, 1.0) for a in y] + [("b" + " ".join(sorted(p)), 1.0) for p in combinations(y, 2)]
    out += [("c" + a, 0.6) for a in core] + [("d" + a + b, 0.3) for a, b in zip(core, core[1:], strict=False)]
    each = ends.split("|") if ends else []
    out += [("e" + e, ENDING / len(each) ** 0.5) for e in each]
    return [(_bucket(t), w) for t, w in out]


def address_terms(city: str, office: str, road: str, door: str, x: float | None, y: float | None) -> list[tuple[int, float]]:
    """The n-grams of an address and location: road with door, road, street office, and cells of two grids. Their weights
    stand for their rarity, which is much the same in all tables."""
    out = []
    if road:
        way = city + road.replace("大", "")
        out += [("w" + way, 0.5), *([("g" + way + "#" + door, 1.8)] if door else [])]
    if office:
        out.append(("o" + city + office, 0.5))
    if x is not None and y is not None:
        for k, (g, w) in enumerate(zip(GRIDS, (0.6, 0.4), strict=True)):
            out += [(f"{k}{s}{int(x / g + s / 2)},{int(y / g + s / 2)}", w) for s in (0, 1)]
    return [(zlib.crc32(t.encode()), w) for t, w in out]


Vector = tuple[np.ndarray, np.ndarray]


def unit(terms: list[tuple[int, float]], idf: np.ndarray | None) -> Vector:
    """The terms in order and their weights, of length 1 together (empty for no terms)."""
    v: dict[int, float] = {}
    for t, w in terms:
        v[t] = v.get(t, 0.0) + w * (1.0 if idf is None else idf[t])
    t = np.fromiter(v, np.int64, len(v))
    w = np.fromiter(v.values(), float, len(v))
    o = np.argsort(t)
    return t[o], w[o] / (np.sqrt((w * w).sum()) or 1.0)


def cosines(left: list[tuple], right: list[tuple], vector: Callable[..., Vector]) -> np.ndarray:
    """Cosine of each pair (left[k], right[k]) of forms; NaN where one of the two has no terms."""
    known: dict[tuple, int] = {}
    li = np.fromiter((known.setdefault(f, len(known)) for f in left), np.int64, len(left))
    ri = np.fromiter((known.setdefault(f, len(known)) for f in right), np.int64, len(right))
    vs = [vector(*f) for f in known]
    size = np.array([len(t) for t, _ in vs], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    ts, ws = (np.concatenate([v[k] for v in vs]) if vs else np.zeros(0) for k in (0, 1))

    def flat(i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[i]
        pair = np.repeat(np.arange(len(i)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[i], n)
        return pair, (pair.astype(np.int64) << 32) + ts[pos].astype(np.int64), ws[pos]

    pl, kl, wl = flat(li)
    _, kr, wr = flat(ri)
    hit = np.minimum(np.searchsorted(kr, kl), max(len(kr) - 1, 0))
    same = kr[hit] == kl if len(kr) else np.zeros(len(kl), bool)
    out = np.bincount(pl[same], wl[same] * wr[hit[same]], minlength=len(left)) if len(left) else np.zeros(0)
    return np.where((size[li] > 0) & (size[ri] > 0), out, np.nan)


def idf_of(names: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket over all names (core, sound, ends); the driver gathers at most BUCKETS + 1 rows."""
    y, chars = F.filter(F.split("sound", " "), lambda a: a != ""), F.filter(F.split("core", ""), lambda a: a != "")
    two = F.flatten(F.transform(y, lambda a, i: F.transform(F.slice(y, i + 2, F.size(y)), lambda b: F.concat(F.lit("b"), F.least(a, b), F.lit(" "), F.greatest(a, b)))))
    next_to = F.transform(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda b, i: F.concat(F.lit("d"), F.get(chars, i), b))
    ends = F.transform(F.filter(F.split("ends", r"\|"), lambda a: a != ""), lambda a: F.concat(F.lit("e"), a))
    terms = F.concat(F.transform(y, lambda a: F.concat(F.lit("s"), a)), two, F.transform(chars, lambda a: F.concat(F.lit("c"), a)), next_to, ends)
    buckets = F.array_distinct(F.array_append(F.transform(terms, lambda t: F.crc32(t.cast("binary")) % BUCKETS), F.lit(BUCKETS).cast("bigint")))
    got = names.select(F.explode(buckets).alias("t")).groupBy("t").count().collect()
    n = np.zeros(BUCKETS + 1)
    n[[r["t"] for r in got]] = [r["count"] for r in got]
    return np.log(1 + n[BUCKETS] / (1 + n[:BUCKETS]))


NAME, ADDRESS = ("core", "sound", "ends"), ("city", "office", "road", "door", "x", "y")


def with_cosines(pairs: DataFrame, idf: np.ndarray, keep: Iterable[str], address: bool = True, suffix: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """The columns `keep` of `pairs` with `name_cos` and, with `address`, `addr_cos` of the forms (NAME and ADDRESS columns
    with the suffixes); null where one of the two says nothing."""
    keep = list(keep)
    forms = [*NAME, *(ADDRESS if address else ())]
    names = [*keep, *(f"{c}{s}" for s in suffix for c in forms)]
    out = ["name_cos", *(["addr_cos"] if address else [])]
    weights = pairs.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers
    n, k, m = len(keep), len(NAME), len(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        by_name, by_address = (lambda *f: unit(name_terms(*f), table)), (lambda *f: unit(address_terms(*f), None))
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(n, n + 2 * m)]
            form = lambda lo, hi: list(zip(*cols[lo:hi], strict=True))
            cos = [cosines(form(0, k), form(m, m + k), by_name)]
            if address:
                cos.append(cosines(form(k, m), form(m + k, 2 * m), by_address))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, mask=np.isnan(c)) for c in cos)], names=[*keep, *out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)
    return pairs.select(*names).mapInArrow(run, ", ".join([schema, *(f"{c} double" for c in out)]))


def cells_around(x: Column, y: Column, side: float, reach: Column | None = None, *with_: Column) -> Column:
    """The hashed cells of a point on a grid: its own, and with `reach` (degrees of latitude) all cells that it reaches;
    `with_` is hashed too."""
    if reach is None:
        return F.array(F.xxhash64(F.lit("l"), F.floor(x / side), F.floor(y / side), *with_))
    span = lambda v, r: F.sequence(F.floor((v - r) / side), F.floor((v + r) / side))
    wide = reach / F.greatest(F.lit(0.2), F.cos(F.radians(y)))
    return F.flatten(F.transform(span(x, wide), lambda i: F.transform(span(y, reach), lambda j: F.xxhash64(F.lit("l"), i, j, *with_))))


#: Order of the terms of an address among all terms, rare ones first, as inverse document frequencies (fixed, like their weights).
_RARITY = {"g": 99.0, "0": 98.0, "w": 6.0, "1": 4.0, "o": 3.5}


def _ranked(terms: list[tuple[int, float]], marks: list[str]) -> dict[int, float]:
    return {t: _RARITY[m] for (t, _), m in zip(terms, marks, strict=True)}


#: Parts of 1 in which weights are written, rounded up.
STEPS = 1000


def prefix_terms(form: tuple, table: np.ndarray, beside: float | None, least: float) -> list[int]:
    """The terms of `prefix_weights` alone."""
    return [t for t, _, _ in prefix_weights(form, table, beside, least)]


def reaches(least: float, a: str = "_a", b: str = "_b") -> Column:
    """Whether two vectors that share a term (columns w and rest with the suffixes) can have a cosine of `least`, if they share no term before it:
    the products of the term's weights and of the lengths of what follows it are no less. At the first term that two such vectors share it holds."""
    return F.col(f"w{a}").cast("int") * F.col(f"w{b}") + F.col(f"rest{a}").cast("int") * F.col(f"rest{b}") >= int(least * STEPS * STEPS)


#: Terms are numbers below 2 to this power.
TERM_BITS = 33


class Units:
    """Vectors of length 1 of many forms: vector k has size[k] terms from at[k] on in t (in order), with weights w and orders of rarity."""

    def __init__(self, owner: list[int], t: list[int], w: list[float], n: int, idf: np.ndarray | None, rank: list[float] | None = None):
        o, t, w = np.array(owner, np.int64), np.array(t, np.int64), np.array(w, float)
        if idf is not None:
            w = w * idf[t]
        key = (o << TERM_BITS) + t
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]]) if len(by) else np.zeros(0, np.int64)
        self.owner, self.t = o[by][first], t[by][first]
        w = np.add.reduceat(w[by], first) if len(first) else w
        self.order = idf[self.t] if rank is None else np.array(rank, float)[by][first]
        length = np.sqrt(np.bincount(self.owner, w * w, minlength=n))
        self.w = w / np.where(length > 0, length, 1.0)[self.owner]
        self.size = np.bincount(self.owner, minlength=n)
        self.at = np.cumsum(self.size) - self.size

    def beginnings(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, t, w, rest) as `prefix_weights`, by owner."""
        by = np.lexsort((self.t, -self.order, self.owner))
        o, w = self.owner[by], self.w[by]
        col = np.arange(len(o)) - self.at[o]
        wide = np.zeros((len(self.size), int(self.size.max(initial=0)) + 1))
        wide[o, col] = w * w
        rest = np.cumsum(wide[:, ::-1], axis=1)[:, ::-1]  # from each term on
        keep = (col == 0) | (rest[o, col] >= least * least - 1e-12)
        up = lambda v: np.ceil(v * STEPS).astype(np.int64)
        return o[keep], self.t[by][keep], up(w[keep]), up(np.sqrt(rest[o, col + 1][keep]))


def name_units(forms: Iterable[tuple], idf: np.ndarray) -> Units:
    """The vectors of the names (core, sound, ends)."""
    terms = [name_terms(*f) for f in forms]
    return Units([i for i, x in enumerate(terms) for _ in x], [t for x in terms for t, _ in x], [w for x in terms for _, w in x], len(terms), idf)


def prefix_weights(form: tuple, table: np.ndarray, beside: float | None, least: float) -> list[tuple[int, int, int]]:
    """The first terms, rare ones first, of the joint vector of a name and (unless `beside` is null) an address, whose share in the squared
    length is `beside` where both are there: so many that what follows is shorter than `least`. Two vectors of length 1 whose cosine
    is `least` or more share one of these terms: all terms that they share would else lie in the shorter rest of one of them. With each
    term come its weight and the length of what follows it, in STEPS, rounded up."""
    t, w = unit(name_terms(*form[: len(NAME)]), table)
    order = table[t]
    if beside is not None and len(t):
        city, office, road, door, x, y = form[len(NAME) :]
        at = address_terms(city, office, road, door, x, y)
        if at:
            marks = (["w", *(["g"] if door else [])] if road else []) + (["o"] if office else []) + (["0", "0", "1", "1"] if x is not None and y is not None else [])
            rank = _ranked(at, marks)
            ta, wa = unit(at, None)
            t = np.concatenate((t, ta + BUCKETS))
            w = np.concatenate((w * (1 - beside) ** 0.5, wa * beside**0.5))
            order = np.concatenate((order, [rank[int(k)] for k in ta]))
    o = np.lexsort((t, -order))
    rest = np.concatenate((np.cumsum((w[o] ** 2)[::-1])[::-1][1:], [0.0]))  # what follows each term
    n = int((rest >= least * least - 1e-12).sum()) + 1
    up = lambda v: np.ceil(v * STEPS).astype(int).tolist()
    return list(zip(t[o][:n].tolist(), up(w[o][:n]), up(np.sqrt(rest[:n])), strict=True))


def _structs(lists: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.array([v for x in lists for v in x], np.int64).reshape(-1, 3)
    fields = list(kind.value_type)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, i]).cast(f.type) for i, f in enumerate(fields)], fields=fields))


def with_prefixes(rows: DataFrame, idf: np.ndarray, keep: Iterable[str], beside: float | None, least: float) -> DataFrame:
    """The columns `keep` of `rows` with `terms`, their `prefix_weights` as structs of t, w and rest."""
    keep = list(keep)
    forms = [*NAME, *(ADDRESS if beside is not None else ())]
    weights = rows.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        known: dict[tuple, list[tuple]] = {}
        kind = pa.list_(pa.struct([("t", pa.int64()), ("w", pa.int16()), ("rest", pa.int16())]))
        for b in batches:
            out = []
            for f in zip(*(b.column(i).to_pylist() for i in range(n, n + len(forms))), strict=True):
                got = known.get(f)
                if got is None:
                    if len(known) >= 50_000:
                        known.clear()
                    got = known[f] = prefix_weights(f, table, beside, least)
                out.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _structs(out, kind)], names=[*keep, "terms"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, *[F.col(c).alias(f"_{c}") for c in forms]).mapInArrow(run, f"{schema}, terms array<struct<t: bigint, w: smallint, rest: smallint>>")
