"""Pairs of records that meet within a district, found and compared in numpy: no pair is shuffled (problems 4 and 6).

A block is the records of one district (`with_blocks`), those of unknown district in each of their city. Large blocks are cut:
the records that ask in one way, those that answer in the other, and each piece of the one meets each of the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Cut, small, spread
from .grams import TERM_BITS, Units

#: Records that ask, and that answer, in one piece of a block.
ASK, ANSWER = 4_000, 60_000
#: Pairs that are held at once.
AT_ONCE = 1_000_000


def with_districts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with a row for each district that `known` has in its city where a record's district is unknown; `own` tells a known district,
    `first` the one of these rows that stands for all."""
    c = F.col
    districts = small(Cut(known.where("district <> ''").groupBy("city").agg(F.sort_array(F.collect_set("district")).alias("ds")), "city-districts"))
    open_ = (c("district") == "") & c("ds").isNotNull()
    d = rows.join(districts, "city", "left").withColumns({"own": c("district") != "", "district": F.explode(F.when(open_, c("ds")).otherwise(F.array("district")))})
    return d.withColumn("first", c("own") | c("ds").isNull() | (c("district") == F.get("ds", F.lit(0)))).drop("ds")


def with_blocks(rows: DataFrame, asks: Column, answers: Column, answer: str) -> DataFrame:
    """The rows (with city and district) by block: `block` is its number, `ask` and `answer` tell the part that a row has there. Rows that
    answer are cut by the hash of the column `answer`."""
    c = F.col
    d = rows.withColumns({"ask": asks, "answer": answers})
    sizes = d.groupBy("city", "district").agg(F.ceil(F.count_if("ask") / ASK).cast("int").alias("p"), F.ceil(F.count_if("answer") / ANSWER).cast("int").alias("q"))
    sizes = small(Cut(sizes.where("p > 0 and q > 0"), "block-sizes"))  # a row per district
    d = d.join(sizes, ["city", "district"]).withColumns({"mine": F.pmod(F.xxhash64("n"), "p").cast("int"), "theirs": F.pmod(F.xxhash64(answer), "q").cast("int")})
    asked, answered = (lambda t: (t / c("q")).cast("int") == c("mine")), (lambda t: t % c("q") == c("theirs"))
    t = F.filter(F.sequence(F.lit(0), c("p") * c("q") - 1), lambda t: (c("ask") & asked(t)) | (c("answer") & answered(t)))
    d = d.withColumn("t", F.explode(t)).withColumns({"ask": c("ask") & asked(c("t")), "answer": c("answer") & answered(c("t")), "block": F.xxhash64("city", "district", "t")})
    return spread(d.drop("p", "q", "mine", "theirs", "t"), "block").sortWithinPartitions("block")


def tables(batches: Iterable[pa.RecordBatch], key: str = "block") -> Iterator[pa.Table]:
    """The rows of each run of equal `key`, of batches in its order."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def coded(t: pa.Table, *cols: str) -> np.ndarray:
    """A number for each combination of values of the columns (strings without nulls)."""
    out = np.zeros(t.num_rows, np.int64)
    for k in cols:
        e = t[k].combine_chunks().dictionary_encode()
        out = np.unique(out * max(len(e.dictionary), 1) + e.indices.to_numpy(), return_inverse=True)[1]
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of x once, in order (sorting is faster than the hashing of np.unique here)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def flat(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[k], lo[k] + 1, .. (n[k] of them) for each k in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def slices(n: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of positions whose n sum up to about `most`, at least one each."""
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


class Postings:
    """Rows by key: which `rows` have each of the `keys`."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        o = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[o], rows[o]

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.searchsorted(self.keys, keys)
        return lo, np.searchsorted(self.keys, keys, "right") - lo


def meeting(keys: np.ndarray, owners: np.ndarray, index: Postings, width: int, check=None) -> Iterator[np.ndarray]:
    """Codes owner * width + row of the pairs that share a key, each once and in order, in runs; owners in order. With `check`, only those
    which it passes for one of their keys (positions in `keys`, positions in the index)."""
    lo, n = index.spans(keys)
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
    for s in slices(np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)):
        a, b = starts[s.start], starts[s.stop] if s.stop < len(starts) else len(keys)
        at, of = flat(lo[a:b], n[a:b]), np.repeat(np.arange(a, b), n[a:b])
        if check is not None:
            ok = check(of, at)
            at, of = at[ok], of[ok]
        yield distinct(owners[of] * width + index.rows[at])


class Rows:
    """Rows by the group they are of, to go from pairs of groups to pairs of rows."""

    def __init__(self, groups: np.ndarray, rows: np.ndarray, n: int):
        o = np.argsort(groups, kind="stable")
        self.rows, self.size = rows[o], np.bincount(groups, minlength=n)
        self.at = np.cumsum(self.size) - self.size


def row_pairs(p: np.ndarray, q: np.ndarray, left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in p and q, rows of the left group, rows of the right group), in runs."""
    size = left.size[p] * right.size[q]
    ends = np.cumsum(size)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        f = np.arange(lo, min(lo + AT_ONCE, int(ends[-1])))
        first, last = np.searchsorted(ends, [f[0], f[-1]], "right")
        k = np.repeat(np.arange(first, last + 1), np.diff(np.r_[lo, np.minimum(ends[first : last + 1], f[-1] + 1)]))
        i, j = np.divmod(f - (ends[k] - size[k]), right.size[q[k]])
        yield k, left.rows[left.at[p[k]] + i], right.rows[right.at[q[k]] + j]


def cosines_of(u: Units, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of vectors (p in order); NaN where one of the two has no terms."""
    out = np.zeros(len(p))
    cols, t = np.unique(u.t, return_inverse=True)
    of = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    each = max(1, 2_000_000 // max(len(cols), 1))
    run = 0
    while run < len(of):  # so many left vectors are spread out at once
        end = min(run + each, len(of))
        while end > run + 1 and (of[end] if end < len(of) else len(p)) - of[run] > 2 * AT_ONCE:
            end = run + (end - run) // 2
        lo, hi = of[run], of[end] if end < len(of) else len(p)
        mine = p[of[run:end]]
        wide = np.zeros((end - run, len(cols)))
        at = flat(u.at[mine], u.size[mine])
        wide[np.repeat(np.arange(end - run), u.size[mine]), t[at]] = u.w[at]
        row = np.repeat(np.arange(end - run), np.diff(np.r_[of[run:end], hi]))
        for a in range(lo, hi, AT_ONCE // 4):
            b = min(a + AT_ONCE // 4, hi)
            n = u.size[q[a:b]]
            at = flat(u.at[q[a:b]], n)
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), n), wide[np.repeat(row[a - lo : b - lo], n), t[at]] * u.w[at], minlength=b - a)
        run = end
    return np.where((u.size[p] > 0) & (u.size[q] > 0), out, np.nan)


def term_keys(group: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (group << TERM_BITS) + t


def cells(x: np.ndarray, y: np.ndarray, side: float, reach: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells) of the points on a grid (NaN for none): their own, and with `reach` (degrees of latitude) all cells that they reach."""
    r = np.flatnonzero(~np.isnan(x))
    x, y = x[r], y[r]
    wide = 0.0 if reach is None else reach / np.maximum(0.2, np.cos(np.radians(y)))
    i0, i1, j0, j1 = (np.floor(v / side).astype(np.int64) for v in (x - wide, x + wide, y - (reach or 0.0), y + (reach or 0.0)))
    ni, nj = i1 - i0 + 1, j1 - j0 + 1
    of = np.repeat(np.arange(len(r)), ni * nj)
    k = flat(np.zeros(len(r), np.int64), ni * nj)
    return r[of], ((i0[of] + k // nj[of]) << 32) + j0[of] + k % nj[of]
