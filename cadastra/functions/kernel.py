"""Planar geometry in numpy, and its Arrow functions. Rings are closed (n, 2) arrays; coordinates any unit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .polygons import parse_polygons


def area(ring: np.ndarray) -> float:
    """Signed area, counter-clockwise positive, around the first vertex."""
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def length(ring: np.ndarray) -> float:
    return float(np.hypot(*np.diff(ring, axis=0).T).sum())


def crossings(ring: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Proper crossings of edges that aren't neighbours: (i, j, point)."""
    a, d = ring[:-1], np.diff(ring, axis=0)
    n, out = len(a), []
    for i in range(n):
        j = np.arange(i + 2, n - (i == 0))
        if not len(j):
            continue
        den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        q = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (q[:, 0] * d[j, 1] - q[:, 1] * d[j, 0]) / den, (q[:, 0] * d[i, 1] - q[:, 1] * d[i, 0]) / den
        for k in np.flatnonzero((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)):
            out.append((i, int(j[k]), a[i] + t[k] * d[i]))
    return out


def is_valid(ring: np.ndarray) -> bool:
    """A ring of area whose edges don't cross and that comes by no vertex twice."""
    v = ring[:-1]
    return len(v) >= 3 and abs(area(ring)) > 0 and len(np.unique(v, axis=0)) == len(v) and not crossings(ring)


def heal(ring: np.ndarray) -> np.ndarray | None:
    """The largest loop of a self-crossing ring, cut at its crossings; null where nothing of area remains."""
    todo, loops = [ring], []
    while todo and len(loops) < 64:
        r = todo.pop()
        hit = crossings(r)
        if not hit:
            loops.append(r)
            continue
        i, j, p = hit[0]
        todo.append(np.vstack((p, r[i + 1 : j + 1], p)))
        todo.append(np.vstack((r[: i + 1], p, r[j + 1 :])))
    loops = [x for x in loops if len(x) >= 4 and abs(area(x)) > 0]
    return max(loops, key=lambda x: abs(area(x))) if loops else None


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise hull (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.vstack((p, p[:1]))

    def half(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in ps:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lo, up = half(p), half(p[::-1])
    return np.array(lo[:-1] + up[:-1] + lo[:1])


def concave_hull(points: np.ndarray, ratio: float = 0.8, passes: int = 100) -> np.ndarray:
    """Hull pulled inwards: the longest edges above `ratio` x the longest are bent to the inner point that adds the
    least length, as long as the ring stays simple."""
    ring = convex_hull(points)
    limit = ratio * np.hypot(*np.diff(ring, axis=0).T).max()
    for _ in range(passes):
        edges = np.hypot(*np.diff(ring, axis=0).T)
        done = True
        for i in np.argsort(-edges):
            if edges[i] <= limit:
                break
            on = {tuple(v) for v in ring}
            free = np.array([q for q in np.unique(points, axis=0) if tuple(q) not in on])
            if not len(free):
                break
            detour = np.hypot(*(free - ring[i]).T) + np.hypot(*(free - ring[i + 1]).T)
            for k in np.argsort(detour)[:3]:
                new = np.insert(ring, i + 1, free[k], axis=0)
                if is_valid(new):
                    ring, done = new, False
                    break
            if not done:
                break
        if done:
            break
    return ring


def min_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(long, short) sides of the smallest rectangle around points, over the directions of the hull's edges."""
    h = convex_hull(points)
    best = (math.inf, 0.0, 0.0)
    for dx, dy in np.diff(h, axis=0):
        n = math.hypot(dx, dy)
        if n:
            u = h @ np.array([[dx / n, -dy / n], [dy / n, dx / n]])
            w, t = np.ptp(u[:, 0]), np.ptp(u[:, 1])
            best = min(best, (w * t, max(w, t), min(w, t)))
    return float(best[1]), float(best[2])


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    up = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[up], b[up]
    return bool((a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > x).sum() % 2)


def edge_distance(ring: np.ndarray, x: float, y: float) -> float:
    a, d = ring[:-1], np.diff(ring, axis=0)
    n = (d**2).sum(1)
    t = np.clip(((np.array([x, y]) - a) * d).sum(1) / np.where(n > 0, n, 1), 0, 1)
    return float(np.hypot(*(a + t[:, None] * d - [x, y]).T).min())


def inscribed_radius(ring: np.ndarray, precision: float = 0.005) -> float:
    """Radius of the largest circle inside, by quartering squares that can still hold a better centre."""
    import heapq

    lo, hi = ring.min(0), ring.max(0)
    size = float(max(hi - lo))
    if size == 0:
        return 0.0
    signed = lambda x, y: edge_distance(ring, x, y) * (1 if inside(ring, x, y) else -1)
    h, best, heap = size / 2, 0.0, []
    c = (lo + hi) / 2
    d = signed(*c)
    best = max(best, d)
    heapq.heappush(heap, (-(d + h * math.sqrt(2)), c[0], c[1], h))
    while heap:
        top, x, y, h = heapq.heappop(heap)
        if -top - best <= precision * size:
            break
        for sx in (-h / 2, h / 2):
            for sy in (-h / 2, h / 2):
                d = signed(x + sx, y + sy)
                best = max(best, d)
                heapq.heappush(heap, (-(d + h / 2 * math.sqrt(2)), x + sx, y + sy, h / 2))
    return best


def triangles(ring: np.ndarray) -> list[np.ndarray]:
    """Ears of a simple ring."""
    v = list(range(len(ring) - 1)) if area(ring) > 0 else list(range(len(ring) - 2, -1, -1))
    out = []
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    guard = 0
    while len(v) > 3 and guard < 10_000:
        guard += 1
        for k in range(len(v)):
            i, j, m = v[k - 1], v[k], v[(k + 1) % len(v)]
            a, b, c = ring[i], ring[j], ring[m]
            if cross(a, b, c) <= 0:
                continue
            if any(cross(a, b, ring[q]) >= 0 and cross(b, c, ring[q]) >= 0 and cross(c, a, ring[q]) >= 0 for q in v if q not in (i, j, m)):
                continue
            out.append(np.array([a, b, c]))
            del v[k]
            break
        else:
            break
    if len(v) == 3:
        out.append(ring[v])
    return out


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside a counter-clockwise convex one (open vertex lists)."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        new = []
        for k in range(len(out)):
            p, q, sp, sq = out[k - 1], out[k], side[k - 1], side[k]
            if (sp >= 0) != (sq >= 0):
                new.append(p + (q - p) * (sp / (sp - sq)))
            if sq >= 0:
                new.append(q)
        out = np.array(new).reshape(-1, 2)
    return out


def _convex_parts(ring: np.ndarray) -> list[np.ndarray]:
    """Counter-clockwise convex parts: a quadrangle or triangle that always turns the same way is one, other rings are cut into triangles."""
    if len(ring) <= 5:
        d = np.diff(ring, axis=0)
        e = np.roll(d, -1, axis=0)
        turn = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        if (turn > 0).all():
            return [ring[:-1]]
        if (turn < 0).all():
            return [ring[-2::-1]]
    return triangles(ring)


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to two simple rings: the sum over their convex parts."""
    if (a.max(0) < b.min(0)).any() or (b.max(0) < a.min(0)).any():
        return 0.0
    o, total = a[0].copy(), 0.0
    ta, tb = _convex_parts(a - o), _convex_parts(b - o)
    for s in ta:
        for t in tb:
            c = clip_convex(s, t)
            if len(c) >= 3:
                total += abs(area(np.vstack((c, c[:1]))))
    return total


def iou(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(overlap over union, overlap over the smaller)."""
    i, x, y = overlap_area(a, b), abs(area(a)), abs(area(b))
    return (i / (x + y - i), i / min(x, y)) if min(x, y) > 0 else (0.0, 0.0)


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, split at the vertex farthest from the first; if the result crosses itself
    the ring stays as it is."""
    def part(p: np.ndarray) -> np.ndarray:
        if len(p) < 3:
            return p
        d = p[-1] - p[0]
        n = math.hypot(*d)
        off = np.abs(d[0] * (p[:, 1] - p[0, 1]) - d[1] * (p[:, 0] - p[0, 0])) / n if n else np.hypot(*(p - p[0]).T)
        k = int(off.argmax())
        return np.vstack((p[:1], p[-1:])) if off[k] <= tolerance else np.vstack((part(p[: k + 1])[:-1], part(p[k:])))

    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    out = np.vstack((part(ring[: far + 1])[:-1], part(ring[far:])))
    return out if len(out) >= 4 and is_valid(out) else ring


def boundary_samples(ring: np.ndarray, spacing: float, least: int = 8, most: int = 40) -> np.ndarray:
    """Points evenly along a ring: its length over `spacing` plus one, within least and most."""
    n = int(min(most, max(least, length(ring) / spacing + 1)))
    step = np.hypot(*np.diff(ring, axis=0).T)
    at = np.concatenate(([0], np.cumsum(step)))
    t = np.arange(n) * at[-1] / n
    return np.column_stack([np.interp(t, at, ring[:, k]) for k in (0, 1)])


def segments(ring: np.ndarray, corner: float = -0.707) -> list[tuple[int, int, float]]:
    """(first vertex, last vertex, length) of the pieces of a ring between its corners: vertices where the angle
    between both edges is sharp (cosine of the inner angle above `corner`), and the first vertex."""
    v = ring[:-1]
    a, b = np.roll(v, 1, axis=0) - v, np.roll(v, -1, axis=0) - v
    cos = (a * b).sum(1) / np.maximum(np.hypot(*a.T) * np.hypot(*b.T), 1e-300)
    cuts = sorted({0, *np.flatnonzero(cos > corner).tolist()})
    return [(i, j, length(ring[i : j + 1])) for i, j in zip(cuts, [*cuts[1:], len(v)], strict=True)]


def _outer(wkt: str | None) -> np.ndarray | None:
    """The largest outer ring of a polygon text; null for any other text."""
    try:
        parts = parse_polygons(wkt) if wkt and "polygon" in wkt[:40].lower() else []
        outer = [p[0] for p in parts if len(p[0]) >= 4]
        return outer[0] if len(outer) == 1 else max(outer, key=lambda q: abs(area(q)), default=None)
    except (ValueError, IndexError):
        return None


# ---- many rings of one number of vertices at once: (rings, vertices + 1, 2)

#: Numbers of one intermediate array; rings with more vertices than these go one by one.
CHUNK, MANY_EDGES, MANY_DIRECTIONS = 1 << 19, 128, 20


def areas(rings: np.ndarray) -> np.ndarray:
    p = rings - rings[:, :1]
    return (p[:, :-1, 0] * p[:, 1:, 1] - p[:, 1:, 0] * p[:, :-1, 1]).sum(1) / 2


def are_valid(rings: np.ndarray) -> np.ndarray:
    """`is_valid` of each ring."""
    a, d = rings[:, :-1], np.diff(rings, axis=1)
    n = a.shape[1]
    if n < 3 or n > MANY_EDGES or not np.isfinite(rings).all():
        return np.array([is_valid(r) for r in rings], bool)
    i, j = np.triu_indices(n, 1)
    twice = (a[:, i] == a[:, j]).all(2).any(1)
    apart = (j >= i + 2) & ~((i == 0) & (j == n - 1))
    i, j = i[apart], j[apart]
    q, di, dj = a[:, j] - a[:, i], d[:, i], d[:, j]
    den = di[..., 0] * dj[..., 1] - di[..., 1] * dj[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (q[..., 0] * dj[..., 1] - q[..., 1] * dj[..., 0]) / den, (q[..., 0] * di[..., 1] - q[..., 1] * di[..., 0]) / den
        crossed = ((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)).any(1)
    return (np.abs(areas(rings)) > 0) & ~twice & ~crossed


def hull_ratios(rings: np.ndarray) -> np.ndarray:
    """Area over that of the hull; a valid ring that always turns the same way is its hull."""
    d = np.diff(rings, axis=1)
    e = np.roll(d, -1, axis=1)
    turn = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    own = are_valid(rings) & ((turn >= 0).all(1) | (turn <= 0).all(1))
    return np.array([1.0 if o else abs(area(r)) / max(abs(area(convex_hull(r))), 1e-300) for o, r in zip(own, rings, strict=True)], float)


def min_rectangles(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`min_rectangle` of each ring, over the directions of any two vertices: those of the hull's edges are among them, and no
    other direction has a smaller rectangle."""
    v = rings[:, :-1]
    n = v.shape[1]
    if n < 2 or n > MANY_DIRECTIONS or not np.isfinite(rings).all():
        got = np.array([min_rectangle(r) for r in rings], float).reshape(-1, 2)
        return got[:, 0], got[:, 1]
    i, j = np.triu_indices(n, 1)
    d = v[:, j] - v[:, i]
    size = np.hypot(d[..., 0], d[..., 1])
    u = d / np.where(size > 0, size, 1)[..., None]
    x, y = u @ v.transpose(0, 2, 1), np.stack((-u[..., 1], u[..., 0]), 2) @ v.transpose(0, 2, 1)
    w, t = np.ptp(x, axis=2), np.ptp(y, axis=2)
    m2 = np.where(size > 0, w * t, np.inf)
    best = np.where(m2 <= m2.min(1)[:, None] * (1 + 1e-9), np.maximum(w, t), np.inf).argmin(1)[:, None]  # of equal ones the least long
    w, t = np.take_along_axis(w, best, 1)[:, 0], np.take_along_axis(t, best, 1)[:, 0]
    some = (size > 0).any(1)
    return np.where(some, np.maximum(w, t), 0.0), np.where(some, np.minimum(w, t), 0.0)


def inscribed_radii(rings: np.ndarray, precision: float = 0.005) -> np.ndarray:
    """`inscribed_radius` of each ring: the squares of all rings are quartered together, as long as they can hold a better centre."""
    lo, hi = rings.min(1), rings.max(1)
    size = (hi - lo).max(1)
    best = np.zeros(len(rings))
    k, c, h = np.flatnonzero(size > 0), (lo + hi) / 2, size / 2
    c, h = c[k], h[k]
    n = rings.shape[1] - 1
    while len(k):
        signed = np.empty(len(k))
        for at in range(0, len(k), max(1, CHUNK // n)):
            s = slice(at, at + max(1, CHUNK // n))
            q = rings[k[s]] - c[s, None]
            a, b = q[:, :-1], q[:, 1:]
            d = b - a
            d2 = (d * d).sum(2)
            t = np.clip(-(a * d).sum(2) / np.where(d2 > 0, d2, 1), 0, 1)
            near = np.sqrt(((a + t[..., None] * d) ** 2).sum(2).min(1))
            up = (a[..., 1] > 0) != (b[..., 1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                right = up & (a[..., 0] - a[..., 1] / d[..., 1] * d[..., 0] > 0)
            signed[s] = np.where(right.sum(1) % 2 == 1, near, -near)
        np.maximum.at(best, k, signed)
        more = signed + h * math.sqrt(2) - best[k] > precision * size[k]
        k, c, h = np.repeat(k[more], 4), np.repeat(c[more], 4, axis=0), np.repeat(h[more] / 2, 4)
        c = c + h[:, None] * np.tile([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]], (len(k) // 4, 1))
    return best


def aspects(rings: np.ndarray) -> np.ndarray:
    long, short = min_rectangles(rings)
    return np.divide(long, short, out=np.full(len(rings), math.inf), where=short > 0)


def metre_rings(rings: np.ndarray) -> np.ndarray:
    """Rings in degrees in metres around their middle latitude."""
    y = np.radians(rings[..., 1].mean(1))
    return (rings - rings[:, :1]) * np.stack((111412.84 * np.cos(y), np.full(len(rings), 111132.954)), 1)[:, None]


def in_groups(rings: list[np.ndarray | None], f, none, numbered: bool = False) -> list:
    """What `f` (an array of rings of one size, and with `numbered` their places, to a sequence) gives for each ring; `none` where there is none."""
    out = [none] * len(rings)
    groups: dict[int, list[int]] = {}
    for i, q in enumerate(rings):
        if q is not None and len(q) >= 4:
            groups.setdefault(len(q), []).append(i)
    for n, ix in groups.items():
        step = max(1, CHUNK // (n * n))
        for at in range(0, len(ix), step):
            part = ix[at : at + step]
            for i, v in zip(part, f(np.stack([rings[i] for i in part]), *([part] if numbered else [])), strict=True):
                out[i] = v
    return out


def _each(f, none):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(in_groups([_outer(w) for w in s], f, none))

    return run


def to_wkt(ring: np.ndarray | None) -> str | None:
    return None if ring is None else "POLYGON ((" + ", ".join(f"{x:.15g} {y:.15g}" for x, y in ring) + "))"


def _udf(f, kind, none=None):
    run = _each(f, none)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


#: Arrow functions of WKT polygons (largest outer ring; null for other texts).
wkt_valid = _udf(are_valid, BooleanType())
wkt_healed = _udf(lambda qs: [to_wkt(heal(q)) for q in qs], StringType())
wkt_hull_ratio = _udf(hull_ratios, DoubleType())
wkt_inscribed = _udf(inscribed_radii, DoubleType())
wkt_aspect = _udf(aspects, DoubleType())
wkt_simplified = _udf(lambda qs: [to_wkt(simplify(q, 5e-5)) for q in qs], StringType())


def _profiles(rings: np.ndarray) -> list[tuple]:
    m = metre_rings(rings)
    long, short = min_rectangles(m)
    ratio = np.divide(long, short, out=np.full(len(rings), math.inf), where=short > 0)
    return list(zip(are_valid(rings).tolist(), long.tolist(), (2 * inscribed_radii(m)).tolist(), ratio.tolist(), strict=True))


@F.pandas_udf(StructType([StructField("valid", BooleanType()), *[StructField(k, DoubleType()) for k in ("length_m", "width_m", "aspect")]]))
def wkt_profile(shapes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Validity, sides of the smallest rectangle and greatest width (twice the largest circle's radius) of a polygon text, in one
    reading; null for other texts."""
    for s in shapes:
        rows = in_groups([_outer(w) for w in s], _profiles, (None,) * 4)
        yield pd.DataFrame(rows, columns=["valid", "length_m", "width_m", "aspect"]).astype({"valid": "boolean", "length_m": float, "width_m": float, "aspect": float})


def widths_between(m: np.ndarray, valid: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the greatest width (twice the largest circle's radius) of rings in metres: the area of a simple ring is at most this radius
    times its length, and the circle fits into the smallest rectangle; for other rings nothing is known."""
    around = np.hypot(*np.moveaxis(np.diff(m, axis=1), 2, 0)).sum(1)
    some = valid & (around > 0)
    lo = np.where(some, 2 * np.abs(areas(m)) / np.where(around > 0, around, 1), 0.0)
    return lo * (1 - 1e-9), np.where(some, short * (1 + 1e-9), math.inf)


def _tested(rings: np.ndarray, means: np.ndarray, strip: tuple[float, float], jagged: float) -> list[tuple]:
    """`_profiles` whose widths are searched only where their bounds leave a test open."""
    m = metre_rings(rings)
    long, short = min_rectangles(m)
    valid = are_valid(rings)
    lo, hi = widths_between(m, valid, short)
    narrow = lambda w: (w < strip[0]) & (long > strip[1])
    rough = lambda w: (w > 1) & ~(means >= jagged * w)
    open_ = np.isinf(hi) | (narrow(lo) != narrow(hi)) | (rough(lo) != rough(hi))  # both tests turn once as the width grows
    width = lo
    if open_.any():
        width[open_] = 2 * inscribed_radii(m[open_])
    ratio = np.divide(long, short, out=np.full(len(rings), math.inf), where=short > 0)
    return list(zip(valid.tolist(), long.tolist(), width.tolist(), ratio.tolist(), strict=True))


def wkt_tested(shape: Column, mean: Column, strip: tuple[float, float], jagged: float) -> Column:
    """`wkt_profile` for two tests of the greatest width: whether it is below strip[0] where the length is above strip[1], and whether
    it is above 1 m and `mean` below `jagged` times it. Where bounds of the width decide both, width_m is one of the bounds."""

    @F.pandas_udf(wkt_profile.returnType)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for s, n in batches:
            means = n.to_numpy(float)
            rows = in_groups([_outer(w) for w in s], lambda q, ix: _tested(q, means[ix], strip, jagged), (None,) * 4, numbered=True)
            yield pd.DataFrame(rows, columns=["valid", "length_m", "width_m", "aspect"]).astype({"valid": "boolean", "length_m": float, "width_m": float, "aspect": float})

    return run(shape, mean)


@F.pandas_udf(DoubleType())
def wkt_iou(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Overlap over union of two polygon texts, 0 where one is none."""
    for a, b in pairs:
        yield pd.Series([0.0 if (x := _outer(p)) is None or (y := _outer(q)) is None else iou(x, y)[0] for p, q in zip(a, b, strict=True)])
