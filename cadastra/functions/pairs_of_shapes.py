"""Measures of two shapes in numpy: distance, shared boundary, difference, lines in polygons, faces of line work."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .kernel import _outer, area, inside, overlap_area, to_wkt, triangles
from .polygons import parse_polygons

_NUMBER = DoubleType()
_POINT = StructType([StructField(k, _NUMBER) for k in "xy"])
PAIR = StructType([StructField(k, _NUMBER) for k in ("inter", "area_a", "area_b", "dist", "shared")])
FACE = StructType([StructField(k, _NUMBER) for k in ("area", "x", "y")])


def _to_segments(points: np.ndarray, ring: np.ndarray) -> float:
    """The least distance of the points to the edges of a ring or line."""
    a, d = ring[:-1], np.diff(ring, axis=0)
    n2 = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(2) / n2, 0, 1)
    return float(np.sqrt(((points[:, None] - a - t[..., None] * d) ** 2).sum(2)).min())


def _crossed(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether an edge of one properly crosses an edge of the other."""
    p, r, q, s = a[:-1], np.diff(a, axis=0), b[:-1], np.diff(b, axis=0)
    den = r[:, None, 0] * s[:, 1] - r[:, None, 1] * s[:, 0]
    w = q - p[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[..., 0] * s[:, 1] - w[..., 1] * s[:, 0]) / den, (w[..., 0] * r[:, None, 1] - w[..., 1] * r[:, None, 0]) / den
    return bool(((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """The distance of two polygons; 0 where they meet."""
    if _crossed(a, b) or inside(a, *b[0]) or inside(b, *a[0]):
        return 0.0
    return min(_to_segments(a, b), _to_segments(b, a))


def shared_length(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> float:
    """The length along which edges of two rings lie on each other."""
    total = 0.0
    for p, d in zip(a[:-1], np.diff(a, axis=0), strict=True):
        n = math.hypot(*d)
        if not n:
            continue
        u = d / n
        off = np.abs((b - p) @ np.array([-u[1], u[0]]))
        at = (b - p) @ u
        for k in range(len(b) - 1):
            if off[k] <= tolerance and off[k + 1] <= tolerance:
                lo, hi = sorted((at[k], at[k + 1]))
                total += max(0.0, min(n, hi) - max(0.0, lo))
    return total


def half_plane(ring: np.ndarray, p: np.ndarray, d: np.ndarray, left: bool) -> np.ndarray:
    """The part of a ring on one side of the line through p along d; an empty array where nothing remains."""
    side = (d[0] * (ring[:, 1] - p[1]) - d[1] * (ring[:, 0] - p[0])) * (1 if left else -1)
    out = []
    for k in range(len(ring) - 1):
        x, y, s, t = ring[k], ring[k + 1], side[k], side[k + 1]
        if s >= 0:
            out.append(x)
        if (s > 0 > t) or (s < 0 < t):
            out.append(x + (y - x) * (s / (s - t)))
    return np.array([*out, out[0]]) if len(out) >= 3 else np.zeros((0, 2))


def difference(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Pieces of the polygon a outside the polygon b: a is cut along the edges of b's triangles, one after the other."""
    left = [a]
    for tri in triangles(b):
        t = tri if area(np.vstack((tri, tri[:1])) if (tri[0] != tri[-1]).any() else tri) > 0 else tri[::-1]
        t = t if (t[0] == t[-1]).all() else np.vstack((t, t[:1]))
        rest = []
        for piece in left:
            within = piece
            for p, d in zip(t[:-1], np.diff(t, axis=0), strict=True):
                out = half_plane(within, p, d, False)
                if len(out) and abs(area(out)) > 1e-18:
                    rest.append(out)
                within = half_plane(within, p, d, True)
                if not len(within):
                    break
        left = rest
    return left


def length_inside(line: np.ndarray, ring: np.ndarray) -> float:
    """The length of a line within a polygon: its edges are cut at the ring, and pieces whose middle lies inside count."""
    a, d = ring[:-1], np.diff(ring, axis=0)
    total = 0.0
    for p, v in zip(line[:-1], np.diff(line, axis=0), strict=True):
        den = v[0] * d[:, 1] - v[1] * d[:, 0]
        q = a - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (q[:, 0] * d[:, 1] - q[:, 1] * d[:, 0]) / den, (q[:, 0] * v[1] - q[:, 1] * v[0]) / den
        cuts = np.unique(np.concatenate(([0.0, 1.0], t[(den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)])))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if inside(ring, *(p + v * (lo + hi) / 2)):
                total += (hi - lo) * math.hypot(*v)
    return total


def faces(lines: list[np.ndarray], digits: int = 9) -> list[np.ndarray]:
    """The bounded faces of line work: lines are cut at their crossings, dangling ends are dropped, and faces are traced by
    always turning to the next edge clockwise."""
    parts = [(p, q) for ln in lines for p, q in zip(ln[:-1], ln[1:], strict=True) if (p != q).any()]
    if not parts:
        return []
    P, V = np.array([p for p, _ in parts]), np.array([q - p for p, q in parts])
    den = V[:, None, 0] * V[:, 1] - V[:, None, 1] * V[:, 0]
    W = P - P[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (W[..., 0] * V[:, 1] - W[..., 1] * V[:, 0]) / den, (W[..., 0] * V[:, None, 1] - W[..., 1] * V[:, None, 0]) / den
    hit = (den != 0) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
    key = lambda p: (round(float(p[0]), digits), round(float(p[1]), digits))
    near: dict[tuple, set[tuple]] = {}
    for i in range(len(P)):
        cuts = np.unique(np.clip(np.concatenate(([0.0, 1.0], t[i][hit[i]])), 0, 1))
        nodes = [key(P[i] + V[i] * c) for c in cuts]
        for a, b in zip(nodes, nodes[1:], strict=False):
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    loose = [n for n, s in near.items() if len(s) == 1]
    while loose:
        n = loose.pop()
        for m in near.pop(n, set()):
            near[m].discard(n)
            if len(near[m]) == 1:
                loose.append(m)
    turn = {n: sorted(s, key=lambda m, n=n: math.atan2(m[1] - n[1], m[0] - n[0])) for n, s in near.items()}
    seen: set[tuple] = set()
    out = []
    for n in sorted(turn):
        for m in turn[n]:
            a, b, ring = n, m, [n]
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(b)
                around = turn[b]
                a, b = b, around[around.index(a) - 1]
            if len(ring) > 3 and ring[0] == ring[-1] and area(np.array(ring)) > 0:
                out.append(np.array(ring))
    return out


def parse_line(wkt: str | None) -> np.ndarray | None:
    """Vertices of a LINESTRING text, null for other texts."""
    if not wkt or not wkt.strip().upper().startswith("LINESTRING"):
        return None
    try:
        p = np.array([x.split()[:2] for x in wkt[wkt.index("(") + 1 : wkt.rindex(")")].split(",")], float)
    except ValueError:
        return None
    return p if len(p) > 1 else None


@F.pandas_udf(PAIR)
def wkt_pair(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """struct(inter, area_a, area_b, dist, shared) of two polygon texts, in their units; all null where one is none."""
    for a, b in pairs:
        rows = []
        for x, y in zip(map(_outer, a), map(_outer, b), strict=True):
            if x is None or y is None:
                rows.append((None,) * 5)
                continue
            d = distance(x, y)
            rows.append((overlap_area(x, y) if d == 0 else 0.0, abs(area(x)), abs(area(y)), d, shared_length(x, y) if d <= 1e-9 else 0.0))
        yield pd.DataFrame(rows, columns=["inter", "area_a", "area_b", "dist", "shared"], dtype=float)


@F.pandas_udf(StringType())
def wkt_difference(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The first polygon without the second, as a MULTIPOLYGON of pieces; null where nothing remains."""
    for a, b in pairs:
        out = []
        for x, y in zip(map(_outer, a), map(_outer, b), strict=True):
            ps = [] if x is None else [x] if y is None else difference(x, y)
            out.append("MULTIPOLYGON (" + ", ".join("(" + to_wkt(p)[len("POLYGON (") : -1] + ")" for p in ps) + ")" if ps else None)
        yield pd.Series(out, dtype=object)


@F.pandas_udf(_NUMBER)
def wkt_area(shapes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Area of all parts of a polygon text, holes left out; 0 for other texts."""
    for s in shapes:
        out = []
        for w in s:
            try:
                ps = parse_polygons(w) if w and "polygon" in w[:40].lower() else []
            except (ValueError, IndexError):
                ps = []
            out.append(float(sum(abs(area(p[0])) - sum(abs(area(h)) for h in p[1:]) for p in ps)))
        yield pd.Series(out)


@F.pandas_udf(_NUMBER)
def line_in_polygon(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of a LINESTRING text within a polygon text, 0 where one is neither."""
    for a, b in pairs:
        yield pd.Series([0.0 if (x := parse_line(p)) is None or (y := _outer(q)) is None else length_inside(x, y) for p, q in zip(a, b, strict=True)])


def _faces_of(texts: list[str] | None) -> list[dict[str, float]] | None:
    if texts is None:
        return None
    lines = [p for p in map(parse_line, texts) if p is not None]
    return [{"area": area(r), "x": float(r[:-1, 0].mean()), "y": float(r[:-1, 1].mean())} for r in faces(lines)]


@F.pandas_udf(ArrayType(FACE))
def line_faces(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The faces of an array of LINESTRING texts: area and middle of the vertices, in the order of their first corner."""
    for s in lines:
        yield pd.Series([_faces_of(ws) for ws in s])


@F.pandas_udf(ArrayType(_POINT))
def centre_line(shapes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Points every 20 m along the longer axis of a strip's smallest rectangle (111 000 m a degree), null for other texts."""
    for s in shapes:
        out = []
        for r in map(_outer, s):
            if r is None:
                out.append(None)
                continue
            d = np.diff(r, axis=0)
            best = None
            for v in d[np.hypot(d[:, 0], d[:, 1]) > 0]:  # the smallest rectangle has a side along a side of the hull
                u = v / math.hypot(*v)
                w = np.array([-u[1], u[0]])
                x, y = r @ u, r @ w
                size = (np.ptp(x), np.ptp(y))
                if best is None or size[0] * size[1] < best[0] - 1e-18:
                    best = (size[0] * size[1], u, w, x, y, size)
            _, u, w, x, y, size = best
            along, across, at, of = (u, w, x, y) if size[0] >= size[1] else (w, u, y, x)
            n = int(max(size) * 111_000 / 20 + 1e-9)
            mid = (of.min() + of.max()) / 2
            out.append([{"x": float(p[0]), "y": float(p[1])} for p in (along * (at.min() + k * 20 / 111_000) + across * mid for k in range(n + 1))])
        yield pd.Series(out)
