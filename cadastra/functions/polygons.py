"""Numpy kernel for polygons: parsing of WKT texts."""

from __future__ import annotations

import re

import numpy as np

_RING = re.compile(r"\(([^()]*)\)")
_PARENTHESIS = re.compile(r"[()]")


def _points(ring: str) -> np.ndarray:
    t = [p.split() for p in ring.split(",")]
    if all(len(p) == 2 for p in t):
        return np.array([float(v) for p in t for v in p]).reshape(-1, 2)
    return np.array([p[:2] for p in t], float)


def parse_polygons(wkt: str) -> list[list[np.ndarray]]:
    """Parts of a POLYGON or MULTIPOLYGON text, each a list of closed rings (n, 2), the outer one first.
    Texts that are not complete polygons are not handed here."""
    text = wkt[wkt.index("(") :]
    if "multi" not in wkt[: wkt.index("(")].lower():
        text = f"({text})"
    parts: list[list[np.ndarray]] = []
    depth, start = 0, 0
    for m in _PARENTHESIS.finditer(text):
        k = m.start()
        if text[k] == "(":
            depth += 1
            if depth == 2:
                start = k
        else:
            depth -= 1
            if depth == 1:
                rings = [_points(ring) for ring in _RING.findall(text[start + 1 : k])]
                parts.append([r if (r[0] == r[-1]).all() else np.vstack((r, r[:1])) for r in rings])
    return parts
