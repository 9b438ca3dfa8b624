"""Declarative gates: constraint trees compiled to columns, dispositions and consumer readiness."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "between", "nonempty", "present", "regex")
NODES = ("fact", "min_count", "none_match", "all_of", "any_of", "not", "warn_if")


def check_spec(spec: dict[str, Any] | str) -> dict[str, Any]:
    """The gate as a dict; raises ValueError at load time for an unknown node or operation, or a missing part."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if "gate_id" not in spec or "must" not in spec:
        raise ValueError("a gate needs gate_id and must")

    def walk(n: dict[str, Any]) -> None:
        kind = n.get("node")
        if kind not in NODES:
            raise ValueError(f"unknown node {kind!r}")
        if kind == "fact" and n.get("op") not in OPS:
            raise ValueError(f"unknown operation {n.get('op')!r}")
        if kind in ("fact", "min_count", "none_match") and "fact" not in n:
            raise ValueError(f"{kind} needs a fact")
        if kind in ("all_of", "any_of"):
            if not n.get("children"):
                raise ValueError(f"{kind} needs children")
            for c in n["children"]:
                walk(c)
        if kind in ("not", "warn_if"):
            walk(n["child"])

    for part in ("must", "blocked", "warns"):
        if spec.get(part):
            walk(spec[part])
    return spec


def _test(f: Column, op: str, v: Any) -> Column:
    """A fact's test; a missing fact fails every test but ne and not_in."""
    t = {
        "eq": lambda: f == v, "gt": lambda: f > v, "gte": lambda: f >= v, "lt": lambda: f < v, "lte": lambda: f <= v, "in": lambda: f.isin(*v), "between": lambda: f.between(*v),
        "regex": lambda: f.rlike(v), "present": lambda: f.isNotNull(), "nonempty": lambda: F.length(f.cast("string")) > 0,
        "ne": lambda: ~f.eqNullSafe(F.lit(v)), "not_in": lambda: f.isNull() | ~f.isin(*v),
    }[op]()
    return F.coalesce(t, F.lit(False))


def holds(n: dict[str, Any]) -> Column:
    """The truth of a tree over the columns of a row (facts by name; list facts for min_count and none_match)."""
    kind = n["node"]
    if kind == "fact":
        return _test(F.col(n["fact"]), n["op"], n.get("value"))
    if kind == "min_count":
        return F.coalesce(F.size(F.col(n["fact"])) >= n["count"], F.lit(False))
    if kind == "none_match":
        return F.coalesce(~F.exists(F.col(n["fact"]), lambda x: F.coalesce(F.lower(x).rlike(n["value"].lower()), F.lit(False))), F.lit(False))
    if kind in ("all_of", "any_of"):
        out = holds(n["children"][0])
        for c in n["children"][1:]:
            out = out & holds(c) if kind == "all_of" else out | holds(c)
        return out
    return ~holds(n["child"]) if kind == "not" else F.lit(True)  # warn_if never fails


def finding(n: dict[str, Any]) -> Column:
    """The message of the first failing child, null where the tree holds."""
    if n["node"] == "all_of":
        return F.coalesce(*[finding(c) for c in n["children"]])
    return F.when(~holds(n), F.lit(n.get("message") or n.get("fact") or n["node"]))


def _warnings(n: dict[str, Any] | None) -> list[dict[str, Any]]:
    if not n:
        return []
    own = [n] if n["node"] == "warn_if" else []
    return own + [w for c in (*n.get("children", []), *([n["child"]] if "child" in n else [])) for w in _warnings(c)]


def gate(spec: dict[str, Any] | str) -> Column:
    """struct(status, finding): BLOCKED, FAILED, WARNED or PASSED, in this order of precedence."""
    s = check_spec(spec)
    warns = [holds(w["child"]) for part in ("must", "warns") for w in _warnings(s.get(part))]
    if s.get("warns") and s["warns"]["node"] != "warn_if":
        warns.append(holds(s["warns"]))
    any_warn = F.lit(False)
    for w in warns:
        any_warn = any_warn | w
    blocked = holds(s["blocked"]) if s.get("blocked") else F.lit(False)
    status = F.when(blocked, "BLOCKED").when(~holds(s["must"]), "FAILED").when(any_warn, "WARNED").otherwise("PASSED")
    return F.struct(status.alias("status"), F.when(blocked, F.lit("blocked")).otherwise(finding(s["must"])).alias("finding"))


def fact(name: str, op: str, value: Any = None, message: str | None = None) -> dict[str, Any]:
    return {"node": "fact", "fact": name, "op": op, "value": value, "message": message}


def all_of(*children: dict[str, Any]) -> dict[str, Any]:
    return {"node": "all_of", "children": list(children)}


def any_of(*children: dict[str, Any]) -> dict[str, Any]:
    return {"node": "any_of", "children": list(children)}


#: The entity types of the ontology.
ENTITY_TYPES = ("RESIDENTIAL_ESTATE", "COMPOUND", "COURTYARD", "BUILDING", "DORMITORY", "SCHOOL", "HOSPITAL", "PARK", "COMMERCIAL", "OFFICE", "INDUSTRIAL", "GOVERNMENT", "TRANSPORT", "SCENIC")
ONTOLOGY = {"gate_id": "ONTOLOGY", "must": fact("entity_type", "in", list(ENTITY_TYPES)), "warns": all_of(fact("entity_type", "eq", "RESIDENTIAL_ESTATE"), fact("boundary_role", "eq", "PHYSICAL_BOUNDARY"))}
GEOMETRY = {
    "gate_id": "GEOMETRY", "blocked": any_of(fact("geometry_empty", "eq", True), fact("parse_error", "eq", True), fact("geometry_valid", "ne", True)),
    "must": fact("area_m2", "between", [100.0, 5e6]), "warns": fact("compactness", "lt", 0.05),
}
EVIDENCE = {
    "gate_id": "EVIDENCE", "blocked": {"node": "not", "child": {"node": "none_match", "fact": "evidence_contents", "value": "conflict_contradiction|explicit_exclusion"}},
    "must": {"node": "min_count", "fact": "evidence_sources", "count": 1}, "warns": all_of(fact("evidence_n", "eq", 1), fact("sole_source", "eq", "AreaPriorBaseline")),
}


def final_disposition(*statuses: Column) -> Column:
    """The disposition of an object from its ontology, geometry and evidence gates."""
    onto, geom, evid = statuses
    any_of_ = lambda v: (onto == v) | (geom == v) | (evid == v)
    return F.when(any_of_("BLOCKED"), "REJECTED").when((onto == "FAILED") | (geom == "FAILED"), "REJECTED").when(evid == "FAILED", "UNRESOLVED").when(any_of_("WARNED"), "PROVISIONAL").otherwise("TRUSTED")


def generation_score(*sources: Column) -> Column:
    """The first score that is given, else .5."""
    return F.coalesce(*sources, F.lit(0.5))


def readiness(disposition: Column, score: Column, warned: Column, min_confidence: Column, allow_provisional: Column, needs_topology: Column) -> Column:
    """READY, READY_WITH_WARNING or NOT_READY of one consumer; a consumer that needs topology is never ready."""
    usable = disposition.isin("TRUSTED", "PROVISIONAL") & ((disposition != "PROVISIONAL") | allow_provisional) & (score >= min_confidence) & ~needs_topology
    return F.when(~F.coalesce(usable, F.lit(False)), "NOT_READY").when(warned | (disposition == "PROVISIONAL"), "READY_WITH_WARNING").otherwise("READY")


def consumer_decisions(objects: DataFrame, consumers: DataFrame) -> DataFrame:
    """One row per object and consumer profile (a handful of profiles, broadcast)."""
    j = objects.crossJoin(F.broadcast(consumers))
    return j.withColumn("decision", readiness(F.col("disposition"), F.col("score"), F.col("warned"), F.col("min_confidence"), F.col("allow_provisional"), F.col("needs_topology")))


def coverage_gate(named: Column, has_provider: Column, poi_m: Column) -> Column:
    """PASSED for named places, WARNED without provider or with a POI within 200 m, else BLOCKED."""
    return F.when(named, "PASSED").when(~has_provider, "WARNED").when(poi_m <= 200, "WARNED").otherwise("BLOCKED")
