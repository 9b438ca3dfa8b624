"""Trust: the disposition lattice, evidence ledgers, belief masses, transition logs and fail-closed consumers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lattice in ascending order; masses of one item of evidence; caps of the belief rule.
LATTICE = ("REJECTED", "UNRESOLVED", "PROVISIONAL", "TRUSTED")
ITEM_MASS, BELIEF_MIN, CONFLICT_CAP = 0.6, 0.60, 0.50
#: Legal transitions of a run.
TRANSITIONS = (("BRIEFED", "RESOLVE", "RESOLVED"), ("RESOLVED", "REASON", "REASONED"), ("REASONED", "GENERATE", "GENERATED"), ("GENERATED", "AUDIT", "AUDITED"), ("AUDITED", "PUBLISH", "PUBLISHED"), ("AUDITED", "FAIL_CLOSE", "FAILED_CLOSED"))
REQUIRED = ("GEOMETRY", "AUDIT")


def rank(d: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, v in enumerate(LATTICE):
        out = F.when(d == v, i).otherwise(out)
    return out


def unrank(r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LATTICE]), r + 1)


def join_(a: Column, b: Column) -> Column:
    return unrank(F.greatest(rank(a), rank(b)))


def meet(a: Column, b: Column) -> Column:
    return unrank(F.least(rank(a), rank(b)))


def ledger_disposition(ledger: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, disposition, active, categories) from ledger rows (evidence_id, kind, category, overrides).

    Items that another item of the entity overrides do not count. An active refuting item rejects; all required
    categories among the supporting ones trust; else unresolved.
    """
    gone = ledger.select(key, F.explode("overrides").alias("evidence_id")).distinct()
    live = ledger.join(gone, [key, "evidence_id"], "left_anti")
    a = live.groupBy(key).agg(
        F.count(F.lit(1)).alias("active"), F.max((F.col("kind") == "REFUTING").cast("int")).alias("refuted"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "SUPPORTING", F.col("category")))).alias("categories"),  # at most one of each category
    )
    full = F.size(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), "categories")) == 0
    out = a.select(key, F.when(F.col("refuted") == 1, "REJECTED").when(full, "TRUSTED").otherwise("UNRESOLVED").alias("disposition"), "active", "categories")
    everyone = ledger.select(key).distinct()
    return everyone.join(out, key, "left").select(key, F.coalesce("disposition", F.lit("UNRESOLVED")).alias("disposition"), F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def ledger_snapshots(ledger: DataFrame, key: str = "entity_id", order: str = "seq") -> DataFrame:
    """(key, seq, disposition, previous, demoted, false_trust): the disposition after every item of an append-only
    ledger without overrides, from running counts; a demotion without a refuting item is false."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.max(((F.col("kind") == "SUPPORTING") & (F.col("category") == c)).cast("int")).over(w) for c in REQUIRED]
    refuted = F.max((F.col("kind") == "REFUTING").cast("int")).over(w)
    full = F.lit(True)
    for s in seen:
        full = full & (s == 1)
    d = ledger.select(key, order, "kind", F.when(refuted == 1, "REJECTED").when(full, "TRUSTED").otherwise("UNRESOLVED").alias("disposition"))
    d = d.withColumn("previous", F.lag("disposition").over(Window.partitionBy(key).orderBy(order)))
    demoted = F.coalesce(rank(F.col("disposition")) < rank(F.col("previous")), F.lit(False))
    return d.select(key, order, "disposition", "previous", demoted.alias("demoted"), (demoted & (F.col("kind") != "REFUTING")).alias("false_trust"))


def combine_masses(a: Column, b: Column) -> Column:
    """Dempster's rule on struct(h, n, u); at total conflict all mass goes to the unknown (Yager)."""
    k = a["h"] * b["n"] + a["n"] * b["h"]
    h, n, u = a["h"] * b["h"] + a["h"] * b["u"] + a["u"] * b["h"], a["n"] * b["n"] + a["n"] * b["u"] + a["u"] * b["n"], a["u"] * b["u"]
    whole = k >= 1 - 1e-12
    part = lambda m: F.when(whole, 0.0).otherwise(m / (1 - k))
    return F.struct(part(h).alias("h"), part(n).alias("n"), F.when(whole, 1.0).otherwise(u / (1 - k)).alias("u"))


def fold_masses(items: Column) -> Column:
    """The combination of an array of struct(h, n, u), in its order."""
    one = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("n"), F.lit(1.0).alias("u"))
    return F.aggregate(items, one, combine_masses)


def count_masses(support: Column, refute: Column) -> Column:
    """struct(h, n, u, conflict) of `support` and `refute` items of the fixed mass: the closed form of the fold, so
    a group of any size needs two counts only. conflict is that of both sides' combined masses."""
    miss_s, miss_r = F.pow(F.lit(1 - ITEM_MASS), support), F.pow(F.lit(1 - ITEM_MASS), refute)
    k = (1 - miss_s) * (1 - miss_r)
    rest = F.when(k >= 1 - 1e-12, None).otherwise(1 - k)
    return F.struct(F.coalesce((1 - miss_s) * miss_r / rest, F.lit(0.0)).alias("h"), F.coalesce((1 - miss_r) * miss_s / rest, F.lit(0.0)).alias("n"), F.coalesce(miss_s * miss_r / rest, F.lit(1.0)).alias("u"), F.least(F.lit(1.0), k).alias("conflict"))


def mass_disposition(m: Column) -> Column:
    """Refuting mass above holding mass rejects; conflict from the cap on, or little belief, hold back."""
    return F.when(m["n"] > m["h"], "REJECTED").when(m["conflict"] >= CONFLICT_CAP, F.when(m["h"] >= BELIEF_MIN, "PROVISIONAL").otherwise("UNRESOLVED")).when(m["h"] >= BELIEF_MIN, "TRUSTED").otherwise("UNRESOLVED")


def vote_belief(support: Column, refute: Column) -> Column:
    """struct(belief, plausibility, conflict) of the counting algebra."""
    n = support + refute
    return F.struct(F.when(n > 0, support / n).otherwise(0.0).alias("belief"), F.when(n > 0, support / n).otherwise(1.0).alias("plausibility"), F.when(n > 0, 2 * F.least(support, refute) / n).otherwise(0.0).alias("conflict"))


def status_bridge(status: Column, ready: Column, severity: Column) -> Column:
    return F.when(status.isin("REJECTED", "QUARANTINED") | ~ready | (severity == "CRITICAL"), "REJECTED").when(status == "RECONSTRUCTED", "PROVISIONAL").when(status.isin("VERIFIED_VALID", "REPAIRED_AUTO"), "TRUSTED").otherwise("UNRESOLVED")


def legal_transitions(log: DataFrame) -> DataFrame:
    """The rows of a log whose (state, transition) is legal, with the state they lead to."""
    t = log.sparkSession.createDataFrame(list(TRANSITIONS), "from_state string, transition string, next_state string")
    return log.join(F.broadcast(t), ["from_state", "transition"])


def canonical_digest(payload: dict) -> str:
    """SHA-256 of a payload as compact JSON with sorted keys; clock fields take no part."""
    clean = {k: v for k, v in payload.items() if not k.endswith("_at")}
    return hashlib.sha256(json.dumps(clean, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def hash_chain(log: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """(run, seq, prev_hash, event_hash): every event hashed with the hash before it. Batches of a run are streamed in
    order with the last hash as state, so a long run needs no more memory than a short one."""
    cols = [c for c in log.columns if c not in (run, order) and not c.endswith("_at")]
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(cols)])
    rows = log.select(run, order, text.alias("body")).repartition(run).sortWithinPartitions(run, order)
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_run, last = None, ""
        for f in frames:
            prev, new = [], []
            for r, body in zip(f[run], f["body"], strict=True):
                if r != last_run:
                    last_run, last = r, ""
                prev.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                new.append(last)
            yield pd.DataFrame({run: f[run], order: f[order], "prev_hash": prev, "event_hash": new})

    return rows.mapInPandas(chain, f"{run} {kinds[run]}, {order} {kinds[order]}, prev_hash string, event_hash string")


def broken_links(chain: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Events whose prev_hash is not the hash of the event before them."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(run).orderBy(order)), F.lit(""))
    return chain.withColumn("before", before).where("before <> prev_hash").drop("before")


def territory_ready(state: DataFrame, findings: DataFrame) -> DataFrame:
    """Entities fit for territories: sound geometry, a point, at most 2 km2, and no critical last finding."""
    last = findings.groupBy("entity_id").agg(F.max_by("severity", "seq").alias("severity"))
    j = state.join(last, "entity_id", "left")
    return j.where(F.col("status").isin("VERIFIED_VALID", "REPAIRED_AUTO") & ~F.coalesce(F.col("severity") == "CRITICAL", F.lit(False)) & F.col("lng").isNotNull() & (F.col("area_m2") <= 2_000_000)).select("entity_id", "area_m2")


def visit_ready(state: DataFrame) -> DataFrame:
    return state.where(F.col("ready") & F.coalesce((F.col("lng") != 0) | (F.col("lat") != 0), F.lit(False))).select("entity_id")


def coverage_ready(state: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without the objects of same-entity or merge-error relations that overlap by more than .30."""
    out = relations.where(F.col("relation").isin("SAME_ENTITY", "POSSIBLE_MERGE_ERROR") & (F.col("iou") > 0.30)).select(F.col("object_id").alias("entity_id")).distinct()
    return state.join(out, "entity_id", "left_anti").select("entity_id")


def decision_ready(state: DataFrame, findings: DataFrame, consumer: str) -> DataFrame:
    """Ready entities that no active finding blocks for a consumer."""
    blocked = findings.where(F.col("active") & F.array_contains("blocked_consumers", consumer)).select("entity_id").distinct()
    return state.where("ready").join(blocked, "entity_id", "left_anti").select("entity_id")
