"""Opinions of counted evidence, and logs of runs: legality, the publish gate, replay and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trust


def opinions(ledger: DataFrame, key: str) -> DataFrame:
    """(key, opinion) with opinion struct(support, refute, categories) of a ledger; categories of the supporting items."""
    o = F.struct(F.count_if(F.col("kind") == "SUPPORTING").cast("double").alias("support"), F.count_if(F.col("kind") == "REFUTING").cast("double").alias("refute"),
                 F.sort_array(F.collect_set(F.when(F.col("kind") == "SUPPORTING", F.col("category")))).alias("categories"))  # at most one of each category
    return ledger.groupBy(key).agg(o.alias("opinion"))


def combine(a: Column, b: Column) -> Column:
    """Both opinions together."""
    return F.struct((a["support"] + b["support"]).alias("support"), (a["refute"] + b["refute"]).alias("refute"), F.sort_array(F.array_union(a["categories"], b["categories"])).alias("categories"))


def arbitrate(a: Column, b: Column) -> Column:
    """The opinion with more support; of equal ones the support, the lesser refutation and both categories."""
    tie = F.struct(F.greatest(a["support"], b["support"]).alias("support"), F.least(a["refute"], b["refute"]).alias("refute"), F.sort_array(F.array_union(a["categories"], b["categories"])).alias("categories"))
    same = lambda o: F.struct(o["support"].alias("support"), o["refute"].alias("refute"), o["categories"].alias("categories"))
    return F.when(a["support"] > b["support"], same(a)).when(b["support"] > a["support"], same(b)).otherwise(tie)


def belief(o: Column) -> Column:
    n = o["support"] + o["refute"]
    return F.when(n > 0, o["support"] / n).otherwise(0.0)


def plausibility(o: Column) -> Column:
    n = o["support"] + o["refute"]
    return F.when(n > 0, 1 - o["refute"] / n).otherwise(1.0)


def conflict(o: Column) -> Column:
    n = o["support"] + o["refute"]
    return F.when(n > 0, 2 * F.least(o["support"], o["refute"]) / n).otherwise(0.0)


def _legal() -> Column:
    out = F.lit(False)
    for a, t, b in trust.TRANSITIONS:
        out = out | ((F.col("from_state") == a) & (F.col("transition") == t) & (F.col("to_state") == b))
    return out


def judged(log: DataFrame, run: str, order: str) -> DataFrame:
    """`log` (from_state, transition, to_state, evidence, digest) with `fault`: why an event cannot be appended to those before
    it, null for sound ones: a gap in the numbers, a state that does not chain, an illegal transition, or a PUBLISH without evidence
    or digest."""
    w = Window.partitionBy(run).orderBy(order)
    start = trust.TRANSITIONS[0][0]
    before = F.coalesce(F.lag("to_state").over(w), F.lit(start))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = F.when(F.col(order) != F.row_number().over(w) - 1, "SEQ_GAP").when(F.col("from_state") != before, "STATE_GAP").when(~_legal(), "ILLEGAL").when((F.col("transition") == "PUBLISH") & (empty("evidence") | empty("digest")), "PUBLISH_GATE")
    return log.withColumn("fault", fault)


def replay(log: DataFrame, run: str, order: str) -> DataFrame:
    """(run, state, broken_at): the state that a run's events lead to, up to the first one with a fault (broken_at, else null).
    Runs whose first event is faulty stay in the first state."""
    j = judged(log, run, order)
    at = j.where("fault IS NOT NULL").groupBy(run).agg(F.min(order).alias("broken_at"))
    live = j.join(at, run, "left").where(F.col("broken_at").isNull() | (F.col(order) < F.col("broken_at")))
    last = live.groupBy(run).agg(F.max_by("to_state", order).alias("state"))
    return j.select(run).distinct().join(last, run, "left").join(at, run, "left").select(run, F.coalesce("state", F.lit(trust.TRANSITIONS[0][0])).alias("state"), "broken_at")


def verify(log: DataFrame, chain: DataFrame, run: str, order: str) -> DataFrame:
    """(run, events, broken): events of a log whose recorded hashes (`chain`) are not those computed again, or don't link."""
    again = trust.hash_chain(log, run, order).select(run, order, F.col("prev_hash").alias("_p"), F.col("event_hash").alias("_e"))
    j = again.join(chain, [run, order], "full")
    bad = ~(F.col("_p").eqNullSafe(F.col("prev_hash")) & F.col("_e").eqNullSafe(F.col("event_hash")))
    return j.groupBy(run).agg(F.count(F.lit(1)).alias("events"), F.count_if(bad).alias("broken"))
