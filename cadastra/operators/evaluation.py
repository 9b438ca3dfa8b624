"""Calibration, benchmark metrics, failure attribution and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BINS = 10


def calibration_bins(pred: DataFrame, confidence: str, correct: str, clamp_last: bool = False) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, gap) of ten equal bins, empty ones with their middle and no gap. A
    confidence of 1 lies in no bin unless `clamp_last`."""
    b = F.floor(F.col(confidence) * BINS).cast("int")
    b = F.least(b, F.lit(BINS - 1)) if clamp_last else b
    got = pred.select(b.alias("bin"), confidence, correct).where(F.col("bin") < BINS).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"))
    dim = pred.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    j = F.broadcast(dim).join(got, "bin", "left")
    return j.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", (F.col("bin") + 0.5) / BINS).alias("mean_confidence"), F.coalesce("a", F.lit(0.0)).alias("accuracy"), F.coalesce(F.abs(F.col("c") - F.col("a")), F.lit(0.0)).alias("gap"))


def calibration_error(bins: DataFrame, total: DataFrame) -> DataFrame:
    """(ece, mce): `total` is one row with n, the number of all predictions."""
    return bins.agg(F.sum(F.col("gap") * F.col("n")).alias("s"), F.max("gap").alias("mce")).crossJoin(F.broadcast(total)).select((F.col("s") / F.greatest("n", F.lit(1))).alias("ece"), "mce")


def calibrated(pred: DataFrame, bins: DataFrame, confidence: str) -> DataFrame:
    """`pred` with the accuracy of its bin, or the raw confidence where the bin is empty."""
    k = bins.where("n > 0").select("bin", F.col("accuracy").alias("calibrated"))
    return pred.withColumn("bin", F.floor(F.col(confidence) * BINS).cast("int")).join(F.broadcast(k), "bin", "left").withColumn("calibrated", F.coalesce("calibrated", confidence)).drop("bin")


def experiment_metrics(runs: DataFrame) -> DataFrame:
    """Per experiment: runs, share with candidates, top-1 quality, share trusted, share failing closed."""
    ok = F.col("candidate_count") > 0
    return runs.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(ok.cast("int")), 6).alias("applicability"), F.round(F.coalesce(F.avg(F.when(ok, F.col("top1_iou"))), F.lit(0.0)), 6).alias("top1_quality"),
        F.round(F.avg((F.col("disposition") == "TRUSTED").cast("int")), 6).alias("trusted_coverage"), F.round(F.avg((F.col("disposition") == "UNRESOLVED").cast("int")), 6).alias("abstention"),
    )


def failure_code(candidates: Column, oracle: Column, top1: Column, disposition: Column) -> Column:
    """The first reason a run failed, null where it did not."""
    return F.when(candidates == 0, "NO_CANDIDATE").when(oracle < 0.5, "GENERATION_CEILING").when(top1 < 0.5, "RANKING_MISS").when(disposition == "REJECTED", "VALIDATION_REJECT").when(disposition == "UNRESOLVED", "EVIDENCE_GAP")


def quadrants(runs: DataFrame) -> DataFrame:
    """(oracle_ok, top1_ok, n): whether any and whether the first candidate is good."""
    return runs.groupBy((F.col("oracle_iou") >= 0.5).alias("oracle_ok"), (F.col("top1_iou") >= 0.5).alias("top1_ok")).agg(F.count(F.lit(1)).alias("n"))


def decision_rule(deltas: DataFrame, delta: float = 0.05, epsilon: float = 0.01) -> DataFrame:
    """One row: ADOPT if the mean regret falls by more than `delta`, REJECT if it rises by more than `epsilon`, else KEEP."""
    return deltas.agg(F.avg("delta").alias("mean_delta")).withColumn("verdict", F.when(F.col("mean_delta") <= -delta, "ADOPT").when(F.col("mean_delta") > epsilon, "REJECT").otherwise("KEEP"))


def stratified_sample(rows: DataFrame, stratum: str, key: Column, per: int) -> DataFrame:
    """The `per` rows of each stratum that come first by a deterministic hash `key`; the feature is a sample."""
    w = Window.partitionBy(stratum).orderBy(key)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per).drop("rn")


def binned_sample(rows: DataFrame, score: str, order: list[str], n: int) -> DataFrame:
    """A sample of `n` rows over ten bins of a score in 0..1: in each bin the first n / 10 by `order`, then the first of
    the rest up to n. The rest is ranked after it is cut to n rows a bin, so no task sorts all rows."""
    per = n // 10
    w = Window.partitionBy("bin").orderBy(*order)
    k = rows.withColumn("bin", F.least(F.lit(9), F.floor(F.col(score) * 10).cast("int"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    own = k.where(F.col("rn") <= per)
    taken = own.agg(F.count(F.lit(1)).alias("taken"))
    rest = k.where(F.col("rn") > per).withColumn("up", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(taken)).where(F.col("up") <= n - F.col("taken"))  # ten times n rows at most
    return own.drop("rn").unionByName(rest.drop("rn", "up", "taken"))


def weighted_mean(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, mean): the mean of a value weighted by, say, lengths; null where all weights are 0."""
    return rows.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean"))


def histogram(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of the bin [edges(i), edges(i+1)) a value lies in, null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when((value >= a) & (value < b), i).otherwise(out)
    return out


def with_total(rows: DataFrame, group: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Aggregates by `group` and over all rows, in one pass."""
    c = rows.rollup(group).agg(F.grouping(group).alias("_g"), *aggs)
    return c.withColumn(group, F.when(F.col("_g") == 1, label).otherwise(F.col(group))).drop("_g")
