"""Mixing sources to target weights (problem 9).

Soft membership: a text has a posterior over the sources, certain where its source is given, from a classifier
trained on texts with a source where it isn't. A text's rate is its posterior times a price per source, held
between 0 and its repeat limit. Projected gradient steps on the prices bring the expected tokens of every source to its
target in the least-squares sense (squares relative to the tokens of the source). A step is two aggregations over all texts
for all plans at once, the tokens and the gradient; with certain sources only, the gradient is what each source lacks, and one is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_blank, trimmed
from ..runtime import Cut
from . import subjects as sub
from .tokens import count_tokens

#: The steps end at CLOSE; a plan that has not settled after STEPS raises an error.
STEPS = 60
#: Relative distance from a target at which the steps end, and at which it counts as reached.
CLOSE, REACHED = 1e-4, 0.01
#: Bound of the labelled sample for the classifier of texts without a source (documents).
MAX_LABELLED = 2_000


def unique_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(src, key, n_tokens, copies, text only where src is null): one row per source and text."""
    src = F.when(~is_blank(F.col("source")), F.lower(trimmed(F.col("source"))))
    d = docs.where("text is not null").select(src.alias("src"), F.md5("text").alias("key"), "text")
    u = d.groupBy("src", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    u = u.withColumn("open_text", F.when(F.col("src").isNull(), F.col("text")))
    return count_tokens(u, ["src", "key", "copies", "open_text"], vocabulary)


def posteriors(texts: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """`texts` with pi, the posterior over `names`: certain where src is one of them, zero for another source,
    predicted where it is null. The classifier is fitted only if there is a text without a source."""
    certain = F.array(*[F.when(F.col("src") == n, 1.0).otherwise(0.0) for n in names])
    known = texts.where("src is not null").select("src", "key", "n_tokens", "copies", certain.alias("pi"))
    open_ = texts.where("src is null")
    if open_.isEmpty():
        return known
    src = F.lower(trimmed(F.col("source")))
    sample = docs.where(F.col("text").isNotNull()).select(src.alias("s"), F.col("text").alias("t"), "doc_id").where(F.col("s").isin(*names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    x = sub.sentences([r["t"] for r in sample])
    y = np.array([[r["s"] == n for n in names] for r in sample], float).reshape(-1, len(names))
    w, bias = sub._fit(x, y[x.doc]) if len(x.doc) else (np.zeros((sub.BUCKETS, len(names))), np.zeros(len(names)))
    shared = texts.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            x = sub.sentences([t or "" for t in b.column(4).to_pylist()])
            p = np.full((b.num_rows, w.shape[1]), 1e-6)
            if len(x.doc):
                np.add.at(p, x.doc, sub._scores(x, w, bias))
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(p), pa.list_(pa.float64()))], names=["src", "key", "n_tokens", "copies", "pi"])

    return known.unionByName(open_.select("src", "key", "n_tokens", "copies", "open_text").mapInArrow(run, "src string, key string, n_tokens bigint, copies bigint, pi array<double>"))


def _dot(a: Column, b: list[float]) -> Column:
    return sum((a[i] * F.lit(float(v)) for i, v in enumerate(b)), F.lit(0.0))


def mix(docs: DataFrame, plans: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, texts, source_tokens, wanted_tokens, mean_repeats, used_tokens,
    actual_share, reached), one row per plan and source.

    Equal texts of a source are one text, used max_repeats times at most however many copies there are. The
    wanted tokens are target_share x total_ratio x tokens of all documents. A text is used floor(rate) times
    and once more where the hash of the text lies below the rest. A source without tokens reaches only the
    target 0; null texts have no tokens; a null target is 0, a null max_repeats 1 and a null total_ratio 1. Without
    plans there is no row.
    """
    spark = docs.sparkSession
    cols = [c.lower() for c in ("mix_id", "source", "target_share", "max_repeats", "total_ratio")]
    got = plans.select(*cols).distinct().orderBy("mix_id", "source").collect()  # the fixed table of plans
    schema = "mix_id string, source string, target_share double, max_repeats int, texts bigint, source_tokens bigint, wanted_tokens double, mean_repeats double, used_tokens bigint, actual_share double, reached boolean"
    if not got:
        return spark.createDataFrame([], schema)
    names = sorted({(r["source"] or "").strip().lower() for r in got})
    at = {n: i for i, n in enumerate(names)}
    ids = sorted({r["mix_id"] or "" for r in got})
    texts = Cut(unique_texts(docs, vocabulary), "texts").df
    soft = Cut(posteriors(texts, docs, names), "posteriors").df
    base = soft.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all"), *[F.sum(F.col("n_tokens") * F.col("pi")[i]).alias(f"t{i}") for i in range(len(names))], *[F.sum((F.col("pi")[i] > 0.5).cast("long")).alias(f"n{i}") for i in range(len(names))], F.max(F.exists("pi", lambda v: (v > 0) & (v < 1))).alias("unsure")).first()
    total = base["all"] or 0
    have = np.array([base[f"t{i}"] or 0.0 for i in range(len(names))])
    target, cap = np.zeros((len(ids), len(names))), np.ones((len(ids), len(names)))
    for r in got:
        m, i = ids.index(r["mix_id"] or ""), at[(r["source"] or "").strip().lower()]
        target[m, i] = (r["target_share"] or 0.0) * (1.0 if r["total_ratio"] is None else r["total_ratio"]) * total
        cap[m, i] = 1 if r["max_repeats"] is None else max(0, r["max_repeats"])

    def free(m: int, price: np.ndarray) -> Column:
        return _dot(F.col("pi"), price[m]).between(0, F.floor(_dot(F.col("pi"), cap[m]) + 1e-9) + 1e-9)

    def rate(m: int, price: np.ndarray) -> Column:
        # the limit of a text without a source is the mean of its possible sources' limits
        return F.greatest(F.lit(0.0), F.least(_dot(F.col("pi"), price[m]), F.floor(_dot(F.col("pi"), cap[m]) + 1e-9)))

    def summed(per_text: Callable[[int], Column], at: np.ndarray) -> np.ndarray:
        """The sums over all texts, by plan and source, of what a text has at the prices, by its posterior."""
        sums = [F.sum(per_text(m) * F.col("n_tokens") * F.col("pi")[i]).alias(f"s{m}_{i}") for m in range(len(ids)) for i in range(len(names))]
        return np.array([v or 0.0 for v in soft.agg(*sums).first()]).reshape(at.shape)

    price = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
    for _ in range(STEPS):
        gap = np.divide(target - summed(lambda m: rate(m, price), price), have, out=np.zeros_like(price), where=have > 0)
        # the gradient: a text whose rate isn't held at a bound moves by its posteriors towards what all its sources lack
        slope = -summed(lambda m: F.when(free(m, price), _dot(F.col("pi"), gap[m])).otherwise(0.0), price) if base["unsure"] else -gap * have
        step = np.clip(price - np.divide(slope, have, out=np.zeros_like(slope), where=have > 0), 0, cap)
        if np.abs(step - price).max() <= CLOSE:
            break
        price = step
    else:
        raise RuntimeError(f"mix: prices not settled after {STEPS} steps")
    part = (F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) / (1 << 30)).cast("double")
    aggs = []
    for m in range(len(ids)):
        r = rate(m, price)
        use = F.floor(r) + (part < r - F.floor(r)).cast("long")
        for i in range(len(names)):
            aggs += [F.sum(use * F.col("n_tokens") * F.col("pi")[i]).alias(f"u{m}_{i}"), F.sum(use * F.col("pi")[i]).alias(f"k{m}_{i}")]
    used = soft.agg(*aggs).first()
    rows = []
    for r in got:
        m, i = ids.index(r["mix_id"] or ""), at[(r["source"] or "").strip().lower()]
        all_used = sum(used[f"u{m}_{j}"] or 0.0 for j in range(len(names)))
        u, n = used[f"u{m}_{i}"] or 0.0, base[f"n{i}"] or 0
        rows.append((r["mix_id"], r["source"], r["target_share"], r["max_repeats"], int(n), int(round(have[i])), round(float(target[m, i]), 1), round(float((used[f"k{m}_{i}"] or 0.0) / n), 4) if n else 0.0,
                     int(round(u)), round(float(u / all_used), 6) if all_used else 0.0, bool(target[m, i] <= price[m, i] * have[i] * (1 + REACHED) + 0.5 and target[m, i] <= cap[m, i] * have[i])))
    return spark.createDataFrame(rows, schema)
