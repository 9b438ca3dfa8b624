"""Subject areas of documents (problem 10).

One-versus-rest linear classifiers on hashed word n-grams (an ideograph is a word) score every sentence of a
text; a document deals with a subject where its sentences hold a share of the text above a threshold
calibrated on held-out labelled documents. Labels name whole documents and are partly wrong, so they are
weak labels of sentences: a first fit takes them as they are, later fits keep those a sentence supports.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 15
#: Bound of the labelled sample the classifiers are fitted on (documents); chosen by a hash of the id.
MAX_LABELLED = 1_500
FITS, EPOCHS, RATE, DECAY = 3, 30, 0.5, 1e-5
#: A sentence belongs to a subject from this probability on.
SENTENCE = 0.5
#: Where labels don't tell, the least share that counts as about a third.
ABOUT = 0.26
BATCH_CHARS = 2_000_000


@dataclass
class Sentences:
    """Sentences of a batch: document, length in words, and their features (flat, from starts[i])."""

    doc: np.ndarray
    words: np.ndarray
    flat: np.ndarray
    starts: np.ndarray


_END = np.zeros(0x10000, bool)
_END[[ord(c) for c in "。！？!?；;\n\r…"]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of the code points `c` (lower case): runs of letters, or single ideographs."""
    letter = ((c >= 97) & (c <= 122)) | (c == 39)
    ideo = (c >= 0x3400) & (c < 0xA000)
    head = ideo | (letter & ~np.concatenate(([False], letter[:-1])))
    at = np.flatnonzero(head)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    run = np.cumsum(head) - 1
    inside = letter | ideo
    pos = np.flatnonzero(inside)
    owner = run[pos]
    off = (pos - at[owner]).astype(np.uint64)
    v = (c[pos].astype(np.uint64) + np.uint64(1)) * (off * _MIX + np.uint64(0xD6E8FEB86659FD93))
    v ^= v >> np.uint64(29)
    v *= _MIX
    return at, np.add.reduceat(v, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))))


def sentences(texts: list[str]) -> Sentences:
    """Sentences of the texts and their hashed features: words of letters, and pairs and triples of words."""
    parts = [np.frombuffer((t.lower() + "\n").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    n = np.array([len(p) for p in parts])
    c = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    small = np.minimum(c, 0xFFFF)
    nxt = np.concatenate((small[1:], [10]))
    end = _END[small] | ((small == 46) & ~(((nxt >= 48) & (nxt <= 57)) | ((nxt >= 97) & (nxt <= 122))))
    sent = np.cumsum(end) - end  # a sentence holds its end mark
    doc = np.repeat(np.arange(len(texts)), n)
    at, h = _words(c)
    s = sent[at]
    two = np.flatnonzero(s[1:] == s[:-1])
    three = np.flatnonzero(s[2:] == s[:-2])
    h2 = h[two] * np.uint64(3) + (h[two + 1] ^ (h[two + 1] >> np.uint64(7))) * np.uint64(5)
    h3 = h[three] * np.uint64(7) + (h[three + 1] ^ (h[three + 1] >> np.uint64(9))) * np.uint64(11) + (h[three + 2] ^ (h[three + 2] >> np.uint64(5))) * np.uint64(13)
    one = np.flatnonzero((c[at] < 0x3400))
    f = np.concatenate((h[one], h2, h3))
    f = ((f ^ (f >> np.uint64(31))) * _MIX >> np.uint64(40)).astype(np.int64) % BUCKETS
    owner = np.concatenate((s[one], s[two], s[three]))
    order = np.argsort(owner, kind="stable")
    owner, f = owner[order], f[order]
    if not len(owner):
        e = np.zeros(0, np.int64)
        return Sentences(e, e, e, e)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    which = owner[starts]
    words = np.bincount(s, minlength=int(sent[-1]) + 1)[which]
    doc_of = np.zeros(int(sent[-1]) + 1, np.int64)
    doc_of[s] = doc[at]
    return Sentences(doc_of[which], words, f, starts)


def _scores(x: Sentences, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probability of each subject for each sentence."""
    size = np.diff(np.append(x.starts, len(x.flat)))
    z = np.add.reduceat(w[x.flat], x.starts, axis=0) / np.sqrt(size)[:, None] + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Sentences, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one classifier per column of y, by full-batch AdaGrad."""
    k = y.shape[1]
    w, bias = np.zeros((BUCKETS, k)), np.zeros(k)
    gw, gb = np.full((BUCKETS, k), 1e-8), np.full(k, 1e-8)
    size = np.diff(np.append(x.starts, len(x.flat)))
    root = np.sqrt(size)[:, None]
    sent = np.repeat(np.arange(len(size)), size)
    order = np.argsort(x.flat, kind="stable")
    feature, by = x.flat[order], sent[order]
    first = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
    used = feature[first]
    for _ in range(EPOCHS):
        err = (_scores(x, w, bias) - y) / len(size)
        g = np.add.reduceat((err / root)[by], first, axis=0) + DECAY * w[used] / len(size)
        gw[used] += g * g
        w[used] -= RATE * g / np.sqrt(gw[used])
        gb += err.sum(0) ** 2
        bias -= RATE * err.sum(0) / np.sqrt(gb)
    return w, bias


def shares(x: Sentences, p: np.ndarray, docs: int) -> np.ndarray:
    """Share of each subject in a document's sentences that belong to any subject (docs, subjects); where fewer
    than a third do, the share is of that third, so that a text about nothing isn't about its one mention."""
    best = p.argmax(1)
    mine = (p == p[np.arange(len(p)), best][:, None]) & (p >= SENTENCE)
    out = np.zeros((docs, p.shape[1]))
    np.add.at(out, x.doc, mine * 1.0)
    total = np.bincount(x.doc, minlength=docs)
    return out / np.maximum(np.maximum(out.sum(1), total / 3), 1)[:, None]


@dataclass
class Model:
    subjects: list[str]
    w: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray


def train(texts: list[str], labels: list[set[str]], subjects: list[str]) -> Model:
    """Classifiers and thresholds from weakly labelled texts; the thresholds come from a fit on the other half."""
    t = texts
    y = np.array([[s in ls for s in subjects] for ls in labels], float).reshape(len(labels), len(subjects))

    def weights(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = sentences([t[i] for i in ids])
        target = weak = y[ids][x.doc]
        w, b = _fit(x, target)
        for _ in range(FITS - 1):
            p = _scores(x, w, b)
            inside = np.where(weak > 0, p, 0)
            target = weak * (inside >= np.maximum(0.3, inside.max(1, keepdims=True)))
            w, b = _fit(x, target)
        return w, b

    ids = np.arange(len(t))
    got = np.zeros_like(y)
    for half in (0, 1):
        w, b = weights(ids[ids % 2 != half])
        held = ids[ids % 2 == half]
        x = sentences([t[i] for i in held])
        got[held] = shares(x, _scores(x, w, b), len(held))
    w, b = weights(ids)
    return Model(subjects, w, b, calibrate(got, y))


def calibrate(got: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of each subject above which held-out documents have its label, by F1, drawn to the common one where labels are few."""
    grid = np.arange(0.18, 0.41, 0.01)

    def f1(g: np.ndarray, t: np.ndarray) -> np.ndarray:
        hit = np.array([((g >= q) & (t > 0)).sum() for q in grid])
        return 2 * hit / np.maximum(1, np.array([(g >= q).sum() for q in grid]) + (t > 0).sum())

    common = f1(got, y)
    return np.array([grid[np.argmax(f1(got[:, k], y[:, k]) * y[:, k].sum() + 200 * common - np.abs(grid - ABOUT))] for k in range(y.shape[1])])


def classify(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject_code): the subjects of every document not in `labels`.

    Null and empty texts, and texts without words, deal with nothing; so does every text where there are no
    labels to learn from. Labels of unknown documents or subjects are not used; repeated ones count once.
    """
    names = sorted(r[0] for r in subjects.select("subject_code").where("subject_code is not null").distinct().collect())  # the fixed table of subjects
    lab = labels.where("doc_id is not null and subject_code is not null").groupBy("doc_id").agg(F.collect_set("subject_code").alias("codes"))  # at most one of each subject
    sample = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "codes").orderBy("doc_id").collect()
    if not rows or not names:
        return docs.select("doc_id", F.lit("").alias("subject_code")).limit(0)
    model = train([r["text"] for r in rows], [set(r["codes"]) for r in rows], names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, model.w.astype(np.float32), model.bias, model.thresholds))  # BUCKETS x subjects numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, w, bias, limits = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                x = sentences(texts[lo:hi])
                if len(x.doc):
                    d, k = np.nonzero(shares(x, _scores(x, w, bias), hi - lo) >= limits)
                    ids = b.column(0).slice(lo, hi - lo).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([codes[i] for i in k], pa.string())], names=["doc_id", "subject_code"])
                lo = hi

    others = docs.select("doc_id", "text").where("text is not null and doc_id is not null").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    return others.mapInArrow(run, f"doc_id {kind}, subject_code string")
