"""Encoding of whole texts with a public byte-level BPE tokenizer (problem 8).

All words of an Arrow batch lie in one flat symbol array. In a round every word merges its lowest-ranked
pair; ranks are found by binary search over sorted pair keys, and only pairs beside a merge are looked up
again. Before the first round words are cut at byte pairs that lie inside no token of the vocabulary: no
merge can ever cross such a place, so the cut changes no id and keeps unspaced scripts short.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int32(2**31 - 1)
#: Characters of text handled at once; longer batches are cut between texts, never inside one.
BATCH_CHARS = 4_000_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json."""
    return os.path.join(os.environ.get("CADASTRA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes batches of texts; one per Python worker and vocabulary."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, letters = model["vocab"], _byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges), strict=True))
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order].astype(np.int32)
        self.first = np.zeros(256, np.int32)
        inside = np.zeros(1 << 16, bool)
        for token, i in vocab.items():
            raw = [letters[ch] for ch in token if ch in letters]
            if len(raw) != len(token):
                continue  # a special token
            if len(raw) == 1:
                self.first[raw[0]] = i
            for x, y in zip(raw, raw[1:]):
                inside[x << 8 | y] = True
        self.inside = inside
        self.find = regex.compile(PATTERN).findall

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the merge table of the pairs (a, b)."""
        k = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.key, k)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == k, self.rank[at], NO_RANK), at

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        raw = [w.encode() for w in words]
        n = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), n
        word = np.repeat(np.arange(len(raw)), n)
        joined = (word[1:] == word[:-1]) & self.inside[flat[:-1].astype(np.int64) << 8 | flat[1:]]
        sym = self.first[flat]
        place = np.arange(len(flat))  # where a symbol's id goes; ids of one word stay in order
        out = np.full(len(flat), -1, np.int32)
        # a piece is what no cut divides
        piece = np.concatenate(([0], np.cumsum(~joined)))
        alone = np.bincount(piece)[piece] == 1
        out[alone] = sym[alone]
        sym, place, piece = sym[~alone], place[~alone], piece[~alone]
        rank = np.full(len(sym), NO_RANK, np.int32)  # of the pair (i, i + 1)
        at = np.zeros(len(sym), np.int64)
        if len(sym):
            same = np.flatnonzero(piece[1:] == piece[:-1])
            rank[same], at[same] = self._look(sym[same], sym[same + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            low = np.repeat(least, size)
            over = low == NO_RANK
            if over.any():
                out[place[over]] = sym[over]
                keep = ~over
                sym, place, piece, rank, at, low = sym[keep], place[keep], piece[keep], rank[keep], at[keep], low[keep]
                if not len(sym):
                    break
            hit = rank == low
            i = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(i) != 1))  # a run of overlapping equal pairs: every second one merges
            if not run.all():
                head = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - head) % 2 == 0]
            sym[i] = self.made[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[i] = True
            sym, place, piece, rank, at, touched = sym[keep], place[keep], piece[keep], rank[keep], at[keep], touched[keep]
            j = np.flatnonzero(touched)
            j = np.union1d(j, j[j > 0] - 1)
            rank[j] = NO_RANK
            j = j[j + 1 < len(sym)]
            j = j[piece[j] == piece[j + 1]]
            rank[j], at[j] = self._look(sym[j], sym[j + 1])
        kept = out >= 0
        return out[kept], np.bincount(word[kept], minlength=len(raw))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has; null and empty texts have none."""
        seen: dict[str, int] = {}
        index: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            if text:
                found = self.find(text)
                index.extend([seen.setdefault(w, len(seen)) for w in found])
                counts[t] = len(found)
        ids, size = self.words(list(seen))
        start = np.concatenate(([0], np.cumsum(size)))
        idx = np.array(index, np.int64)
        n = size[idx] if len(idx) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(start[idx] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
        text_of = np.repeat(np.arange(len(texts)), counts)
        return flat, np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64) if len(idx) else counts


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every text without special tokens; null and empty texts give an empty list.

    Whole texts of any length are encoded; repeated rows are encoded each. Strings of special tokens in a
    text are ordinary text. Other columns of `docs` are not read.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _parts(texts):
                flat, size = enc.texts(texts[lo:hi])
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` and n_tokens bigint of its text (0 for null and empty)."""
    path = vocabulary or default_vocabulary()
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path)
        for b in batches:
            texts = b.column(0).to_pylist()
            size = [enc.texts(texts[lo:hi])[1] for lo, hi in _parts(texts)]
            n = np.concatenate(size) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(text, *keep).mapInArrow(run, f"{schema}, n_tokens bigint" if keep else "n_tokens bigint")
