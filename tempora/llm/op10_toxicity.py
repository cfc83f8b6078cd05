"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: beginnings of words (and whole words) that documents labelled toxic have far more often than
others, counted by Spark over one part of a bounded sample. Trees are grown on another part, calibration uses a third.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BYTE_BASE, blocks, crc_mod, mix, prefix_hash, released, span_hash, table
from .sampling import labelled_sample

#: Documents to learn from, and entries of the lexicon, at most about.
SAMPLE, LEXICON = 8000, 1500
#: Bytes of the beginnings of words that may enter the lexicon (0: the whole word).
LENGTHS = (4, 5, 6, 7, 0)
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 64
#: Words that address the reader (fixed values).
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
#: Signs that stand for letters inside words (fixed values).
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}
NEAR = 5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True
_PLAIN = _LOWER.copy()
for _a, _b in STANDS_FOR.items():
    _PLAIN[ord(_a)] = ord(_b)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(inside)]
    first[at] = inside[at]
    to = offsets[1:][offsets[1:] > 0] - 1
    last[to] = inside[to]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _keys(prefix, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the hash of that beginning of each word; 0 for shorter words."""
    for n in LENGTHS:
        key = span_hash(prefix, start, np.minimum(start + n, end) if n else end)
        yield mix(key + np.uint64(n + 1)) if not n else np.where(end - start > n, mix(key + np.uint64(n + 1)), np.uint64(0))


def _weights(prefix, start, end, names: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The largest weight in the lexicon of any beginning of each word."""
    out = np.zeros(len(start))
    if len(names):
        for key in _keys(prefix, start, end):
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            np.maximum(out, np.where(names[at] == key, weight[at], 0), out=out)
    return out


_YOU = np.sort(np.array([next(iter(span_hash(prefix_hash(np.frombuffer(w.encode(), np.uint8), BYTE_BASE), np.zeros(1, np.int64), np.array([len(w.encode())])))) for w in SECOND_PERSON.split()], np.uint64))
FEATURES = ("log_words", "lexicon", "lexicon_weight", "lexicon_most", "lexicon_hits", "second_person", "near_second_person", "capitals", "shouted", "punctuation", "exclamation", "digits", "obfuscated", "hidden", "repeats")


def features(data: np.ndarray, offsets: np.ndarray, names: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1

    def per_text(at: np.ndarray, values=None) -> np.ndarray:
        return np.bincount(np.searchsorted(offsets, at, "right") - 1, values, minlength=n)[:n] if len(at) else np.zeros(n)

    letter = _LETTER[data]
    start, end = _runs(letter, offsets)
    lower = _LOWER[data]
    prefix = prefix_hash(lower, BYTE_BASE)
    w = _weights(prefix, start, end, names, weight) if len(start) else np.zeros(0)
    whole = span_hash(prefix, start, end) if len(start) else np.zeros(0, np.uint64)
    you = _YOU[np.minimum(np.searchsorted(_YOU, whole), len(_YOU) - 1)] == whole
    of = np.searchsorted(offsets, start, "right") - 1
    count = np.cumsum(np.concatenate([[0], you]))
    place = np.arange(len(start))
    near = (count[np.minimum(place + NEAR + 1, len(start))] - count[np.maximum(place - NEAR, 0)]) > 0
    caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    shouted = (end - start > 2) & (caps[end] - caps[start] == end - start)
    # words with signs inside, read with the letters that those stand for
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    s2, e2 = _runs(letter | _SIGN[data], offsets)
    inner = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        inside = np.zeros(len(data), bool)
        inside[1:-1] = _SIGN[data[1:-1]] & letter[:-2] & letter[2:]
        inner[1:] = np.cumsum(inside)
    mixed = inner[e2] > inner[s2]
    s2, e2 = s2[mixed], e2[mixed]
    hidden = _weights(prefix_hash(_PLAIN[data], BYTE_BASE), s2, e2, names, weight) if len(s2) else np.zeros(0)
    triple = np.flatnonzero((lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & letter[2:]) if len(data) > 2 else np.zeros(0, np.int64)
    words = np.maximum(1, per_text(start))
    size, letters = np.maximum(1, np.diff(offsets)), np.maximum(1, per_text(np.flatnonzero(letter)))
    most = np.zeros(n)
    np.maximum.at(most, of, w)
    hits = per_text(start[w > 0])
    rows = (
        np.log(words), hits / words, per_text(start, w) / words, most, np.log1p(hits), per_text(start[you]) / words, per_text(start[(w > 0) & near]) / words,
        per_text(np.flatnonzero((data >= 65) & (data <= 90))) / letters, per_text(start[shouted]) / words, per_text(np.flatnonzero(_PUNCTUATION[data])) / size,
        per_text(np.flatnonzero(data == 33)) / size, per_text(np.flatnonzero((data >= 48) & (data <= 57))) / size, per_text(s2) / words, per_text(s2[hidden > 0]) / words, per_text(triple) / size,
    )
    return np.stack(rows, axis=1)


class Trees:
    """Boosted trees of a fixed depth on binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self._bin(x)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                width = 1 << level
                best = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, BINS, np.int64)
                for k in range(x.shape[1]):
                    cell = node * (BINS + 1) + bins[:, k]
                    gs, hs = (np.bincount(cell, v, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = np.where((hs > 1) & (ht - hs > 1), gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), 0)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best[0]
                    for b, v in zip(best, (top, np.full(width, k), at), strict=True):
                        b[better] = v[better]
                splits.append((best[1], best[2]))
                node = node * 2 + (bins[np.arange(len(y)), best[1][node]] > best[2][node])
            leaf = RATE * np.bincount(node, g, minlength=1 << DEPTH) / (np.bincount(node, h, minlength=1 << DEPTH) + 1)
            self.trees.append((splits, leaf))
            f = f + leaf[node]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._bin(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (bins[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to score (pool adjacent violators), to be interpolated."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v1, n1, lo, _ = pools[-2]
            v2, n2, _, hi = pools.pop()
            pools[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi]
    xs = np.array([z for p in pools for z in (p[2], p[3])])
    return xs, np.array([z for p in pools for z in (p[0], p[0])])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each beginning of a word, in how many toxic and other documents of a block it stands."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            start, end = _runs(_LETTER[data], offsets)
            if not len(start):
                continue
            of = np.searchsorted(offsets, start, "right") - 1
            prefix = prefix_hash(_LOWER[data], BYTE_BASE)
            key = np.concatenate(list(_keys(prefix, start, end)))
            of = np.tile(of, len(LENGTHS))
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) & (key != 0)
            name, at = np.unique(key[new], return_inverse=True)
            toxic = np.bincount(at, label[of[new]], minlength=len(name)).astype(np.int64)
            yield pa.record_batch({"key": pa.array(name.view(np.int64)), "toxic": pa.array(toxic), "other": pa.array(np.bincount(at, minlength=len(name)) - toxic)})


def _rows(names, weight) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                x = features(data, offsets, names, weight)
                yield pa.record_batch({"label": part.column(1), "part": part.column(2), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))})

    return run


class Model:
    """A learned lexicon, trees over the features, and the calibration; small enough to go to every task."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE):
        chosen = labelled_sample(docs, labels, "toxic", learn, sample)
        sizes = {r["label"]: r["n"] for r in chosen.filter("part < 0.5").groupBy("label").agg(F.count("*").alias("n")).collect()}
        toxic, other = sizes.get(1, 0), sizes.get(0, 0)
        counted = chosen.filter("part < 0.5").select("text", "label").mapInArrow(released(_counts), "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
        rate = F.log((F.col("t") + 0.1) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
        best = counted.filter(F.col("t") >= max(2, toxic // 100)).withColumn("w", rate).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.log1p("t")), "key").limit(LEXICON).collect()
        names = np.array([r["key"] for r in best], np.int64).view(np.uint64)
        order = np.argsort(names)
        self.names, self.weight = names[order], np.array([r["w"] for r in best], float)[order]
        rows = chosen.filter("part >= 0.5").select("text", "label", "part").mapInArrow(released(_rows(self.names, self.weight)), "label int, part double, x array<double>").collect()
        rows.sort(key=lambda r: (r["part"], r["x"]))
        x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
        y, part = np.array([r["label"] for r in rows], float), np.array([r["part"] for r in rows])
        self.trees, self.rate = None, float(y.mean()) if len(y) else 0.0
        grow, fit = part < 0.85, part >= 0.85
        if len(np.unique(y[grow])) == 2:
            self.trees = Trees(x[grow], y[grow])
            self.knots = isotonic(self.trees.raw(x[fit]), y[fit]) if len(np.unique(y[fit])) == 2 else None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.rate)
        raw = self.trees.raw(features(data, offsets, self.names, self.weight))
        plain = 1 / (1 + np.exp(-raw))
        if self.knots is None:
            return plain
        # the calibrated value, with a little of the plain one, which keeps the order inside a pool
        return 0.98 * np.interp(raw, *self.knots) + 0.02 * plain


def _scored(model, out: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text, 1 << 18):
                columns = [*part.columns, pa.array(model.score(data, offsets))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, out])

    return run


def scored(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score in the new column ``out``."""
    return docs.mapInArrow(released(_scored(model, out, text)), StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learned from labels outside the fold ``held_out``.

    The score depends on the text alone. A null or empty text gets the score of a text without words. Without labels of
    both kinds every score is the share of toxic ones (0 without any). Each row has its own result; a null id stays
    null and is not held out. Other columns are not read.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = Model(ready, labels.select("doc_id", "toxic"), crc_mod("doc_id", folds) != held_out)
    out = scored(ready, model).drop("text")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
