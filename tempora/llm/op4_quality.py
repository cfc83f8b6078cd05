"""Quality by a byte-level convolutional network in numpy.

Filters over bytes run along chunks that overlap and cover the whole document; each filter's largest response in a
chunk is kept, and the mean and the largest over the chunks go into one logistic unit. The network is trained by
back-propagation through the places of the largest responses, on whole texts of one part of a bounded sample; the other
part, which the filters have not seen, calibrates the output as a probability (a logistic fit of two numbers).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, spread, table
from .op10_toxicity import scored
from .sampling import labelled_sample

#: Filters and bytes they see; bytes of a chunk and how many of them it shares with the next.
FILTERS, WIDTH = 16, 6
CHUNK, OVERLAP = 512, 16
#: Documents and bytes of text to learn from, about, at most.
SAMPLE, SAMPLE_BYTES = 2400, 8 << 20
#: Share of the sample that the filters are trained on; the rest calibrates.
TRAINED = 0.75
EPOCHS, BATCH, STEP = 10, 64, 0.01


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.pairs = None

    def tables(self) -> list[np.ndarray]:
        """Of each two neighbouring places of the filters, the response to each pair of bytes."""
        if self.pairs is None:
            self.pairs = [(self.w[k][:, None, :] + self.w[k + 1][None, :, :]).reshape(1 << 16, FILTERS) for k in range(0, WIDTH, 2)]
        return self.pairs

    def responses(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: bool):
        """The largest response of each filter in each [start, end) of at least WIDTH bytes, and where it is."""
        two = data[:-1].astype(np.int32) << 8 | data[1:]
        first, last = self.tables(), None
        top = np.empty((len(starts), FILTERS), np.float32)
        at = np.empty((len(starts), FILTERS), np.int64) if places else None
        for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            n = hi - lo - WIDTH + 1
            r = first[0][two[lo : lo + n]]
            for k in range(1, WIDTH // 2):
                r += first[k][two[lo + 2 * k : lo + 2 * k + n]]
            if places:
                last = r.argmax(axis=0)
                at[i], top[i] = lo + last, r[last, np.arange(FILTERS)]
            else:
                r.max(axis=0, out=top[i])
        return top, at

    def pooled(self, top: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, top + self.b)
        count = np.maximum(1, np.bincount(of, minlength=n))[:, None]
        mean = np.zeros((n, FILTERS))
        np.add.at(mean, of, h)
        most = np.zeros((n, FILTERS))
        np.maximum.at(most, of, h)
        return np.concatenate([mean / count, most], axis=1), h

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, starts, ends, of = chunked(data, offsets)
        top, _ = self.responses(data, starts, ends, False)
        return self.pooled(top, of, len(offsets) - 1)[0] @ self.v + self.c[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, offsets) + self.shift, -60, 60)))

    def train(self, texts: list[bytes], y: np.ndarray) -> None:
        rng = np.random.Generator(np.random.PCG64(1))
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        weight = np.sqrt(weight)
        params = [self.w, self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(EPOCHS):
            rate = STEP * (1 if epoch < EPOCHS - 3 else 0.2)
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
                offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
                data, starts, ends, of = chunked(data, offsets)
                self.pairs = None
                top, at = self.responses(data, starts, ends, True)
                x, h = self.pooled(top, of, len(rows))
                p = 1 / (1 + np.exp(-np.clip(x @ self.v + self.c[0], -60, 60)))
                d = (p - y[rows]) * weight[rows] / len(rows)
                g_v, g_c = x.T @ d, d.sum()
                count = np.maximum(1, np.bincount(of, minlength=len(rows)))
                g_h = d[of, None] * (self.v[:FILTERS] / count[of, None] + self.v[FILTERS:] * (h == x[of, FILTERS:])) * (h > 0)
                g_w = np.zeros_like(self.w)
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(WIDTH):
                    np.add.at(g_w[j], (data[at + j], f), g_h)
                t += 1
                for p_, g, m_, s_ in zip(params, (g_w, g_h.sum(axis=0), g_v, np.array([g_c])), m, s, strict=True):
                    g = g + 1e-5 * p_
                    m_ += 0.1 * (g - m_)
                    s_ += 0.001 * (g * g - s_)
                    p_ -= (rate * (m_ / (1 - 0.9**t)) / (np.sqrt(s_ / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.pairs = None

    def calibrate(self, texts: list[bytes], y: np.ndarray) -> None:
        """Slope and shift of the output that make the labels of these texts likeliest, by Newton's steps with a little shrinkage."""
        x = self.raw(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        x = np.stack([x, np.ones_like(x)], axis=1)
        # targets a little off 0 and 1, as for any fit of few points
        good, bad = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        at = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
            at = at - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        if at[0] > 0:  # else the output says nothing of these texts
            self.slope, self.shift = float(at[0]), float(at[1])

    def __getstate__(self):
        return self.__dict__ | {"pairs": None}


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts laid out with room at their ends, [start, end) of their chunks and the text of each chunk; an empty text has one chunk too."""
    size = np.diff(offsets)
    room = np.maximum(size, 0) + WIDTH
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[spread(begin, size)] = data[: int(offsets[-1])]
    number = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    of = np.repeat(np.arange(len(size)), number)
    start = begin[of] + spread(np.zeros(len(size), np.int64), number) * (CHUNK - OVERLAP)
    return out, start, np.minimum(start + CHUNK, begin[of] + room[of]), of


class Model:
    """The trained network; without labels of both kinds, the share of good ones."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE):
        chosen = labelled_sample(docs, labels, "quality", learn, sample, SAMPLE_BYTES)
        rows = chosen.select("doc_id", F.encode("text", "utf-8").alias("text"), "label", "part").collect()
        rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or b""))
        texts, y = [bytes(r["text"] or b"") for r in rows], np.array([r["label"] for r in rows], float)
        self.network, self.rate = None, float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) == 2:
            grown = np.array([r["part"] for r in rows]) < TRAINED
            if len(np.unique(y[grown])) < 2 or len(np.unique(y[~grown])) < 2:  # too few to be parted
                grown[:] = True
            held = ~grown if not grown.all() else grown
            self.network = Network()
            self.network.train([t for t, g in zip(texts, grown, strict=True) if g], y[grown])
            self.network.calibrate([t for t, h in zip(texts, held, strict=True) if h], y[held])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.rate) if self.network is None else self.network.score(data, offsets)


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learned from labels outside the fold ``held_out``.

    The score depends on the bytes of the whole text alone; a null text counts as empty. Without labels of both kinds
    every score is the share of good ones (0 without any). Each row has its own result; a null id stays null and is not
    held out. Other columns are not read.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = Model(ready, labels.select("doc_id", "quality"), crc_mod("doc_id", folds) != held_out)
    out = scored(ready, model).drop("text")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
