"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, fitted by expectation-maximisation over the
words of a bounded sample. The likelihood of a word is the sum over all its segmentations into pieces, by the forward
algorithm; words are scored once for each distinct word and add up over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_BASE, binary, blocks, crc_mod, gram_hash, spread, table, to_binary
from .op10_toxicity import _LETTER, _runs

#: Documents and bytes of text to learn from, about, at most; rounds of fitting.
SAMPLE, SAMPLE_BYTES, ROUNDS = 1000, 8 << 20, 2
#: Probability of a letter that the vocabulary lacks; added count of each piece.
UNKNOWN, ADDED = 1e-7, 0.02
#: Words whose likelihoods a worker keeps at most (then it starts anew), and bytes of a word that is kept.
KEPT_WORDS, KEPT_BYTES = 500_000, 64
#: Bytes of words whose lattices are held at once, about.
LATTICE_BYTES = 1 << 19


def default_vocabulary() -> list[str]:
    """The pieces of an installed vocabulary that are letters, with the mark of a word's start or without; in lower case."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(k) for k in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and p.strip("▁").isalpha() and "▁" not in p[1:])


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, each led by the mark of a start, and where each word begins."""
    marked = ["▁" + w for w in words]
    return np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in marked])]).astype(np.int64)


class Lattice:
    """The pieces that stand at each place of some words."""

    def __init__(self, pieces: np.ndarray, order: np.ndarray, longest: int, words: list[str]):
        letters, self.edge = _code_points(words)
        self.longest = longest
        n = len(letters)
        self.size = np.diff(self.edge)
        left = np.repeat(self.edge[1:], self.size) - np.arange(n)
        unknown = len(pieces)
        self.piece = np.full((longest + 1, n), unknown + 1, np.int32)  # unknown + 1: no piece
        self.piece[1] = unknown
        for k in range(1, longest + 1):
            key = gram_hash(letters, k, BYTE_BASE) + np.uint64(k)
            at = np.minimum(np.searchsorted(pieces, key), unknown - 1) if unknown else np.zeros(len(key), np.int64)
            hit = np.flatnonzero((pieces[at] == key) & (left[: len(key)] >= k)) if unknown else np.zeros(0, np.int64)
            self.piece[k, hit] = order[at[hit]]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each word, for each column of p (pieces, unknown, none)."""
        by = np.argsort(-self.size, kind="stable")
        start, size = self.edge[:-1][by], self.size[by]
        scale = np.zeros((len(by), p.shape[1]))
        ring = [np.ones((len(by), p.shape[1]))]
        out = np.empty((len(by), p.shape[1]))
        for j in range(1, int(size[0]) + 1 if len(size) else 0):
            live = int(np.searchsorted(-size, -j, "right"))
            new = np.zeros((live, p.shape[1]))
            for k in range(1, min(j, self.longest) + 1):
                new += ring[-k][:live] * p[self.piece[k, start[:live] + j - k]]
            ring = [r[:live] for r in ring[-self.longest :]] + [new]
            if j % 16 == 0:
                top = new.max(axis=1, keepdims=True)
                scale[:live] += np.log(top)
                ring = [r / top for r in ring]
            done = np.flatnonzero(size[:live] == j)
            out[done] = np.log(np.maximum(ring[-1][done], 1e-300)) + scale[done]
        back = np.empty_like(out)
        back[by] = out
        return back

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected, over all segmentations of words that stand ``times`` times."""
        n, letters = len(self.size), int(self.edge[-1])
        begin = self.edge[:-1] + np.arange(n)  # places between letters: one more for each word
        a, b = np.zeros(letters + n), np.zeros(letters + n)  # logs, so that long runs do not vanish
        by = np.argsort(-self.size, kind="stable")
        size, start, place = self.size[by], self.edge[:-1][by], begin[by]
        for j in range(1, int(size[0]) + 1 if n else 0):
            live = int(np.searchsorted(-size, -j, "right"))
            at, end, v, w = place[:live] + j, place[:live] + size[:live] - j, np.zeros(live), np.zeros(live)
            for k in range(1, min(j, self.longest) + 1):
                v += np.exp(a[at - k] - a[at - 1]) * p[self.piece[k, start[:live] + j - k]]
                w += np.exp(b[end + k] - b[end + 1]) * p[self.piece[k, start[:live] + size[:live] - j]]
            a[at], b[end] = a[at - 1] + np.log(v), b[end + 1] + np.log(w)
        total = a[begin + self.size]
        out = np.zeros(len(p))
        of = np.repeat(np.arange(n), self.size)
        at = np.arange(letters) + of
        for k in range(1, self.longest + 1):
            fits = np.flatnonzero(self.piece[k] < len(p) - 1)
            fits = fits[fits + k <= self.edge[1:][of[fits]]]
            out += np.bincount(self.piece[k, fits], np.exp(a[at[fits]] + b[at[fits] + k] - total[of[fits]]) * p[self.piece[k, fits]] * times[of[fits]], minlength=len(p))
        return out


def _words(column: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Blocks of texts: their words in lower case, coded, and where each text's words begin."""
    lower = pc.utf8_lower(column.cast(pa.large_string()))
    for part, data, offsets in blocks(pa.record_batch([lower], ["text"]), "text", 1 << 22):
        start, end = _runs(_LETTER[data], offsets)
        of = np.searchsorted(start, offsets)
        yield part, to_binary(data[spread(start, end - start)], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode(), of


def _text(word: bytes) -> str:
    return word.decode("utf-8")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part, coded, of in _words(batch.column(0)):
            lang = batch.column(1).slice(at, len(part)).dictionary_encode()
            at += len(part)
            code = coded.indices.to_numpy().astype(np.int64)
            pair, n = np.unique(np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(of)) * (len(coded.dictionary) + 1) + code, return_counts=True)
            yield pa.record_batch({"lang": lang.dictionary.take(pa.array(pair // (len(coded.dictionary) + 1))).cast(pa.string()), "word": coded.dictionary.take(pa.array(pair % (len(coded.dictionary) + 1))), "n": pa.array(n)})


class Model:
    """Probabilities of the pieces in each language: a table bounded by the vocabulary and the number of languages."""

    def __init__(self, docs: DataFrame, learn, vocabulary: list[str], sample: int = SAMPLE):
        chosen = docs.filter(F.col("lang").isNotNull() & learn)
        sizes = {r["lang"]: (r["n"], r["size"] or 1) for r in chosen.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
        self.langs = sorted(sizes)
        scale = 1 << 20
        # about as many documents of each language, and a bounded size of text
        part = lambda n, size: min(scale, scale * sample // len(sizes) // n + 1, scale * SAMPLE_BYTES // len(sizes) // size + 1)
        share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(part(*n))) for x, n in sorted(sizes.items())), F.lit(0)) if sizes else F.lit(0)
        picked = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(scale)) < share).select("text", "lang")
        rows = picked.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect() if sizes else []
        letters, edge = np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in vocabulary])])
        size = np.diff(edge)
        keys = np.empty(len(vocabulary), np.uint64)
        for k in np.unique(size):
            keys[size == k] = (gram_hash(letters, int(k), BYTE_BASE) + np.uint64(k))[edge[:-1][size == k]]
        order = np.argsort(keys)
        self.pieces, self.order, self.longest = keys[order], order.astype(np.int32), int(size.max(initial=1))
        n = len(vocabulary)
        self.p = np.zeros((n + 2, len(self.langs)))
        for k, lang in enumerate(self.langs):
            words = sorted((bytes(r["word"]), r["n"]) for r in rows if r["lang"] == lang)
            lattice, times = self.lattice([_text(w) for w, _ in words]), np.array([c for _, c in words], float)
            p = np.full(n + 2, 1.0 / max(1, n))
            for _ in range(ROUNDS):
                p[n], p[n + 1] = UNKNOWN, 0
                count = lattice.expected(p, times)[:n] + ADDED
                p[:n] = count / count.sum()
            p[n], p[n + 1] = UNKNOWN, 0
            self.p[:, k] = p

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self.pieces, self.order, self.longest, words)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Log of the sum over all segmentations of each word in each language, however long the word."""
        out, at = np.empty((len(words), len(self.langs))), 0
        edge = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + LATTICE_BYTES, "right")) - 1)
            out[at:to] = self.lattice([_text(w) for w in words[at:to]]).forward(self.p)
            at = to
        return out


def _predicted(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        values = np.zeros((1 << 16, len(model.langs)))
        for batch in batches:
            lang, score = [], []
            for part, coded, of in _words(batch.column(1)):
                words = coded.dictionary.to_pylist()
                if len(known) > KEPT_WORDS:
                    known.clear()
                new = [w for w in words if len(w) <= KEPT_BYTES and w not in known]
                have = len(known)
                while have + len(new) > len(values):
                    values = np.concatenate([values, np.zeros_like(values)])
                values[have : have + len(new)] = model.likelihoods(new) if model.langs else 0
                known.update((w, have + k) for k, w in enumerate(new))
                at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                of_word, long = values[at], np.flatnonzero(at < 0)
                if model.langs:
                    of_word[long] = model.likelihoods([words[k] for k in long])
                row = coded.indices.to_numpy().astype(np.int64)
                total = np.zeros((len(part), len(model.langs)))
                text_of = np.repeat(np.arange(len(part)), np.diff(of))
                for k in range(len(model.langs)):
                    total[:, k] = np.bincount(text_of, of_word[row, k], minlength=len(part))
                data, offsets = binary(part.column(0))
                ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in range(len(part)):
                    text = None if plain[i] else part.column(0)[i].as_py()
                    if not len(model.langs) or not plain[i] and not any(c.isalpha() for c in text or ""):
                        lang.append("und")
                        score.append(0.0)
                    else:
                        best = int(total[i].argmax())
                        lang.append(model.langs[best])
                        score.append(float(1 / np.exp(total[i] - total[i, best]).sum()))
            yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def language(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 4, held_out: int = 2, vocabulary: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from documents with a language outside the fold ``held_out``.

    The prediction depends on the letters of the whole text alone; score is the posterior of the language under equal
    priors. A null text, one without letters, or any text if nothing could be learned, is ``und`` with score 0; ties go
    to the first name. Each row has its own result; a null id stays null, is not held out and not learned from. Bytes
    that are not UTF-8 count as U+FFFD; bytes from 0x80 on count as letters, signs of other scripts included, and a run
    of letters is one word, summed over as a whole. Other columns are not read.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.make_valid_utf8(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    model = Model(ready, crc_mod("doc_id", folds) != held_out, default_vocabulary() if vocabulary is None else vocabulary)
    out = ready.select("doc_id", "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
