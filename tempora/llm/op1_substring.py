"""Substring dedup with FM-indexes over word sequences.

Segments that may repeat meet by anchor (see ``anchors``); each partition cuts them into shards of bounded size at
changes of the anchor. A shard gets a compressed FM-index: the Burrows-Wheeler transform of its distinct segments, in a
wavelet matrix of packed bits with block counts. The segments are streamed from right to left through backward search,
all at once; when a match reaches the window's width it is reported with the least document of its interval, and then
cut by one word at its end (the parent interval one word shorter), which gives the matching statistics of every position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors
from .common import Words, binary, chunks, runs, table, to_binary

WIDTH = 13
UNIT = anchors.Unit(words=True, width=WIDTH, gram=5, share=1)
#: Bytes of segments in a shard, about; a shard ends where the anchor changes.
SHARD_BYTES = 4 << 20


class WaveletMatrix:
    """rank over a sequence of small integers, in packed bits: a word of 64 bits and a count for each block and level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(values), bits, []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = self.n - int(ones[-1])
            self.levels.append((packed, ones, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, plus the start of the symbol's run in the last level."""
        for level, (packed, ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = ones[block] + np.bitwise_count(packed[block] & mask)
            at = np.where((symbol >> level) & 1, zeros + one, at - one)
        return at


class FMIndex:
    """Backward search to a depth of ``width`` words over sequences that end in 0."""

    def __init__(self, text: np.ndarray, width: int, owner: np.ndarray):
        n = len(text)
        ranks, depth = [text.astype(np.int64)], 1
        while depth < width:  # ranks by the first 1, 2, 4, ... words
            r = ranks[-1]
            after = np.zeros(n, np.int64)
            after[: n - depth] = r[depth:] + 1
            pair = r * (int(r.max()) + 2) + after
            order = np.argsort(pair)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
            ranks.append(new)
            depth *= 2
        suffixes = np.argsort(ranks[-1])
        before = text[suffixes - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(before, self.bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        # the start of each symbol's run in the matrix's last level
        self.base = self.wavelet.rank(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, np.int64))

        def boundary(length: int) -> np.ndarray:
            differs, done = np.zeros(n, bool), 0
            differs[0] = True
            for k in range(len(ranks) - 1, -1, -1):
                if length >> k & 1:
                    at = suffixes + done
                    inside = at < n
                    x = np.where(inside, ranks[k][np.minimum(at, n - 1)], -1)
                    differs[1:] |= x[1:] != x[:-1]
                    done += 1 << k
            return differs

        short = boundary(width - 1)
        self.short_group = np.cumsum(short) - 1
        self.short_begin = np.append(np.flatnonzero(short), n)
        full = boundary(width)
        self.full_group = np.cumsum(full) - 1
        self.least = np.minimum.reduceat(owner[suffixes], np.flatnonzero(full))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + match."""
        shift = self.first[symbol] - self.base[symbol]
        return self.wavelet.rank(symbol, lo) + shift, self.wavelet.rank(symbol, hi) + shift

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches without their last word."""
        group = self.short_group[lo]
        return self.short_begin[group], self.short_begin[group + 1]


def least_owner(segments: pa.Array, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of each segment the least document that has it, by backward search; and the number of windows of each segment."""
    data, offsets = binary(segments)
    w = Words(data, offsets)
    # words by their bytes, not by their hashes
    size = w.end - w.start
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, w.start, 1)
    np.add.at(keep, w.end, -1)
    flat = data[np.cumsum(keep[:-1], dtype=np.int8) > 0]
    ids = to_binary(flat, np.concatenate([[0], np.cumsum(size)])).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    words = np.diff(w.of_text)
    text = np.zeros(len(ids) + len(words), np.int64)
    start = w.of_text[:-1] + np.arange(len(words))
    text[np.arange(len(ids)) + np.repeat(np.arange(len(words)), words)] = ids
    index = FMIndex(text, width, np.repeat(owner, words + 1))
    windows = words - width + 1
    begin = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    order = np.argsort(-words, kind="stable")  # the longest first, so that those still running are a prefix
    start, words, begin = start[order], words[order], begin[order]
    lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(text), np.int64)
    for step in range(int(words[0]) if len(words) else 0):
        live = int(np.searchsorted(-words, -step, "left"))  # words > step
        lo, hi = index.extend(text[start[:live] + words[:live] - 1 - step], lo[:live], hi[:live])
        if step >= width - 1:
            out[begin[:live] + words[:live] - 1 - step] = index.least[index.full_group[lo]]
            lo, hi = index.shorten(lo)
    return out, windows


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in chunks(batches, "anchor", "seg", SHARD_BYTES):
        coded = shard.column("seg").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        occ, n = anchors.occurrences(shard.column("occ").combine_chunks())
        code = np.repeat(coded.indices.to_numpy().astype(np.int64), n)
        owner = np.full(len(coded.dictionary), anchors.LAST, np.int64)
        np.minimum.at(owner, code, occ["doc"])
        least, windows = least_owner(coded.dictionary, owner, WIDTH)
        doc = occ["doc"]
        yield from anchors.spans_of(code, windows, occ, lambda window, place, least=least, doc=doc: least[window] < doc[place])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, none, text, th, ths, froms, tos in zip(*(c.to_pylist() if k != 2 else c.cast(pa.binary()).to_pylist() for k, c in enumerate(batch.columns)), strict=True):
            data = np.frombuffer(text or b"", np.uint8)
            w = Words(data, np.array([0, len(data)]))
            gone = anchors.covered(len(w.start), th, ths, froms, tos, WIDTH)
            keep = ~gone
            flat = data.tobytes()
            kept = b" ".join(flat[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True))
            lo, hi = runs(gone, np.zeros(1, np.int64)) if len(gone) else ((), ())
            out.append((None if none else doc, len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace"), [{"first": int(a), "last": int(b) - 1} for a, b in zip(lo, hi, strict=True)]))
        names = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) and spans (removed words, first to last) of each document.

    Words are runs of bytes other than white space. A word goes if a window of 13 words of one document covers it whose
    words also start in a document with a smaller id. Null and empty texts have no words. Rows that repeat an id and
    text get the same result each, rows that share an id are no earlier than each other; a null id counts as the
    largest, 2**63 - 1. Bytes that are not UTF-8 count as parts of words, and stand as U+FFFD in ``kept`` alone. Other
    columns are not read.
    """
    ready = anchors.prepared(docs, text, doc_id)
    unit = anchors.hot_grams(ready, UNIT)
    spans = anchors.segments(ready, unit, across=True).mapInArrow(search, anchors.SPANS)
    return anchors.with_spans(ready, spans, unit).mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first:long,last:long>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
