"""Suffix-array dedup by prefix-free parsing.

Segments that may repeat meet by anchor (see ``anchors``). In each shard a rolling hash sets triggers that cut the text
into phrases; every phrase ends with a trigger and the next begins with it, so that no dictionary suffix longer than
a trigger is a prefix of another. The suffixes of the dictionary and of the parse are sorted on their own, and the
order of the text is that of (rank of the phrase's suffix, rank of the parse after it). Neighbours in that order that
agree in ``WIDTH`` bytes are one string that stands in several places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors
from .common import BYTE_BASE, binary, chunks, gram_hash, runs, spread, table, to_binary

WIDTH = 200
UNIT = anchors.Unit(words=False, width=WIDTH, gram=48, share=16)
#: Bytes of segments in a shard, about; a shard ends where the anchor changes.
SHARD_BYTES = 2 << 20
#: Bytes of a trigger, and one in how many windows is one.
TRIGGER, EVERY = 8, 32
#: A byte that UTF-8 never has: ends each segment.
END = 0xFF


def eights(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place as one number; places past the end count as 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), np.dtype(f"{order}u8"), padded, strides=(1,))


def ranked(key: np.ndarray) -> np.ndarray:
    """How many keys are smaller than each."""
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def doubled(rank: np.ndarray, depth: int, until: int, room: np.ndarray) -> np.ndarray:
    """Ranks by the first ``until`` symbols, from ranks by the first ``depth``; room: symbols left from each place.

    A place without more symbols than ``depth`` keeps its rank: others of that rank are the same string.
    """
    rank = rank.copy()
    more = np.flatnonzero(room > depth)
    while depth < until and len(more):
        order = np.lexsort((rank[more + depth], rank[more])) if len(rank) >= 1 << 31 else np.argsort(rank[more] << 32 | rank[more + depth])
        at = more[order]
        a, b = rank[at], rank[at + depth]
        top = np.concatenate([[True], a[1:] != a[:-1]])
        new = top.copy()
        new[1:] |= b[1:] != b[:-1]
        place = np.arange(len(at))
        rank[at] = a + place[new][np.cumsum(new) - 1] - place[top][np.cumsum(top) - 1]
        depth *= 2
        more = more[room[more] > depth]
    return rank


def parse(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the phrases: a trigger is a window whose hash says so, or one of END bytes alone."""
    hashes = gram_hash(text, TRIGGER, BYTE_BASE)
    at_end = text == END
    ends = np.concatenate([[0], np.cumsum(at_end)])
    inside = ends[TRIGGER:] - ends[:-TRIGGER]
    trigger = np.flatnonzero(((hashes & np.uint64(EVERY - 1) == 0) & (inside == 0)) | (inside == TRIGGER))
    end = trigger + TRIGGER
    return np.concatenate([[0], end[:-1] - TRIGGER]), end


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The order of the places ``wanted`` by the text from there, by ``depth`` bytes at least, from a prefix-free parse."""
    start, end = parse(text)
    size = end - start
    coded = to_binary(text[spread(start, size)], np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
    phrase = coded.indices.to_numpy().astype(np.int64)
    words, edges = binary(coded.dictionary)
    # dictionary: ranks of all suffixes of all phrases
    room = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(words))
    first = eights(words, ">").astype(np.uint64)
    short = room < 8
    first[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * room[short].astype(np.uint64))
    rank = doubled(ranked(first), 8, depth, room)
    # parse: ranks of the phrases by content, then of all suffixes of their sequence
    in_order = doubled(ranked(rank[edges[:-1]][phrase]), 1, depth, np.arange(len(phrase), 0, -1))
    following = np.append(in_order[1:] + 1, 0)
    # text: place i lies in the phrase that has it before its closing trigger
    mark = np.zeros(len(text), np.int32)
    mark[end - TRIGGER] = 1
    of = np.cumsum(mark, dtype=np.int32)[wanted]
    return np.argsort(rank[edges[phrase[of]] + wanted - start[of]] << 32 | following[of])


def multiplicity(segments: pa.Array, windows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of each window of each segment, how often its string stands in the shard."""
    data, edges = binary(segments)
    size = np.diff(edges)
    start = edges[:-1] + np.arange(len(size)) * TRIGGER
    text = np.full(len(data) + len(size) * TRIGGER, END, np.uint8)
    text[spread(start, size)] = data
    wanted = spread(start, windows)
    order = suffix_order(text, wanted, 256)
    eight, at = eights(text, "<"), wanted[order]
    a, b = at[:-1], at[1:]
    same = np.flatnonzero(eight[a] == eight[b])
    a, b = a[same], b[same]
    for k in [*range(WIDTH - 8, 0, -64), *range(8, WIDTH - 8, 8)]:  # bytes, not hashes: exact
        equal = eight[a + k] == eight[b + k]
        if not equal.all():
            same, a, b = same[equal], a[equal], b[equal]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    out = np.empty(len(wanted), np.int64)
    if len(order):
        weight = np.repeat(times, windows)[order]
        out[order] = np.add.reduceat(weight, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _spans(code: np.ndarray, windows: np.ndarray, occ: np.ndarray, often: np.ndarray, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """doc, th, from, to of each run of repeated windows, at each place of its segment."""
    begin = np.cumsum(windows) - windows
    lo, hi = runs(often, begin)
    seg = np.searchsorted(begin, lo, "right") - 1
    lo, hi = lo - begin[seg], hi - begin[seg]
    first = np.searchsorted(seg, np.arange(len(windows) + 1))
    many = np.diff(first)
    for at in range(0, len(occ), step):
        of = code[at : at + step]
        run, place = spread(first[of], many[of]), np.repeat(np.arange(at, at + len(of)), many[of])
        start = occ["start"][place]
        yield pa.record_batch({"doc": pa.array(occ["doc"][place]), "th": pa.array(occ["th"][place]), "from": pa.array(start + lo[run]), "to": pa.array(start + hi[run])})


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in chunks(batches, "anchor", "seg", SHARD_BYTES):
        coded = shard.column("seg").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        occ, n = anchors.occurrences(shard.column("occ").combine_chunks())
        index = coded.indices.to_numpy().astype(np.int64)
        windows = np.empty(len(coded.dictionary), np.int64)
        windows[index] = shard.column("windows").to_numpy()
        code = np.repeat(index, n)
        times = np.bincount(code, minlength=len(windows))
        often = multiplicity(coded.dictionary, windows, times) > 1
        yield from _spans(code, windows, occ, often)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, none, text, th, ths, froms, tos in zip(*(c.to_pylist() if k != 2 else c.cast(pa.binary()).to_pylist() for k, c in enumerate(batch.columns)), strict=True):
            data = np.frombuffer(text or b"", np.uint8)
            gone = anchors.covered(len(data), th, ths, froms, tos, WIDTH)
            kept = data[~gone].tobytes()
            lo, hi = runs(gone, np.zeros(1, np.int64)) if len(gone) else ((), ())
            out.append((None if none else doc, len(gone), int(gone.sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept, [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and spans ([start, end) in bytes) of each document.

    A byte goes if a string of 200 bytes covers it that also starts anywhere else: in another document or elsewhere in
    this one, overlaps included; matches end where a document ends. Every copy goes, the first too. Null texts are
    empty. A row that repeats an id and text is one more place of its strings, as any other row. A null id stays null.
    Other columns are not read.
    """
    ready = anchors.prepared(docs, text, doc_id)
    unit = anchors.hot_grams(ready, UNIT)
    spans = anchors.segments(ready, unit, across=False).mapInArrow(search, anchors.SPANS)
    return anchors.with_spans(ready, spans, unit).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
