"""Content routing for substring search: which stretches of a text may repeat, and where equal windows meet.

A window is ``width`` units (words or bytes). Its anchor is the least hash of the grams of ``gram`` units inside it, so
equal windows have equal anchors wherever they stand. A segment is a run of neighbouring windows with one anchor.
Anchors that occur once in the corpus cannot lie in a repeated window; only the segments of the others travel on, to
the partition of their anchor, where an index over them decides.

Grams that stand in many documents of a sample are hot: they rank after all others, so that a window with anything of
its own meets its like by that, and only windows that are hot throughout, whose segments are the same everywhere and
are combined before they travel, meet by a hot gram. The sample only guides the routing; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, binary, blocks, gram_hash, runs, sliding_min, spread, to_binary
from .sampling import SCALE

#: Windows in a segment at most; longer runs (periodic text) are cut, their parts keep the anchor.
LONGEST = 1024
#: A document without an id comes after all others.
LAST = (1 << 63) - 1
#: Documents to look for hot grams in, in how many of them a gram is hot, and hot grams at most (the commonest).
HOT_SAMPLE, HOT_TIMES, HOT_MOST = 4096, 21, 1 << 16

_OCC = np.dtype([("doc", "<i8"), ("th", "<i8"), ("start", "<i4")])


class Unit:
    """How texts fall into units: ``width`` of a window, ``gram`` of an anchor, words or bytes.

    One gram in ``share`` (those with the least hashes) is looked up among the hot ones; a window takes the others as
    its anchor only if it has none of those, or none that is not hot. ``short``: texts with fewer bytes have no window.
    """

    def __init__(self, words: bool, width: int, gram: int, share: int, hot: np.ndarray | None = None):
        self.words, self.width, self.gram, self.share = words, width, gram, share
        self.hot = np.zeros(0, np.uint64) if hot is None else hot
        self.short = 2 * width - 1 if words else width
        self._seen = None

    def with_hot(self, hot: np.ndarray) -> Unit:
        return Unit(self.words, self.width, self.gram, self.share, hot)

    def small(self, grams: np.ndarray) -> np.ndarray:
        return np.flatnonzero(grams < np.uint64((1 << 63) // self.share)) if self.share > 1 else np.arange(len(grams))

    def ranked(self, grams: np.ndarray) -> np.ndarray:
        """The hashes in the order of choice: the top bit marks those that come last."""
        grams = grams >> np.uint64(1)
        first = self.small(grams)
        if len(self.hot):
            if self._seen is None:  # a coarse filter before the search
                self._seen = np.zeros(1 << 20, bool)
                self._seen[self.hot & np.uint64((1 << 20) - 1)] = True
            maybe = np.flatnonzero(self._seen[grams[first] & np.uint64((1 << 20) - 1)])
            found = grams[first[maybe]]
            hit = maybe[self.hot[np.minimum(np.searchsorted(self.hot, found), len(self.hot) - 1)] == found]
            first = np.delete(first, hit)
        out = grams | np.uint64(1 << 63)
        out[first] = grams[first]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_seen": None}

    def grams_of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The hashes of the grams of each text that may be hot, each once."""
        if self.words:
            w = Words(data, offsets)
            grams, first = gram_hash(w.hash, self.gram), w.of_text
        else:
            grams, first = gram_hash(data, self.gram), offsets
        grams = grams >> np.uint64(1)
        for k in range(len(offsets) - 1):
            own = grams[first[k] : max(first[k], first[k + 1] - self.gram + 1)]
            yield k, np.unique(own[self.small(own)])

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, first window in the text, number of windows, anchor, [from, to) in bytes, and whether the anchor stands in it again, of each segment."""
        if self.words:
            w = Words(data, offsets)
            grams, first = gram_hash(w.hash, self.gram), w.of_text
        else:
            grams, first = gram_hash(data, self.gram), offsets
        grams = self.ranked(grams)
        least = sliding_min(grams, self.width - self.gram + 1)
        n = len(least)  # windows of the block, those across texts included
        if not n:
            return tuple(np.zeros(0, np.int64) for _ in range(7))
        change = np.ones(n, bool)
        change[1:] = least[1:] != least[:-1]
        change[first[:-1][first[:-1] < n]] = True
        outside = np.maximum(first[:-1], first[1:] - self.width + 1)  # from here on, windows leave the text
        change[outside[outside < n]] = True
        begin = np.flatnonzero(change)
        count = np.diff(np.append(begin, n))
        # two equal windows of one segment: the anchor then comes in anew after the first window
        twice = np.logical_or.reduceat((grams[self.width - self.gram :] == least) & ~change, begin)
        text = np.searchsorted(first, begin, "right") - 1
        inside = begin + self.width <= first[text + 1]
        begin, count, twice, text = begin[inside], count[inside], twice[inside], text[inside]
        if not len(begin):
            return tuple(np.zeros(0, np.int64) for _ in range(7))
        key = least[begin] >> np.uint64(16)  # 48 bits travel; anchors that agree in them share a partition
        if count.max() > LONGEST:
            parts = -(-count // LONGEST)
            part = spread(np.zeros(len(parts), np.int64), parts)
            begin, count, twice, key, text = np.repeat(begin, parts) + part * LONGEST, np.repeat(count, parts), np.repeat(twice, parts), np.repeat(key, parts), np.repeat(text, parts)
            count = np.minimum(LONGEST, count - part * LONGEST)
        lo, hi = begin, begin + count + self.width - 1
        span = (w.start[lo], w.end[hi - 1]) if self.words else (lo, hi)
        return text, lo - first[text], count, key.view(np.int64), *span, twice


def prepared(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """text, doc (the id; null: after all others), none (no id), th (hash of the text), row and part (what rows are joined by).

    Both joins with the text read the same columns, so that one shuffle serves both.

    Rows that share an id but not their text have different ``th``; rows without an id are told apart by it alone.
    """
    # an alias of the same name would keep Spark from seeing that the two shuffles are one
    column = F.col(text) if text == "text" else F.col(text).alias("text")
    ready = docs.select(column, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(doc_id).isNull().alias("none"), F.xxhash64(text).alias("th"))
    return ready.withColumns({"row": _row(), "part": _part()})


def _row() -> Column:
    return F.when(F.col("doc") == LAST, F.col("th")).otherwise(F.col("doc"))


def _part() -> Column:
    return F.col("th").bitwiseAND(0xFF)


def _gram_counts(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch, "text"):
                found = [g for _, g in unit.grams_of(data, offsets)]
                if found:
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.record_batch({"gram": pa.array(gram.view(np.int64)), "n": pa.array(n)})

    return run


def hot_grams(docs: DataFrame, unit: Unit) -> Unit:
    """``unit`` with the hashes of the grams that stand in HOT_TIMES of about HOT_SAMPLE documents: a table of bounded size."""
    n = docs.count()
    share = SCALE if n <= HOT_SAMPLE else -(-SCALE * HOT_SAMPLE // n)
    sample = docs.filter(F.pmod(F.xxhash64("doc", "th"), F.lit(SCALE)) < share).select("text")
    counted = sample.mapInArrow(_gram_counts(unit), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= HOT_TIMES).orderBy(F.desc("n"), "gram").limit(HOT_MOST).collect()
    return unit.with_hot(np.sort(np.array([r["gram"] for r in rows], np.uint64)))


def _anchors(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each anchor of a block of documents with all its places there: what one key holds is combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                doc, row, of_part = (part.column(k).to_numpy() for k in (0, 2, 3))
                text, _, _, key, _, _, twice = unit.segments(data, offsets)
                if not len(key):
                    continue
                of_text = np.searchsorted(text, np.arange(len(doc)))
                place = np.arange(len(text)) - of_text[text] | of_part[text] << 32
                order = np.argsort(key, kind="stable")
                key, text, place, twice = key[order], text[order], place[order], twice[order]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.diff(np.append(begin, len(key)))
                ids, rows = doc[text], row[text]
                lo, hi = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
                plain = (lo == hi) & (lo == rows[begin])  # the row says it all
                out = pa.record_batch({
                    "anchor": pa.array(key[begin]), "lo": pa.array(lo, mask=plain), "hi": pa.array(hi, mask=plain), "row": pa.array(rows[begin]), "place": pa.array(place[begin]),
                    "again": pa.array((count > 1) | np.logical_or.reduceat(twice, begin)),
                    "more": pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(rows), pa.array(place)], ["row", "place"]), mask=pa.array(count == 1)),
                })
                yield out.take(pa.array(np.argsort(text[begin], kind="stable")))  # in the order of the rows: neighbours compress

    return run


def repeated(docs: DataFrame, unit: Unit, across: bool) -> DataFrame:
    """row, part and the ordinals of its segments whose anchor occurs again: in a document with another id if ``across``, else anywhere."""
    found = docs.select("doc", "text", "row", "part").mapInArrow(_anchors(unit), "anchor long, lo long, hi long, row long, place long, again boolean, more array<struct<row:long,place:long>>")
    here = Window.partitionBy("anchor")
    if across:
        known = F.min(F.coalesce("lo", "row")).over(here) != F.max(F.coalesce("hi", "row")).over(here)
    else:
        known = (F.count("*").over(here) > 1) | F.col("again")
    one = F.array(F.struct("row", "place"))
    return (
        found.withColumn("known", known).filter("known")
        .select(F.explode(F.coalesce("more", one)).alias("x"))
        .groupBy(F.col("x.row").alias("row"), F.shiftright("x.place", 32).alias("part")).agg(F.collect_set(F.col("x.place").bitwiseAND(0xFFFFFFFF).cast("int")).alias("ordinals"))
    )


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chosen segments of each document; equal ones of a block are one row with all their places."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                doc, th = part.column(0).to_numpy(), part.column(2).to_numpy()
                text, first, count, key, lo, hi, _ = unit.segments(data, offsets)
                if not len(key):
                    continue
                chosen, of = part.column(3), np.searchsorted(text, np.arange(len(doc)))
                limit = np.searchsorted(text, np.arange(len(doc)), "right")
                have = chosen.flatten().to_numpy() if len(chosen.flatten()) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(doc)), np.nan_to_num(chosen.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                take = of[row] + have
                take = np.unique(take[take < limit[row]])
                if not len(take):
                    continue
                text, first, count, key, lo, hi = (x[take] for x in (text, first, count, key, lo, hi))
                size = hi - lo
                seg = to_binary(data[spread(lo, size)], np.concatenate([[0], np.cumsum(size)]))
                coded = seg.dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
                occ = np.empty(len(order), _OCC)
                occ["doc"], occ["th"], occ["start"] = doc[text[order]], th[text[order]], first[order]
                lead = order[begin]
                yield pa.record_batch({
                    "anchor": pa.array(key[lead]), "seg": coded.dictionary.cast(pa.binary()), "windows": pa.array(count[lead].astype(np.int32)),
                    "occ": to_binary(occ.view(np.uint8), np.append(begin, len(order)) * _OCC.itemsize),
                })

    return run


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places packed in a column, and how many each row has."""
    data, offsets = binary(column)
    return np.ascontiguousarray(data).view(_OCC), np.diff(offsets) // _OCC.itemsize


def _long(unit: Unit) -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) >= unit.short


def segments(docs: DataFrame, unit: Unit, across: bool) -> DataFrame:
    """anchor, seg (bytes), windows, occ (packed places) of the segments that may repeat, sorted by anchor within the anchor's partition."""
    long = docs.filter(_long(unit))
    chosen = long.join(repeated(long, unit, across), ["row", "part"]).select("doc", "text", "th", "ordinals", "none")
    cut = chosen.mapInArrow(_cut(unit), "anchor long, seg binary, windows int, occ binary")
    return cut.repartition("anchor").sortWithinPartitions("anchor")


def spans_of(seg_code: np.ndarray, windows: np.ndarray, occ: np.ndarray, flag_of: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of flagged windows of each place: doc, th, from, to (in windows). flag_of(window, place) tells whether a window repeats.

    seg_code: of each place, the segment; windows: the number of windows of each segment, whose windows are numbered on.
    """
    begin = np.cumsum(windows) - windows
    count = windows[seg_code]
    edges = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(occ):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, "right")) - 1)
        n = count[at:to]
        window, place = spread(begin[seg_code[at:to]], n), np.repeat(np.arange(at, to), n)
        own = np.cumsum(n) - n
        lo, hi = runs(flag_of(window, place), own)
        if len(lo):
            who = place[lo]
            start = occ["start"][who].astype(np.int64) + lo - own[who - at]
            yield pa.record_batch({"doc": pa.array(occ["doc"][who]), "th": pa.array(occ["th"][who]), "from": pa.array(start), "to": pa.array(start + hi - lo)})
        at = to


SPANS = "doc long, th long, `from` long, `to` long"


def with_spans(docs: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """doc, none, text, th and the distinct spans found in its row, as arrays; texts without a window need no join."""
    names = ("doc", "none", "text", "th")
    grouped = spans.withColumns({"row": _row(), "part": _part()}).groupBy("row", "part").agg(F.collect_set(F.struct("th", "from", "to")).alias("x"))
    grouped = grouped.select("row", "part", F.col("x.th").alias("ths"), F.col("x.from").alias("froms"), F.col("x.to").alias("tos"))
    found = docs.filter(_long(unit)).join(grouped, ["row", "part"], "left").select(*names, "ths", "froms", "tos")
    return found.unionByName(docs.filter(~_long(unit)).select(*names), allowMissingColumns=True)


def covered(n: int, th: int, ths, froms, tos, width: int) -> np.ndarray:
    """Which of n units lie in a window of the spans that belong to the text with hash ``th``."""
    mark = np.zeros(n + 1, np.int64)
    if ths is not None:
        ths, froms, tos = np.asarray(ths), np.asarray(froms), np.asarray(tos)
        own = ths == th
        np.add.at(mark, froms[own], 1)
        np.add.at(mark, tos[own] + width - 1, -1)
    return np.cumsum(mark[:-1]) > 0
