"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has 64 bits, by majority over the hashes of all shingles. Bits that go together, by a sample of fingerprints,
form GROUPS groups. If two fingerprints differ in at most MOST bits and the thresholds of the groups add up to
MOST - GROUPS + 1, then in one group at least they differ by no more than its threshold (-1: a group that is not asked).
Each fingerprint chooses its own thresholds, by dynamic programming over how many candidates each group is estimated to
give at each threshold, and probes the values of a group within its threshold; all fingerprints are found under the value
they have. So every link is found from either of its ends. Values that hold many rows are told apart further by runs of the
other bits, of which one must agree, and what is still large is compared in blocks of bounded size. A block verifies by the
whole fingerprints and emits only pairs that join what it has not yet joined, fewer than its rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, checkpointed, released, spread, table
from .components import components

SHINGLE, SEED, MOST = 3, 42, 3
GROUPS, WIDTH = 4, 16
#: Fingerprints of the sample that groups and estimates come from, about. They guide the routing alone, not the result.
SAMPLE = 1 << 14
#: Candidates that cost as much as one row of a probe.
PROBE = 200
#: Rows under a value that are compared as they are; rows on either side of a block.
BLOCK = 2048
#: Parts in which the rows of a value look up their blocks.
SPREAD = 32
SCALE = 1 << 40
_ROWS = 1 << 15  # shingles whose bits are counted at a time


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    w = Words(data, offsets, lower=True)
    words = np.diff(w.of_text)
    # all words joined by one space each
    length = w.end - w.start
    to = np.cumsum(length + 1) - 1 if len(length) else np.zeros(0, np.int64)
    joined = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    joined[spread(to - length, length)] = w.data[spread(w.start, length)]
    many = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    first = spread(w.of_text[:-1], many)
    last = first + np.repeat(np.minimum(words, SHINGLE), many) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(words), np.uint64)
    edge = np.concatenate([[0], np.cumsum(many)])
    ones = np.zeros((len(words), 64), np.int64)
    lo, hi = to[first] - length[first], to[last]
    for at in range(0, len(first), _ROWS):
        end = min(at + _ROWS, len(first))
        h = np.array([digest(raw[a:b], SEED) for a, b in zip(lo[at:end].tolist(), hi[at:end].tolist(), strict=True)], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero((edge[1:] > at) & (edge[:-1] < end) & (many > 0))
        ones[cut] += np.add.reduceat(bits, np.maximum(edge[cut], at) - at, axis=0, dtype=np.int64)
    majority = 2 * ones > many[:, None]
    out[:] = np.packbits(majority, axis=1).view(">u8").ravel()
    return out


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 19):
            yield pa.record_batch({"doc": part.column(0), "fp": pa.array(simhash(data, offsets).view(np.int64))})


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, fp: the id and the fingerprint (as a signed number) of each row."""
    ready = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return ready.mapInArrow(released(_printed), "doc long, fp long")


class Plan:
    """Which bits form a group, and how many fingerprints to expect around each value of it."""

    def __init__(self, sample: np.ndarray, total: int):
        self.sample, self.total = sample, total
        self.bits = grouped(sample)
        self._near: np.ndarray | None = None

    def __getstate__(self):
        return {"sample": self.sample, "total": self.total, "bits": self.bits, "_near": None}

    def values(self, fp: np.ndarray) -> np.ndarray:
        """The value of each group, row by row."""
        out = np.zeros((len(fp), GROUPS), np.int64)
        for g, bits in enumerate(self.bits):
            for k, b in enumerate(bits):
                out[:, g] |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        return out

    @property
    def near(self) -> np.ndarray:
        """near[g, t, v]: estimated fingerprints that differ from v by t bits or fewer in group g; one more in the sample counts for values that it lacks."""
        if self._near is None:
            value, out = self.values(self.sample), np.zeros((GROUPS, MOST + 1, 1 << WIDTH))
            at = np.arange(1 << WIDTH)
            for g in range(GROUPS):
                out[g, 0] = np.bincount(value[:, g], minlength=1 << WIDTH) + 1 / (1 << WIDTH)
                for k in range(WIDTH):  # with bit k free as well, from the largest distance down
                    for t in range(MOST, 0, -1):
                        out[g, t] += out[g, t - 1][at ^ (1 << k)]
            self._near = np.cumsum(out, axis=1) * (self.total / (len(self.sample) + 1))
        return self._near

    def thresholds(self, value: np.ndarray) -> np.ndarray:
        """The thresholds of each row's groups (-1 to MOST) that add up to MOST - GROUPS + 1 at the least estimated cost."""
        n, states = len(value), (MOST + 1) * GROUPS + 1  # a state is the sum so far plus one for each group
        want = MOST + 1
        best = np.full((n, states), np.inf)
        best[:, 0] = 0
        taken = np.zeros((GROUPS, n, states), np.int8)
        for g in range(GROUPS):
            following = np.full_like(best, np.inf)
            for t in range(-1, MOST + 1):
                cost = 0 if t < 0 else self.near[g, t][value[:, g]] + PROBE * sum(math.comb(WIDTH, k) for k in range(t + 1))
                reached = (best[:, : states - t - 1] + (cost if np.isscalar(cost) else cost[:, None]))
                better = reached < following[:, t + 1 :]
                following[:, t + 1 :][better] = reached[better]
                taken[g][:, t + 1 :][better] = t
            best = following
        out, left = np.zeros((n, GROUPS), np.int64), np.full(n, want)
        for g in range(GROUPS - 1, -1, -1):
            out[:, g] = taken[g][np.arange(n), left]
            left -= out[:, g] + 1
        return out


def grouped(sample: np.ndarray) -> list[list[int]]:
    """GROUPS groups of WIDTH bits each: each grows by the bit that goes most with those it has."""
    bit = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bit -= bit.mean(axis=0) if len(bit) else 0
    norm = np.sqrt((bit * bit).sum(axis=0))
    together = np.abs(bit.T @ bit) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(together, 0)
    free, out = list(range(64)), []
    for _ in range(GROUPS):
        own = [max(free, key=lambda b: together[b, free].sum())]
        free.remove(own[0])
        while len(own) < WIDTH:
            own.append(max(free, key=lambda b: together[b, own].sum()))
            free.remove(own[-1])
        out.append(own)
    return out


_FLIPS = [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(WIDTH), t)], np.int64) for t in range(MOST + 1)]


def _probes(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                fp = batch.column(0).to_numpy().view(np.uint64)
                value = plan.values(fp)
                threshold = plan.thresholds(value)
                row, group, v, asks, held = [], [], [], [], []
                for g in range(GROUPS):
                    for t in range(MOST + 1):
                        # under its own value a fingerprint is found whether it asks there or not
                        who = np.arange(len(fp)) if t == 0 else np.flatnonzero(threshold[:, g] >= t)
                        near = (value[who, g][:, None] ^ _FLIPS[t]).ravel()
                        row.append(np.repeat(who, len(_FLIPS[t])))
                        group.append(np.full(len(near), g))
                        v.append(near)
                        asks.append(threshold[row[-1], g] >= t)
                        held.append(np.full(len(near), t == 0))
                row = np.concatenate(row)
                yield pa.record_batch({
                    "grp": pa.array(np.concatenate(group).astype(np.int32)), "value": pa.array(np.concatenate(v).astype(np.int32)), "fp": pa.array(fp[row].view(np.int64)),
                    "asks": pa.array(np.concatenate(asks)), "held": pa.array(np.concatenate(held)),
                })

    return run


def _refined(plan: Plan):
    """Each row under each run of a quarter of the bits that its group does not have: two that are linked agree in one of those."""
    rest = [[b for b in range(64) if b not in own] for own in plan.bits]
    size = (64 - WIDTH) // (MOST + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, group = batch.column("fp").to_numpy().view(np.uint64), batch.column("grp").to_numpy()
            out = []
            for k in range(MOST + 1):
                sub = np.full(len(fp), k << size, np.int64)
                for g in range(GROUPS):
                    at = group == g
                    for j, b in enumerate(rest[g][k * size : (k + 1) * size]):
                        sub[at] |= ((fp[at] >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
                out.append(sub)
            for sub in out:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sub)], names=[*batch.schema.names, "sub"])

    return run


def joined(asks: np.ndarray, held: np.ndarray) -> list[tuple[int, int]]:
    """A forest that joins all fingerprints of ``asks`` with those of ``held`` that differ in MOST bits or fewer; its pairs are of one component, not always links themselves."""
    name, at = np.unique(np.concatenate([asks, held]), return_inverse=True)
    mine, theirs = at[: len(asks)], at[len(asks) :]
    label, pairs = np.arange(len(name)), []
    step = max(1, (1 << 22) // max(1, len(held)))
    for lo in range(0, len(asks), step):
        near = np.bitwise_count(asks[lo : lo + step, None] ^ held[None, :]) <= MOST
        row, col = np.nonzero(near)
        a, b = label[mine[lo + row]], label[theirs[col]]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            # of the pairs between labels, the first for each larger label: no cycle among these
            high, low = np.maximum(a, b), np.minimum(a, b)
            who, first = np.unique(high, return_index=True)
            pairs += zip(name[who].tolist(), name[low[first]].tolist(), strict=True)
            to = np.arange(len(name))
            to[who] = low[first]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
            a, b = to[a], to[b]
    return pairs


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each (grp, value, sub, s, m), whose rows come one after the other."""
    last, held = None, []

    def done() -> list[tuple[int, int]]:
        t = pa.Table.from_batches(held)
        fp = t.column("fp").to_numpy().view(np.uint64)
        asks, there = t.column("asks").to_numpy(), t.column("held").to_numpy()
        return joined(fp[asks], fp[there]) if asks.any() and there.any() else []

    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy() for k in ("grp", "value", "sub", "s", "m")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        pairs: list[tuple[int, int]] = []
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(key)]):
            if held and (key[lo] != last).any():
                pairs += done()
                held.clear()
            held.append(batch.slice(lo, hi - lo))
            last = key[lo]
        yield _links(pairs)
    if held:
        yield _links(done())


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch({"a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with s and m such that under each (grp, value, sub) every row that asks meets every one that is held, in blocks of about BLOCK rows on either side."""
    key = ["grp", "value", "sub"]
    size = rows.groupBy(*key).agg(F.ceil(F.count_if("asks") / BLOCK).alias("ns"), F.ceil(F.count_if("held") / BLOCK).alias("nm"))
    size = size.filter("ns > 1 or nm > 1").select(*key, F.greatest("ns", F.lit(1)).alias("ns"), F.greatest("nm", F.lit(1)).alias("nm"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    at = rows.withColumn("_at", F.pmod(F.xxhash64("fp"), F.lit(1 << 40))).withColumn("salt", (F.col("_at") % SPREAD).cast("int")).join(size, [*key, "salt"], "left").fillna(1, ["ns", "nm"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    mine = lambda n: F.pmod(F.col("_at"), F.col(n)).cast("int")
    one = at.filter("ns = 1 and nm = 1").select(*key, F.lit(0).alias("s"), F.lit(0).alias("m"), "fp", "asks", "held")
    large = at.filter("ns > 1 or nm > 1")
    asks = large.filter("asks").select(*key, mine("ns").alias("s"), every("nm").alias("m"), "fp", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    held = large.filter("held").select(*key, every("ns").alias("s"), mine("nm").alias("m"), "fp", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    return one.unionByName(asks).unionByName(held)


def hamming_links(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of the distinct numbers ``fp`` that have the same components as all links between numbers that differ in MOST bits or fewer."""
    n = nodes.count()
    share = SCALE if n <= SAMPLE else -(-SCALE * SAMPLE // n)
    chosen = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(SCALE)) < share).select("fp").collect()
    plan = Plan(np.sort(np.array([r["fp"] for r in chosen], np.int64)).view(np.uint64), n)
    rows = nodes.select("fp").mapInArrow(released(_probes(plan)), "grp int, value int, fp long, asks boolean, held boolean")
    size = rows.groupBy("grp", "value").agg(F.count_if("asks").alias("_s"), F.count_if("held").alias("_m"))
    # values that nobody asks for, or has, need nobody; those with many rows are told apart further (GROUPS << WIDTH rows at most)
    size = checkpointed(size.filter("_s > 0 and _m > 0").select("grp", "value", (F.greatest("_s", "_m") > BLOCK).alias("_large"), (F.col("_s") + F.col("_m") > 2).alias("_met")))
    marked = rows.join(F.broadcast(size.filter("_met").select("grp", "value", "_large")), ["grp", "value"])
    few = marked.filter("not _large").select("grp", "value", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("s"), F.lit(0).alias("m"), "fp", "asks", "held")
    many = marked.filter("_large").select("grp", "value", "fp", "asks", "held").mapInArrow(_refined(plan), "grp int, value int, fp long, asks boolean, held boolean, sub long")
    key = ("grp", "value", "sub", "s", "m")
    dealt = few.unionByName(_in_blocks(many)).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(released(_compared), "a long, b long")


def near_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``.

    Words are runs of bytes other than white space, A-Z in lower case; shingles are runs of three words joined by one
    space, with repeats, or the whole sequence if it is shorter. A bit is 1 if it is set in more than half of the shingles'
    XXH64 (seed 42). A text without words, or a null one, has the fingerprint zero, which is linked like any other. Rows
    are linked at three differing bits or fewer. component_id: the least id of the component; null if no row of it has an
    id. Rows that repeat an id or have none are rows of their own. Other columns are not read.
    """
    held = checkpointed(fingerprints(docs, text, doc_id))
    nodes = checkpointed(held.groupBy("fp").agg(F.min("doc").alias("least")))
    found = components(hamming_links(nodes), "a", "b").withColumnRenamed("node", "fp")
    part = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    least = part.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = part.join(least, "comp").select("fp", "component_id")
    return held.join(of, "fp").select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
