"""MinHash near-dedup with circulant permutations.

One permutation places a shingle on a circle, a second gives the values there; coordinate k of a signature is the least
value k places on from the shingles, so all coordinates of a shingle are one contiguous stretch of the value table.
Documents with equal sets collapse into one node first, named by a digest of the whole set, so ids play no part in the
linking. Signatures fall into bands; the nodes of a bucket form a star around the earliest of them, and each node is
verified against the centre that it shares most buckets with. Where a bucket's members are not all in one component by then, they are
verified against its hub, the member with most links so far. Those still outside its main component are compared with
the members whose size allows a link, in blocks of bounded bytes and on full sets, and only links that join components
leave a block, fewer than it has rows. So no group emits its pairs, and no link found by the bands is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BASE, Words, blocks, checkpointed, forget, gram_hash, mix, prefix_hash, released, span_hash, spread, table
from .components import components

SHINGLE = 5
#: Places on the circle, coordinates of a signature, and coordinates in a band: a pair at similarity 0.75 would share no
#: band with probability (1 - 0.75**4)**32 = 5e-6 if the coordinates were independent; neighbouring ones are not quite,
#: so a test measures the recall.
CIRCLE, COORDINATES, ROWS = 1 << 20, 128, 4
#: Shingles on either side of a block of a bucket, about.
BLOCK = 1 << 19
#: Parts in which the members of a bucket look up their blocks.
SPREAD = 32
_VALUES: list[np.ndarray] = []


def _values() -> np.ndarray:
    """Row s: the values of the second permutation at s, s + 1, ..., around the circle (a view)."""
    if not _VALUES:
        value = np.random.Generator(np.random.PCG64(20240607)).permutation(CIRCLE).astype(np.int32)
        around = np.concatenate([value, value[:COORDINATES]])
        _VALUES.append(np.lib.stride_tricks.as_strided(around, (CIRCLE, COORDINATES), (4, 4)))
    return _VALUES[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and how many each has."""
    w = Words(data, offsets, lower=True)
    words = np.diff(w.of_text)
    grams = gram_hash(w.hash, SHINGLE)
    many = np.maximum(0, words - SHINGLE + 1)
    few = np.flatnonzero((words > 0) & (words < SHINGLE))
    whole = mix(span_hash(prefix_hash(w.hash, WORD_BASE), w.of_text[few], w.of_text[few + 1]) + words[few].astype(np.uint64)) if len(few) else np.zeros(0, np.uint64)
    value = np.concatenate([grams[spread(w.of_text[:-1], many)], whole])
    text = np.concatenate([np.repeat(np.arange(len(words)), many), few])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(words))


def signatures(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The signature of each set; of an empty one, a row of the largest value."""
    out = np.full((len(count), COORDINATES), np.iinfo(np.int32).max, np.int32)
    table_of = _values()
    place = (mix(value ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CIRCLE)).astype(np.int64)  # the first permutation
    edge = np.concatenate([[0], np.cumsum(count)])
    for k in np.flatnonzero(count):
        for at in range(edge[k], edge[k + 1], 2048):
            part = table_of[place[at : min(at + 2048, edge[k + 1])]]
            np.minimum(out[k], part.min(axis=0), out=out[k])
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 18):
            value, count = shingle_sets(data, offsets)
            sign = signatures(value, count).astype(np.uint64).reshape(len(count), -1, ROWS)
            band = np.zeros(sign.shape[:2], np.uint64) + np.arange(1, sign.shape[1] + 1, dtype=np.uint64)
            for k in range(ROWS):
                band = mix(band * WORD_BASE + sign[:, :, k])
            full = count > 0
            name = np.frombuffer(b"".join(_digests(value, count)), np.int64).reshape(-1, 2)
            yield pa.record_batch({
                "doc": part.column(0), "row": part.column(1), "n": pa.array(count.astype(np.int64)), "node": pa.array(np.ascontiguousarray(name[:, 0])), "check": pa.array(np.ascontiguousarray(name[:, 1])),
                "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * band.shape[1])]).astype(np.int32)), pa.array(band[full].ravel().view(np.int64))),
            })


def _digests(value: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
    """16 bytes that name each set."""
    data, edge = value.tobytes(), np.concatenate([[0], np.cumsum(count)]) * 8
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield hashlib.blake2b(data[lo:hi], digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in blocks(batch, "text", 1 << 18):
            value, count = shingle_sets(data, offsets)
            node = np.frombuffer(b"".join(d[:8] for d in _digests(value, count)), np.int64)
            yield pa.record_batch({"node": pa.array(node), "set": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value.view(np.int64)))})


def linked(shared, n_a, n_b):
    """Whether two sets are alike: 100 * intersection >= 75 * union."""
    return 100 * shared >= 75 * (n_a + n_b - shared)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components among the rows of each (bucket, window, s, m): rows outside the main component against all."""
    held: list[pa.RecordBatch] = []

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        comp, side = t.column("comp").to_numpy(), t.column("outside").to_numpy(zero_copy_only=False)
        sets = t.column("set").chunk(0)
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = sets.flatten().to_numpy()
        edge = np.concatenate([[0], np.cumsum(size)])
        inner, outer = np.flatnonzero(~side), np.flatnonzero(side)
        shingle = flat[spread(edge[inner], size[inner])]
        order = np.argsort(shingle, kind="stable")
        posting = np.repeat(np.arange(len(inner)), size[inner])[order]
        shingle = shingle[order]
        # only links that join what the block has not yet joined
        name, at = np.unique(comp, return_inverse=True)
        top = list(range(len(name)))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        pairs: list[tuple[int, int]] = []
        for x in outer:
            own = flat[edge[x] : edge[x + 1]]
            lo, hi = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            shared = np.bincount(posting[spread(lo, hi - lo)], minlength=len(inner))
            hit = np.flatnonzero(linked(shared, size[x], size[inner]))
            for other in np.unique(at[inner[hit]]).tolist():
                a, b = root(int(at[x])), root(other)
                if a != b:
                    top[max(a, b)] = min(a, b)
                    pairs.append((int(comp[x]), int(name[other])))
        return pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
        at = 0
        for k in range(len(keys) + 1):
            if k == len(keys) or keys[k] != last:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if k < len(keys):
                    if held:
                        yield done()
                    held, at, last = [], k, keys[k]
    if held:
        yield done()


def _window(n):
    """Sets that are linked differ by a factor of 4/3 at most, so their windows are the same or neighbours."""
    return F.floor(F.log(n) / math.log(4 / 3))


def _blocks_of(part: DataFrame) -> DataFrame:
    """Rows (bucket, window, s, m, outside, comp, node) such that each node outside its bucket's main component meets all members that it may be linked with."""
    sizes = part.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    main = (
        sizes.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", F.col("top.comp").alias("main"))
    )
    open_ = part.join(main, "bucket").withColumns({"outside": F.col("comp") != F.col("main"), "window": _window("n"), "at": F.pmod(F.xxhash64("node"), F.lit(1 << 40))}).drop("main")
    held = open_.groupBy("bucket", "window").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("outside"), F.col("n"))).alias("out"))
    near = lambda: F.explode(F.array(F.col("window") - 1, F.col("window"), F.col("window") + 1))
    room = held.select("bucket", "all", near().alias("window")).groupBy("bucket", "window").agg(F.sum("all").alias("all"))
    cells = held.filter("out is not null").select("bucket", "window", F.ceil(F.col("out") / BLOCK).alias("ns")).join(room, ["bucket", "window"])
    # cells are few; some copies of each, so that a large bucket is joined in several tasks
    cells = cells.select("bucket", "window", "ns", F.ceil(F.col("all") / BLOCK).alias("nm"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    open_ = open_.withColumn("salt", (F.col("at") % SPREAD).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = open_.filter("outside").join(cells, ["bucket", "window", "salt"]).select("bucket", "window", (F.col("at") % F.col("ns")).alias("s"), every("nm").alias("m"), "outside", "comp", "node")
    inside = open_.select("bucket", near().alias("window"), "salt", "at", "comp", "node").join(cells, ["bucket", "window", "salt"])
    inside = inside.select("bucket", "window", every("ns").alias("s"), (F.col("at") % F.col("nm")).alias("m"), F.lit(False).alias("outside"), "comp", "node")
    return outside.unionByName(inside)


def _verified(pairs: DataFrame, sets: DataFrame, a: str = "node", b: str = "centre") -> DataFrame:
    """The columns ``a`` and ``b`` of those (node, centre) whose sets are alike."""
    x, y = sets.select("node", F.col("set").alias("x")), sets.select(F.col("node").alias("centre"), F.col("set").alias("y"))
    alike = linked(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))
    return pairs.join(x, "node").join(y, "centre").filter(alike).select(F.col(a).alias("a"), F.col(b).alias("b"))


def _unresolved(member: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    several = member.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo != _hi").select("bucket")
    return member.join(several, "bucket", "left_semi")


def _parted(ready: DataFrame, classes: DataFrame) -> DataFrame:
    """node, comp: the component of each node that shares a bucket with another."""
    placed = classes.select("node", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"), F.explode("bands").alias("bucket"))
    # the centre of a bucket is its earliest document, which copies are often copies of
    centres = placed.groupBy("bucket").agg(F.min(F.struct("least", "node")).alias("first"), F.count("*").alias("size")).filter("size > 1").select("bucket", F.col("first.node").alias("centre"))
    starred = checkpointed(placed.select("node", "bucket").join(centres, "bucket"))
    # a node's centre: the one it shares most buckets with
    votes = starred.filter("node != centre").groupBy("node", "centre").agg(F.count("*").alias("votes"))
    ends = votes.groupBy("node").agg(F.max(F.struct("votes", F.negative("centre").alias("_"), "centre")).alias("top")).select("node", F.col("top.centre").alias("centre"))
    # a node's set, from the text of one of its rows
    wanted = starred.select("node").distinct().join(classes.select("node", "row", "n"), "node")
    sets = ready.join(wanted.select("row"), "row", "left_semi").mapInArrow(released(_sets), "node long, set array<long>")
    sets = checkpointed(sets.groupBy("node").agg(F.first("set").alias("set")))
    links = checkpointed(_verified(ends, sets))
    part = wanted.select("node", "n").join(components(links, "a", "b"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp"))
    member = checkpointed(starred.select("bucket", "node").join(part, "node"))
    # again, where a bucket holds several components: against its hub
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")
    open_ = _unresolved(member).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = open_.groupBy("bucket").agg(F.max(F.struct("degree", F.negative("node").alias("_"), "node", "comp")).alias("hub")).select("bucket", F.col("hub.node").alias("centre"), F.col("hub.comp").alias("to"))
    # of a component, one pair with each hub would do, but which is not known: each member once
    again = open_.join(hubs, "bucket").filter("comp != to").select("node", "centre", "comp", "to").distinct()
    joined = _verified(again, sets, "comp", "to")
    final = components(joined, "a", "b").withColumnRenamed("node", "comp")
    part = checkpointed(part.join(final, "comp", "left").select("node", "n", F.coalesce("component", "comp").alias("comp")))
    member = checkpointed(_unresolved(member.join(final, "comp", "left").select("bucket", "node", "n", F.coalesce("component", "comp").alias("comp"))))
    # what the steps before have written goes before sets travel to their blocks
    del starred, links, open_, hubs, again, joined, degree, votes, ends, wanted
    forget(ready.sparkSession)
    keys = ("bucket", "window", "s", "m")
    rows = _blocks_of(member).join(sets, "node").select(*keys, "outside", "comp", "set")
    more = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(_compare), "a long, b long")
    final = components(more.distinct(), "a", "b").withColumnRenamed("node", "comp")
    return checkpointed(part.select("node", "comp").join(final, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of each row.

    A set holds the distinct runs of five words, A-Z in lower case; with fewer words the whole sequence; without words,
    or for a null text, it is empty and linked with nothing. Rows are linked at a similarity of 0.75 or more, whatever
    their ids: rows that share an id, or have none, are rows of their own. class_id: the least id with the same set;
    component_id: the least id of the component; both null if none of those rows has an id. kept: component_id is the
    row's own id; where a component has no id, one of its rows is kept. Shingles are compared by 64 bits of hash, and
    equal sets by 128 bits of a digest of them. Other columns are not read.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    signed = checkpointed(ready.mapInArrow(released(_signed), "doc long, row long, n long, node long, check long, bands array<long>"))
    name = ["node", "check"]
    classes = checkpointed(signed.filter("n > 0").groupBy(*name).agg(F.min("doc").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    part = _parted(ready, classes)
    forget(ready.sparkSession)  # sets and buckets are of no more use
    of_class = classes.select(*name, "least", "row").join(part, "node", "left").select(*name, "least", "row", F.coalesce("comp", "node").alias("comp"))
    tops = of_class.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("row").alias("first"))
    known = of_class.join(tops, "comp").select(*name, F.col("least").alias("class_id"), "component_id", "first", F.lit(True).alias("known"))
    out = signed.select("doc", "row", "n", *name).join(known, name, "left")
    alone = F.col("known").isNull()  # an empty set
    kept = alone | F.when(F.col("component_id").isNull(), F.col("row") == F.col("first")).otherwise(F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)))
    own = lambda c: F.when(alone, F.col("doc")).otherwise(F.col(c)).alias(c)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), kept.alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")
