"""Helpers shared by the training-data operators: tables, batches, byte-level hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the polynomial hashes over bytes and over word hashes (arithmetic is modulo 2**64).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
#: Bytes that the contracts count as white space.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spark's setting by which the shuffle files of a query are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``; Spark alone reads the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor loses none of it.

    The folder is the one that spark.checkpoint.dir names; only in one process may it be missing.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and (context.master.startswith("local-") or not context.master.startswith("local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    # what the shuffles of this run have written is of no use once the result stands, so it goes at once
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, before)


def forget(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to any more, so that Spark's cleaner removes those shuffles and checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_mod(column, n: int):
    """crc32 of an id written as text, modulo ``n``: the folds of the labelled tables."""
    return F.crc32(F.col(column).cast("string")) % n


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) and their inverses, modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        x = np.full(n, b, np.uint64)
        if n:
            x[0] = _ONE
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _KEPT.get(int(base))
    if have is None or len(have[0]) < n:
        have = powers(base, max(n, 1 << 16))
        if n <= 1 << 22:  # a very long text gets its own
            _KEPT[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i with a leading 0, and the inverse powers that shift a difference to its start."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + _ONE) * up, out=sums[1:])
    return sums, down


def span_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, len(down) - 1)]) if len(down) else np.zeros(0, np.uint64)


def gram_hash(values: np.ndarray, width: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """The hash of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums, down = prefix_hash(values, base)
    return mix((sums[width:] - sums[:-width]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Words:
    """The words of a block of texts: bytes, [start, end) of each word, its hash, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_here = offsets[:-1][offsets[:-1] < len(data)]
        first[starts_here] = inside[starts_here]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends_here = offsets[1:][offsets[1:] > offsets[0]] - 1
        last[ends_here] = inside[ends_here]
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = span_hash(prefix_hash(data, BYTE_BASE), self.start, self.end) if len(data) else np.zeros(0, np.uint64)
        self.of_text = np.searchsorted(self.start, offsets)  # text i has the words of_text[i] .. of_text[i + 1]


def binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array; nulls are empty."""
    if pa.types.is_dictionary(array.type):
        array = array.dictionary_decode()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text each (one text at least), their bytes and offsets."""
    data, offsets = binary(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def released(run):
    """``run`` (over the batches of a task), after which the worker, which goes on to other tasks, gives unused memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _KEPT.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def to_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array out of bytes and offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of each run of true flags; a run ends before each position in ``breaks``."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    breaks = breaks[breaks < len(flags)]
    begin[breaks] = flags[breaks]
    finish = flags.copy()
    finish[:-1] &= ~flags[1:]
    inner = breaks[breaks > 0] - 1
    finish[inner] = flags[inner]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def chunks(batches: Iterator[pa.RecordBatch], key: str, size: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of the column ``size``, cut where the (sorted) key changes."""
    held, held_size, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        sizes = np.diff(binary(batch.column(batch.schema.get_field_index(size)))[1])
        change = np.flatnonzero(np.concatenate([[last is not None and keys[0] != last], keys[1:] != keys[:-1]]))
        at, done = 0, np.concatenate([[0], np.cumsum(sizes)])
        for cut in change:
            if held_size + done[cut] - done[at] >= limit:
                held.append(batch.slice(at, cut - at))
                yield pa.Table.from_batches([x for x in held if len(x)])
                held, held_size, at = [], 0, cut
        held.append(batch.slice(at))
        held_size += int(done[-1] - done[at])
        last = keys[-1]
    if any(len(x) for x in held):
        yield pa.Table.from_batches([x for x in held if len(x)])
