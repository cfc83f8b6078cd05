"""Resampling of documents towards a target distribution, by the importance of their hashed word features.

Runs of one and two words fall into buckets by their checksum. One pass counts the buckets of both sides; their gains are
an array of fixed length, with which a second pass scores each document. Adding Gumbel noise that depends on the id alone
turns "the highest scores" into a draw without replacement. The scores are written once; the cutoff is found by bisection,
each count job over the written scores answering the next few halvings, first of the score, then of the id among rows at
that score. Only the selected rows are dealt into ranges, sorted and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, released, runs, table

BUCKETS = 10000
#: Thresholds that one count job tries: LEVELS halvings.
LEVELS = 4
#: Bytes of a word that the vectorised checksum walks through; longer words go one by one.
WALKED = 48
#: Ids that are missing count as the largest.
LAST = (1 << 63) - 1
_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)


def _table() -> np.ndarray:
    """T with crc' = T[(crc ^ byte) & 255] ^ (crc >> 8) on the inverted register."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_TABLE = _table()
_FF, _EIGHT, _ONES = np.uint32(255), np.uint32(8), np.uint32(0xFFFFFFFF)


def _walk(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The (inverted) checksum registers after the bytes [start, end) of each row."""
    register, length = register.copy(), end - start
    order = np.argsort(-length, kind="stable")
    held = np.searchsorted(-length[order], -np.arange(1, min(WALKED, int(length.max(initial=0))) + 1), "right")
    for k, n in enumerate(held.tolist()):  # the n longest have a byte k
        at = order[:n]
        r = register[at]
        register[at] = _TABLE[(r ^ data[start[at] + k]) & _FF] ^ (r >> _EIGHT)
    for at in np.flatnonzero(length > WALKED).tolist():
        rest = data[start[at] + WALKED : end[at]].tobytes()
        register[at] = zlib.crc32(rest, int(register[at] ^ _ONES)) ^ 0xFFFFFFFF
    return register


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of some texts, the text of each, and how many words each text has."""
    data = _LOWER[data]
    start, end = runs(_WORD[data], offsets[:-1]) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    text = np.searchsorted(offsets, start, "right") - 1
    one = _walk(np.full(len(start), _ONES, np.uint32), data, start, end)
    first = np.flatnonzero(text[1:] == text[:-1])
    space = _TABLE[(one[first] ^ np.uint32(32)) & _FF] ^ (one[first] >> _EIGHT)
    two = _walk(space, data, start[first + 1], end[first + 1])
    bucket = (np.concatenate([one, two]) ^ _ONES) % np.uint32(BUCKETS)
    return bucket, np.concatenate([text, text[first]]), np.bincount(text, minlength=len(offsets) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, offsets in blocks(batch, "text"):
            total += np.bincount(features(data, offsets)[0], minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""
    return docs.select(F.col(text).alias("text")).mapInArrow(released(_counted), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each of the BUCKETS buckets: the floored thousandths of the smoothed logarithm of how much likelier it is in the target."""
    spark = docs.sparkSession
    at = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    side = lambda counts, name: counts.withColumnRenamed("n", name)
    both = at.join(side(docs, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    out = [0] * BUCKETS
    rows = both.collect()  # BUCKETS rows
    all_s, all_t = float(sum(r["s"] for r in rows) + BUCKETS), float(sum(r["t"] for r in rows) + BUCKETS)
    for r in rows:
        out[r["bucket"]] = math.floor(1000 * math.log(float(r["t"] + 1) * all_s / (float(r["s"] + 1) * all_t)))
    return out


def _weighed(gain: list[int]):
    value = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                bucket, text, words = features(data, offsets)
                total, n = np.zeros(len(words), np.int64), np.bincount(text, minlength=len(words))
                np.add.at(total, text, value[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(words), "n_features": pa.array(n), "weight": pa.array(weight)})

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """The floored thousandths of Gumbel noise that depends on seed and id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def bisect(rows: DataFrame, value: Column, lo: int, hi: int, want: int) -> int:
    """The least v in [lo, hi] such that at least ``want`` rows have a value of v or less (hi must be one); exact counts only."""
    while lo < hi:
        step = max(1, -(-(hi - lo + 1) // (1 << LEVELS)))
        tries = list(range(lo + step - 1, hi, step))
        found = rows.agg(*(F.count_if(value <= v) for v in tries)).first() if tries else []
        enough = [v for v, n in zip(tries, found, strict=True) if n >= want]
        short = [v for v, n in zip(tries, found, strict=True) if n < want]
        lo, hi = (short[-1] + 1 if short else lo), (enough[0] if enough else hi)
    return lo


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of ``docs``.

    Words are runs of digits, letters a to z (A-Z in lower case) and bytes from 0x80 on; features are words and pairs of
    neighbouring words. weight: the floored mean gain of the features, 0 without any (a null or empty text). score: weight
    plus noise of the id. Of the N rows with ``least_words`` or more, floor(percent * N / 100) with the highest scores are
    drawn; ties go to the smaller id, a null id last, then to fewer features. rank counts them from 1, null for the rest.
    Rows that share an id are rows of their own with the same noise; which of equal rows is drawn makes no difference.
    Empty tables give no rows, an empty target gives gains of its smoothing alone. Other columns are not read.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(ready), bucket_counts(target, target_text))
    held = ready.mapInArrow(released(_weighed(gain)), "doc_id long, n_words long, n_features long, weight long")
    order = F.coalesce("doc_id", F.lit(LAST))
    held = checkpointed(held.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "able": F.col("n_words") >= least_words}))
    able = held.filter("able")
    n, low, high = able.agg(F.count("*"), F.min("score"), F.max("score")).first()
    draw = percent * n // 100
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return held.select(*names, none)
    cut = -bisect(able, -F.col("score"), -high, -low, draw)
    above, at, first, last = able.agg(F.count_if(F.col("score") > cut), F.count_if(F.col("score") == cut), F.min(F.when(F.col("score") == cut, order)), F.max(F.when(F.col("score") == cut, order))).first()
    tied = last if above + at == draw else bisect(able.filter(F.col("score") == cut), order, first, last, draw - above)
    chosen = F.col("able") & ((F.col("score") > cut) | ((F.col("score") == cut) & (order <= tied)))
    # ranges of the chosen rows; a number of each row lets those that are equal in all else be dealt out too
    picked = held.filter(chosen).select(*names, order.alias("_id"), F.monotonically_increasing_id().alias("_row"))
    keys = (F.desc("score"), F.col("_id"), F.col("n_features"), F.col("_row"))
    sorted_ = checkpointed(picked.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*names, F.monotonically_increasing_id().alias("_place")))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    size = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each range
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place + 1)
    # rows that repeat the last id at the cutoff may be more than are wanted
    ranked = ranked.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
    return held.filter(~chosen).select(*names, none).unionByName(ranked)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_TRANSLATED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BUCKET = "(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)])), 4294967295) % 10000)"
ORACLE = rf"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS l FROM range(256) AS t(b)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_TRANSLATED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(coalesce({_TRANSLATED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS MATERIALIZED (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
fq AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM q),
h AS MATERIALIZED (SELECT f, {_BUCKET} AS b FROM (SELECT f FROM fd UNION SELECT f FROM fq), crc),
s AS (SELECT b, count(*) AS n FROM fd JOIN h USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM fq JOIN h USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM fd)::DOUBLE + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM fq)::DOUBLE + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM h) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM fd JOIN h USING (f) JOIN g USING (b) GROUP BY r),
x AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
  (('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln(u))))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM y WHERE words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
