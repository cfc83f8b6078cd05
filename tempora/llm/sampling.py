"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 1 << 20
#: Shares of tables of any size: a sample of one row in 2**40 can still be told.
FINE = 1 << 40


def share_of(limit: int, n: int) -> int:
    """The share (of FINE) of ``n`` rows that has about ``limit`` of them, never none."""
    return FINE if n <= limit else -(-FINE * limit // n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label, part (0 to 1) of about ``limit`` labelled documents that may be learned from.

    The sample is a fixed share of the ids by their hash, and of equal texts with one label the least id is taken, so it
    is the same at every run; it is written once. With ``most_bytes``, texts longer than a sixteenth of it are not learned
    from, and of the others as many are taken, in the order of another hash, as have no more bytes together; texts are
    whole in any case. Ids that the labels repeat get the larger label; null ids and labels take no part.
    """
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = clean.count()
    chosen = clean.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FINE)) < share_of(limit, n))
    # bounded by ``limit`` in expectation, whatever the size of the labels
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "label")
    if most_bytes is not None:
        found = found.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 16)
    kept = checkpointed(found.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SCALE)) / SCALE))
    if most_bytes is None:
        return kept
    at = F.xxhash64("doc_id", F.lit(13))
    sizes: dict[int, int] = {}
    for r in kept.select(at.alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect():  # about ``limit`` pairs of numbers
        sizes[r["at"]] = sizes.get(r["at"], 0) + r["size"]
    total, last = 0, None
    for place in sorted(sizes):
        total += sizes[place]
        if total > most_bytes:
            return kept.filter(at <= last) if last is not None else kept.limit(0)
        last = place
    return kept
