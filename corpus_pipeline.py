"""A corpus pipeline of five operators; each stage reads what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import checkpointed, fresh, table
from tempora.llm.op2_minhash import near_duplicates
from tempora.llm.op3_decontamination import contaminated
from tempora.llm.op6_secrets import scan_secrets
from tempora.llm.op8_packing import pack_documents
from tempora.llm.op10_toxicity import Model, scored

REDACTED = "[secret]"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity is 0.5 or more; learned from all labels."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = Model(ready, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True))
    score = fresh(docs, "score")
    return scored(docs, model, out=score).filter(F.col(score) < 0.5).select(*docs.columns)


def _row_key() -> Column:
    """What tells the rows of a stage apart: their id with their text. Rows that repeat both are one."""
    return F.xxhash64("doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each group of near duplicates, null ids last.

    Rows that repeat an id and text are one, with the least of their other columns, so that every run keeps the same.
    """
    name = fresh(docs, "row")
    keyed = docs.withColumn(name, _row_key())
    group = near_duplicates(keyed, doc_id=name).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    ids = keyed.select(F.col(name).alias("key"), F.col("doc_id").alias("id")).distinct()
    # partial minima first, so that a large group is not gathered in one task
    least = group.join(ids, "key").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("least"))
    kept = least.select(F.col("least.key").alias(name))
    same, others = ("doc_id", "text"), [c for c in docs.columns if c not in ("doc_id", "text")]
    stay = keyed.join(kept, name, "left_semi")
    if others:
        stay = stay.groupBy(*same).agg(F.min(F.struct(*others)).alias(name)).select(*same, *(F.col(name)[c].alias(c) for c in others))
    else:
        stay = stay.select(*same).distinct()
    return stay.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold three quarters of the shingles of a benchmark item, each by its own id and text.

    The key is a digest of 128 bits: rows that shared a shorter one would go with each other.
    """
    name = fresh(docs, "row")
    keyed = docs.withColumn(name, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")))
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark", "item_id", "text"), doc_id=name).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(leaks, name, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets found in each text; every document stays."""
    spans, clean = fresh(docs, "spans"), fresh(docs, "clean")
    found = scan_secrets(docs, keep=spans)
    piece = lambda lo, n: F.substring(F.col("text"), (lo + 1).cast("int"), n.cast("int"))
    # left to right; a span that begins inside one already replaced is merged into it
    walked = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], piece(a["at"], s["start"] - a["at"]), F.lit(REDACTED))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    done = found.withColumn(clean, F.when(F.size(spans) > 0, walked))
    whole = F.when(F.size(spans) > 0, F.concat(F.col(clean)["out"], piece(F.col(clean)["at"], F.length("text")))).otherwise(F.col("text"))
    replaced = {"text": whole}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.size(spans) > 0, F.length(whole).cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns(replaced).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in full sequences of 4096 tokens."""
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
