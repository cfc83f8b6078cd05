"""Flags, their reasons, and the log of operations, as tables that change by whole keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import append_row
from .algebra import overwrite_scanned
from .temporal import EPISODE

LOG = "number long, at string, op string, dataset string, episodes array<long>, status string, details string"
REASONS = "episode_index long, type string, reason string"


def log(spark: SparkSession, path: str, number: int, at: str, op: str, dataset: str, episodes: list[int], status: str = "ok", details: str = "") -> None:
    """One more line of the log."""
    append_row(spark, path, LOG, (number, at, op, dataset, sorted(set(episodes)), status, details))


def log_tail(spark: SparkSession, path: str, limit: int = 100) -> list[Row]:
    """The last lines, the newest first; at least 1 and at most 1000."""
    return spark.read.schema(LOG).json(path).orderBy(F.desc("number")).limit(max(1, min(1000, limit))).collect()


def toggled(flags: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes that were flagged no longer are, and those that were not are."""
    both = flags.select(EPISODE).distinct().withColumn("_a", F.lit(True)).join(episodes.select(EPISODE).distinct().withColumn("_b", F.lit(True)), EPISODE, "full")
    return both.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(EPISODE)


def with_reason(reasons: DataFrame, episodes: DataFrame, reason: str, kind: str = "manual") -> DataFrame:
    """One reason of a kind for each of the episodes, in place of those of that kind."""
    new = episodes.select(EPISODE).distinct().select(EPISODE, F.lit(kind).alias("type"), F.lit(reason).alias("reason"))
    others = reasons.filter(F.col("type") != kind)
    return others.unionByName(overwrite_scanned(reasons.filter(F.col("type") == kind), new, new))


def flag_reasons(flagged: DataFrame, sidecars: list[DataFrame], tasks: DataFrame) -> DataFrame:
    """Each flagged episode with its task and the distinct reasons (type, reason) that any sidecar gives, sorted."""
    every = None
    for rows in sidecars:
        rows = rows.select(EPISODE, "type", "reason")
        every = rows if every is None else every.unionByName(rows)
    held = every.join(flagged.select(EPISODE).distinct(), EPISODE, "left_semi").groupBy(EPISODE).agg(F.sort_array(F.collect_set(F.struct("type", "reason"))).alias("reasons"))
    out = flagged.select(EPISODE).distinct().join(held, EPISODE, "left").join(tasks.select(EPISODE, "task"), EPISODE, "left")
    return out.select(EPISODE, "task", F.coalesce("reasons", F.array().cast("array<struct<type:string,reason:string>>")).alias("reasons"))


def all_flags(files: list[DataFrame]) -> DataFrame:
    """The episodes that any flag file lists."""
    every = None
    for rows in files:
        every = rows.select(EPISODE) if every is None else every.union(rows.select(EPISODE))
    return every.distinct()


def without(files: list[DataFrame], episodes: DataFrame) -> list[DataFrame]:
    """Each flag file without some episodes."""
    return [rows.join(episodes.select(EPISODE), EPISODE, "left_anti") for rows in files]


def assigned_prompts(episodes: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes (episode_index, task) with the last pending prompt of each (episode_index, task, number), and the assignments that fail: unknown episodes, empty prompts."""
    last = pending.groupBy(EPISODE).agg(F.max_by("task", "number").alias("_new"))
    checked = last.join(episodes.select(EPISODE, F.lit(True).alias("_known")), EPISODE, "left")
    error = F.when(F.col("_known").isNull(), "unknown episode").when(F.trim(F.coalesce("_new", F.lit(""))) == "", "empty prompt")
    checked = checked.withColumn("error", error)
    done = episodes.join(checked.filter("error is null").select(EPISODE, "_new"), EPISODE, "left").withColumn("task", F.coalesce("_new", "task")).drop("_new")
    return done, checked.filter("error is not null").select(EPISODE, F.col("_new").alias("task"), "error")


def merged_sources(sources: DataFrame) -> DataFrame:
    """Provenance (source, key, value) of merged datasets: of each key the value of the last source, and a row ``merged_from`` with all sources."""
    last = sources.groupBy("key").agg(F.max_by("value", "source").alias("value"))
    return last.unionByName(sources.agg(F.lit("merged_from").alias("key"), F.array_join(F.sort_array(F.collect_set(F.col("source").cast("string"))), ",").alias("value")).select("key", "value"))
