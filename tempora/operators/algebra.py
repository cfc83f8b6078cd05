"""Sets of episodes: split, merge, subtract, delete, repair. New numbers are given on the small episodes table, never on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import EPISODE, ORDER, global_index, over, running
from .written import written


def dense(ids: DataFrame, key: str, out: str) -> DataFrame:
    """Numbers 0, 1, ... in the order of a long key."""
    return running(ids, key, {out: None})


def renumbered(frames: DataFrame) -> DataFrame:
    """Frames with dense episode numbers and a fresh global index; ``old_episode`` keeps the former number.

    Numbers and offsets are given on one table of episodes, which is written and which the frames join once.
    """
    lengths = written(frames.groupBy(F.col(EPISODE).alias("old_episode")).agg(F.count("*").alias("_n")))
    episodes = running(lengths, "old_episode", {EPISODE: None, "_from": "_n"}).drop("_n")
    named = frames.withColumnRenamed(EPISODE, "old_episode").join(episodes, "old_episode")
    return named.withColumn("index", F.col("_from") + F.col(ORDER)).drop("_from")


def split(frames: DataFrame, keep: Column) -> DataFrame:
    """The episodes that satisfy ``keep`` in any frame, renumbered."""
    kept = frames.filter(keep).select(EPISODE).distinct()
    return renumbered(frames.join(kept, EPISODE, "left_semi"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Datasets one after the other on all columns, episodes renumbered by (source, old number)."""
    rows = None
    for k, part in enumerate(parts):
        part = part.withColumn("source", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    numbers = written(rows.groupBy("source", EPISODE).agg(F.count("*").alias("_n")))
    # one long that sorts as (source, episode)
    span = numbers.agg((F.max(EPISODE) - F.min(EPISODE) + 1).alias("_span"), F.min(EPISODE).alias("_lo"))
    numbers = numbers.join(F.broadcast(span)).select("source", EPISODE, "_n", (F.col("source") * F.col("_span") + F.col(EPISODE) - F.col("_lo")).alias("_key"))
    numbers = running(numbers, "_key", {"new_episode": None, "_from": "_n"}).drop("_key", "_n")
    named = rows.join(numbers, ["source", EPISODE]).withColumnRenamed(EPISODE, "old_episode").withColumnRenamed("new_episode", EPISODE)
    return named.withColumn("index", F.col("_from") + F.col(ORDER)).drop("_from")


def delete(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Without the listed episodes, renumbered."""
    return renumbered(frames.join(episodes.select(EPISODE), EPISODE, "left_anti"))


def fingerprints(frames: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of each episode's content: its length, the columns, and all values in the order of the frames.

    Frames are digested first, so that only digests gather for an episode.
    """
    parts = [F.coalesce(F.to_json(F.struct(c)), F.lit("null")) for c in columns]
    each = frames.select(EPISODE, ORDER, F.sha2(F.concat_ws("|", *parts), 256).alias("_d"))
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(ORDER, "_d"))), lambda s: s["_d"]))
    return each.groupBy(EPISODE).agg(F.sha2(F.concat(F.lit(",".join(columns) + ":"), F.count("*").cast("string"), F.lit(":"), joined), 256).alias("fingerprint"), F.count("*").alias("length"))


def subtract(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """The episodes of ``base`` whose content no episode of ``other`` has."""
    gone = fingerprints(other, columns).select("fingerprint").distinct()
    kept = fingerprints(base, columns).join(gone, "fingerprint", "left_anti").select(EPISODE)
    return base.join(kept, EPISODE, "left_semi")


def intersect_counts(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Episodes of ``a`` with and without their like in ``b``."""
    there = fingerprints(b, columns).select("fingerprint").distinct().withColumn("_in", F.lit(True))
    both = fingerprints(a, columns).join(there, "fingerprint", "left")
    return both.agg(F.count_if("_in").alias("matched"), F.count_if(F.col("_in").isNull()).alias("unmatched"))


def venn(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with a_only, b_only or both."""
    sides = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s")))
    return sides.groupBy(key).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).select(key, F.when(F.col("_lo") != F.col("_hi"), "both").when(F.col("_lo") == 1, "a_only").otherwise("b_only").alias("side"))


def chunks(episodes: DataFrame, size: int) -> DataFrame:
    """The dataset (chunk) and the place in it of each episode, ``size`` episodes a chunk."""
    return dense(episodes, EPISODE, "_r").withColumns({"chunk": F.floor(F.col("_r") / size), "place": F.col("_r") % size}).drop("_r")


def flag_algebra(flagged: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """manual = flagged - previous automatic ones; the new flags are manual and the next automatic ones."""
    manual = flagged.select(EPISODE).distinct().join(before.select(EPISODE), EPISODE, "left_anti")
    return manual.withColumn("manual", F.lit(True)).join(after.select(EPISODE).distinct().withColumn("auto", F.lit(True)), EPISODE, "full").select(EPISODE, F.coalesce("manual", F.lit(False)).alias("manual"), F.coalesce("auto", F.lit(False)).alias("auto"))


def overwrite_scanned(old: DataFrame, new: DataFrame, scanned: DataFrame, key: str = EPISODE) -> DataFrame:
    """Rows of scanned keys are replaced by the new ones (or go); others stay."""
    return old.join(scanned.select(key).distinct(), key, "left_anti").unionByName(new)


def fix_indices(frames: DataFrame, order: str = ORDER) -> DataFrame:
    """frame_index from 0 without gaps, timestamps from 0 where the first is off by over 1e-6, a fresh global index."""
    w = over(EPISODE, order)
    t0 = F.first("timestamp").over(w)
    fixed = frames.withColumns({"_f": (F.row_number().over(w) - 1).cast("long"), "timestamp": F.when(F.abs(t0) > 1e-6, F.col("timestamp") - t0).otherwise(F.col("timestamp"))})
    return global_index(fixed.drop(ORDER).withColumnRenamed("_f", ORDER))


def trim_first(frames: DataFrame, flagged: DataFrame) -> DataFrame:
    """Flagged episodes without their first frame, repaired."""
    marked = frames.join(flagged.select(EPISODE).distinct().withColumn("_cut", F.lit(True)), EPISODE, "left")
    return fix_indices(marked.filter(F.col("_cut").isNull() | (F.col(ORDER) > 0)).drop("_cut"))


def remap_tasks(rows: DataFrame, tasks: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Task texts are rewritten, equal ones become one (the least index), and rows follow; returns rows and tasks."""
    new = tasks.withColumn("task", text)
    new = new.withColumn("new_index", F.min("task_index").over(Window.partitionBy("task")))
    moved = rows.join(new.select("task_index", "new_index"), "task_index").withColumn("task_index", F.col("new_index")).drop("new_index")
    return moved, new.filter("task_index = new_index").select("task_index", "task")


def append_tasks(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that the dictionary lacks, numbered on from its largest index, in their own order."""
    fresh = texts.select("task").distinct().join(tasks, "task", "left_anti")
    top = tasks.agg(F.coalesce(F.max("task_index"), F.lit(-1)).alias("_top"))
    numbered = in_text_order(fresh, "task", "_r").join(F.broadcast(top))
    return tasks.select("task_index", "task").unionByName(numbered.select((F.col("_top") + 1 + F.col("_r")).cast("long").alias("task_index"), "task"))


def in_text_order(texts: DataFrame, column: str, out: str) -> DataFrame:
    """Numbers from 0 in the order of distinct texts: ranges of them are sorted each on its own and numbered on."""
    part = written(texts.select(column).repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    # one row for each range
    ranges = part.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = ranges.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return part.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").select(column, (F.col("_before") + inside).alias(out))


def compacted(rows: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks that no row has any more go, the others are numbered on from 0 in their order, and rows follow."""
    used = written(tasks.join(rows.select("task_index").distinct(), "task_index", "left_semi"))
    new = running(used, "task_index", {"_new": None})
    moved = rows.join(new.select("task_index", "_new"), "task_index").withColumn("task_index", F.col("_new")).drop("_new")
    return moved, new.select(F.col("_new").alias("task_index"), "task")


def overlay(original: DataFrame, reviewed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Reviewed values over original ones, field by field."""
    r = reviewed.select(F.col(key), *(F.col(f).alias(f"_r_{f}") for f in fields), F.lit(True).alias("_r"))
    return original.join(r, key, "full").select(key, *(F.coalesce(f"_r_{f}", f).alias(f) for f in fields), F.coalesce("_r", F.lit(False)).alias("reviewed"))


def remapped(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Cached rows (source, episode_index, frame_index, ...) under the numbers of a merge: episodes holds source, old_episode, episode_index and from_index."""
    new = episodes.select("source", F.col("old_episode").alias(EPISODE), F.col(EPISODE).alias("_new"), F.col("from_index").alias("_from"))
    out = rows.join(new, ["source", EPISODE])
    return out.withColumns({"index": F.col("_from") + F.col(ORDER), EPISODE: F.col("_new")}).drop("_new", "_from")
