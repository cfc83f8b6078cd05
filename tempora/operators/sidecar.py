"""Records kept beside the frames: labels, tags, flags, totals and candidates, joined to episodes by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .algebra import dense
from .temporal import EPISODE


def off_grid(delta: Column, fps: float, tolerance: float) -> Column:
    """whether a time step is further than the tolerance from a multiple of a frame's length (halves go to the even one)."""
    return F.abs(delta * fps - F.rint(delta * fps)) / fps > tolerance


def width_mismatches(df: DataFrame, feature: str, width: str) -> DataFrame:
    """rows whose width is not the commonest of their feature (ties: the smaller one); counts are small, rows stay where they are."""
    counts = df.groupBy(feature, width).agg(F.count("*").alias("n"))
    most = counts.groupBy(feature).agg(F.max_by(width, F.struct("n", (-F.col(width)).alias("_w"))).alias("majority"))
    return counts.join(most, feature).filter(F.col(width) != F.col("majority"))


def attach(episodes: DataFrame, records: DataFrame, name: str, key: str = EPISODE) -> DataFrame:
    """The record of each episode as a struct, null where there is none; records hold a key once."""
    packed = records.select(key, F.struct(*(c for c in records.columns if c != key)).alias(name))
    return episodes.join(packed, key, "left")


def tag_counts(rows: DataFrame, tags: DataFrame, tag: str, key: str = EPISODE) -> DataFrame:
    """Rows and episodes of each tag; rows without a tag count as ``untagged``. Rows are summed by episode before they meet the tags."""
    per = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return per.join(tags.select(key, tag), key, "left").groupBy(F.coalesce(tag, F.lit("untagged")).alias(tag)).agg(F.sum("_n").alias("rows"), F.count("*").alias("episodes"))


def movement(first: DataFrame, last: DataFrame) -> DataFrame:
    """Each detection of the first frame with the nearest one of the last frame, and how far it moved.

    Both sides hold episode_index, det, x, y; a frame has a handful of detections, so an episode's pairs are few.
    """
    there = last.select(EPISODE, F.col("det").alias("match"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    gap = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)
    return first.join(there, EPISODE).withColumn("moved", gap).groupBy(EPISODE, "det").agg(F.min_by("match", F.struct("moved", "match")).alias("match"), F.min("moved").alias("moved"))


def totals(stated: DataFrame, counted: DataFrame, key: str, total: str) -> DataFrame:
    """The stated total, or the number of rows where it is zero or missing."""
    n = counted.groupBy(key).agg(F.count("*").alias("_n"))
    return stated.join(n, key, "left").withColumn(total, F.coalesce(F.nullif(total, F.lit(0)), "_n", F.lit(0))).drop("_n")


def memberships(labels: DataFrame, scenarios: Column, missing: Column) -> DataFrame:
    """Candidates, and missing words, of each scenario; a label may belong to several, each counts once for it."""
    each = labels.select(F.explode(F.array_distinct(scenarios)).alias("scenario"), missing.alias("_missing"))
    return each.groupBy("scenario").agg(F.count("*").alias("candidates"), F.sum(F.size("_missing")).alias("missing"))


def reindexed(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """Records of the episodes that stay, under their new dense numbers."""
    numbers = dense(episodes.select(EPISODE).distinct(), EPISODE, "new_episode")
    return records.join(numbers, EPISODE).withColumn(EPISODE, F.col("new_episode")).drop("new_episode")


def cleared(flags: DataFrame) -> DataFrame:
    """Lists are emptied and ``*_count`` columns are zero; all else stays."""
    kinds = dict(flags.dtypes)
    empty = {c: F.array().cast(kinds[c]) for c in flags.columns if kinds[c].startswith("array")}
    zero = {c: F.lit(0).cast(kinds[c]) for c in flags.columns if c.endswith("_count")}
    return flags.withColumns(empty | zero)


def unwrap(text: Column) -> Column:
    """The words inside ``tf.Tensor(b'...', shape=(), dtype=string)``; other texts stay."""
    return F.regexp_replace(text, r"^tf\.Tensor\(b'(.*)', shape=\(\), dtype=string\)$", "$1")


def masked_mean(vectors: DataFrame, vector: str, keep: Column, *keys: str) -> DataFrame:
    """The mean, by dimension, of the vectors that a mask keeps."""
    return vectors.filter(keep).select(*keys, F.posexplode(vector).alias("dim", "_v")).groupBy(*keys, "dim").agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))


def label_issues(labels: DataFrame, match: Column, detections: Column) -> DataFrame:
    """Q09, Q10: labels whose action does not fit the prompt, and labels without a target."""
    kinds = F.array_compact(F.array(F.when(match == "mismatch", F.lit("prompt_action_mismatch")), F.when(detections == 0, F.lit("missing_target"))))
    return labels.select(EPISODE, F.explode(kinds).alias("type"))


def without_resolved(issues: DataFrame, resolved: DataFrame, reason: str) -> DataFrame:
    """Issues but those of one reason in the episodes that were repaired."""
    done = resolved.select(EPISODE).distinct().withColumn("reason", F.lit(reason))
    return issues.join(done, [EPISODE, "reason"], "left_anti")


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """rows that meet all stated conditions; those that are None do not count."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return rows
