"""Which episodes, frames, tasks and objects are meant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from .algebra import in_text_order
from .sidecar import unwrap
from .temporal import EPISODE, ORDER


def task_texts(spec: str | list[str] | None, tasks: DataFrame) -> DataFrame:
    """the task texts (column task) that the tokens of a list mean: the task of a number that the dictionary has, else the token itself."""
    tokens = x.task_tokens(spec) if isinstance(spec, str) else [t for t in (str(v).strip() for v in spec or ()) if t]
    given = tasks.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    known = tasks.select(F.col("task_index").cast("long").alias("_i"), "task")
    number = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("long"))
    return given.join(known, number == F.col("_i"), "left").select(F.coalesce("task", "token").alias("task")).distinct()


def selected_episodes(episodes: DataFrame, span: str | None, spec: str | list[str] | None, tasks: DataFrame) -> DataFrame:
    """episodes in the range START:END that have any of the tasks meant; without a range or tasks, all."""
    bounds = x.episode_range(span)
    rows = episodes.filter(F.col(EPISODE).between(bounds[0], bounds[1] - 1)) if bounds else episodes
    if not spec:
        return rows
    meant = rows.select(EPISODE, F.explode("tasks").alias("task")).join(task_texts(spec, tasks), "task", "left_semi").select(EPISODE)
    return rows.join(meant, EPISODE, "left_semi")


def first_episodes(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the n episodes with the least numbers."""
    least = rows.select(EPISODE).distinct().orderBy(EPISODE).limit(n)
    return rows.join(F.broadcast(least), EPISODE)  # n rows


def nearest_frames(frames: DataFrame, times: DataFrame) -> DataFrame:
    """episode_index, start_frame and end_frame: the frames nearest to start_s and end_s (the earlier of two; null: the end of the episode)."""
    rows = frames.join(times, EPISODE)
    near = lambda c: F.min_by(ORDER, F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("timestamp") - F.col(c)), F.col(ORDER))))
    found = rows.groupBy(EPISODE).agg(near("start_s").alias("_a"), near("end_s").alias("_b"), F.min(ORDER).alias("_lo"), F.max(ORDER).alias("_hi"))
    return found.select(EPISODE, F.coalesce("_a", "_lo").alias("start_frame"), F.coalesce("_b", "_hi").alias("end_frame"))


def trimmed(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """the frames from start_frame to end_frame of each episode of ``cuts``, numbered from 0 and with times from 0; other episodes stay as they are.

    Two aggregates for each episode and a join, no window: an episode of any length spreads over tasks.
    """
    marked = frames.join(cuts.select(EPISODE, "start_frame", "end_frame"), EPISODE, "left")
    kept = marked.filter(F.col("start_frame").isNull() | F.col(ORDER).between(F.col("start_frame"), F.col("end_frame")))
    first = kept.filter("start_frame is not null").groupBy(EPISODE).agg(F.min(ORDER).alias("_f"), F.min_by("timestamp", ORDER).alias("_t"))
    out = kept.drop("start_frame", "end_frame").join(first, EPISODE, "left")
    return out.withColumns({ORDER: F.col(ORDER) - F.coalesce("_f", F.lit(0)), "timestamp": F.when(F.col("_t").isNotNull(), F.col("timestamp") - F.col("_t")).otherwise(F.col("timestamp"))}).drop("_f", "_t")


def object_vocabulary(tasks: DataFrame) -> DataFrame:
    """Object, first_task and whether it is ever a target: targets and references of the tasks that have a known form, by their common names."""
    p = x.parse_prompt(F.col("task"))
    named = lambda c, is_target: F.struct(x.object_name(c).alias("object"), F.lit(is_target).alias("target"))
    both = tasks.select("task_index", F.explode(F.array(named(p["target"], True), named(p["reference"], False))).alias("o")).filter("o.object is not null")
    return both.groupBy("o.object").agg(F.min("task_index").alias("first_task"), F.max("o.target").alias("is_target"))


def with_task_index(frames: DataFrame, task: str = "task") -> tuple[DataFrame, DataFrame]:
    """Frames with the index of their task's text, wrappers of tensors taken off, and the dictionary: texts in their order, numbered from 0."""
    clean = frames.withColumn("_text", unwrap(F.col(task)))
    tasks = in_text_order(clean.select(F.col("_text").alias("task")).filter("task is not null").distinct(), "task", "task_index")
    return clean.join(tasks.withColumnRenamed("task", "_text"), "_text", "left").drop("_text"), tasks.select("task_index", "task")


def routed(parts: list[DataFrame]) -> DataFrame:
    """Datasets one after the other on the columns that all have, with dataset_index and the global row: the rows of the datasets before and the own index.

    parts hold ``index`` from 0 without gaps, as a dataset does.
    """
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    rows, before = None, 0
    for k, part in enumerate(parts):
        more = part.select(*common, F.lit(k).alias("dataset_index"), (F.col("index") + before).alias("row"))
        rows = more if rows is None else rows.unionByName(more)
        if k < len(parts) - 1:
            before += part.count()  # a number for each dataset
    return rows


def stage_shares(frames: DataFrame, stage: str = "stage") -> DataFrame:
    """The stage of each frame as a share of its episode's largest, which counts as 1 at least."""
    top = frames.groupBy(EPISODE).agg(F.greatest(F.max(stage), F.lit(1)).alias("_top"))
    return frames.join(top, EPISODE).withColumn(stage, F.col(stage) / F.col("_top")).drop("_top")
