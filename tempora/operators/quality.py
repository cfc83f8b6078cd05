"""Detectors of faulty episodes and repairs of their signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import EPISODE, ORDER, early_frames, over, transitions, whole

GRIPPER, STUCK_RATIO, STUCK_ACTION, STUCK_DELTA = 0.5, 0.6, 0.1, 0.1


def issues(found: DataFrame, kind: str, reason: Column) -> DataFrame:
    """episode_index, type, reason, frames."""
    return found.groupBy(EPISODE).agg(F.sort_array(F.collect_set(ORDER)).alias("frames")).select(EPISODE, F.lit(kind).alias("type"), reason.alias("reason"), "frames")


def contiguous(frames: DataFrame, start: int = 0) -> DataFrame:
    """episode_index, frames and contiguous: whether the numbers of an episode's frames are start, start + 1, ..., each once.

    Each number is compared with its place in their order, so no state holds the numbers.
    """
    place = F.row_number().over(over(EPISODE, ORDER)) - 1 + start
    each = frames.select(EPISODE, F.coalesce(F.col(ORDER) == place, F.lit(False)).alias("_ok"))
    return each.groupBy(EPISODE).agg(F.count("*").alias("frames"), F.bool_and("_ok").alias("contiguous"))


def early_transition(frames: DataFrame, signal: str, threshold: float = GRIPPER, seconds: float = 0.3) -> DataFrame:
    """Q02: the signal crosses its threshold within the first moments of an episode."""
    early = transitions(frames, signal, threshold).join(early_frames(frames, seconds), EPISODE).filter(F.col(ORDER) < F.col("early"))
    return issues(early, "early_transition", F.lit("signal changes within the first frames"))


def stuck_closed(frames: DataFrame, state: str, action: str, threshold: float = GRIPPER, ratio: float = STUCK_RATIO, action_max: float = STUCK_ACTION, delta_max: float = STUCK_DELTA) -> DataFrame:
    """Q03: the state is mostly closed while the action neither rises nor moves."""
    good = F.col(state).isNotNull() & F.col(action).isNotNull() & ~F.isnan(state) & ~F.isnan(action)
    moved = frames.filter(good).withColumn("_d", F.abs(F.col(action) - F.lag(action).over(over())))
    each = moved.groupBy(EPISODE).agg(F.avg((F.col(state) > threshold).cast("double")).alias("closed_ratio"), F.max(F.abs(action)).alias("max_action"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("max_delta"), F.percentile(state, F.lit(0.5)).alias("median_state"))
    return each.filter((F.col("closed_ratio") >= ratio) & (F.col("max_action") <= action_max) & (F.col("max_delta") <= delta_max))


def unmatched_transitions(frames: DataFrame, state: str, action: str, before: int, after: int, threshold_state: float = GRIPPER, threshold_action: float = GRIPPER) -> DataFrame:
    """Crossings of the state with no crossing of the action from ``before`` frames earlier to ``after`` later: rolling windows, no range join."""
    w = over()
    flip = lambda c, t: F.coalesce((F.col(c) > t) != F.lag(F.col(c) > t).over(w), F.lit(False))
    marked = frames.withColumns({"_s": flip(state, threshold_state), "_a": flip(action, threshold_action)})
    near = F.max("_a").over(w.rowsBetween(-before, after))
    return marked.withColumn("_near", near).filter(F.col("_s") & ~F.col("_near")).drop("_s", "_a", "_near")


def zero_resets(runs: DataFrame, dim: str = "dim", events: int = 6, together: int = 4, joints: int = 3, joint_events: int = 4) -> DataFrame:
    """Q05: many short drops to zero: in all, at one frame, or over several joints. ``runs``: episode, dim, first."""
    at = runs.groupBy(EPISODE, "first").agg(F.countDistinct(dim).alias("sync"))
    each = runs.groupBy(EPISODE).agg(F.count("*").alias("events"), F.countDistinct(dim).alias("joints")).join(at.groupBy(EPISODE).agg(F.max("sync").alias("most_at_once")), EPISODE)
    return each.filter((F.col("events") >= events) | (F.col("most_at_once") >= together) | ((F.col("joints") >= joints) & (F.col("events") >= joint_events)))


def missing_states(frames: DataFrame, state: str) -> DataFrame:
    """Q06: episodes without any state, or with one only."""
    n = frames.groupBy(EPISODE).agg(F.countDistinct(state).alias("n"))
    return n.filter("n < 2").select(EPISODE, F.when(F.col("n") == 0, "missing_state").otherwise("unsegmented_state").alias("type"))


def prompt_issues(episodes: DataFrame, prompts: str) -> DataFrame:
    """Q07, Q08: prompts of several sentences, and episodes with several prompts."""
    several = F.exists(prompts, lambda p: p.rlike("[,.]"))
    many = F.size(F.array_distinct(prompts)) > 1
    kinds = F.array_compact(F.array(F.when(several, F.lit("multi_sentence_prompt")), F.when(many, F.lit("multiple_task_assignments"))))
    return episodes.select(EPISODE, F.explode(kinds).alias("type"))


def missing_frames(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Q11."""
    return episodes.join(frames.select(EPISODE).distinct(), EPISODE, "left_anti")


def uncertainty(skip: Column, selected: Column, relation: Column, detections: Column, implicit: Column, kind: Column, confidence: Column, gap: Column) -> Column:
    """Q13: how much a label needs review, -1 to 100; kind is 'implicit', 'self' or 'detector'."""
    own = F.when(confidence < 0.45, 85).when(confidence < 0.65, 70).when(gap < 0.10, 60).otherwise(30)
    machine = F.when(confidence < 0.25, 80).when(confidence < 0.30, 70).when(gap < 0.03, 65).when(gap < 0.05, 55).otherwise(10)
    scale = F.when(implicit | (kind == "implicit"), 30).when(kind == "self", own).otherwise(machine)
    return F.when(skip, -1).when(~selected, 100).when(~relation, 90).when(detections == 0, 95).otherwise(scale)


def fill_stuck(frames: DataFrame, action: str, at: int, closed: float, stuck: DataFrame) -> DataFrame:
    """The gripper's action of stuck episodes takes the closed value."""
    marked = frames.join(stuck.select(EPISODE).distinct().withColumn("_fix", F.lit(True)), EPISODE, "left")
    filled = F.transform(action, lambda x, i: F.when(i == at, F.lit(closed)).otherwise(x))
    return marked.withColumn(action, F.when(F.col("_fix"), filled).otherwise(F.col(action))).drop("_fix")


def backfill(frames: DataFrame, action: str, state: str, lead: int, open_value: float = 0.0, closed_value: float = 1.0, threshold: float = GRIPPER) -> DataFrame:
    """The action follows the state's crossings, ``lead`` frames early; before that, for ``lead`` frames, the former side.

    Crossings write in their order, so the last one that covers a frame counts: a window over the frames that the next
    2 * lead bring, then the last crossing so far.
    """
    w = over()
    crossing = F.coalesce((F.col(state) > threshold) != F.lag(F.col(state) > threshold).over(w), F.lit(False))
    value = lambda high: F.when(high, F.lit(closed_value)).otherwise(F.lit(open_value))
    event = F.when(crossing, F.struct(F.col(ORDER).alias("f"), (F.col(state) > threshold).alias("high")))
    marked = frames.withColumn("_e", event)
    # crossings whose overwritten stretch has begun: those up to lead frames ahead; the last of them holds, but one that
    # is lead to 2 * lead ahead writes the former side over it
    begun = F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, lead))
    coming = F.last("_e", ignorenulls=True).over(w.rowsBetween(lead + 1, 2 * lead))
    marked = marked.withColumns({"_b": begun, "_c": coming})
    new = F.when(F.col("_c").isNotNull(), value(~F.col("_c.high"))).when(F.col("_b").isNotNull(), value(F.col("_b.high"))).otherwise(F.col(action))
    return marked.withColumn(action, new).drop("_e", "_b", "_c")


def rescale_gripper(frames: DataFrame, column: str, limit: float = 1.5, factor: float = 100.0) -> DataFrame:
    """An episode whose values exceed the limit is in percent."""
    top = F.max(F.abs(column)).over(whole(over()))
    return frames.withColumn(column, F.when(top > limit, F.col(column) / factor).otherwise(F.col(column)))


def scan(frames: DataFrame, action: str, state: str, threshold: float = GRIPPER, seconds: float = 0.3, lead: int = 3, lag: int = 1, stuck: dict | None = None, runs: DataFrame | None = None, stage: str | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """Q01: episode_index and reason of every detector that finds something: Q02 on action and state, Q03, Q04, Q05 on ``runs`` (see zero_resets), Q06 on ``stage``, Q07 and Q08 on ``prompts`` (episode_index, prompts)."""
    said = lambda rows, reason: rows.select(EPISODE, F.lit(reason).alias("reason"))
    found = [said(early_transition(frames, c, threshold, seconds), "early_gripper_transition") for c in (action, state)]
    found.append(said(stuck_closed(frames, state, action, threshold, **(stuck or {})), "stuck_closed_gripper_no_action"))
    found.append(said(unmatched_transitions(frames, state, action, lead, lag, threshold, threshold), "state_gripper_transition_without_action"))
    if runs is not None:
        found.append(said(zero_resets(runs), "joint_zero_reset_spike"))
    if stage is not None:
        found.append(missing_states(frames, stage).select(EPISODE, F.col("type").alias("reason")))
    if prompts is not None:
        found.append(prompt_issues(prompts, "prompts").select(EPISODE, F.col("type").alias("reason")))
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    return every.distinct()
