"""Segmentation of manipulation episodes into stages.

The rules look for one frame after the other: changes of the grippers, the first motion, the last one. Each search is a
window over the frames or an aggregate with a condition, and what follows from the frames found is arithmetic on one row
for each episode. Frames meet the rows of their episodes again where a search depends on an earlier one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stage_text
from ..functions.vector import near_pose
from .temporal import EPISODE, ORDER, over, whole
from .written import written

#: Fixed values of the rules: columns of the grippers and of the body; least frames of a stage; thresholds of motion.
GRIPPERS, BODY, CLAMP = (7, 15), (16, 17, 18), 10
MOVING, STILL, CLOSED, OPENED, LIFTED = 0.1, 0.06, 0.5, 0.1, -0.4
#: Seconds around a gripper's change, by version of the hardware; after the start pose and after a gripper has opened.
MARGIN = {"DVT1": 0.6, "DVT2": 0.2}
POSE_DELAY, OPEN_DELAY = 0.2, 0.1
#: The second version ends a stage once the arm has rested for so long, within this range.
REST, REST_PLACE, RESTING = 0.4, 0.2, 0.08
#: Its start pose in degrees, for the joints of each arm from this column on; tolerances in degrees.
POSES = {0: (-20.7723, 50.0851, -16.0979, -46.6055, -62.3497, 49.7502, -3.2868), 8: (-20.7723, -50.0851, 16.0979, -46.6055, 62.3497, 49.7502, 3.2868)}
POSE_RMS, POSE_MOST = 1.0, 3.0


@dataclass
class Signals:
    """How frames hold their signals: vectors of a known width, the task's text, the rate and the version of the hardware."""

    fps: float
    action_width: int
    state_width: int = 0
    version: str = "DVT1"
    margin: float | None = None
    action: str = "action"
    state: str = "state"
    task: str = "task"

    def frames(self, seconds: float) -> int:
        """Seconds as frames, one at least."""
        return max(1, round(self.fps * seconds))


def _number(vector: str, at: int) -> Column:
    """A component; null where it is missing or no number."""
    x = F.get(vector, F.lit(at)).cast("double")
    return F.when(~F.isnan(x), x)


def _percent(x: Column, signals: Signals) -> Column:
    """A gripper of the second version that goes up to 100 in its episode, as a share."""
    if signals.version != "DVT2":
        return x
    top = F.max(F.when(F.abs(x) < math.inf, F.abs(x))).over(Window.partitionBy(EPISODE))
    return F.when(top > 1.5, x / 100.0).otherwise(x)


def _told(frames: DataFrame, signals: Signals) -> DataFrame:
    """The signals that the rules need, for each frame: grippers, range of motion, start pose, lifted arm."""
    s, w = signals, over()
    out = {"_t": F.col("timestamp").cast("double"), "_n": F.count(F.lit(1)).over(whole(w)), "_said": F.coalesce(F.first(s.task).over(whole(w)), F.lit(""))}
    for g in GRIPPERS:
        if g < s.action_width:
            out[f"_a{g}"] = _percent(_number(s.action, g), s)
        if g < s.state_width:
            out[f"_s{g}"] = _percent(_number(s.state, g), s)
    width = max(round(s.fps), 2)
    near = w.rowsBetween(-(width // 2), (width - 1) // 2)
    ranges = [F.max(x).over(near) - F.min(x).over(near) for x in (_number(s.action, k) for k in range(s.action_width) if k not in (*GRIPPERS, *BODY))]
    # a window without any number in one column has no range at all
    known = F.lit(True)
    for r in ranges:
        known = known & r.isNotNull()
    out["_range"] = F.when(known, F.greatest(*ranges, F.lit(0.0))) if ranges else F.lit(None).cast("double")
    lifted = [F.coalesce(_number(s.state, k) > LIFTED, F.lit(False)) for k in (1, 9) if k < s.state_width]
    out["_lifted"] = (lifted[0] if len(lifted) == 1 else lifted[0] | lifted[1]) if lifted else F.lit(not s.state_width)
    pose = F.lit(False)
    if s.version == "DVT2":
        for at, degrees in POSES.items():
            if s.state_width >= at + len(degrees):
                own = F.slice(F.col(s.state), at + 1, len(degrees)).cast("array<double>")
                fits = (F.size(own) == len(degrees)) & ~F.exists(own, lambda x: x.isNull() | F.isnan(x))
                target = F.array(*(F.lit(math.radians(d)) for d in degrees))
                pose = pose | F.coalesce(fits & near_pose(own, target, math.radians(POSE_RMS), math.radians(POSE_MOST)), F.lit(False))
    out["_pose"] = pose
    return frames.select(EPISODE, ORDER, *(c.alias(n) for n, c in out.items()))


def gripper_changes(told: DataFrame, signals: Signals) -> DataFrame:
    """Each change of a gripper's action: gripper, frame, the frame at which its state follows (or the same), times of both, and what G02 asks of the gripper."""
    w, back, found = over(), Window.partitionBy(EPISODE).orderBy(F.desc(ORDER)), []
    for g in GRIPPERS:
        if g >= signals.action_width:
            continue
        source = F.col(f"_s{g}" if g < signals.state_width else f"_a{g}")
        high = lambda x: F.coalesce(x > CLOSED, F.lit(False))
        flips = lambda x: F.coalesce(high(x) != F.lag(high(x)).over(w), F.lit(False))
        here = F.struct(F.col(ORDER).alias("f"), F.col("_t").alias("t"), F.col("_v").alias("v"))
        finite = F.when(F.abs("_v") < math.inf, F.struct(ORDER, F.col("_v").alias("v")))
        rows = told.select(EPISODE, ORDER, "_t", source.alias("_v"), flips(F.col(f"_a{g}")).alias("_flip"), (flips(source) if g < signals.state_width else F.lit(False)).alias("_follows"))
        # the next change of the state is the last one so far when frames are walked through from the end
        rows = rows.withColumn("_next", F.coalesce(F.last(F.when(F.col("_follows"), here), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)), here))
        rows = rows.withColumns({"_head": F.min(finite).over(Window.partitionBy(EPISODE)), "_tail": F.max(finite).over(Window.partitionBy(EPISODE))})
        found.append(rows.filter("_flip").select(
            EPISODE, F.lit(g).alias("gripper"), F.col(ORDER).alias("frame"), F.col("_t").alias("at"), F.col("_next.f").alias("state_frame"), F.col("_next.t").alias("state_at"),
            F.coalesce(F.col("_head.v") > CLOSED, F.lit(False)).alias("begins_closed"), F.coalesce(F.col("_tail.v") <= CLOSED, F.lit(False)).alias("ends_open"), F.coalesce(F.col("_next.v") <= CLOSED, F.lit(False)).alias("open_then"),
        ))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _has(words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.col("_task"), F.lit(word))
    return found


def _chosen(told: DataFrame, signals: Signals) -> DataFrame:
    """One row for each episode: the changes that count as grasp and release, what kind of task it is, and what is wrong."""
    episodes = told.groupBy(EPISODE).agg(F.first("_n").cast("int").alias("n"), F.first("_said").alias("_said")).withColumn("_task", F.lower("_said"))
    episodes = episodes.select(EPISODE, "n", "_said", _has(("pick",)).alias("pick"), _has(("place", "put")).alias("place"), _has(("give", "hand")).alias("give"))
    if not any(g < signals.action_width for g in GRIPPERS):
        none = F.lit(None)
        changed = episodes.select(EPISODE, F.lit(0).cast("long").alias("changes"), none.cast("array<long>").alias("frames"), none.cast("int").alias("opens"), none.cast("boolean").alias("opening"), *(none.cast("double").alias(c) for c in ("g_at", "g_state", "r_at", "r_state")))
    else:
        order = Window.partitionBy(EPISODE).orderBy(F.desc("gripper"), F.desc("frame"))
        first = F.row_number().over(Window.partitionBy(EPISODE, "gripper").orderBy("frame")) == 1
        rows = gripper_changes(told, signals).withColumns({"_last": F.row_number().over(order), "_first": first})
        pick = lambda k, c: F.max(F.when(F.col("_last") == k, F.col(c)))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("gripper", "frame"))), lambda x: x["frame"])
        changed = rows.groupBy(EPISODE).agg(
            F.count("*").alias("changes"), listed.alias("frames"), F.count_if(F.col("_first") & F.col("begins_closed") & F.col("open_then")).cast("int").alias("opens"), F.max(F.col("begins_closed") & F.col("ends_open")).alias("opening"),
            pick(2, "at").alias("g_at"), pick(2, "state_at").alias("g_state"), pick(1, "at").alias("r_at"), pick(1, "state_at").alias("r_state"),
        )
    out = episodes.join(changed, EPISODE, "left").fillna(0, ["changes", "opens"])
    direct = F.col("give") & (F.col("changes") == 1) & F.coalesce("opening", F.lit(False))
    wrong = (
        F.when(F.col("n") < 5 * CLAMP, F.concat(F.lit("too few frames ("), F.col("n").cast("string"), F.lit(") for 5 stages")))
        .when(F.col("changes") == 0, F.when(F.col("pick"), F.concat(F.lit("no gripper transition found (task: '"), F.col("_said"), F.lit("')"))).otherwise("no gripper transition found"))
        .when(F.col("give") & (F.col("changes") < 2) & ~direct, F.concat(F.lit("give task needs >=2 gripper transitions or one closed-to-open direct-give transition, found "), F.col("changes").cast("string")))
        .when(F.lit(all(k in (*GRIPPERS, *BODY) for k in range(signals.action_width))), "no arm action columns found")
    )
    out = out.withColumns({"error": wrong, "direct": direct})
    # without a hand-over, the last change is the grasp; with a direct one, there is no grasp
    one = F.when(F.col("direct"), None)
    return out.withColumns({
        "g_at": one.when(F.col("give"), F.col("g_at")).otherwise(F.col("r_at")), "g_state": one.when(F.col("give"), F.col("g_state")).otherwise(F.col("r_state")),
        "expected": F.when(F.col("give"), 2).otherwise(1) + F.col("opens"),
    })


def _around(lo: str, hi: str, least: Column) -> tuple[Column, Column]:
    """At least CLAMP frames from lo to hi, inside the episode and not before ``least``."""
    n, middle = F.col("n"), F.floor((F.col(lo) + F.col(hi)) / 2)
    start = F.greatest(least, middle - CLAMP // 2)
    beyond = start + CLAMP > n
    short = F.col(hi) - F.col(lo) < CLAMP
    from_ = F.when(~short, F.col(lo)).when(beyond, F.greatest(least, n - CLAMP)).otherwise(start)
    return from_.cast("int"), F.when(~short, F.col(hi)).otherwise(F.least(n, start + CLAMP)).cast("int")


def boundaries(frames: DataFrame, signals: Signals) -> DataFrame:
    """For each episode is_give, direct_give, the ends and starts of its stages in seconds, error, and the issues found.

    Columns: episode_index, is_give, direct_give, stage0_end, stage2_start, stage2_end, stage4_start, stage4_end (null where
    a stage is not there), error (null if there are boundaries), changes (frames of the gripper changes, if more than expected),
    issue (the words for these). Frames of an episode are numbered from 0 and their times ascend. A null task is empty.
    """
    s = signals
    margin = MARGIN[s.version] if s.margin is None else s.margin
    # a few numbers of each frame, read by every search below
    told = written(_told(frames, s))
    ep = written(_chosen(told, s))
    # windows around grasp and release, by counting the frames before and up to their times
    seen = told.select(EPISODE, "_t").join(ep.filter("error is null").select(EPISODE, "g_at", "g_state", "r_at", "r_state"), EPISODE)
    before = lambda c: F.count_if(F.col("_t") < F.col(c) - margin).cast("int")
    upto = lambda c: F.count_if(F.col("_t") <= F.col(c) + margin).cast("int")
    counted = seen.groupBy(EPISODE).agg(before("g_at").alias("b2"), upto("g_state").alias("b3"), before("r_at").alias("b5"), upto("r_state").alias("b6"))
    ep = ep.join(counted, EPISODE, "left")
    b2, b3 = _around("b2", "b3", F.lit(0))
    ep = ep.withColumns({"b2": F.when(~F.col("direct"), b2), "b3": F.when(~F.col("direct"), b3)})
    least = F.when(F.col("direct"), F.lit(CLAMP)).otherwise(F.col("b3") + CLAMP)
    ep = ep.withColumn("b5", F.greatest(least, "b5"))
    b5, b6 = _around("b5", "b6", least)
    ep = ep.withColumns({"b5": F.when(F.col("give"), b5), "b6": F.when(F.col("give"), b6)})
    ep = written(ep.withColumn("upper", F.when(F.col("direct"), F.col("b5")).otherwise(F.col("b2"))))
    # what the frames show, given those
    rest = {False: s.frames(REST), True: s.frames(REST_PLACE)}
    marks = told.join(ep.filter("error is null").select(EPISODE, "upper", "b3", "place"), EPISODE)
    ahead = {p: over().rowsBetween(0, k - 1) for p, k in rest.items()}
    resting = lambda p: (F.max("_range").over(ahead[p]) <= RESTING) & (F.col(ORDER) <= F.col("_n") - rest[p])
    marks = marks.withColumn("_resting", F.when(F.col("place"), resting(True)).otherwise(resting(False)))
    early = F.col(ORDER) < F.col("upper")
    shut = {}
    for g in GRIPPERS:
        if g < s.state_width:
            finite = early & (F.abs(f"_s{g}") < math.inf)
            begins = F.first(F.when(finite, F.col(f"_s{g}")), ignorenulls=True).over(over().rowsBetween(Window.unboundedPreceding, 0))
            marks = marks.withColumn(f"_shut{g}", begins > CLOSED)
            shut[f"open{g}"] = F.min(F.when(F.col(f"_shut{g}") & finite & (F.col(f"_s{g}") <= OPENED), F.col(ORDER)))
    first = lambda c: F.min(F.when(c, F.col(ORDER))).cast("int")
    found = marks.groupBy(EPISODE).agg(
        first((F.col("_range") >= MOVING) & F.col("_lifted")).alias("moves"), first(F.col("_pose") & early).alias("posed"),
        F.max(F.when(F.col("_range") >= STILL, F.col(ORDER))).cast("int").alias("still"), first(F.col("_resting") & (F.col(ORDER) >= F.col("b3"))).alias("rests"), *(c.cast("int").alias(k) for k, c in shut.items()),
    )
    ep = ep.join(found, EPISODE, "left")
    opened = F.greatest(*(F.col(k) for k in shut), F.lit(None)) if shut else F.lit(None).cast("int")
    opened = F.when(F.col("pick") | F.col("give"), opened)
    posed = F.col("posed").isNotNull()
    start = F.when(posed, F.least(F.col("posed") + s.frames(POSE_DELAY), F.col("upper") - 1)).otherwise(F.coalesce("moves", "upper"))
    start = F.greatest(start, opened + s.frames(OPEN_DELAY))
    high = F.col("upper") - F.when(posed, 1).otherwise(CLAMP)
    b1 = F.when(high >= CLAMP, F.greatest(F.lit(CLAMP), F.least(high, start))).otherwise(F.greatest(F.lit(1), F.floor(F.col("upper") / 2)))
    least1 = max(round(2 * s.fps), CLAMP)
    ep = ep.withColumn("b1", b1.cast("int"))
    ep = ep.withColumn("b1", F.when(~F.col("direct") & ~posed & (F.col("b2") - F.col("b1") < least1), F.greatest(F.lit(CLAMP), F.col("b2") - least1)).otherwise(F.col("b1")))
    rests = F.when(F.lit(s.version == "DVT2") & ~F.col("give"), F.col("rests"))
    end = F.coalesce(rests, F.col("still") + 1, F.col("b3"), F.col("b5"))
    low, top = F.col("b3") + (0 if s.version == "DVT2" else CLAMP), F.col("n") - CLAMP
    b4 = F.when(low <= top, F.greatest(low, F.least(top, end))).otherwise(F.floor((F.col("b3") + F.col("n")) / 2)).cast("int")
    ep = ep.withColumn("b4", F.when(F.col("give"), F.col("b5")).otherwise(b4))
    # the times of the frames found
    places = {"stage0_end": F.col("b1"), "stage2_start": F.col("b2"), "stage2_end": F.col("b3") - 1, "stage4_start": F.col("b4"), "stage4_end": F.col("b6") - 1}
    ep = written(ep)
    at = ep.select(EPISODE, *(F.when(c.isNotNull(), F.least(c, F.col("n") - 1)).alias(k) for k, c in places.items()))
    timed = told.select(EPISODE, ORDER, "_t").join(at, EPISODE).groupBy(EPISODE).agg(*(F.max(F.when(F.col(ORDER) == F.col(k), F.col("_t"))).alias(k) for k in places))
    many = (F.col("changes") > F.col("expected")) & (F.col("error").isNull() | (F.col("error") == "no arm action columns found"))
    listed = F.concat(F.lit("["), F.array_join("frames", ", "), F.lit("]"))
    told_many = F.when(F.col("give"), F.concat(F.col("changes").cast("string"), F.lit(" gripper transitions at frames "), listed, F.lit(", expected "), F.col("expected").cast("string"), F.lit(" for give; using second-to-last for grasp, last for release")))
    told_many = told_many.otherwise(F.concat(F.col("changes").cast("string"), F.lit(" gripper transitions at frames "), listed, F.lit(", using LAST")))
    good = F.col("error").isNull()
    out = ep.select(EPISODE, (good & F.col("give")).alias("is_give"), (good & F.col("direct")).alias("direct_give"), "error", F.when(many, F.col("frames")).alias("changes"), F.when(many, told_many).alias("issue"))
    return out.join(timed, EPISODE, "left").select(EPISODE, "is_give", "direct_give", *(F.when(F.col("error").isNull(), F.col(k)).alias(k) for k in places), "error", "changes", "issue")


def boundary_issues(bounds: DataFrame) -> DataFrame:
    """episode_index, type (error or multi_gripper), reason, frames of what ``boundaries`` has found to be wrong."""
    error = F.struct(F.lit("error").alias("type"), F.col("error").alias("reason"), F.lit(None).cast("array<bigint>").alias("frames"))
    many = F.struct(F.lit("multi_gripper").alias("type"), F.col("issue").alias("reason"), F.col("changes").cast("array<bigint>").alias("frames"))
    each = F.array_compact(F.array(F.when(F.col("issue").isNotNull(), many), F.when(F.col("error").isNotNull(), error)))
    return bounds.select(EPISODE, F.explode(each).alias("_x")).select(EPISODE, "_x.*")


def assigned(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """The stage of each frame by the boundaries of its episode; 0 throughout where there are none."""
    t = F.col("timestamp")
    after = F.when(t < F.col("stage4_start"), 3).when(~F.col("is_give") | (t <= F.col("stage4_end")), 4).otherwise(5)
    stage = F.when(F.col("stage0_end").isNull() | (t < F.col("stage0_end")), 0).when(F.col("direct_give"), after).when(t < F.col("stage2_start"), 1).when(t <= F.col("stage2_end"), 2).otherwise(after)
    rows = frames.join(bounds.select(EPISODE, "is_give", "direct_give", "stage0_end", "stage2_start", "stage2_end", "stage4_start", "stage4_end"), EPISODE, "left")
    return rows.withColumn("stage", stage).drop("is_give", "direct_give", "stage0_end", "stage2_start", "stage2_end", "stage4_start", "stage4_end")


def as_transitions(bounds: DataFrame) -> DataFrame:
    """Boundaries as rows of (timestamp, state) for step functions; after stage 0 a direct hand-over is in stage 3."""
    after = F.when(F.col("direct_give"), 3).otherwise(1)
    pairs = F.array(*(F.struct(F.col(c).alias("time"), k.alias("state")) for k, c in ((after, "stage0_end"), (F.lit(2), "stage2_start"), (F.lit(3), "stage2_end"), (F.lit(4), "stage4_start"), (F.lit(5), "stage4_end"))))
    return bounds.select(EPISODE, F.explode(F.filter(pairs, lambda p: p["time"].isNotNull())).alias("x")).select(EPISODE, F.col("x.time").alias("timestamp"), "x.state")


def decode_stage(value: Column, most: int) -> Column:
    """A stage from a value between 0 and 1."""
    return F.when(value.between(0, 1), F.bround(value * most).cast("int"))


def initial_opens(frames: DataFrame, changes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How many grippers of each episode begin closed and are open where their first change has come through.

    frames: episode_index, frame_index, gripper, value (the state, or the action where there is none); changes:
    episode_index, gripper, action_frame, state_frame. Episodes without such a gripper count 0.
    """
    first = changes.groupBy(EPISODE, "gripper").agg(F.min_by(F.greatest("action_frame", "state_frame", F.lit(0)), "action_frame").alias("_at"))
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    marked = frames.join(first, [EPISODE, "gripper"])
    end = F.least(F.col("_at"), F.col("_last"))
    held = marked.withColumn("_last", F.max("frame_index").over(Window.partitionBy(EPISODE, "gripper")))
    each = held.groupBy(EPISODE, "gripper").agg(F.min_by(F.when(finite, F.col("value")), F.when(finite, F.col("frame_index"))).alias("_first"), F.max(F.when(finite & (F.col("frame_index") == end), F.col("value"))).alias("_then"))
    opened = F.coalesce((F.col("_first") > threshold) & (F.col("_then") <= threshold), F.lit(False))
    return each.groupBy(EPISODE).agg(F.count_if(opened).alias("initial_opens"))


def stage_values(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """What is written back: subtask_state of each frame of the episodes that have boundaries."""
    found = bounds.filter("error is null")
    return assigned(frames.join(found.select(EPISODE), EPISODE, "left_semi"), found).select(EPISODE, ORDER, F.col("stage").cast("int").alias("subtask_state"))


def stage_texts(frames: DataFrame, episodes: DataFrame, state: str = "subtask_state", exist: str | None = None) -> DataFrame:
    """subtask_state, -1 where the object is not there (``exist`` is 0), and the text of the stage of the episode's first task; frames without a state keep none."""
    task = F.coalesce(F.get("tasks", F.lit(0)), F.lit(""))
    rows = frames.join(episodes.select(EPISODE, task.alias("_task")), EPISODE, "left")
    at = F.col(state).cast("int")
    at = F.when(F.col(exist).cast("int") == 0, F.lit(-1)).otherwise(at) if exist else at
    rows = rows.select(EPISODE, ORDER, at.alias("subtask_state"), F.coalesce("_task", F.lit("")).alias("_task"))
    # the rule runs once for each task and state, not for each frame
    told = rows.select("_task", "subtask_state").distinct().filter("subtask_state is not null").withColumn("subtask", stage_text(F.col("_task"), F.col("subtask_state")))
    return rows.join(told, ["_task", "subtask_state"], "left").select(EPISODE, ORDER, "subtask_state", "subtask")
