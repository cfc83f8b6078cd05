"""Where an episode grasps: the source of its planar track, the event, the point, and what a viewer is told of the track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import forward_kinematics
from ..sources.catalogue import axis_of, busier_arm, xy_places
from .temporal import EPISODE, ORDER, SPAN, in_pieces, own

#: Fixed values of the two-armed robot: lengths of its links, offset of its arms, bounds of its workspace, least change of a gripper.
LINKS, BASE, BOUNDS, CHANGED = (0.24, 0.20, 0.16, 0.11), 0.32, (-1.1, 1.1, -0.85, 0.85), 1e-4
#: Columns that are looked at first for named components, and for arms; words that tell of an image (fixed values).
POSES = ("observation.ee_pose", "observation.eef_pose", "observation.tcp_pose", "ee_pose", "eef_pose", "tcp_pose", "observation.state", "state", "action")
ARMED = ("state", "observation.state", "action", "observation.action")
IMAGE = ("image", "pixel", "uv", "screen")


def source_of(columns: list[str], vectors: dict[str, tuple[int, list[str]]], robot_type: str = "") -> dict:
    """Where x and y come from, the best first: scalar columns that differ in the axis alone, named components of a vector, the arms.

    vectors: width and names of the components by column. kind is scalar, vector, arms or unavailable.
    """
    pairs: dict[str, dict[str, str]] = {}
    for c in columns:
        axis = axis_of(c)
        if axis in ("x", "y") and c not in vectors:
            low = c.lower()
            stem = low[:-2] if low[-2:] in (f"_{axis}", f".{axis}", f"/{axis}", f"-{axis}") else low
            pairs.setdefault(stem, {})[axis] = c
    shown = lambda text: "image" if any(w in text.lower() for w in IMAGE) else "xy"
    for found in pairs.values():
        if len(found) == 2:
            text = f"{found['x']},{found['y']}"
            return {"kind": "scalar", "x": found["x"], "y": found["y"], "source": text, "projection": shown(text)}
    for c in sorted(vectors, key=lambda c: POSES.index(c) if c in POSES else len(POSES)):
        width, names = vectors[c]
        places = xy_places(names)
        if places and max(places) < width:
            text = f"{c}[{names[places[0]]},{names[places[1]]}]"
            return {"kind": "vector", "column": c, "places": places, "source": text, "projection": shown(text)}
    armed = next((c for c in ARMED if c in vectors and vectors[c][0] >= 16), None)
    if armed and ("h10" in robot_type.lower() or vectors[armed][0] in (16, 17)):
        return {"kind": "arms", "column": armed, "source": f"planar kinematics of {armed}", "projection": "workspace"}
    return {"kind": "unavailable", "source": "", "projection": "unavailable"}


def _number(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def tracks(frames: DataFrame, source: dict) -> DataFrame:
    """episode_index, frame_index, x, y, grip and arm of each frame (grip and arm null without arms)."""
    none = (F.lit(None).cast("double").alias("grip"), F.lit(None).cast("string").alias("arm"))
    if source["kind"] == "scalar":
        return frames.select(EPISODE, ORDER, _number(F.col(f"`{source['x']}`")).alias("x"), _number(F.col(f"`{source['y']}`")).alias("y"), *none)
    vector = F.col(f"`{source['column']}`")
    at = lambda k: _number(F.get(vector, F.lit(k)))
    if source["kind"] == "vector":
        return frames.select(EPISODE, ORDER, at(source["places"][0]).alias("x"), at(source["places"][1]).alias("y"), *none)
    # a gripper counts twice
    score = lambda first: [*(at(first + k) for k in range(7)), 2 * at(first + 7)]
    arm = busier_arm(frames, score(0), score(8)).select(EPISODE, "arm")
    (lx, ly), (rx, ry) = (forward_kinematics([at(first + k) for k in range(4)], list(LINKS), base, mirror) for first, base, mirror in ((0, -BASE, True), (8, BASE, False)))
    left = F.col("arm") == "left"
    pick = lambda a, b: F.when(left, a).otherwise(b)
    return frames.join(arm, EPISODE).select(EPISODE, ORDER, pick(lx, rx).alias("x"), pick(ly, ry).alias("y"), pick(at(7), at(15)).alias("grip"), "arm")


def grasp_points(track: DataFrame, span: int = SPAN) -> DataFrame:
    """episode_index, arm, grasp_frame, x and y.

    The frame is that of the gripper's largest change if any is above CHANGED, else that of the track's largest step, else
    the first; of equal ones the first.
    """
    rows, w = in_pieces(track, 1, 0, span=span)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    moved = own(rows.withColumns({"_grip": F.abs(F.col("grip") - F.lag("grip").over(w)), "_step": step}))
    at = F.struct(F.col(ORDER).alias("f"), "x", "y")
    most = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.negative(ORDER).alias("_"), at.alias("at"))))
    each = moved.groupBy(EPISODE).agg(F.first("arm").alias("arm"), most("_grip").alias("g"), most("_step").alias("s"), F.min(at).alias("first"))
    best = F.when(F.col("g.v") > CHANGED, F.col("g.at")).when(F.col("s").isNotNull(), F.col("s.at")).otherwise(F.col("first"))
    return each.select(EPISODE, "arm", best.alias("_b")).select(EPISODE, "arm", F.col("_b.f").alias("grasp_frame"), F.col("_b.x").alias("x"), F.col("_b.y").alias("y"))


def details(track: DataFrame, grasps: DataFrame, most: int = 160) -> DataFrame:
    """Place, episode_index, frame_index, x, y and whether it is the grasp, of ``most`` evenly spaced points of each track (all of a shorter one); the grasp is the point nearest to its frame."""
    n = track.groupBy(EPISODE).agg(F.count("*").alias("_n"))
    step = (F.col("_n") - 1) / F.lit(max(1, most - 1))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.when(k == most - 1, F.col("_n") - 1).otherwise(F.floor(k * step)).cast("long"))
    wanted = F.when(F.col("_n") > most, spaced).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    picked = n.join(grasps.select(EPISODE, "grasp_frame"), EPISODE, "left").select(EPISODE, "grasp_frame", wanted.alias("_w"))
    near = F.array_min(F.transform("_w", lambda f: F.abs(f - F.col("grasp_frame"))))
    mark = F.array_position(F.transform("_w", lambda f: F.abs(f - F.col("grasp_frame")) == near), True) - 1
    rows = picked.select(EPISODE, mark.alias("_mark"), F.posexplode("_w").alias("place", ORDER))
    out = rows.join(track.select(EPISODE, ORDER, "x", "y"), [EPISODE, ORDER])
    return out.select(EPISODE, "place", ORDER, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.coalesce(F.col("place") == F.col("_mark"), F.lit(False)).alias("is_grasp"))
