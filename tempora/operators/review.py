"""Review of labels: which box is meant, how sure that is, and what candidates there are for new episodes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as x
from .algebra import append_tasks, overwrite_scanned
from .annotate import area, center
from .temporal import EPISODE, running
from .written import written

#: Motion in pixels from which a box counts as moved, and how far behind the largest motion it may lie (fixed values).
MOVED, BEHIND = 20.0, 5.0
#: Context of a label that tags give (fixed values).
CONTEXT = ("arm", "object_count", "background", "background_color", "prompt_action_match")


def _gap(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2)))


def selected_box(df: DataFrame) -> DataFrame:
    """Place (in ``targets``), satisfied and method of the box that a task means, for each row.

    targets, refs (null: no reference asked for), last: arrays of struct<box: struct<left, top, right, bottom>, confidence>
    (last: of the last frame); direction and arm: left, right or null. Without a direction, the box nearest to the arm's
    side among those that moved most, or the first (most confident) one; with one alone, the outermost; with a reference,
    the nearest to a reference of those on the right side of it. Rows hold a handful of boxes.
    """
    targets, refs, direction, arm = F.col("targets"), F.col("refs"), F.col("direction"), F.col("arm")
    at = F.transform(targets, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def motion(t: Column) -> Column:
        nearest = F.array_min(F.transform("last", lambda z, j: F.struct(_gap(t["box"], z["box"]).alias("d"), j.alias("j"), z["box"].alias("box"))))
        sides = F.sqrt(F.abs(F.greatest(area(t["box"]), F.lit(1.0)) - F.greatest(area(nearest["box"]), F.lit(1.0))))
        return F.when(F.size("last") > 0, nearest["d"] + 0.25 * sides).otherwise(0.0)

    moves = F.transform(at, lambda y: F.struct(y["t"].alias("t"), y["i"].alias("i"), motion(y["t"]).alias("m")))
    df = df.withColumn("_moves", moves).withColumn("_most", F.array_max(F.transform("_moves", lambda y: y["m"])))
    moved = F.col("_most") >= MOVED
    xc = lambda t: center(t["box"])[0]
    side = lambda y: F.struct(F.when(arm == "left", xc(y["t"])).otherwise(-xc(y["t"])).alias("x"), (-y["t"]["confidence"]).alias("c"), y["i"].alias("i"))
    by_arm = F.array_min(F.transform(F.filter("_moves", lambda y: ~moved | (y["m"] >= F.col("_most") - BEHIND)), side))["i"]
    outer = F.array_min(F.transform(at, lambda y: F.struct(F.when(direction == "left", xc(y["t"])).otherwise(-xc(y["t"])).alias("x"), y["i"].alias("i"))))["i"]
    on_side = lambda t, r: F.when(direction == "left", xc(t) < xc(r)).otherwise(xc(t) > xc(r))
    pairs = F.flatten(F.transform(at, lambda y: F.transform(F.filter(refs, lambda r: on_side(y["t"], r)), lambda r: F.struct(_gap(y["t"]["box"], r["box"]).alias("d"), y["i"].alias("i")))))
    related = F.array_min(pairs)["i"]
    armed = arm.isin("left", "right")
    none = F.size(targets) <= 0
    place = F.when(none, None).when(direction.isNull(), F.when(armed, by_arm).otherwise(0)).when(refs.isNull(), outer).otherwise(related)
    method = (
        F.when(none, "no_target_detections").when(direction.isNull() & armed, F.concat(F.when(moved, "last_frame_motion_then_").otherwise(""), arm, F.lit("_hand_nearest"))).when(direction.isNull(), "top_confidence")
        .when(refs.isNull(), F.concat(F.lit("absolute_"), direction)).when(related.isNull(), "no_candidate_on_correct_side").otherwise(F.concat(F.lit("relative_"), direction, F.lit("_of_reference")))
    )
    return df.withColumns({"place": place.cast("int"), "satisfied": place.isNotNull(), "method": method}).drop("_moves", "_most")


def uncertain(df: DataFrame) -> DataFrame:
    """Q13: ``uncertainty`` (-1 to 100) and ``why`` of each label; the steps and their limits are fixed values.

    Columns: skip (string), parsed (struct with direction and reference, null: not parsed), selected (boolean), satisfied
    (boolean, null: not asked), detections (array of struct<confidence, source, x>, x: the centre).
    """
    d, parsed = F.col("detections"), F.col("parsed")
    top, second, source = F.get(d, 0)["confidence"], F.get(d, 1)["confidence"], F.get(d, 0)["source"]
    gap, two = top - second, F.size(d) >= 2
    xs = F.transform(F.slice(d, 1, 3), lambda z: z["x"])
    close = parsed["direction"].isNotNull() & parsed["reference"].isNull() & (F.size(xs) >= 2) & (F.array_max(xs) - F.array_min(xs) < 30)
    unmet = F.col("satisfied").eqNullSafe(F.lit(False))
    own = F.when(top < 0.45, 85).when(top < 0.65, 70).when(two & (gap < 0.10), 60).otherwise(30)
    machine = F.when(top < 0.25, 80).when(top < 0.30, 70).when(two & (gap < 0.03), 65).when(two & (gap < 0.05), 55).when(close, 50).otherwise(10)
    skipped, none = F.col("skip").eqNullSafe(F.lit("exist_label_zero")), F.coalesce(F.size(d), F.lit(0)) <= 0
    score = F.when(skipped | parsed.isNull(), -1).when(~F.col("selected"), 100).when(unmet, 90).when(none, 95).when(source == "vlm_implicit", 30).when(source == "vlm_self_reported", own).otherwise(machine)
    two_digits = lambda text, value, end="": F.concat(F.lit(text), F.format_string("%.2f", value), F.lit(end))
    why_own = F.when(top < 0.65, two_digits("low vlm self-conf ", top)).when(two & (gap < 0.10), two_digits("close vlm self-conf (d=", gap, ")")).otherwise(two_digits("vlm self-conf ", top))
    why_machine = F.when(top < 0.30, two_digits("low conf ", top)).when(two & (gap < 0.05), two_digits("close top-2 (d=", gap, ")")).when(close, "absolute: x_centers close").otherwise("ok")
    why = (
        F.when(skipped, "exist_label=0").when(parsed.isNull(), "not Pick-up").when(~F.col("selected") & unmet, "no candidate on correct side").when(~F.col("selected"), "no detection")
        .when(unmet, "relation unsatisfied (fallback)").when(none, "no target candidates").when(source == "vlm_implicit", "vlm implicit conf").when(source == "vlm_self_reported", why_own).otherwise(why_machine)
    )
    return df.withColumns({"uncertainty": score, "why": why})


def context_warnings(tags: Column) -> Column:
    """Q14: what the tags that give context warn of."""
    context = F.map_filter(tags, lambda k, v: k.isin(*CONTEXT) & v.isNotNull() & (v != ""))
    return F.when(F.try_element_at(context, F.lit("prompt_action_match")) == "mismatch", F.array(F.lit("prompt_action_mismatch"))).otherwise(F.array().cast("array<string>"))


def reviewed(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Reviewed records with those of ``changes`` saved (its columns and ``keep``) or removed (keep: false)."""
    return overwrite_scanned(records, changes.filter("keep").drop("keep"), changes)


def first_box(records: DataFrame, source: str = "reviewed") -> DataFrame:
    """episode_index, box, confidence and source of the chosen detection of each record that has one."""
    return records.filter(F.col("selected").isNotNull()).select(EPISODE, F.col("selected.box").alias("box"), F.col("selected.confidence").alias("confidence"), F.lit(source).alias("source"))


def candidates(labels: DataFrame, vocabulary: list[str], threshold: int) -> DataFrame:
    """Labels that new episodes can be made from, with scenario, target, reference, direction, existing, missing, background and count_bucket.

    labels: episode_index, task, uncertainty, has_target, has_ref (whether anything was detected), tags (map). A target,
    and for relative tasks a reference, must have been detected, and the vocabulary must hold an object that is not there.
    """
    # labels are small and their prompts dear: written once over several tasks, else the few files' tasks parse them all
    labels = written(labels.repartition(EPISODE))
    p = x.parse_prompt(F.col("task"))
    low = lambda c: F.nullif(F.lower(x.stripped(c)), F.lit(""))
    scenario = x.one_of(p["kind"], {"give": "give", "single": "single_pick", "absolute": "directional_pick", "relative": "relative_pick"})
    out = labels.filter(F.col("uncertainty").between(0, threshold)).withColumns({"scenario": scenario, "target": low(p["target"]), "_reference": low(p["reference"]), "direction": p["direction"]})
    there = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(F.col("has_target"), F.col("target")), F.when(F.col("has_ref"), F.col("_reference"))))))
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    out = out.withColumns({
        "existing": there, "missing": F.array_except(F.array(*(F.lit(v) for v in sorted(set(vocabulary)))).cast("array<string>"), there),
        "reference": F.when(F.col("has_ref"), F.col("_reference")), "background": F.coalesce(low(tag("background")), F.lit("unknown")), "count_bucket": x.count_bucket(tag("object_count").try_cast("int")),
    }).drop("_reference")
    fits = F.col("scenario").isNotNull() & F.col("has_target") & F.col("target").isNotNull() & (F.size("missing") > 0)
    return out.filter(fits & ((F.col("scenario") != "relative_pick") | F.col("reference").isNotNull()))


def by_scenario(found: DataFrame, pick_to_give: bool = False) -> DataFrame:
    """Candidates under each scenario that they serve: their own, and give for single picks if allowed."""
    own = F.col("scenario")
    also = F.array_compact(F.array(own, F.when((own == "single_pick") & F.lit(pick_to_give), F.lit("give"))))
    return found.withColumn("source_scenario", own).withColumn("scenario", F.explode(also))


def candidate_distributions(found: DataFrame, pick_to_give: bool = False) -> DataFrame:
    """Scenario, distribution, key, count: candidates, missing, source_visual, source_scenario, reference, direction, background, object_count."""
    cell = lambda name, key: F.when(key.isNotNull(), F.struct(F.lit(name).alias("distribution"), key.alias("key")))
    cells = [cell("candidates", F.lit("all"))] + [cell(n, F.col(c)) for n, c in (("source_visual", "target"), ("source_scenario", "source_scenario"), ("reference", "reference"), ("direction", "direction"), ("background", "background"), ("object_count", "count_bucket"))]
    every = F.concat(F.array_compact(F.array(*cells)), F.transform("missing", lambda m: F.struct(F.lit("missing").alias("distribution"), m.alias("key"))))
    return by_scenario(found, pick_to_give).select("scenario", F.explode(every).alias("c")).groupBy("scenario", "c.distribution", "c.key").agg(F.count("*").alias("count"))


def new_prompt(scenario: str, missing: str, direction: str | None, reference: str | None, target: str | None, existing: list[str]) -> str:
    """X11: the prompt for an object that is not there."""
    if scenario == "give":
        return f"Give me the {missing}"
    if scenario == "single_pick":
        return f"Pick up the {missing}"
    side = direction or "left"
    if scenario == "directional_pick":
        return f"Pick up the {missing} on the {side}"
    if reference not in existing and existing:
        reference = existing[0]
    return f"Pick up the {missing} to the {side} of the {reference or target or 'object'}"


def balanced_sources(found: DataFrame, counts: dict[str, int], oversample: float = 1.0, pick_to_give: bool = False) -> DataFrame:
    """For each scenario ``counts`` candidates (times ``oversample``, rounded up), each with an object that it lacks and a prompt for it.

    Chosen one after the other: the pair (candidate, object) that leaves the choice most even, by how often its object,
    count bucket, background, object with count bucket, object with background, target, reference, object with target and
    direction were chosen so far, in this order; then by uncertainty, episode and object. An episode is chosen once. Of the
    pairs that agree in all of these but the last three, only the first as many as are wanted can ever be chosen, since
    before the last choice fewer episodes are gone. So a scenario is first cut to those, and what one pandas frame holds is
    bounded by the combinations of objects, counts, backgrounds, targets, references and directions.
    """
    want = {s: max(n, math.ceil(n * max(1.0, oversample))) for s, n in counts.items() if n > 0}
    if not want:
        want = {"": 0}
    out = T.StructType([
        T.StructField(n, t) for n, t in (("scenario", T.StringType()), ("pick", T.LongType()), (EPISODE, T.LongType()), ("missing_object", T.StringType()), ("new_task", T.StringType()), ("source_scenario", T.StringType()), ("uncertainty", T.LongType()))
    ])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        scenario = rows["scenario"].iloc[0]
        pairs = []
        for r in rows.itertuples():
            none = lambda v: "" if v is None or v != v else v
            m = r.object
            keys = (m, ("n", r.count_bucket), ("b", r.background), ("mn", m, r.count_bucket), ("mb", m, r.background), ("s", r.target), ("r", none(r.reference)), ("ms", m, r.target), ("d", none(r.direction)))
            pairs.append((keys, (int(r.uncertainty), int(r.episode_index), m), r))
        seen: dict = {}
        gone, picks = set(), []
        while len(picks) < want[scenario]:
            left = [p for p in pairs if p[1][1] not in gone]
            if not left:
                break
            keys, order, r = min(left, key=lambda p: (*(seen.get(k, 0) for k in p[0]), *p[1]))
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
            gone.add(order[1])
            text = [v if isinstance(v, str) else None for v in (r.direction, r.reference, r.target)]
            picks.append((scenario, len(picks), order[1], order[2], new_prompt(scenario, order[2], *text, list(r.existing)), r.source_scenario, order[0]))
        return pd.DataFrame(picks, columns=out.names)

    pairs = by_scenario(found, pick_to_give).filter(F.col("scenario").isin(*want)).withColumn("object", F.explode("missing"))
    alike = ("scenario", "object", "count_bucket", "background", "target", "reference", "direction")
    number = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # an episode once for each combination, then the first of each
    pairs = pairs.withColumn("_r", number((*alike, EPISODE), "uncertainty")).filter("_r = 1").withColumn("_r", number(alike, "uncertainty", EPISODE))
    most = F.element_at(F.create_map(*(F.lit(x) for p in want.items() for x in p)), F.col("scenario"))
    columns = ("scenario", EPISODE, "uncertainty", "object", "count_bucket", "background", "target", "reference", "direction", "existing", "source_scenario")
    return pairs.filter(F.col("_r") <= most).select(*columns).groupBy("scenario").applyInPandas(choose, out)


def constructed(frames: DataFrame, plans: DataFrame, tasks: DataFrame, first_episode: int) -> tuple[DataFrame, DataFrame]:
    """Frames of the planned episodes under new numbers from ``first_episode`` on, with the index of their new task and exist_label 0; and the tasks.

    plans: pick order (``number`` from 0), episode_index and new_task; tasks: task_index, task. Positive episodes are
    the frames as they are.
    """
    every = append_tasks(tasks, plans.select(F.col("new_task").alias("task")))
    named = plans.select(EPISODE, "number", F.col("new_task").alias("task")).join(every.withColumnRenamed("task_index", "_task"), "task").drop("task")
    out = frames.join(named, EPISODE).withColumns({EPISODE: F.col("number") + first_episode, "task_index": F.col("_task"), "exist_label": F.lit(0).cast("long")})
    return out.drop("_task", "number"), every


def decided(plans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Plans with their last decision (number, decision, at); those rejected go, the others are numbered on from 0 in their order."""
    last = decisions.groupBy("number").agg(F.max_by("decision", "at").alias("decision"))
    kept = plans.join(last, "number", "left").filter(F.coalesce(F.col("decision") != "reject", F.lit(True))).drop("decision")
    return running(kept, "number", {"_new": None}).drop("number").withColumnRenamed("_new", "number")
