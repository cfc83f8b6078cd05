"""The analysis of a dataset: what its tasks, stages and labels are made of, as one long table of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from .temporal import EPISODE
from .written import written

#: Buckets of durations in seconds, left-closed, the last one open (fixed values).
DURATIONS = ((0, "0-5s"), (5, "5-10s"), (10, "10-15s"), (15, "15-20s"), (20, "20-30s"), (30, "30-45s"), (45, "45-60s"), (60, "60s+"))


def duration_bucket(seconds: Column) -> Column:
    out = F.lit(DURATIONS[0][1])
    for low, name in DURATIONS[1:]:
        out = F.when(seconds >= low, name).otherwise(out)
    return out


def last_stage(scene: Column) -> Column:
    return F.when(scene == "give", 5).otherwise(4)


def stage_index(value: Column, most: Column) -> Column:
    """The stage of a value between 0 and 1 (a share of the last stage) or of a number; null for none."""
    number = value.cast("double")
    return F.when(number.between(0, 1), F.bround(number * most)).when(~F.isnan(number), F.bround(number)).cast("int")


def described(episodes: DataFrame, frames: DataFrame, exist: list[str], stage: str = "stage") -> DataFrame:
    """One row for each episode (episode_index, task): scene, target, canonical task, side, reference, frames, duration, stages, review reasons.

    frames: episode_index, timestamp, ``stage`` (see stage_index) and columns of existence labels (text); episodes without
    frames have none of what comes from them.
    """
    canonical, told = x.canonical_task(F.col("task")), x.scene(F.col("task"))
    out = episodes.select(EPISODE, "task", told.alias("scene"), *(canonical[k].alias(n) for k, n in (("canonical", "is_canonical"), ("task", "canonical_task"), ("side", "side"), ("reference", "reference"))))
    out = out.withColumns({"task_type": F.col("scene"), "named": x.target_object(F.col("task"), exist), "bare": x.target_object(F.col("task")), "most": last_stage(F.col("scene"))})
    marked = frames.join(out.select(EPISODE, "most"), EPISODE).withColumn("_s", stage_index(F.col(stage), F.col("most")))
    count = lambda c: F.count_if(c)
    flags = [f(x.truth(F.col(c))).alias(f"{n}_{k}") for k, c in enumerate(exist) for n, f in (("true", lambda t: count(t)), ("false", lambda t: count(~t)), ("missing", lambda t: count(t.isNull())))]
    held = marked.groupBy(EPISODE).agg(
        F.count("*").alias("frames"), F.when(F.count("timestamp") > 1, F.max("timestamp") - F.min("timestamp")).otherwise(0.0).alias("duration"),
        *(F.count_if(F.col("_s") == k).alias(f"stage_{k}") for k in range(6)), *flags,
    )
    out = out.join(held, EPISODE, "left").drop("most")
    # an object that the text does not tell, from the labels: the one that is true most often
    objects = [(k, o) for k, o in ((k, x.object_of_columns([c])) for k, c in enumerate(exist)) if o in x.OBJECTS]
    true_of = {o: sum((F.coalesce(f"true_{k}", F.lit(0)) for k, p in objects if p == o), F.lit(0)) for o in sorted({o for _, o in objects})}
    ranked = F.reverse(F.array_sort(F.array_compact(F.array(*(F.when(n > 0, F.struct(n.alias("n"), F.lit(o).alias("o"))) for o, n in true_of.items()))))) if true_of else None
    by_label = F.when((F.size(ranked) == 1) | (F.get(ranked, 0)["n"] > F.get(ranked, 1)["n"]), F.get(ranked, 0)["o"]) if true_of else F.lit(None).cast("string")
    # the names of the labels count where there are any, their values where the names do not tell
    out = out.withColumn("target", F.when(F.col("frames").isNull(), F.col("bare")).when(F.col("named") != "unknown", F.col("named")).otherwise(F.coalesce(by_label, F.lit("unknown"))))
    staged = sum((F.coalesce(f"stage_{k}", F.lit(0)) for k in range(6)), F.lit(0))
    several = F.size(ranked) > 1 if true_of else F.lit(False)
    reasons = F.array_compact(F.array(
        F.when(~F.col("is_canonical"), F.lit("non_canonical_task_text")), F.when(F.col("scene") == "unknown", F.lit("unknown_scene")),
        F.when((F.col("target") == "unknown") & several, F.lit("ambiguous_exist_labels")), F.when(F.col("target") == "unknown", F.lit("unknown_object")),
        F.when(F.col("frames").isNull(), F.lit("missing_csv")), F.when(F.col("frames").isNotNull() & (staged == 0), F.lit("missing_stage")),
    ))
    return out.withColumns({"review_reasons": reasons, "duration_bucket": F.when(F.col("frames").isNotNull(), duration_bucket(F.col("duration")))}).drop("named", "bare")


def distributions(rows: DataFrame, exist: list[str]) -> DataFrame:
    """Distribution, key, count, percent of all 13 distributions of ``described`` rows, each with its own whole.

    scene, target, canonical_task, task_type: of all episodes; side, reference, review_reason: of what there is; duration:
    of episodes with frames, buckets without episodes too; stage: frames of all frames; stage_seconds: seconds of all
    seconds; stage_by_scene, stage_by_target: frames in the group, keys group/stage; exist: true values of all values.
    """
    cells = [F.struct(F.lit(n).alias("distribution"), F.col(c).alias("key"), F.lit(1.0).alias("count")) for n, c in (("scene", "scene"), ("target", "target"), ("canonical_task", "canonical_task"), ("task_type", "task_type"))]
    cells += [F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("distribution"), F.col(c).alias("key"), F.lit(1.0).alias("count"))) for n, c in (("side", "side"), ("reference", "reference"), ("duration", "duration_bucket"))]
    for k in range(6):
        n = F.coalesce(f"stage_{k}", F.lit(0)).cast("double")
        for name, key, value in (("stage", F.lit(str(k)), n), ("stage_seconds", F.lit(str(k)), n * F.col("duration") / F.col("frames")), ("stage_by_scene", F.concat("scene", F.lit(f"/{k}")), n), ("stage_by_target", F.concat("target", F.lit(f"/{k}")), n)):
            cells.append(F.when(n > 0, F.struct(F.lit(name).alias("distribution"), key.alias("key"), value.alias("count"))))
    for k, c in enumerate(exist):
        cells.append(F.when(F.col("frames").isNotNull(), F.struct(F.lit("exist").alias("distribution"), F.lit(c).alias("key"), F.col(f"true_{k}").cast("double").alias("count"))))
    of_reasons = F.transform("review_reasons", lambda r: F.struct(F.lit("review_reason").alias("distribution"), r.alias("key"), F.lit(1.0).alias("count")))
    # every episode is read once; the counts of each key are combined before they travel
    counts = rows.select(F.explode(F.concat(F.array_compact(F.array(*cells)), of_reasons)).alias("c")).select("c.*").groupBy("distribution", "key").agg(F.sum("count").alias("count"))
    none = rows.sparkSession.createDataFrame([("duration", n, 0.0) for _, n in DURATIONS], "distribution string, key string, count double")
    counts = counts.unionByName(none).groupBy("distribution", "key").agg(F.sum("count").alias("count"))
    values = [f"sum(coalesce(true_{k} + false_{k} + missing_{k}, 0)) AS _e{k}" for k in range(len(exist))]
    whole = rows.agg(F.count("*").alias("_episodes"), F.coalesce(F.sum("frames"), F.lit(0)).alias("_frames"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("_seconds"), *(F.expr(v) for v in values))
    group = F.when(F.col("distribution").isin("stage_by_scene", "stage_by_target"), F.substring_index("key", "/", 1)).otherwise("")
    here = counts.withColumn("_g", group)
    sums = here.groupBy("distribution", "_g").agg(F.sum("count").alias("_sum"))
    total = F.when(F.col("distribution").isin("scene", "target", "canonical_task", "task_type"), F.col("_episodes")).when(F.col("distribution") == "stage", F.col("_frames")).when(F.col("distribution") == "stage_seconds", F.col("_seconds"))
    for k, c in enumerate(exist):
        total = total.when((F.col("distribution") == "exist") & (F.col("key") == c), F.col(f"_e{k}"))
    out = here.join(sums, ["distribution", "_g"]).join(F.broadcast(whole)).withColumn("_t", total.otherwise(F.col("_sum")).cast("double"))
    return out.select("distribution", "key", "count", F.when(F.col("_t") > 0, 100 * F.col("count") / F.col("_t")).otherwise(0.0).alias("percent"))


def totals(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    return rows.agg(F.count("*").alias("episodes"), F.count("frames").alias("with_frames"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distribution, key, and count and percent on either side, of two tables of distributions."""
    side = lambda t, n: t.select("distribution", "key", F.col("count").alias(f"count_{n}"), F.col("percent").alias(f"percent_{n}"))
    both = side(a, "a").join(side(b, "b"), ["distribution", "key"], "full")
    return both.select("distribution", "key", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("count_a", "percent_a", "count_b", "percent_b")))


def side(frames: DataFrame, tasks: DataFrame, info: dict, tags: DataFrame | None = None, action: str = "action", episodes: int = 64) -> DataFrame:
    """Section, key, value of one dataset: metadata, action statistics, vocabulary, scenarios of its tasks and tags.

    frames: episode_index, frame_index and the action vector; tasks: task_index, task; tags: episode_index, tags (map of
    strings). Action statistics are of the first ``episodes`` episodes, shorter vectors filled with zeros. All counts come
    from one pass over the frames, one over the tasks and one over the tags.
    """
    cell = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    long = lambda rows: rows.select(F.explode("_c").alias("_c")).select("_c.*").filter("value is not null")
    lengths = written(frames.groupBy(EPISODE).agg(F.count("*").alias("_n"), F.max(F.size(action)).alias("_w")))
    first = lengths.orderBy(EPISODE).limit(episodes)
    totals = lengths.agg(F.count("*").alias("e"), F.coalesce(F.sum("_n"), F.lit(0)).alias("f"))
    kinds = parsed_tasks(tasks)
    counted = tasks.agg(F.count("*").alias("t"))
    meta = totals.join(F.broadcast(counted)).select(F.array(cell("metadata", F.lit("total_episodes"), F.col("e")), cell("metadata", F.lit("total_frames"), F.col("f")), cell("metadata", F.lit("total_tasks"), F.col("t")), cell("metadata", F.lit("fps"), F.lit(info.get("fps")))).alias("_c"))
    width = (first.agg(F.max("_w")).first()[0]) or 0
    out = long(meta)
    if width:
        x = [F.coalesce(F.get(action, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(width)]
        some = frames.join(F.broadcast(first.select(EPISODE)), EPISODE).filter(F.col(action).isNotNull())  # ``episodes`` rows
        of = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
        each = some.agg(*(f(c).alias(f"{n}_{k}") for n, f in of.items() for k, c in enumerate(x)))
        cells = [cell("action", F.lit(f"{n}_{k}"), F.col(f"{n}_{k}")) for n in of for k in range(width)]
        out = out.unionByName(long(each.select(F.array(cell("action", F.lit("dims"), F.lit(width)), *cells).alias("_c"))))
    scenario = kinds.groupBy("scenario").agg(F.count("*").alias("n")).select(F.array(cell("scenarios", F.col("scenario"), F.col("n"))).alias("_c"))
    named = kinds.select(F.explode(F.array_compact(F.array("target", "reference"))).alias("o")).distinct().select(F.array(cell("vocabulary", F.col("o"), F.lit(1))).alias("_c"))
    out = out.unionByName(long(scenario)).unionByName(long(named))
    if tags is not None:
        marks = tags.select(F.explode("tags").alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))
        out = out.unionByName(long(marks.select(F.array(cell("tags", F.concat("k", F.lit("="), F.coalesce("v", F.lit("None"))), F.col("n"))).alias("_c"))))
    return out


def parsed_tasks(tasks: DataFrame) -> DataFrame:
    """scenario, target and reference (lower case) of each task; unknown where the text has no known form."""
    from ..functions import text as x

    p = x.parse_prompt(F.col("task"))
    low = lambda c: F.nullif(F.lower(x.stripped(c)), F.lit(""))
    scenario = x.one_of(p["kind"], {"give": "give", "single": "single_pick", "absolute": "directional_pick", "relative": "relative_pick"})
    return tasks.select(F.coalesce(scenario, F.lit("unknown")).alias("scenario"), low(p["target"]).alias("target"), low(p["reference"]).alias("reference"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Section, key, a, b and where the key is (a_only, b_only, both), by one join of two tables of ``side``."""
    mine = lambda t, n: t.select("section", "key", F.col("value").alias(n))
    where = F.when(F.col("b").isNull(), "a_only").when(F.col("a").isNull(), "b_only").otherwise("both")
    return mine(a, "a").join(mine(b, "b"), ["section", "key"], "full").select("section", "key", "a", "b", where.alias("where"))
