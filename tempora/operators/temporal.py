"""Windows over the frames of an episode; nothing sorts all frames.

Operators that look a bounded number of frames back or ahead cut an episode into pieces of SPAN frames, each with the
neighbours that it looks at, so that an episode of any length spreads over tasks. They need frames numbered from 0 without
gaps (algebra.fix_indices gives such numbers). The others partition by the episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .written import written

EPISODE, ORDER = "episode_index", "frame_index"
#: Frames of a piece of an episode.
SPAN = 1 << 16


def over(episode: str = EPISODE, *order: str) -> WindowSpec:
    return Window.partitionBy(episode).orderBy(*(order or (ORDER,)))


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def in_pieces(df: DataFrame, before: int, after: int, episode: str = EPISODE, order: str = ORDER, span: int = SPAN) -> tuple[DataFrame, WindowSpec]:
    """Each row in the piece that it belongs to (``_own``) and in those that look at it from up to ``before`` frames later or ``after`` frames earlier; and the window over a piece.

    A row of a piece finds all frames of its episode in it that it looks at, so one that is missing lies outside the
    episode, and then the piece begins or ends with the episode.
    """
    at = F.col(order)
    piece = F.floor(at / span)
    of = F.sequence(F.greatest(F.lit(0), F.floor((at - after) / span)), F.floor((at + before) / span))
    out = df.withColumn("_piece", F.explode(of)).withColumn("_own", F.col("_piece") == piece)
    return out, Window.partitionBy(episode, "_piece").orderBy(order)


def own(pieces: DataFrame) -> DataFrame:
    """The rows that belong to their piece."""
    return pieces.filter("_own").drop("_own", "_piece")


def delta_window(df: DataFrame, columns: list[str], offsets: list[int], episode: str = EPISODE, order: str = ORDER, span: int = SPAN) -> DataFrame:
    """The value at each offset, clamped to the episode, and whether the offset lies outside (``_is_pad``)."""
    rows, w = in_pieces(df, -min(0, *offsets), max(0, *offsets), episode, order, span)
    out = {}
    for c in columns:
        for k in offsets:
            name = f"{c}_{'m' if k < 0 else 'p'}{abs(k)}"
            to = lambda x, k=k: F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k else F.col(x)
            edge = (F.first(c) if k < 0 else F.last(c)).over(whole(w))
            outside = to(order).isNull()
            out[name], out[f"{name}_is_pad"] = F.when(outside, edge).otherwise(to(c)), outside
    return own(rows.withColumns(out))


def wide_window(df: DataFrame, column: str, offsets: list[int], episode: str = EPISODE, order: str = ORDER, span: int = SPAN) -> DataFrame:
    """T02-T04 for many offsets: the values from the least to the largest offset as an array, and those wanted of it."""
    lo, hi = min(0, *offsets), max(0, *offsets)
    rows, w = in_pieces(df, -lo, hi, episode, order, span)
    near = F.collect_list(F.struct(F.col(column).alias("v"))).over(w.rowsBetween(lo, hi))
    # how many frames lie before and after, as far as the offsets reach
    behind, ahead = F.count(F.lit(1)).over(w.rowsBetween(lo, 0)) - 1, F.count(F.lit(1)).over(w.rowsBetween(0, hi)) - 1
    wanted = F.array(*(F.lit(k) for k in offsets))
    place = lambda k: F.greatest(F.lit(0), F.least(F.col("_ahead"), k) + F.col("_behind")).cast("int")
    return own(rows.withColumns({"_v": near, "_behind": behind, "_ahead": ahead})).withColumns({
        f"{column}_window": F.transform(wanted, lambda k: F.get("_v", place(k))["v"]),
        f"{column}_is_pad": F.transform(wanted, lambda k: (F.col("_behind") + k < 0) | (k > F.col("_ahead"))),
    }).drop("_v", "_behind", "_ahead")


def frame_offsets(deltas: dict[str, list[float]], fps: float, tolerance: float = 1e-4) -> dict[str, list[int]]:
    """Seconds as numbers of frames, rounded half to even; those that are no multiple of 1 / fps are an error that names them."""
    wrong = {c: [d for d in ds if abs(d * fps - round(d * fps)) / fps > tolerance] for c, ds in deltas.items()}
    wrong = {c: ds for c, ds in wrong.items() if ds}
    if wrong:
        raise ValueError(f"no multiples of 1 / {fps} within {tolerance}: {wrong}")
    return {c: [round(d * fps) for d in ds] for c, ds in deltas.items()}


def delta_windows(df: DataFrame, deltas: dict[str, list[float]], fps: float, tolerance: float = 1e-4) -> DataFrame:
    """Each column at the seconds given for it, as an array, and whether those lie outside the episode."""
    for column, offsets in frame_offsets(deltas, fps, tolerance).items():
        df = wide_window(df, column, offsets)
    return df


def query_timestamps(df: DataFrame, deltas: list[float], fps: float) -> DataFrame:
    """The times of the frames that ``deltas`` seconds from each frame lead to, within the episode."""
    return wide_window(df, "timestamp", frame_offsets({"timestamp": deltas}, fps)["timestamp"]).withColumnRenamed("timestamp_window", "query_timestamps")


def running(rows: DataFrame, key: str, sums: dict[str, str | None], buckets: int = 1024) -> DataFrame:
    """The sum of a column (None: the number of rows) over all rows before each, in the order of a long key, in two steps.

    The keys fall into ranges of equal width, and a range that holds more than its share into ranges of its own; those are
    summed (two for each of ``buckets`` at most), and each is walked through on its own.
    """
    span = rows.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count("*").alias("_all"))
    cut = lambda x, lo, hi, n: F.when(hi > lo, F.least(n - 1, F.floor((x.cast("double") - lo) / (hi.cast("double") - lo) * n))).otherwise(F.lit(0)).cast("long")
    one = rows.join(F.broadcast(span)).withColumn("_b", cut(F.col(key), F.col("_lo"), F.col("_hi"), F.lit(buckets)))
    own = one.groupBy("_b").agg(F.min(key).alias("_l"), F.max(key).alias("_h"), F.ceil(F.count("*") * buckets / F.first("_all")).alias("_k"))
    two = one.drop("_lo", "_hi", "_all").join(F.broadcast(own), "_b").withColumn("_c", cut(F.col(key), F.col("_l"), F.col("_h"), F.col("_k"))).drop("_l", "_h", "_k")
    total = lambda c: F.sum(c) if c else F.count("*")
    held = two.groupBy("_b", "_c").agg(*(total(c).alias(f"_s{k}") for k, c in enumerate(sums.values())))
    before = Window.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_b", "_c", *(F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))))
    here = Window.partitionBy("_b", "_c").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = {out: (F.col(f"_s{k}") + F.coalesce(total(c).over(here), F.lit(0))).cast("long") for k, (out, c) in enumerate(sums.items())}
    return two.join(F.broadcast(held), ["_b", "_c"]).withColumns(inside).drop("_b", "_c", *(f"_s{k}" for k in range(len(sums))))


def offsets_from_lengths(episodes: DataFrame) -> DataFrame:
    """From and to of each episode, by a running sum."""
    return running(episodes, EPISODE, {"from_index": "length"}).withColumn("to_index", F.col("from_index") + F.col("length"))


def islands(df: DataFrame, value: str, episode: str = EPISODE, order: str = ORDER) -> DataFrame:
    """Runs of equal values: first, last and length of each, in order."""
    w = over(episode, order)
    change = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull(), F.lit(True))
    numbered = df.withColumn("_new", change.cast("int")).withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(episode, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def sync_violations(df: DataFrame, fps: float, tolerance: float, span: int = SPAN) -> DataFrame:
    """steps that differ from 1 / fps by more than the tolerance."""
    rows, w = in_pieces(df, 0, 1, span=span)
    step = F.lead("timestamp").over(w) - F.col("timestamp")
    return own(rows.withColumn("step", step)).filter(F.abs(F.col("step") - 1 / fps) > tolerance)


def difference(df: DataFrame, column: str, out: str = "delta", span: int = SPAN) -> DataFrame:
    """T08."""
    rows, w = in_pieces(df, 1, 0, span=span)
    return own(rows.withColumn(out, F.col(column) - F.lag(column).over(w)))


def moving_average(df: DataFrame, column: str, window: int, out: str = "smooth", span: int = SPAN) -> DataFrame:
    """Centred mean over an odd window; beyond the ends the first or last value repeats."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    p = window // 2
    rows, w = in_pieces(df, p, p, span=span)
    x = F.col(column).cast("double")
    lacking = lambda lo, hi: p + 1 - F.count(F.lit(1)).over(w.rowsBetween(lo, hi))
    total = F.sum(x).over(w.rowsBetween(-p, p)) + lacking(-p, 0) * F.first(x).over(whole(w)) + lacking(0, p) * F.last(x).over(whole(w))
    return own(rows.withColumn(out, total / window))


def centered_range(df: DataFrame, column: str, window: int, out: str = "range", span: int = SPAN) -> DataFrame:
    """Rolling maximum - minimum; an even window reaches one frame further back."""
    rows, w = in_pieces(df, window // 2, (window - 1) // 2, span=span)
    near = w.rowsBetween(-(window // 2), (window - 1) // 2)
    return own(rows.withColumn(out, F.max(column).over(near) - F.min(column).over(near)))


def transitions(df: DataFrame, column: str, threshold: float, span: int = SPAN) -> DataFrame:
    """Frames at which the value crosses the threshold, and the side that it comes to."""
    rows, w = in_pieces(df.withColumn("high", F.col(column) > threshold), 1, 0, span=span)
    return own(rows.withColumn("_before", F.lag("high").over(w))).filter("_before != high").drop("_before")


def zero_runs(df: DataFrame, column: str, near_zero: float = 0.03, neighbour: float = 0.25, jump: float = 0.45, longest: int = 2, span: int = SPAN) -> DataFrame:
    """Short runs near zero between large neighbours: first frame and length of each.

    A run of at most ``longest`` frames shows from its first frame by looking that far ahead; longer ones need no numbering.
    """
    rows, w = in_pieces(df.withColumn("_zero", F.coalesce(F.abs(column) <= near_zero, F.lit(False))), 1, longest, span=span)
    ahead = {f"_z{k}": F.lead("_zero", k).over(w) for k in range(1, longest + 1)} | {f"_v{k}": F.lead(column, k).over(w) for k in range(1, longest + 1)}
    marked = rows.withColumns(ahead | {"before": F.lag(column).over(w), "_into": F.lag("_zero").over(w)})
    length, after = F.lit(None).cast("long"), F.lit(None).cast("double")
    for k in range(longest, 0, -1):
        ends = ~F.col(f"_z{k}")
        length, after = F.when(ends, F.lit(k).cast("long")).otherwise(length), F.when(ends, F.col(f"_v{k}")).otherwise(after)
    runs = own(marked).filter(F.col("_zero") & ~F.col("_into")).select(EPISODE, F.col(ORDER).alias("first"), length.alias("length"), "before", after.alias("after"))
    least, most = F.least(F.abs("before"), F.abs("after")), F.greatest(F.abs("before"), F.abs("after"))
    return runs.filter("length is not null and before is not null and after is not null").filter((least >= neighbour) & (most >= jump))


def stable_window(df: DataFrame, column: str, frames: int, limit: float) -> DataFrame:
    """The first frame from which ``frames`` values stay within the limit; the one after the last value beyond it; the first value beyond it."""
    w = over()
    ahead = F.max(column).over(w.rowsBetween(0, frames - 1))
    room = F.row_number().over(w) <= F.count(F.lit(1)).over(whole(w)) - frames + 1
    marked = df.withColumn("_stable", (ahead <= limit) & room)
    return marked.groupBy(EPISODE).agg(
        F.min(F.when(F.col("_stable"), F.col(ORDER))).alias("first_stable"),
        (F.max(F.when(F.col(column) > limit, F.col(ORDER))) + 1).alias("after_last_active"),
        F.min(F.when(F.col(column) > limit, F.col(ORDER))).alias("first_active"),
    )


def time_bounds(df: DataFrame, low: float, high: float) -> DataFrame:
    """How many timestamps lie before ``low`` (left side) and up to ``high`` (right side)."""
    return df.groupBy(EPISODE).agg(F.count_if(F.col("timestamp") < low).alias("left_index"), F.count_if(F.col("timestamp") <= high).alias("right_index"))


def every_nth(df: DataFrame, n: int) -> DataFrame:
    """T17."""
    return df.withColumn("_r", F.row_number().over(over())).filter((F.col("_r") - 1) % n == 0).drop("_r")


def at_most_points(df: DataFrame, points: int) -> DataFrame:
    """Every stride-th frame, with stride = ceil(n / points) of the episode."""
    n = F.count(F.lit(1)).over(whole(over()))
    return df.withColumn("stride", F.ceil(n / points)).filter(F.col(ORDER) % F.col("stride") == 0)


def change_sizes(df: DataFrame, before: str, after: str) -> DataFrame:
    """Root of the mean square and largest size of the change of a column in each episode."""
    d = F.col(after) - F.col(before)
    return df.groupBy(EPISODE).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_change"))


def evenly_spaced(df: DataFrame, k: int) -> DataFrame:
    """K frames of each episode, evenly spaced from the first to the last, rounded half to even."""
    n = df.groupBy(EPISODE).agg(F.count("*").alias("n"))
    wanted = n.select(EPISODE, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(k - 1)).cast("long")))).alias(ORDER))
    return df.join(wanted, [EPISODE, ORDER])


def first_middle_last(df: DataFrame) -> DataFrame:
    """T20."""
    n = F.count(F.lit(1)).over(whole(over()))
    return df.withColumn("n", n).filter(F.col(ORDER).isin(0) | (F.col(ORDER) == F.floor(F.col("n") / 2)) | (F.col(ORDER) == F.col("n") - 1))


def infer_fps(df: DataFrame) -> DataFrame:
    """1 / the median of the positive steps."""
    steps = difference(df, "timestamp", "dt").filter("dt > 0")
    return steps.groupBy(EPISODE).agg((1 / F.percentile("dt", F.lit(0.5))).alias("fps"))


def early_frames(df: DataFrame, seconds: float, least: int = 3) -> DataFrame:
    """Frames within the first seconds, at least ``least``, at most all."""
    first = df.withColumn("_t0", F.min("timestamp").over(Window.partitionBy(EPISODE)))
    return first.groupBy(EPISODE).agg(F.least(F.count("*"), F.greatest(F.lit(least), F.count_if(F.col("timestamp") <= F.col("_t0") + seconds))).alias("early"))


def done_mask(df: DataFrame, done: Column) -> DataFrame:
    """True from the first done frame on, and that frame."""
    w = over()
    return df.withColumns({"done_mask": F.coalesce(F.max(done).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)), "first_done": F.min(F.when(done, F.col(ORDER))).over(whole(w))})


def step_function(df: DataFrame, changes: DataFrame, time: str = "timestamp", state: str = "state") -> DataFrame:
    """The state of the last change at or before each frame's time, 0 before the first: one sort of both sides, no range join."""
    both = df.withColumns({"_kind": F.lit(1), "_s": F.lit(None).cast("long")}).unionByName(changes.select(EPISODE, F.col(time), F.lit(0).alias("_kind"), F.col(state).cast("long").alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(EPISODE).orderBy(time, "_kind", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(state, F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(0))).filter("_kind = 1").drop("_kind", "_s")


def nearest(left: DataFrame, right: DataFrame, time: str, value: str, tolerance: float) -> DataFrame:
    """The nearest row of the other side in time (ties to the earlier), null beyond the tolerance: windows, no range join."""
    a = left.withColumns({"_kind": F.lit(1), "_rt": F.lit(None).cast("double"), "_rv": F.lit(None).cast("double")})
    b = right.select(EPISODE, F.col(time), F.lit(0).alias("_kind"), F.col(time).alias("_rt"), F.col(value).alias("_rv"))
    w = Window.partitionBy(EPISODE).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # the next one is the last one so far when rows are walked through from the end: a frame up to the end would be gone through for every row
    back = Window.partitionBy(EPISODE).orderBy(F.desc(time), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = F.struct(F.col("_rt").alias("t"), F.col("_rv").alias("v"))
    pair = F.when(F.col("_rt").isNotNull(), near)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumns({"_b": F.last(pair, ignorenulls=True).over(w), "_a": F.last(pair, ignorenulls=True).over(back)}).filter("_kind = 1")
    db, da = F.abs(F.col(time) - F.col("_b.t")), F.abs(F.col("_a.t") - F.col(time))
    best = F.when(F.col("_a").isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    out = both.withColumn("_m", best).withColumn("_d", F.abs(F.col("_m.t") - F.col(time)))
    return out.withColumns({"near_value": F.when(F.col("_d") <= tolerance, F.col("_m.v")), "near_distance": F.col("_d"), "is_pad": F.coalesce(F.col("_d") > tolerance, F.lit(True))}).drop("_kind", "_rt", "_rv", "_b", "_a", "_m", "_d")


def stage_states(df: DataFrame, bounds: DataFrame, give: bool = False) -> DataFrame:
    """The stage of each frame from the boundaries of its episode (stage0_end, stage2_start, stage2_end, stage4_start, stage4_end)."""
    t = F.col("timestamp")
    late = F.when(t < F.col("stage4_start"), 3).when(t <= F.col("stage4_end"), 4).otherwise(5) if give else F.when(t < F.col("stage4_start"), 3).otherwise(4)
    stage = F.when(F.col("stage0_end").isNull() | (t < F.col("stage0_end")), 0).when(t < F.col("stage2_start"), 1).when(t <= F.col("stage2_end"), 2).otherwise(late)
    return df.join(bounds, EPISODE, "left").withColumn("stage", stage).drop("stage0_end", "stage2_start", "stage2_end", "stage4_start", "stage4_end")


def global_index(df: DataFrame) -> DataFrame:
    """index = offset of the episode + frame_index."""
    starts = offsets_from_lengths(written(df.groupBy(EPISODE).agg(F.count("*").alias("length")))).select(EPISODE, "from_index")
    return df.join(starts, EPISODE).withColumn("index", F.col("from_index") + F.col(ORDER)).drop("from_index")
