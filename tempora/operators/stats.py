"""Mergeable statistics, distributions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import EPISODE, ORDER, over
from .written import dealt, written


def dims(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row for each component of a vector: keys, dim, x."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x"))


def vector_stats(df: DataFrame, vector: str, width: int, *keys: str) -> DataFrame:
    """Keys, dim, min, max, mean, population std and count of each component of vectors of a known width.

    Components are aggregated side by side and become rows afterwards, so rows are not multiplied by the width.
    """
    held = wide_stats(df, vector, width, *keys)
    return held.select(*keys, F.posexplode("stats").alias("dim", "_s")).select(*keys, "dim", "_s.*").filter("count > 0")


def wide_stats(df: DataFrame, vector: str, width: int, *keys: str) -> DataFrame:
    """keys and stats, an array of the structs (min, max, mean, std, count) of the components; those without values count 0.

    Rows of a key are few, and the buffers of an aggregate are several times as wide as a row. So the components are dealt
    by the keys before they are aggregated: partial aggregates would hold and send a buffer for about each row.
    """
    rows = df.select(*keys, *(F.get(vector, k).alias(f"_x{k}") for k in range(width)))
    if keys:
        rows = dealt(rows, *keys)
    of = lambda c: F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("count"))
    held = rows.groupBy(*keys).agg(*(of(f"_x{k}").alias(f"_{k}") for k in range(width)))
    return held.select(*keys, F.array(*(f"_{k}" for k in range(width))).alias("stats"))


def episode_stats(df: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """A01 for each episode."""
    if width is not None:
        return vector_stats(df, vector, width, EPISODE)
    return dims(df, vector, EPISODE).groupBy(EPISODE, "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def merge_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Statistics of statistics; the variance by sums of squares, so partial results merge in one pass."""
    n = F.sum("count")
    mean = F.sum(F.col("mean") * F.col("count")) / n
    square = F.sum((F.col("std") * F.col("std") + F.col("mean") * F.col("mean")) * F.col("count")) / n
    return stats.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std"), n.alias("count"))


def nan_stats(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Statistics over values that are numbers; the count is that of all rows."""
    x = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.col(column))
    return df.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.lit(1)).alias("count"))


def range_stats(df: DataFrame, start: Column, n: Column) -> DataFrame:
    """The statistics of start, start + 1, ... in closed form."""
    return df.withColumns({"min": start, "max": start + n - 1, "mean": start + (n - 1) / 2, "std": F.sqrt((n * n - 1) / 12), "count": n})


def same(left: str, right: str, keys: tuple[str, ...]) -> Column:
    """Whether the keys of two aliased sides are equal, nulls together."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def quantiles(df: DataFrame, column: str, shares: list[float], *keys: str, parts: int = 1024, few: int = 1 << 14) -> DataFrame:
    """The keys and q0, q1, ... for each of ``shares``, exact, with linear interpolation; nulls and NaN do not count.

    Selection in passes: each wanted rank lies in a range of values, whose ``parts`` parts are counted with their least
    and largest values, and the part that holds the rank is the next range. A range of one value is done, one of ``few``
    rows is sorted; so no task and no state holds all values of a key.
    """
    rows = written(df.select(*keys, F.col(column).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)"))
    one = lambda t: t.groupBy(*keys) if keys else t.groupBy()
    whole = one(rows).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_n > 0")
    place = [F.lit(q) * (F.col("_n") - 1) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in place))))
    state = written(whole.select(*keys, "_n", F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_held")))
    names = [*keys, "_n", "_rank", "_lo", "_hi", "_before", "_held"]
    within = lambda t: rows.alias("r").join(t.alias("s"), same("r", "s", keys) & F.col("r._x").between(F.col("s._lo"), F.col("s._hi"))).select("s.*", "r._x")
    while state.filter((F.col("_lo") < F.col("_hi")) & (F.col("_held") > few)).limit(1).count():
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_held") > few)
        # halves, as the width of a range may be beyond what a double holds
        part = F.least(F.lit(parts - 1), F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * parts))
        counted = within(state.filter(wide)).groupBy(*keys, "_n", "_rank", "_before", part.alias("_part")).agg(F.count("*").alias("_held"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys, "_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_held").over(w), F.lit(0)))
        found = placed.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_held")))
        state = written(state.filter(~wide).select(*names).unionByName(found.select(*names)))
    short = within(state.filter("_lo < _hi")).groupBy(*keys, "_n", "_rank", "_before").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    short = short.select(*keys, "_n", "_rank", F.get("_xs", (F.col("_rank") - F.col("_before")).cast("int")).alias("_v"))
    known = state.filter("_lo = _hi").select(*keys, "_n", "_rank", F.col("_lo").alias("_v")).unionByName(short)
    of = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_v")))
    share = lambda p: p - F.floor(p)
    ends = known.groupBy(*keys, "_n").agg(*(c for k, p in enumerate(place) for c in (of(F.floor(p)).alias(f"_a{k}"), of(F.ceil(p)).alias(f"_b{k}"))))
    return ends.select(*keys, *((F.col(f"_a{k}") * (1 - share(p)) + F.col(f"_b{k}") * share(p)).alias(f"q{k}") for k, p in enumerate(place)))


def timings(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mean, median, 90th percentile (linear interpolation), maximum and sum."""
    totals = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.sum(column).alias("total"))
    middle = quantiles(df, column, [0.5, 0.9], *keys)
    joined = totals.alias("t").join(middle.alias("m"), same("t", "m", keys), "left")
    return joined.select(*(F.col(f"t.{k}").alias(k) for k in keys), "mean", F.col("q0").alias("p50"), F.col("q1").alias("p90"), "max", "total")


def distribution(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """Counts with percent of all rows (or of ``of``), by count, then key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    total = (of or df).agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("percent", 100 * F.col("count") / F.col("_total")).drop("_total")


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Left-closed buckets, the last one open; buckets without rows count 0."""
    bucket = F.lit(0)
    for k, e in enumerate(edges[1:], 1):
        bucket = F.when(F.col(column) >= e, k).otherwise(bucket)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"), F.element_at(F.array(*(F.lit(float(e)) for e in edges)), (F.col("id") + 1).cast("int")).alias("low"))
    return every.join(counts, "bucket", "left").select("bucket", "low", F.coalesce("count", F.lit(0)).alias("count"))


def flag_counts(df: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """A10: true, false and missing flags, and episodes with any that is true."""
    each = df.groupBy(*keys, EPISODE).agg(F.count_if(flag).alias("t"), F.count_if(~flag).alias("f"), F.count_if(flag.isNull()).alias("m"))
    return each.groupBy(*keys).agg(F.sum("t").alias("n_true"), F.sum("f").alias("n_false"), F.sum("m").alias("n_missing"), F.count_if(F.col("t") > 0).alias("episodes_any"))


def issue_reasons(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each reason stands, and the reasons of each episode."""
    return issues.groupBy("reason").agg(F.count("*").alias("count")), issues.groupBy(EPISODE).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def duplicate_summary(prints: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Groups of episodes with one fingerprint."""
    return prints.groupBy(key).agg(F.count("*").alias("members"), F.min(EPISODE).alias("first")).filter("members > 1")


def padded_stats(df: DataFrame, vector: str, width: int, episodes: int) -> DataFrame:
    """Statistics over the first episodes, vectors filled up with zeros, rounded to six digits half to even."""
    first = df.select(EPISODE).distinct().orderBy(EPISODE).limit(episodes)
    full = df.join(first, EPISODE, "left_semi").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(vector, i), F.lit(0.0)))).alias("dim", "x"))
    return full.groupBy("dim").agg(*(F.bround(f("x"), 6).alias(n) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "std"))), F.count("*").alias("count"))


def compare_sides(df: DataFrame, side: str, key: str) -> DataFrame:
    """Counts of each key on sides A and B, and their difference."""
    counts = df.groupBy(key).pivot(side, ["A", "B"]).agg(F.count(F.lit(1)))
    return counts.select(key, F.coalesce("A", F.lit(0)).alias("a"), F.coalesce("B", F.lit(0)).alias("b")).withColumn("difference", F.col("b") - F.col("a"))


def rollout_metrics(df: DataFrame, reward: str, done: Column, success: Column, extra_steps: int = 1) -> DataFrame:
    """Rewards up to the first done frame and ``extra_steps`` more; whether any of those frames is a success."""
    first = F.min(F.when(done, F.col(ORDER))).over(Window.partitionBy(EPISODE))
    kept = df.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(ORDER) <= F.col("_first") + extra_steps))
    return kept.groupBy(EPISODE).agg(F.sum(reward).alias("sum_reward"), F.max(reward).alias("max_reward"), F.max(success).alias("success"), F.count("*").alias("steps"))


def running_mean(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """The weighted mean of all frames so far."""
    w = over().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.sum(F.col(value) * weight).over(w) / F.sum(weight).over(w))


def inverted_index(df: DataFrame, key: str, span: int = 4096) -> DataFrame:
    """The distinct episodes of each key, sorted, and how many; a list covers ``span`` episode numbers at most, so that no row grows with the data."""
    chunk = F.floor(F.col(EPISODE) / span).alias("chunk")
    return df.select(key, EPISODE).distinct().groupBy(key, chunk).agg(F.sort_array(F.collect_list(EPISODE)).alias("episodes"), F.count("*").alias("n"))


def column_normaliser(stats: DataFrame, dim: str = "dim") -> DataFrame:
    """One row with the arrays of means, stds, minima and maxima by component."""
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(dim, c))), lambda s: s[c]).alias(c)
    return stats.agg(*(at(c) for c in ("mean", "std", "min", "max")))


def bincount(df: DataFrame, group: str, value: str, minlength: int) -> DataFrame:
    """How often each value from 0 to ``minlength`` - 1 (or more, if there is more) stands in each group, 0 where it does not."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    top = F.greatest(F.lit(minlength - 1), F.max(value))
    every = counts.groupBy(group).agg(top.alias("_top")).select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top").cast("long"))).alias(value))
    return every.join(counts, [group, value], "left").select(group, value, F.coalesce("n", F.lit(0)).alias("n"))
