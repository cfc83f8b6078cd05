"""Samples, weights and picks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .temporal import EPISODE, ORDER, over, whole


def stratified(df: DataFrame, stratum: str, n: int, seed: int, key: str = EPISODE) -> DataFrame:
    """At most n rows of each stratum, chosen by a digest of key and seed."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def inner_frames(frames: DataFrame, drop_first: int, drop_last: int) -> DataFrame:
    """Frames without the first and last of their episode."""
    r, n = F.row_number().over(over()), F.count(F.lit(1)).over(whole(over()))
    return frames.withColumns({"_r": r, "_n": n}).filter((F.col("_r") > drop_first) & (F.col("_r") <= F.col("_n") - drop_last)).drop("_r", "_n")


def mixed_weights(frames: DataFrame, source: str, keep: Column, shares: dict[str, float]) -> DataFrame:
    """Sampling weights: each source's share over its kept frames; all equal if nothing has weight."""
    marked = frames.withColumn("_keep", keep.cast("int"))
    kept = marked.groupBy(source).agg(F.sum("_keep").alias("_kept"))
    share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(shares.items()) for x in pair)), F.col(source)), F.lit(0.0))
    raw = marked.join(F.broadcast(kept), source).withColumn("_w", F.when(F.col("_kept") > 0, F.col("_keep") * share / F.col("_kept")).otherwise(0.0))
    total = raw.agg(F.sum("_w").alias("_t"), F.count("*").alias("_n"))
    return raw.join(F.broadcast(total)).withColumn("weight", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(1 / F.col("_n"))).drop("_keep", "_kept", "_w", "_t", "_n")


def sample_size(n: Column) -> Column:
    """n^0.75, from 100 (or n) to 10000."""
    return F.greatest(F.least(F.lit(100), n), F.least(F.floor(F.pow(n, F.lit(0.75))), F.lit(10000)))


def top_by(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_r = 1").drop("_r")


def review_queue(df: DataFrame, score: str) -> DataFrame:
    """O02."""
    return df.orderBy(F.desc(score), EPISODE)


def weighted_subset(df: DataFrame, weight: str, k: int, seed: int, key: str) -> DataFrame:
    """K rows without replacement by weight: the largest log(u) / weight, u a digest of key and seed."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)
    return df.filter(F.col(weight) > 0).orderBy(F.desc(F.log(u) / F.col(weight)), key).limit(k)


def balanced(candidates: DataFrame, group: str, n: int, features: list[str], order: list[str]) -> DataFrame:
    """N candidates of each group, one after the other, each the one whose features were chosen least so far.

    The choice is sequential, but of the candidates with the same features only the first n can ever be chosen: before
    the last choice fewer than n of them are gone. So each group is first cut to those, exactly, and what one pandas frame
    holds is bounded by the combinations of features.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        seen: dict[tuple, int] = {}
        left, out = list(range(len(rows))), []
        values = rows[features].astype(str).values.tolist()
        while left and len(out) < n:
            best = min(left, key=lambda i: (tuple(seen.get((k, v), 0) for k, v in enumerate(values[i])), i))
            left.remove(best)
            out.append(best)
            for k, v in enumerate(values[best]):
                seen[k, v] = seen.get((k, v), 0) + 1
        return rows.loc[out].assign(pick=range(len(out)))

    first = F.row_number().over(Window.partitionBy(group, *features).orderBy(*order))
    able = candidates.withColumn("_r", first).filter(F.col("_r") <= n).drop("_r")
    return able.groupBy(group).applyInPandas(pick, StructType([*candidates.schema.fields, StructField("pick", LongType())]))


def action_chunks(frames: DataFrame, steps: int) -> DataFrame:
    """The chunk of a step and its place in the chunk."""
    return frames.withColumns({"chunk": F.floor(F.col(ORDER) / steps), "step": F.col(ORDER) % steps})
