"""Arithmetic on vectors: built-in array expressions, no Python in the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def normalize_mean_std(v: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + eps)."""
    return F.transform(F.arrays_zip(v.alias("x"), mean.alias("m"), std.alias("s")), lambda t: (t["x"] - t["m"]) / (t["s"] + EPS))


def normalize_min_max(v: Column, low: Column, high: Column) -> Column:
    """To -1 .. 1."""
    return F.transform(F.arrays_zip(v.alias("x"), low.alias("l"), high.alias("h")), lambda t: (t["x"] - t["l"]) / (t["h"] - t["l"] + EPS) * 2 - 1)


def unnormalize_mean_std(v: Column, mean: Column, std: Column) -> Column:
    """M02."""
    return F.transform(F.arrays_zip(v.alias("x"), mean.alias("m"), std.alias("s")), lambda t: t["x"] * t["s"] + t["m"])


def unnormalize_min_max(v: Column, low: Column, high: Column) -> Column:
    """M02."""
    return F.transform(F.arrays_zip(v.alias("x"), low.alias("l"), high.alias("h")), lambda t: (t["x"] + 1) / 2 * (t["h"] - t["l"]) + t["l"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """Of length 1; zeros stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def fit(v: Column, n: int, fill: float = 0.0) -> Column:
    """Cut or filled to n components."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(v, i), F.lit(fill)))


def near_pose(a: Column, b: Column, rms: float, most: float) -> Column:
    """root mean square and largest difference within bounds."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return (F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / F.size(d)) <= rms) & (F.array_max(d) <= most)


def mean_pool(df: DataFrame, vector: str, key: str) -> DataFrame:
    """The mean vector of each group, made of partial sums by component, of length 1."""
    means = df.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    pooled = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return pooled.select(key, unit(F.col("mean")).alias("vector"))


def stat_embedding(stats: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Mean, std, min, max of all components in one vector, cut or filled to a width, of length 1."""
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "min", "max")))
    return wide_embedding(stats.groupBy(key).agg(rows.alias("stats")), key, width)


def wide_embedding(stats: DataFrame, key: str, width: int = 64) -> DataFrame:
    """M04 of the statistics of all components in one array (stats), in their order."""
    part = lambda c: F.transform("stats", lambda s: s[c])
    # filled up and cut as a whole: a lambda that names the vector would make it anew for each place
    v = F.slice(F.concat(part("mean"), part("std"), part("min"), part("max"), F.array_repeat(F.lit(0.0), width)), 1, width)
    whole = stats.select(key, F.transform(v, lambda x: F.coalesce(x, F.lit(0.0))).alias("_v")).withColumn("_n", norm(F.col("_v")))
    return whole.select(key, F.when(F.col("_n") > 0, F.zip_with("_v", F.array_repeat("_n", width), lambda x, n: x / n)).otherwise(F.col("_v")).alias("embedding"))


def active_arm(left: Column, right: Column, ratio: float = 1.25) -> Column:
    """Which half moved more; both if neither by the ratio; unclear if nothing moved."""
    more, less = F.greatest(left, right), F.least(left, right)
    return F.when(more < 1e-6, "unclear").when(more < ratio * less, "both").when(left > right, "left").otherwise("right")


def forward_kinematics(angles: list[Column], lengths: list[float], base_x: float, mirror: bool = False) -> tuple[Column, Column]:
    """X and y of the end of a planar chain."""
    x, y, total = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for a, n in zip(angles, lengths, strict=True):
        total = total + a
        x, y = x + n * F.cos(total), y + n * F.sin(total)
    return F.lit(base_x) + (-x if mirror else x), y


def ensemble(df: DataFrame, target: str, age: str, value: str, coefficient: float = 0.01) -> DataFrame:
    """Predictions for one target step, weighted exp(-coefficient * age)."""
    w = F.exp(-coefficient * F.col(age))
    return df.groupBy(target).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("ensembled"), F.count("*").alias("predictions"))


def sim_position(position: Column, start: Column, direction: int, offset: float) -> Column:
    """H22."""
    return direction * (position - start) * (2 * 3.141592653589793 / 4096) + offset


def percent_gripper(x: Column) -> Column:
    """0 .. 100 to 0 .. 1."""
    return x / 100.0


def pca_2d(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Two principal components of centred vectors; the largest loading of each is positive. A single row lies at the origin."""
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if df.limit(2).count() < 2:
        return df.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    sign = [float(np.sign(loadings[np.abs(loadings[:, k]).argmax(), k]) or 1.0) for k in range(2)]
    at = vector_to_array("_p")
    return model.transform(centred).select(key, (at[0] * sign[0]).alias("x"), (at[1] * sign[1]).alias("y"))


def grasp_event(df: DataFrame, column: str, episode: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """The frame of the largest change of a signal, the first of equal ones."""
    w = Window.partitionBy(episode).orderBy(order)
    d = df.withColumn("_d", F.abs(F.col(column) - F.lag(column).over(w))).filter("_d IS NOT NULL")
    return d.groupBy(episode).agg(F.min_by(order, F.struct(-F.col("_d"), F.col(order))).alias("grasp_frame"), F.max("_d").alias("grasp_change"))


def kmeans(df: DataFrame, vector: str, clusters: int, rounds: int, seed: int = 7) -> DataFrame:
    """``df`` with the cluster of each vector, by Lloyd's rounds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=clusters, maxIter=rounds, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_v")
