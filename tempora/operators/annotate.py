"""Boxes, detections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import EPISODE


def center(box: Column) -> tuple[Column, Column]:
    """M14."""
    return (box["left"] + box["right"]) / 2, (box["top"] + box["bottom"]) / 2


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["right"] - box["left"]) * F.greatest(F.lit(0.0), box["bottom"] - box["top"])


def to_pixels(box: Column, width: float, height: float) -> Column:
    """Boxes in 0-1, 0-1000 or pixels, in pixels inside the image; null if nothing is left."""
    most = F.greatest(box["left"], box["right"], box["top"], box["bottom"])
    scale = lambda n: F.when(most <= 1.0, n).when(most <= 1000.0, n / 1000.0).otherwise(1.0)
    clamp = lambda x, n: F.least(F.greatest(x * scale(n), F.lit(0.0)), F.lit(n))
    out = F.struct(clamp(box["left"], width).alias("left"), clamp(box["top"], height).alias("top"), clamp(box["right"], width).alias("right"), clamp(box["bottom"], height).alias("bottom"))
    return F.when((out["right"] > out["left"]) & (out["bottom"] > out["top"]), out)


def closest_pair(targets: DataFrame, references: DataFrame, direction: Column) -> DataFrame:
    """Of each episode the target detection nearest to a reference on the given side of it.

    Both sides hold episode_index, det, x, y; an episode has a handful of detections, so its pairs are few.
    """
    r = references.select(EPISODE, F.col("det").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = targets.join(r, EPISODE).withColumn("dir", direction)
    side = F.when(F.col("dir") == "left", F.col("x") < F.col("rx")).when(F.col("dir") == "right", F.col("x") > F.col("rx")).otherwise(F.lit(True))
    d = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)
    return pairs.filter(side).withColumn("distance", d).groupBy(EPISODE).agg(F.min_by(F.struct("det", "ref"), F.struct("distance", "det", "ref")).alias("best"), F.min("distance").alias("distance")).select(EPISODE, "best.det", "best.ref", "distance")


def missing_from_vocabulary(df: DataFrame, present: str, vocabulary: list[str]) -> DataFrame:
    """What each row lacks of a closed vocabulary."""
    return df.withColumn("missing", F.array_except(F.array(*(F.lit(v) for v in sorted(vocabulary))), present))


def heatmap(df: DataFrame, x: str, y: str, grid: int) -> DataFrame:
    """Counts in a grid over the extent of the points, y upwards."""
    span = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    scaled = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * grid), F.lit(grid - 1))).otherwise(0)
    cells = df.join(F.broadcast(span)).select(scaled(x, "_x0", "_x1").alias("px"), (grid - 1 - scaled(y, "_y0", "_y1")).alias("py"))
    return cells.groupBy("px", "py").agg(F.count("*").alias("n"))
