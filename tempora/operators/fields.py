"""Fields of a dataset: dropping, trimming, standardising, and the statistics and metadata that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .algebra import delete, fix_indices
from .quality import rescale_gripper
from .segment import stage_values
from .stats import vector_stats
from .temporal import EPISODE, ORDER, moving_average

#: Last parts of the names of depth fields (fixed values), and the width that vectors are standardised to.
DEPTH = ("head_depth", "left_wrist_depth", "right_wrist_depth")
WIDTH = 16


def drop_field(frames: DataFrame, features: dict, stats: DataFrame, name: str) -> tuple[DataFrame, dict, DataFrame]:
    """Frames, features and statistics (episode_index, feature, ...) without a field; an unknown one is an error."""
    if name not in features and name not in frames.columns:
        raise ValueError(f"no field {name!r}")
    return frames.drop(name), {k: v for k, v in features.items() if k != name}, stats.filter(F.col("feature") != name)


def widths(frames: DataFrame, vectors: list[str]) -> dict[str, int]:
    """The width of each vector; several widths in one column are an error that names them."""
    row = frames.agg(*(F.sort_array(F.collect_set(F.size(v))).alias(v) for v in vectors)).first()
    mixed = {v: row[v] for v in vectors if len(row[v]) > 1}
    if mixed:
        raise ValueError(f"vectors of several widths: {mixed}")
    return {v: row[v][0] for v in vectors if row[v]}


def trimmed(frames: DataFrame, vectors: list[str], width: int) -> DataFrame:
    """The first ``width`` components, of vectors and of each vector in lists of them; shorter ones are an error."""

    def cut(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind.elementType, T.ArrayType):
            return F.transform(column, lambda x: cut(x, kind.elementType))
        short = F.raise_error(F.concat(F.lit("vector of width "), F.size(column).cast("string"), F.lit(f" cannot be cut to {width}")))
        return F.when(F.size(column) == 0, column).when(F.size(column) < width, short.cast(kind)).otherwise(F.slice(column, 1, width))

    return frames.withColumns({v: cut(F.col(v), frames.schema[v].dataType) for v in vectors})


def standardized(frames: DataFrame, features: dict, vectors: list[str], gripper: int | None = None, width: int = WIDTH) -> tuple[DataFrame, dict]:
    """No depth fields, gripper components in 0 to 1, vectors cut to ``width``, exist_label 1 where there is none."""
    depth = [c for c in frames.columns if c.replace("/", ".").split(".")[-1] in DEPTH]
    out = frames.drop(*depth)
    if gripper is not None:
        for v in vectors:
            out = rescale_gripper(out.withColumn("_g", F.col(v)[gripper]), "_g")
            out = out.withColumn(v, F.transform(v, lambda x, i: F.when(i == gripper, F.col("_g")).otherwise(x))).drop("_g")
    out = trimmed(out, vectors, width)
    told = {k: dict(f) for k, f in features.items() if k not in depth}
    for v in vectors:
        told[v] = told.get(v, {"dtype": "float32"}) | {"shape": [width]}
    if "exist_label" not in out.columns:
        out, told = out.withColumn("exist_label", F.lit(1).cast("long")), told | {"exist_label": {"dtype": "int64", "shape": [1]}}
    return out, told


def standardized_in_steps(frames: DataFrame, features: dict, vectors: list[str], bounds: DataFrame, deleted: DataFrame | None = None, gripper: int | None = None, width: int = WIDTH) -> tuple[DataFrame, dict]:
    """Standardised, stages written for the episodes that have boundaries, listed episodes deleted, numbers and times repaired."""
    out, told = standardized(frames, features, vectors, gripper, width)
    states = stage_values(out, bounds)
    out = out.drop("subtask_state").join(states, [EPISODE, ORDER], "left")
    if deleted is not None:
        out = delete(out, deleted).drop("old_episode", "index")
    return fix_indices(out), told | {"subtask_state": {"dtype": "int32", "shape": [1]}}


def upserted(frames: DataFrame, name: str, values: Column) -> DataFrame:
    """A column replaced in its place, or added at the end."""
    return frames.withColumn(name, values)


def changed_stats(old: DataFrame, frames: DataFrame, vectors: dict[str, int]) -> DataFrame:
    """Statistics (episode_index, feature, dim, ...) with those of changed vectors counted anew; other features keep theirs."""
    rows = None
    for name, width in vectors.items():
        new = vector_stats(frames, name, width, EPISODE).select(EPISODE, F.lit(name).alias("feature"), "dim", "min", "max", "mean", "std", "count")
        rows = new if rows is None else rows.unionByName(new)
    return old.filter(~F.col("feature").isin(*vectors)).unionByName(rows)


def smoothed(frames: DataFrame, vector: str, width: int, window: int) -> DataFrame:
    """T09 for each component of a vector."""
    out = frames
    for k in range(width):
        out = moving_average(out.withColumn(f"_x{k}", F.col(vector)[k]), f"_x{k}", window, f"_y{k}").drop(f"_x{k}")
    return out.withColumn(vector, F.array(*(f"_y{k}" for k in range(width)))).drop(*(f"_y{k}" for k in range(width)))


def updated_features(info: dict, new: dict[str, dict]) -> dict:
    """The info of a dataset with features added or replaced."""
    return info | {"features": info.get("features", {}) | new}


def counted_lengths(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Episodes with their lengths counted from the frames; 0 without any."""
    n = frames.groupBy(EPISODE).agg(F.count("*").alias("_n"))
    return episodes.drop("length").join(n, EPISODE, "left").withColumn("length", F.coalesce("_n", F.lit(0))).drop("_n")


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested fields as columns a/b/c."""

    def leaves(path: list[str], kind: T.DataType) -> list[list[str]]:
        return [x for f in kind.fields for x in leaves([*path, f.name], f.dataType)] if isinstance(kind, T.StructType) else [path]

    paths = [x for f in df.schema.fields for x in leaves([f.name], f.dataType)]
    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in paths))


def unflattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns a/b/c as nested fields, in the order in which their first parts come."""
    tree: dict = {}
    for c in df.columns:
        node, *rest = tree, *c.split(sep)
        for part in rest[:-1]:
            node = node.setdefault(part, {})
        node[rest[-1]] = F.col(f"`{c}`")

    def built(node: dict) -> list[Column]:
        return [(F.struct(*built(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*built(tree))


def nested_item(df: DataFrame, path: str, sep: str = "/") -> Column:
    """The field that a path leads to."""
    return df[".".join(f"`{p}`" for p in path.split(sep))]


STATS_JSON = "struct<min:array<double>,max:array<double>,mean:array<double>,std:array<double>,count:array<bigint>>"


def stats_to_json(stats: DataFrame) -> DataFrame:
    """episode_index, feature and the statistics of all components as JSON text."""
    names = ("min", "max", "mean", "std")
    # one sorted list for each group, taken apart afterwards
    rows = stats.groupBy(EPISODE, "feature").agg(F.array_sort(F.collect_list(F.struct("dim", *names))).alias("_s"), F.array(F.max("count")).alias("count"))
    at = lambda c: F.transform("_s", lambda x: x[c]).alias(c)
    held = rows.select(EPISODE, "feature", *(at(c) for c in names), "count")
    return held.select(EPISODE, "feature", F.to_json(F.struct("min", "max", "mean", "std", "count")).alias("stats"))


def stats_from_json(rows: DataFrame) -> DataFrame:
    """P12, the other way."""
    x = F.col("_x")
    cells = F.arrays_zip(x["min"].alias("min"), x["max"].alias("max"), x["mean"].alias("mean"), x["std"].alias("std"))
    # parsed once; outer, as Spark would parse all once more to see whether a list is empty
    cells = rows.select(EPISODE, "feature", F.from_json("stats", STATS_JSON).alias("_x")).select(EPISODE, "feature", x["count"][0].alias("count"), F.posexplode_outer(cells).alias("dim", "x"))
    return cells.filter("dim is not null").select(EPISODE, "feature", "dim", "x.*", "count")


def image_constants(stats: DataFrame, features: list[str], mean: list[float], std: list[float]) -> DataFrame:
    """The mean and std of image features replaced by constants of each channel."""
    rows = [(k, float(m), float(s)) for k, (m, s) in enumerate(zip(mean, std, strict=True))]
    fixed = stats.sparkSession.createDataFrame(rows, "dim int, _m double, _s double")
    image = F.col("feature").isin(*features)
    out = stats.join(F.broadcast(fixed), "dim", "left")
    return out.withColumns({"mean": F.when(image, F.col("_m")).otherwise(F.col("mean")), "std": F.when(image, F.col("_s")).otherwise(F.col("std"))}).drop("_m", "_s").select(*stats.columns)


def beyond_tolerance(stats: DataFrame, reference: DataFrame, keys: list[str], values: list[str], rtol: float = 5e-6, atol: float = 6e-5) -> DataFrame:
    """Keys, name, value and reference of the statistics that differ from the reference by more than atol + rtol * |reference|."""
    x = lambda t, side: t.select(*keys, *(F.col(v).cast("double").alias(f"_{side}{k}") for k, v in enumerate(values)))
    both = x(stats, "a").join(x(reference, "b"), keys)
    # rows that differ nowhere go before names multiply them
    far = lambda a, b: F.abs(a - b) > atol + rtol * F.abs(b)
    any_far = F.lit(False)
    for k in range(len(values)):
        any_far = any_far | F.coalesce(far(F.col(f"_a{k}"), F.col(f"_b{k}")), F.lit(False))
    pair = lambda k, v: F.struct(F.lit(v).alias("name"), F.col(f"_a{k}").alias("value"), F.col(f"_b{k}").alias("reference"))
    found = both.filter(any_far).select(*keys, F.explode(F.array(*(pair(k, v) for k, v in enumerate(values)))).alias("_"))
    return found.select(*keys, "_.name", "_.value", "_.reference").filter(far(F.col("value"), F.col("reference")))
