"""Checks of frames, episodes and datasets before they are written or merged."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .temporal import EPISODE, ORDER

#: Columns that every dataset has beside its features (fixed values), and names of types of features.
DEFAULTS = ("timestamp", "frame_index", "episode_index", "index", "task_index")
TYPES: dict[str, T.DataType] = {
    "float32": T.FloatType(), "float64": T.DoubleType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(),
}


def storage_schema(features: dict[str, dict]) -> T.StructType:
    """P10: the columns that features (name: dtype, shape) are stored in: scalars for shape (1,), arrays for longer ones, nested for matrices, a struct for images."""

    def stored(feature: dict) -> T.DataType | None:
        if feature["dtype"] == "video":
            return None  # frames of a video lie in files of their own
        if feature["dtype"] == "image":
            return T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
        if feature["dtype"] not in TYPES:
            raise ValueError(f"no such type of feature: {feature['dtype']}")
        shape = tuple(feature.get("shape") or (1,))
        return TYPES[feature["dtype"]] if shape == (1,) else reduce(lambda inner, _: T.ArrayType(inner), shape, TYPES[feature["dtype"]])

    kept = ((name, stored(f)) for name, f in features.items())
    return T.StructType([T.StructField(name, kind) for name, kind in kept if kind is not None])


def schema_problems(frames: DataFrame, features: dict[str, dict], optional: tuple[str, ...] = ("timestamp",)) -> list[str]:
    """what is missing, extra or of another type among the columns of ``frames``; ``task`` is expected too."""
    expected = (set(features) - set(DEFAULTS)) | {"task"}
    have = {f.name: f.dataType for f in frames.schema.fields}
    extra = set(have) - expected - set(optional) - set(DEFAULTS)
    problems = [f"missing: {sorted(expected - set(have))}"] if expected - set(have) else []
    problems += [f"extra: {sorted(extra)}"] if extra else []
    wanted = {f.name: f.dataType for f in storage_schema(features).fields}
    for name in sorted(expected & set(have)):
        kind = wanted.get(name, T.StringType() if name == "task" else None)
        if kind is not None and have[name].simpleString() != kind.simpleString():
            problems.append(f"{name}: {have[name].simpleString()} instead of {kind.simpleString()}")
    return problems


def frame_problems(frames: DataFrame, features: dict[str, dict]) -> DataFrame:
    """episode_index, frame_index, problems of each frame with a null feature or task, or a vector of another shape."""

    def shape_of(column: Column, shape: tuple[int, ...]) -> Column:
        good = F.size(column) == shape[0]
        return good & F.forall(column, lambda inner: shape_of(inner, shape[1:])) if len(shape) > 1 else good

    found = [F.when(F.col("task").isNull(), F.lit("task: null"))] if "task" in frames.columns else []
    for name in sorted(set(features) & set(frames.columns) - set(DEFAULTS)):
        shape = tuple(features[name].get("shape") or (1,))
        wrong = F.when(F.col(name).isNull(), F.lit(f"{name}: null"))
        if shape != (1,) and features[name]["dtype"] in TYPES:
            wrong = wrong.when(~F.coalesce(shape_of(F.col(name), shape), F.lit(False)), F.concat(F.lit(f"{name}: length "), F.size(name).cast("string"), F.lit(f" instead of {'x'.join(map(str, shape))}")))
        found.append(wrong)
    return frames.select(EPISODE, ORDER, F.array_compact(F.array(*found)).alias("problems")).filter(F.size("problems") > 0)


def episode_problems(frames: DataFrame, next_episode: int) -> DataFrame:
    """episode_index and problems of each new episode: numbers that do not follow, a task that lacks, frames that do not count up from 0."""
    w = frames.groupBy(EPISODE).agg(F.count("*").alias("n"), F.min(ORDER).alias("lo"), F.max(ORDER).alias("hi"), F.count_distinct(ORDER).alias("distinct"), F.count("task").alias("tasks"))
    total = w.agg((F.count("*") + next_episode).alias("end"))
    checks = (
        F.when((F.col(EPISODE) < next_episode) | (F.col(EPISODE) >= F.col("end")), F.lit("episode_index does not follow")),
        F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("distinct") != F.col("n")), F.lit("frames do not count up from 0")),
        F.when(F.col("tasks") < F.col("n"), F.lit("task missing")),
    )
    return w.join(F.broadcast(total)).select(EPISODE, F.array_compact(F.array(*checks)).alias("problems")).filter(F.size("problems") > 0)


def check_mergeable(infos: list[dict]) -> None:
    """datasets go together if robot_type, fps and all features (type and shape) agree; else an error that names what does not."""
    told = lambda info: {name: (f["dtype"], tuple(f.get("shape") or ())) for name, f in info.get("features", {}).items()}
    wrong = []
    for k, info in enumerate(infos[1:], 1):
        wrong += [f"{key} of dataset {k}: {info.get(key)!r}, not {infos[0].get(key)!r}" for key in ("robot_type", "fps") if info.get(key) != infos[0].get(key)]
        a, b = told(infos[0]), told(info)
        wrong += [f"feature {name} of dataset {k}: {b.get(name)}, not {a.get(name)}" for name in sorted(set(a) | set(b)) if a.get(name) != b.get(name)]
    if wrong:
        raise ValueError("; ".join(wrong))


def version_status(version: str, current: str, strict: bool = True) -> str:
    """'current', 'old' (a smaller minor version) or, for a smaller major version, an error ('breaking' if not strict)."""
    parts = []
    for v in (version, current):
        found = re.fullmatch(r"v?(\d+)\.(\d+)(?:\.(\d+))?", v.strip())
        if not found:
            raise ValueError(f"no version: {v!r}")
        parts.append((int(found[1]), int(found[2])))
    if parts[0][0] < parts[1][0]:
        if strict:
            raise ValueError(f"version {version} came before a break: {current}")
        return "breaking"
    return "old" if parts[0][1] < parts[1][1] else "current"
