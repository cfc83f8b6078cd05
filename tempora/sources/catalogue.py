"""Which datasets and cached tables there are, and what the names of their columns mean; listings and schemas only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_slug
from ..operators.temporal import EPISODE

#: Columns that are no signal (fixed values), and where a dataset's info lies below its folder.
NO_SIGNAL = ("timestamp", "frame_index", "episode_index", "index", "task_index", "subtask_state")
INFO = "meta/info.json"


def discovered(spark: SparkSession, root: str, registry: DataFrame | None = None) -> DataFrame:
    """Path, name, fps, robot_type, total_episodes and total_frames of each dataset below a folder; with ``registry`` (path, ...), what it says of them.

    A dataset is a folder that holds meta/info.json. Files are found and read by Spark's reader.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "info.json").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "fps double, robot_type string, total_episodes long, total_frames long").alias("i")).filter(F.col("file").endswith("/" + INFO))
    path = F.regexp_replace(F.col("file"), "/" + re.escape(INFO) + "$", "")
    found = files.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), "i.*")
    return found.join(registry, "path", "left") if registry is not None else found


def cached_csv(spark: SparkSession, root: str) -> DataFrame:
    """File and every (the n of _dsN in its name) of the cached table of each episode, the least thinned one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "episode_*.csv").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"))
    told = files.select("file", F.regexp_extract("file", r"episode_(\d+)", 1).cast("long").alias(EPISODE), F.coalesce(F.nullif(F.regexp_extract("file", r"_ds(\d+)\.csv$", 1), F.lit("")).try_cast("long"), F.lit(10**9)).alias("every"))
    return told.groupBy(EPISODE).agg(F.min_by("file", F.struct("every", "file")).alias("file"), F.min("every").alias("every"))


def component_names(feature: dict):
    """The names that a feature states for its components, out of any groups around them."""
    names = feature.get("names")
    while isinstance(names, dict) and names:
        names = next(iter(names.values()))
    return names


def signal_columns(features: dict[str, dict]) -> dict[str, list[str]]:
    """The features that are plotted (numbers of rank 0 or 1, the marks of time and state aside) with the names of their components."""
    out = {}
    for name, f in features.items():
        shape = tuple(f.get("shape") or (1,))
        numeric = f["dtype"] in ("float32", "int32") or (name == "exist_label" and f["dtype"].startswith(("int", "float", "bool")))
        if numeric and len(shape) <= 1 and name not in NO_SIGNAL:
            names = component_names(f)
            out[name] = [f"{name}_{n}" for n in names] if names and len(names) == shape[0] else [name] if shape == (1,) else [f"{name}_{k}" for k in range(shape[0])]
    return out


def vector_groups(columns: list[str]) -> dict[str, list[str]]:
    """Columns of a flat table by the vector that they are components of: what stands before a last _ and a number or name that several share."""
    heads: dict[str, list[str]] = {}
    for c in columns:
        if c not in NO_SIGNAL:
            heads.setdefault(c.rsplit("_", 1)[0] if re.search(r"_\d+$", c) else c, []).append(c)
    return heads


def existence_columns(columns: list[str], feature: dict | None) -> tuple[list[str], str]:
    """The columns of existence labels and where the names come from.

    In order: exist_label and what begins with it if the feature is known; the names that it states; numbered ones; then
    exist_label by any spelling without the feature; then anything with 'exist' in it.
    """
    by_slug = {label_slug(c): c for c in columns}
    prefixed = [c for c in columns if c != "exist_label" and label_slug(c).startswith("exist_label_")]
    if feature is not None:
        explicit = [c for c in columns if c == "exist_label"] + prefixed
        stated = [by_slug[s] for s in (label_slug(str(n)) for n in component_names(feature) or []) if s in by_slug]
        shape = feature.get("shape") or [0]
        numbered = [f"exist_label_{k}" for k in range(int(shape if isinstance(shape, int) else shape[0])) if f"exist_label_{k}" in columns]
        for found in (explicit, stated, numbered):
            if found:
                return found, "exist_label"
    spelled = [c for c in columns if label_slug(c) == "exist_label"] + [c for c in columns if label_slug(c).startswith("exist_label_")]
    legacy = [c for c in columns if "exist" in c.lower()]
    return (spelled, "exist_label") if spelled else (legacy, "legacy_exist" if legacy else "missing")


def exists_not(frames: DataFrame, label: str) -> DataFrame:
    """The episodes whose first frame says that nothing is there: label 0, or a list of nothing but zeros."""
    kind = frames.schema[label].dataType.typeName()
    zero = F.coalesce((F.size(label) > 0) & F.forall(label, lambda x: F.coalesce(x.cast("int") == 0, F.lit(False))), F.lit(False)) if kind == "array" else F.coalesce(F.col(label).try_cast("int") == 0, F.lit(False))
    return frames.filter(F.col("frame_index") == 0).filter(zero).select(EPISODE)


def served_csv(rows: DataFrame, gripper: list[str], limit: float = 1.5) -> DataFrame:
    """A cached table as it is served: no subtask_state columns, gripper cells in 0 to 1, exist_label_0 as exist_label."""
    out = rows.drop(*(c for c in rows.columns if c.startswith("subtask_state")))
    cell = lambda c: F.when(F.abs(F.col(c).cast("double")) > limit, F.col(c).cast("double") / 100).otherwise(F.col(c).cast("double"))
    out = out.withColumns({c: cell(c) for c in gripper})
    return out.withColumnRenamed("exist_label_0", "exist_label") if "exist_label" not in out.columns else out


def axis_of(name: str) -> str | None:
    """X, y or z, if a part of the name is it."""
    parts = re.split(r"[^a-z0-9]+", name.lower())
    return next((p for p in parts if p in ("x", "y", "z")), None)


def xy_places(names: list[str]) -> tuple[int, int] | None:
    """The places of the first x and the first y component that follow one another by name, or None."""
    axes = [axis_of(n) for n in names]
    for i, a in enumerate(axes):
        if a == "x":
            rest = re.sub(r"(^|[^a-z0-9])x([^a-z0-9]|$)", r"\1y\2", names[i].lower())
            for j, b in enumerate(axes):
                if b == "y" and names[j].lower() == rest:
                    return i, j
    return (axes.index("x"), axes.index("y")) if "x" in axes and "y" in axes else None


def trajectory(frames: DataFrame, vector: str, names: list[str], points: int = 160) -> DataFrame:
    """episode_index, frame_index, x, y of at most ``points`` evenly strided frames of each episode, from the components whose names say x and y."""
    from ..operators.temporal import at_most_points

    places = xy_places(names)
    if places is None:
        raise ValueError(f"no x and y among {names}")
    cut = at_most_points(frames, points)
    return cut.select(EPISODE, "frame_index", F.col(vector)[places[0]].alias("x"), F.col(vector)[places[1]].alias("y"))


def busier_arm(frames: DataFrame, left: list[Column], right: list[Column]) -> DataFrame:
    """The arm whose signals vary most in each episode: the larger sum of population standard deviations, left if equal."""
    total = lambda cs: sum((F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    each = frames.groupBy(EPISODE).agg(total(left).alias("left_score"), total(right).alias("right_score"))
    return each.withColumn("arm", F.when(F.col("right_score") > F.col("left_score"), "right").otherwise("left"))
