"""Episodic datasets on any Hadoop path: frames partitioned by chunks of episodes, with small JSON tables beside them."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.written import shared_folder

MANDATORY = {"timestamp": T.FloatType(), "frame_index": T.LongType(), "episode_index": T.LongType(), "index": T.LongType(), "task_index": T.LongType()}
CHUNK = 1000
#: Folders of a table, at most: the chunks of larger datasets are wider.
FOLDERS = 256
POINTER = "number long, version string, info string, schema string, parts string"
STATS = "episode_index long, feature string, dim int, min double, max double, mean double, std double, count long"


@dataclass
class EpisodicDataset:
    """Frames (facts), episodes (episode_index, tasks, length), tasks (task_index, task), and info (fps, robot_type, ...)."""

    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    info: dict = field(default_factory=dict)
    #: Episode numbers that a chunk covers, of a dataset that was read as it was written.
    chunk: int = CHUNK

    def with_task(self) -> DataFrame:
        """Frames with the text of their task (J01, P13): an equi-join, broadcast by Spark while the dictionary is small."""
        return self.frames.join(self.tasks, "task_index")

    def totals(self) -> DataFrame:
        """One row of recounted metadata."""
        e = self.episodes.agg(F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames"))
        return e.crossJoin(self.tasks.agg(F.count("*").alias("total_tasks"))).withColumn("total_chunks", F.ceil(F.col("total_episodes") / self.chunk))


def write(data: EpisodicDataset, path: str, version: str) -> None:
    """A new version is written beside the old ones, then a line that names it is added; readers take the last line.

    The line's file appears in one step and nothing is deleted, so readers see a whole version at any time, also if the
    writer dies in between. One writer at a time.
    """
    ends = data.frames.agg(F.min("episode_index"), F.max("episode_index")).first()
    width, n = chunk_width(*ends)
    chunked = data.frames.withColumn("episode_chunk", _chunk(width))
    chunked.repartition(n, "episode_chunk").sortWithinPartitions("episode_index", "frame_index").write.mode("overwrite").partitionBy("episode_chunk").parquet(f"{path}/{version}/frames")
    data.episodes.write.mode("overwrite").json(f"{path}/{version}/episodes")
    data.tasks.write.mode("overwrite").json(f"{path}/{version}/tasks")
    spark = data.frames.sparkSession
    last = latest(spark, f"{path}/versions", POINTER)
    # the frames' schema goes along: a version without frames has no file to infer it from
    append_row(spark, f"{path}/versions", POINTER, (last.number + 1 if last else 0, version, json.dumps(data.info, sort_keys=True), chunked.schema.json(), json.dumps({"frames": [[version, []]], "stats": [], "tables": version, "chunk": width})))


def chunk_width(first: int | None, last: int | None, width: int = CHUNK, folders: int = FOLDERS) -> tuple[int, int]:
    """How many episode numbers a chunk covers, ``width`` or twice, four times, ... as many, and how many chunks there may be: ``folders`` at most, so that files grow with the data, not their number."""
    if first is None:
        return width, 1
    while last // width - first // width >= folders:
        width *= 2
    return width, last // width - first // width + 1


def append_row(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    """One more line of a table of JSON lines."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(path)


def latest(spark: SparkSession, path: str, schema: str, by: str = "number") -> Row | None:
    """The line with the largest number; None if there is no table yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).json(path).orderBy(F.desc(by)).first()


def parts_of(row: Row) -> dict:
    """Where a version's tables lie: folders of frames and statistics, each without the chunks that later ones hold; the folder of the other tables."""
    told = json.loads(row.parts) if row.parts else {"frames": [[row.version, []]], "stats": [], "tables": row.version}
    return {"chunk": CHUNK} | told


def pieces(spark: SparkSession, path: str, kind: str, folders: list, schema: T.StructType) -> DataFrame:
    """The chunks of all folders; those that a later folder holds are pruned, columns that an earlier one lacks are null."""
    out = spark.createDataFrame([], schema)
    for folder, without in folders:
        rows = spark.read.schema(schema).parquet(f"{path}/{folder}/{kind}")
        out = out.unionByName(rows.filter(~F.col("episode_chunk").isin(without)) if without else rows)
    return out


def read(spark: SparkSession, path: str, episodes: list[int] | None = None) -> EpisodicDataset:
    """The version that the pointer names; of listed episodes only their chunks are read (partition pruning)."""
    row = latest(spark, f"{path}/versions", POINTER)
    parts = parts_of(row)
    frames = pieces(spark, path, "frames", parts["frames"], T.StructType.fromJson(json.loads(row.schema)))
    table = spark.read.schema("episode_index long, tasks array<string>, length long").json(f"{path}/{parts['tables']}/episodes")
    if episodes is not None:
        frames = frames.filter(F.col("episode_chunk").isin(sorted({e // parts["chunk"] for e in episodes})) & F.col("episode_index").isin(episodes))
        table = table.filter(F.col("episode_index").isin(episodes))
    tasks = spark.read.schema("task_index long, task string").json(f"{path}/{parts['tables']}/tasks")
    return EpisodicDataset(frames.drop("episode_chunk"), table, tasks, json.loads(row.info), parts["chunk"])


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of episodes that the newest version has."""
    return pieces(spark, path, "stats", parts_of(latest(spark, f"{path}/versions", POINTER))["stats"], _stats_schema()).drop("episode_chunk")


def _stats_schema() -> T.StructType:
    return T.StructType.fromDDL(STATS + ", episode_chunk long")


def _chunk(width: int) -> Column:
    return F.floor(F.col("episode_index") / width)


def write_back(spark: SparkSession, path: str, version: str, values: DataFrame, scanned: DataFrame, features: dict[str, dict] | None = None) -> list[int]:
    """New columns of the frames of scanned episodes, with their statistics; returns the chunks that were written.

    values: episode_index, frame_index and the columns; frames of scanned episodes that have no row there get nulls, other
    episodes keep what they have. Only the chunks of scanned episodes are written, to a folder of this version; all other
    files stay as they are, and the line that names the version is added last. So a run that fails leaves the version
    before, and may be repeated; one that has come to its end changes nothing when it is repeated.
    """
    last = latest(spark, f"{path}/versions", POINTER)
    parts = parts_of(last)
    keys = ["episode_index", "frame_index"]
    names = [c for c in values.columns if c not in keys]
    if last.version == version:
        return next((without for _, without in parts["frames"] if without), [])
    who = scanned.select("episode_index").distinct()
    chunks = sorted(r[0] for r in who.select(_chunk(parts["chunk"])).distinct().collect())  # as many as there are folders
    schema = T.StructType.fromJson(json.loads(last.schema))
    now = pieces(spark, path, "frames", parts["frames"], schema).filter(F.col("episode_chunk").isin(chunks))
    marked = now.join(who.withColumn("_scanned", F.lit(True)), "episode_index", "left").join(values.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in names)), keys, "left")
    old = lambda c: F.col(c) if c in schema.names else F.lit(None)
    changed = marked.withColumns({c: F.when(F.col("_scanned"), F.col(f"_new_{c}")).otherwise(old(c)) for c in names}).drop("_scanned", *(f"_new_{c}" for c in names))
    changed.repartition(max(1, len(chunks)), "episode_chunk").sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("episode_chunk").parquet(f"{path}/{version}/frames")
    # statistics of what was written, and of these chunks' other features and episodes as they were
    numbers = [f.name for f in values.schema.fields if f.name in names and isinstance(f.dataType, T.NumericType)]
    x = lambda c: F.col(c).cast("double")
    own = lambda c: F.struct(F.lit(c).alias("feature"), F.lit(0).alias("dim"), F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), F.avg(x(c)).alias("mean"), F.stddev_pop(x(c)).alias("std"), F.count(c).alias("count"))
    fresh = spark.createDataFrame([], STATS)
    if numbers:
        each = values.join(who, "episode_index", "left_semi").groupBy("episode_index").agg(*(own(c).alias(f"_{c}") for c in numbers))
        fresh = each.select("episode_index", F.explode(F.array(*(f"_{c}" for c in numbers))).alias("_s")).select("episode_index", "_s.*").filter("count > 0")
    before = pieces(spark, path, "stats", parts["stats"], _stats_schema()).filter(F.col("episode_chunk").isin(chunks)).drop("episode_chunk")
    mine = who.crossJoin(spark.createDataFrame([(c,) for c in names], "feature string"))  # a few names
    stats = before.join(mine, ["episode_index", "feature"], "left_anti").unionByName(fresh)
    stats.withColumn("episode_chunk", _chunk(parts["chunk"])).repartition(max(1, len(chunks)), "episode_chunk").sortWithinPartitions("episode_index", "feature").write.mode("overwrite").partitionBy("episode_chunk").parquet(f"{path}/{version}/stats")
    less = lambda folders: [[f, sorted({*w, *chunks})] for f, w in folders] + [[version, []]]
    told = json.dumps({"frames": less(parts["frames"]), "stats": less(parts["stats"]), "tables": parts["tables"], "chunk": parts["chunk"]})
    info = json.loads(last.info)
    info["features"] = info.get("features", {}) | (features or {})
    new = T.StructType([*(f for f in schema.fields if f.name not in names), *(f for f in changed.schema.fields if f.name in names)])
    append_row(spark, f"{path}/versions", POINTER, (last.number + 1, version, json.dumps(info, sort_keys=True), new.json(), told))
    return chunks


class SidecarTable:
    """A table of records of episodes beside a dataset, in the order of ``order``; a change writes a new version and then a line that names it."""

    POINTER = "number long, version string"

    def __init__(self, spark: SparkSession, path: str, schema: str, order: list[str]):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order

    def read(self) -> DataFrame:
        row = latest(self.spark, f"{self.path}/versions", self.POINTER)
        return self.spark.read.schema(self.schema).json(f"{self.path}/{row.version}") if row else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: str) -> None:
        """All rows, sorted through all files; a version that stands is not written again."""
        last = latest(self.spark, f"{self.path}/versions", self.POINTER)
        if last and last.version == version:
            return
        rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.mode("overwrite").json(f"{self.path}/{version}")
        append_row(self.spark, f"{self.path}/versions", self.POINTER, (last.number + 1 if last else 0, version))

    def replace_scanned(self, new: DataFrame, scanned: DataFrame | None, version: str, of: Column | None = None) -> None:
        """Records of scanned episodes (None: all) that satisfy ``of`` go, the new ones come; all others stay."""
        of = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
        old = self.read().withColumn("_of", of)
        if scanned is None:
            kept = old.filter(~F.col("_of"))
        else:
            gone = scanned.select("episode_index").distinct().withColumn("_gone", F.lit(True))
            kept = old.join(gone, "episode_index", "left").filter(F.col("_gone").isNull() | ~F.col("_of")).drop("_gone")
        columns = self.read().columns
        self.write(kept.select(*columns).unionByName(new.select(*columns)), version)

    def add_missing(self, new: DataFrame, version: str, overwrite: bool = False) -> None:
        """Records of episodes that have none yet, or with ``overwrite`` of all episodes of ``new``."""
        old, columns = self.read(), self.read().columns
        names = lambda df: df.select("episode_index").distinct()
        if overwrite:
            old = old.join(names(new), "episode_index", "left_anti")
        else:
            new = new.join(names(old), "episode_index", "left_anti")
        self.write(old.unionByName(new.select(*columns)), version)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines; malformed ones are skipped, partly malformed ones too, and of each key the last line of the last file counts.

    Lines are in the order of their file's path, of the part of the file, and of the lines in it.
    """
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_block"), F.desc("_at")))
    return rows.filter(F.col(key).isNotNull() & F.col("_bad").isNull()).withColumn("_last", last).filter("_last = 1").drop("_file", "_block", "_at", "_last", "_bad")


def head(frames: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The first frames of each episode; the filter and the columns reach the scan."""
    return frames.filter(F.col("frame_index") < rows).select(*columns)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Datasets one after the other, on their common columns, with dataset_index."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = None
    for k, part in enumerate(parts):
        rows = part.select(*common, F.lit(k).alias("dataset_index"))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_csv(frames: DataFrame, vectors: dict[str, int], path: str, every: int = 1, scalars: list[str] | None = None, folders: int | None = FOLDERS) -> None:
    """Vectors flattened to columns, scalars as they are, every n-th frame, rows in the order of time.

    Up to ``folders`` episodes have a folder each, episode_index=3. Of more episodes, those whose numbers are near share a
    folder, first_episode=40, named by the least number that it may hold: their rows lie in one file, episode after episode,
    with episode_index as its last column, so that files grow with the data, not their number. Either way a schema that ends
    with episode_index reads them. None: a folder for each episode, however many they are.

    Tasks move their own files into place (Hadoop's second commit algorithm), as the folders may be too many for the driver
    to move one by one; Spark's _SUCCESS file says that all are there.
    """
    flat = frames.filter(F.col("frame_index") % every == 0)
    cells = [F.col(v)[i].alias(f"{v}_{i}") for v, n in vectors.items() for i in range(n)]
    flat, by = flat.select("timestamp", *cells, *(scalars or []), "episode_index"), "episode_index"
    if folders is not None:
        first, last, n = frames.agg(F.min(by), F.max(by), F.countDistinct(by)).first()
        if n > folders:
            width, _ = chunk_width(first, last, 1, folders)
            flat, by = flat.withColumn("first_episode", _chunk(width) * width), "first_episode"
    flat.repartition(by).sortWithinPartitions(*dict.fromkeys((by, "episode_index", "timestamp"))).write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).csv(path, header=True)


def manifest(episodes: DataFrame) -> DataFrame:
    """One JSON text for each chunk of episodes."""
    row = F.struct("episode_index", "length", "tasks")
    return episodes.groupBy(F.floor(F.col("episode_index") / CHUNK).alias("chunk")).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("manifest"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one use, below the one that spark.checkpoint.dir names; in one process a temporary one serves."""
    return f"{shared_folder(spark) or tempfile.mkdtemp(prefix='scratch-')}/{name}-{uuid.uuid4().hex}"


def created(spark: SparkSession, fps: float, robot_type: str, features: dict[str, dict]) -> EpisodicDataset:
    """An empty dataset; names of features hold no /, and the columns that every dataset has are added to them."""
    wrong = [n for n in features if "/" in n]
    if wrong:
        raise ValueError(f"names of features hold no /: {wrong}")
    from ..operators.validate import storage_schema

    stored = storage_schema({n: f for n, f in features.items() if n not in MANDATORY})
    schema = T.StructType([*stored.fields, *(T.StructField(n, t) for n, t in MANDATORY.items())])
    empty = lambda s: spark.createDataFrame([], s)
    info = {"fps": fps, "robot_type": robot_type, "features": features, "total_episodes": 0, "total_frames": 0, "total_tasks": 0, "total_chunks": 0, "chunks_size": CHUNK}
    return EpisodicDataset(empty(schema), empty("episode_index long, tasks array<string>, length long"), empty("task_index long, task string"), info)
