"""Sources, sinks, streams and the operators that SQL does not express."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import algebra, sampling, temporal
from tempora.sources import dataset as ds
from tempora.streaming import ingest


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(e, f, f / 10, e * 3 + f, e % 2, float(f)) for e, n in ((0, 2), (1, 3), (2500, 4)) for f in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, index long, task_index long, value double")


def test_dataset_round_trip(spark, frames, tmp_path):
    episodes = frames.groupBy("episode_index").agg(F.array(F.lit("t")).alias("tasks"), F.count("*").alias("length"))
    tasks = spark.createDataFrame([(0, "Pick up the cube"), (1, "Give the cube to me")], "task_index long, task string")
    data = ds.EpisodicDataset(frames, episodes, tasks, {"fps": 10})
    ds.write(data, str(tmp_path), "v1")
    back = ds.read(spark, str(tmp_path))
    assert back.info == {"fps": 10} and sorted(back.frames.collect()) == sorted(frames.collect())
    assert ds.read(spark, str(tmp_path), [2500]).frames.count() == 4
    assert back.with_task().filter("episode_index = 1").first().task == "Give the cube to me"
    assert tuple(back.totals().first()) == (3, 9, 2, 1)
    ds.write(ds.EpisodicDataset(frames.limit(0), episodes.limit(0), tasks, {"fps": 5}), str(tmp_path), "v2")
    assert ds.read(spark, str(tmp_path)).info == {"fps": 5}
    ds.export_csv(frames, {}, f"{tmp_path}/csv", 2)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 5
    assert ds.manifest(episodes).count() == 2
    both = ds.concatenated([frames, frames.drop("value")])
    assert both.columns == [c for c in frames.columns if c != "value"] + ["dataset_index"] and both.count() == 18


def test_tolerant_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"episode_index": 1, "task": "x"}\nnot json\n{"episode_index": 1, "task": "y"}\n{"episode_index": 2, "task": "z"}\n')
    got = ds.read_jsonl(spark, str(tmp_path / "a.jsonl"), "episode_index long, task string", "episode_index").collect()
    assert sorted((r.episode_index, r.task) for r in got) == [(1, "y"), (2, "z")]


def test_algebra(spark, frames):
    cut = algebra.split(frames, F.col("episode_index") == 1)
    assert [(r.episode_index, r["index"]) for r in cut.orderBy("frame_index").collect()] == [(0, 0), (0, 1), (0, 2)]
    cut = cut.drop("old_episode")
    twice = algebra.merge([cut, cut]).orderBy("index").collect()
    assert [(r.episode_index, r["index"]) for r in twice] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]
    rest = algebra.subtract(frames, frames.filter("episode_index = 1").withColumn("episode_index", F.lit(77).cast("long")), ["value", "timestamp"])
    assert {r.episode_index for r in rest.collect()} == {0, 2500}
    smooth = temporal.moving_average(frames.filter("episode_index = 1"), "value", 3).orderBy("frame_index").collect()
    assert np.allclose([r.smooth for r in smooth], [1 / 3, 1, 5 / 3])
    with pytest.raises(ValueError):
        temporal.moving_average(frames, "value", 4)


def test_balanced(spark):
    rows = [(e, "s", "a" if e < 8 else "b") for e in range(10)]
    table = spark.createDataFrame(rows, "episode_index long, scenario string, kind string")
    got = sampling.balanced(table, "scenario", 4, ["kind"], ["episode_index"]).orderBy("pick").collect()
    assert [r.episode_index for r in got] == [0, 8, 1, 9]


def test_streams(spark, tmp_path):
    schema = "episode_index long, seq long, value double, last boolean"
    for k, rows in enumerate([[(1, 0, 1.0, False), (2, 1, 5.0, False), (1, 2, 2.0, False)], [(1, 3, 3.0, True), (2, 4, 6.0, False)], [(1, 5, 9.0, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest.run_to(ingest.record(stream, 10), f"{tmp_path}/recorded")
    got = sorted((r.episode_index, r.frame_index, r.value) for r in spark.read.parquet(f"{tmp_path}/recorded/out").collect())
    assert len(got) == 6 and {(e, f) for e, f, _ in got} >= {(1, 0), (1, 1), (2, 0), (2, 1)}
    buffer = ingest.FifoBuffer(spark, f"{tmp_path}/fifo", 4)
    q = buffer.sink(stream, ["seq"], f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    kept = buffer.read().orderBy("index").collect()
    assert [(r["index"], r.slot) for r in kept] == [(2, 2), (3, 3), (4, 0), (5, 1)]
    buffer.add(spark.createDataFrame([(9, 9, 9.0, False)], schema), 0, ["seq"])  # a batch that was applied before
    assert buffer.read().count() == 4


def test_observation_queue(frames):
    got = ingest.last_observations(frames.filter("episode_index = 1"), "value", 3).orderBy("frame_index").collect()
    assert [r.value_queue for r in got] == [[0, 0, 0], [0, 0, 1], [0, 1, 2]]
