"""Streams with state: restarted from their checkpoint they give the batch result, and state goes when an episode ends or is abandoned."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import vector
from tempora.streaming import ingest

SCHEMA = "episode_index long, seq long, value double, last boolean"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = {1: 17, 2: 1, 3: 9, 4: 30}
    order = rng.permutation([e for e, k in n.items() for _ in range(k)]).tolist()
    seen: dict = {}
    out = []
    for seq, e in enumerate(order):
        seen[e] = seen.get(e, 0) + 1
        out.append((e, seq, round(float(rng.random()), 3), seen[e] == n[e]))
    return out


def arrived(spark, path, rows, parts, schema=SCHEMA):
    for k, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/{time.time_ns()}-{k}")


def source(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def state_rows(spark, path, name) -> int:
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/state").count()


def test_recording_goes_on_after_a_restart(spark, tmp_path, rows):
    path = str(tmp_path)
    arrived(spark, f"{path}/in", rows[:30], 3)
    ingest.run_to(ingest.record(source(spark, f"{path}/in"), 10), path)
    assert state_rows(spark, path, "next") > 0
    arrived(spark, f"{path}/in", rows[30:], 2)
    ingest.run_to(ingest.record(source(spark, f"{path}/in"), 10), path)
    got = sorted((r.episode_index, r.frame_index, r.timestamp, r.value, r["last"]) for r in spark.read.parquet(f"{path}/out").collect())
    at: dict = {}
    expected = []
    for e, _, v, last in rows:
        expected.append((e, at.get(e, 0), at.get(e, 0) / 10, v, last))
        at[e] = at.get(e, 0) + 1
    assert got == sorted(expected)
    assert state_rows(spark, path, "next") == 0


def test_queue_as_state(spark, tmp_path, rows):
    path = str(tmp_path)
    for part in (rows[:25], rows[25:]):
        arrived(spark, f"{path}/in", part, 2)
        ingest.run_to(ingest.observation_queue(source(spark, f"{path}/in"), 3), path)
    got = {(r.episode_index, r.seq): r.queue for r in spark.read.parquet(f"{path}/out").collect()}
    frames = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("seq", "frame_index")
    assert got == {(r.episode_index, r.frame_index): r.value_queue for r in ingest.last_observations(frames, "value", 3).collect()}
    assert state_rows(spark, path, "last") == 0


def test_ensembler_as_state(spark, tmp_path):
    rng = np.random.default_rng(7)
    schema = "episode_index long, step long, chunk array<double>, last boolean"
    rows = [(e, s, rng.random(4).round(3).tolist(), s == n - 1) for e, n in ((1, 12), (2, 5)) for s in range(n)]
    path = str(tmp_path)
    for part in (rows[:7], rows[7:]):
        arrived(spark, f"{path}/in", part, 2, schema)
        ingest.run_to(ingest.ensembled(source(spark, f"{path}/in", schema), 0.3), path)
    got = {(r.episode_index, r.step): (round(r.action, 9), r.predictions) for r in spark.read.parquet(f"{path}/out").collect()}
    flat = spark.createDataFrame([(e * 1000 + s + k, 3 - k, x) for e, s, c, _ in rows for k, x in enumerate(c)], "target long, made long, value double")
    # the batch form weighs by age in steps, counted from the oldest prediction of a target
    flat = flat.withColumn("age", F.col("made") - F.min("made").over(ingest.Window.partitionBy("target")))
    batch = {r.target: (round(r.ensembled, 9), r.predictions) for r in vector.ensemble(flat, "target", "age", "value", 0.3).collect()}
    assert got == {(e, s): batch[e * 1000 + s] for e, s, _, _ in rows}
    assert state_rows(spark, path, "sums") == 0


def test_an_abandoned_episode_is_forgotten(spark, tmp_path):
    path, schema = str(tmp_path), SCHEMA + ", at timestamp"
    at = lambda seconds: datetime(2024, 1, 1) + timedelta(seconds=seconds)
    run = lambda: ingest.run_to(ingest.record(source(spark, f"{path}/in", schema).withWatermark("at", "0 seconds"), 10, "at", 10_000), path)
    arrived(spark, f"{path}/in", [(1, 0, 1.0, False, at(0)), (2, 1, 2.0, False, at(0))], 1, schema)
    run()
    assert state_rows(spark, path, "next") == 2
    arrived(spark, f"{path}/in", [(2, 2, 3.0, False, at(5))], 1, schema)
    arrived(spark, f"{path}/in", [(3, 3, 4.0, False, at(12))], 1, schema)  # 1 is over, 2 is not: its last row is 7 seconds old
    run()
    arrived(spark, f"{path}/in", [(2, 4, 5.0, False, at(14)), (1, 5, 6.0, False, at(14))], 1, schema)
    run()
    got = sorted((r.episode_index, r.frame_index, r.value) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(1, 0, 1.0), (1, 0, 6.0), (2, 0, 2.0), (2, 1, 3.0), (2, 2, 5.0), (3, 0, 4.0)]
    arrived(spark, f"{path}/in", [(4, 6, 7.0, True, at(1000))], 1, schema)
    run()
    assert state_rows(spark, path, "next") == 0
