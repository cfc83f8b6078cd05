"""Write-back touches only the chunks of scanned episodes, fails and repeats without harm, and carries statistics."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tempora.operators import segment
from tempora.sources import dataset as ds


def files(path: str) -> dict[str, float]:
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def frames_of(spark, path) -> dict:
    return {(r.episode_index, r.frame_index): r.subtask_state for r in ds.read(spark, path).frames.collect()}


@pytest.fixture
def stored(spark, tmp_path):
    frames = spark.createDataFrame([(e, f, f / 10, float(e)) for e in (1, 2, 1003, 2500, 2501) for f in range(60)], "episode_index long, frame_index long, timestamp double, value double")
    episodes = frames.groupBy("episode_index").agg(F.array(F.lit("Pick up the lemon")).alias("tasks"), F.count("*").alias("length"))
    ds.write(ds.EpisodicDataset(frames, episodes, spark.createDataFrame([(0, "Pick up the lemon")], "task_index long, task string"), {"fps": 10}), str(tmp_path), "v1")
    return str(tmp_path)


def bounds(spark, *episodes: int):
    rows = [(e, False, False, 1.0, 2.0, 3.0, 4.0, None, None) for e in episodes] + [(2501, False, False, None, None, None, None, None, "no gripper transition found")]
    return spark.createDataFrame(rows, "episode_index long, is_give boolean, direct_give boolean, stage0_end double, stage2_start double, stage2_end double, stage4_start double, stage4_end double, error string")


def test_stages_written_for_some_episodes(spark, stored):
    before = files(stored)
    found = bounds(spark, 2, 2500)
    values = segment.stage_values(ds.read(spark, stored).frames, found)
    assert ds.write_back(spark, stored, "v2", values, found.filter("error is null"), {"subtask_state": {"dtype": "int32"}}) == [0, 2]
    after = files(stored)
    assert {k: after[k] for k in before} == before  # nothing that stood is touched
    assert {p.split("episode_chunk=")[1].split("/")[0] for p in set(after) - set(before)} == {"0", "2"}
    stage = lambda f: 0 if f < 10 else 1 if f < 20 else 2 if f <= 30 else 3 if f < 40 else 4
    got = frames_of(spark, stored)
    assert got == {(e, f): stage(f) if e in (2, 2500) else None for e in (1, 2, 1003, 2500, 2501) for f in range(60)}
    assert [(r.episode_index, r.frame_index) for r in ds.read(spark, stored, [1003]).frames.filter("frame_index = 5").collect()] == [(1003, 5)]
    stats = {(r.episode_index, r.feature): (r.min, r.max, r["count"]) for r in ds.read_stats(spark, stored).collect()}
    assert stats == {(2, "subtask_state"): (0, 4, 60), (2500, "subtask_state"): (0, 4, 60)}
    assert ds.read(spark, stored).info["features"] == {"subtask_state": {"dtype": "int32"}}
    # repeated after its end, it changes nothing
    ds.write_back(spark, stored, "v2", values, found.filter("error is null"))
    assert files(stored) == after
    # of these some are scanned again, one gets no row, and another column comes
    again = spark.createDataFrame([(2500, f, 7, "late") for f in range(30)], "episode_index long, frame_index long, subtask_state int, word string")
    ds.write_back(spark, stored, "v3", again, spark.createDataFrame([(2500,)], "episode_index long"))
    rows = {(r.episode_index, r.frame_index): (r.subtask_state, r.word) for r in ds.read(spark, stored).frames.collect()}
    assert rows[2500, 3] == (7, "late") and rows[2500, 45] == (None, None) and rows[2, 3] == (0, None) and rows[2501, 3] == (None, None) and len(rows) == 300
    stats = {r.episode_index: (r.min, r["count"]) for r in ds.read_stats(spark, stored).collect()}
    assert stats == {2: (0, 60), 2500: (7, 30)}


def test_a_failed_write_back_leaves_the_version_before(spark, stored, monkeypatch):
    found = bounds(spark, 1)
    values = segment.stage_values(ds.read(spark, stored).frames, found)
    with monkeypatch.context() as m:
        m.setattr(ds, "append_row", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            ds.write_back(spark, stored, "v2", values, found.filter("error is null"))
    assert "subtask_state" not in ds.read(spark, stored).frames.columns and ds.read(spark, stored).frames.count() == 300
    assert ds.write_back(spark, stored, "v2", values, found.filter("error is null")) == [0]
    assert sum(v is not None for v in frames_of(spark, stored).values()) == 60


def test_nothing_scanned(spark, stored):
    none = bounds(spark)
    assert ds.write_back(spark, stored, "v2", segment.stage_values(ds.read(spark, stored).frames, none), none.filter("error is null")) == []
    assert set(frames_of(spark, stored).values()) == {None} and ds.read_stats(spark, stored).count() == 0


def test_sidecar_tables(spark, tmp_path):
    schema = "episode_index long, type string, reason string"
    rows = lambda *r: spark.createDataFrame(r, schema)
    one = lambda *e: spark.createDataFrame([(x,) for x in e], "episode_index long")
    issues = ds.SidecarTable(spark, str(tmp_path / "issues"), schema, ["episode_index", "type", "reason"])
    told = lambda: [tuple(r) for r in issues.read().collect()]
    assert told() == []
    issues.replace_scanned(rows((2, "error", "b"), (1, "multi_gripper", "a"), (2, "error", "a"), (3, "quality_flag", "c"), (4, None, "d")), None, "v1")
    mine = F.col("type").isin("error", "multi_gripper")
    issues.replace_scanned(rows((3, "error", "n")), one(2, 3, 3), "v2", mine)
    assert sorted(told(), key=str) == sorted([(1, "multi_gripper", "a"), (3, "error", "n"), (3, "quality_flag", "c"), (4, None, "d")], key=str)
    assert told() == sorted(told(), key=lambda r: r[0])  # sorted through all files
    issues.replace_scanned(rows(), one(3), "v2", mine)  # a version that stands
    assert len(told()) == 4
    issues.replace_scanned(rows((9, "error", "z")), None, "v3", mine)
    assert sorted(told()[-1:]) == [(9, "error", "z")] and len(told()) == 3
    issues.add_missing(rows((9, "error", "not this"), (10, "error", "this")), "v4")
    assert ("not this" not in {r[2] for r in told()}) and len(told()) == 4
    issues.add_missing(rows((9, "error", "now this")), "v5", overwrite=True)
    assert [r[2] for r in told() if r[0] == 9] == ["now this"]


def test_texts_of_stages(spark):
    frames = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 2, 0), (1, 2, None, 1), (2, 0, 0, 1)], "episode_index long, frame_index long, subtask_state int, exist int")
    episodes = spark.createDataFrame([(1, ["Pick up the lemon", "x"]), (2, [])], "episode_index long, tasks array<string>")
    got = {(r.episode_index, r.frame_index): (r.subtask_state, r.subtask) for r in segment.stage_texts(frames, episodes, exist="exist").collect()}
    assert got[1, 0] == (2, "grasp lemon") and got[1, 1] == (-1, "lemon not found") and got[1, 2] == (None, None) and got[2, 0][0] == 0
