"""Validation, fields, construction and catalogue on small hand-made tables."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import fields, flags, review, temporal, validate
from tempora.sources import catalogue, dataset
from tempora.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_offsets_of_seconds():
    assert temporal.frame_offsets({"a": [-0.1, 0.0, 0.25], "b": [1]}, 20) == {"a": [-2, 0, 5], "b": [20]}
    with pytest.raises(ValueError, match=r"'b': \[0.07\]"):
        temporal.frame_offsets({"a": [0.1], "b": [0.07, 0.2]}, 10)


def test_validation(spark):
    features = {"action": {"dtype": "float64", "shape": (2,)}, "grid": {"dtype": "int64", "shape": (2, 2)}, "index": {"dtype": "int64", "shape": (1,)}, "camera": {"dtype": "video", "shape": (3, 4, 5)}}
    assert validate.storage_schema(features).simpleString() == "struct<action:array<double>,grid:array<array<bigint>>,index:bigint>"
    with pytest.raises(ValueError):
        validate.storage_schema({"x": {"dtype": "complex", "shape": (1,)}})
    good = spark.createDataFrame([(0, 0, [1.0, 2.0], [[1, 2], [3, 4]], "t"), (0, 1, [1.0], [[1, 2], [3]], None)], "episode_index long, frame_index long, action array<double>, grid array<array<long>>, task string")
    del features["camera"]
    assert validate.schema_problems(good, features) == []
    assert validate.schema_problems(good.drop("task").withColumn("more", F.lit(1)).withColumn("action", F.lit(1)), features) == ["missing: ['task']", "extra: ['more']", "action: int instead of array<double>"]
    found = validate.frame_problems(good, features).collect()
    assert [(r.frame_index, sorted(r.problems)) for r in found] == [(1, ["action: length 1 instead of 2", "grid: length 2 instead of 2x2", "task: null"])]
    one = {"robot_type": "arm", "fps": 10, "features": {"a": {"dtype": "float32", "shape": [2]}}}
    validate.check_mergeable([one, json.loads(json.dumps(one))])
    with pytest.raises(ValueError, match="fps of dataset 1: 20, not 10; feature a of dataset 1"):
        validate.check_mergeable([one, {"robot_type": "arm", "fps": 20, "features": {"a": {"dtype": "float32", "shape": [3]}}}])
    assert [validate.version_status(v, "v2.1") for v in ("v2.1", "2.0", "v3.0")] == ["current", "old", "old"]
    with pytest.raises(ValueError):
        validate.version_status("v1.6", "v2.1")
    assert validate.version_status("v1.6", "v2.1", strict=False) == "breaking"
    with pytest.raises(ValueError):
        validate.version_status("two", "v2.1")


def test_fields(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [[1.0, 2.0, 3.0]]), (0, [4.0, 5.0, 6.0], [])], "episode_index long, v array<double>, deep array<array<double>>")
    assert fields.widths(rows, ["v"]) == {"v": 3}
    with pytest.raises(ValueError, match="several widths"):
        fields.widths(rows.union(rows.withColumn("v", F.slice("v", 1, 2))), ["v"])
    assert [tuple(r) for r in fields.trimmed(rows, ["v", "deep"], 2).select("v", "deep").collect()] == [([1.0, 2.0], [[1.0, 2.0]]), ([4.0, 5.0], [])]
    with pytest.raises(Exception, match="cannot be cut to 4"):
        fields.trimmed(rows, ["v"], 4).collect()
    stats = spark.createDataFrame([(0, "v", 0, 1.0), (0, "w", 0, 2.0)], "episode_index long, feature string, dim int, mean double").withColumn("std", F.lit(1.0))
    frames, features, kept = fields.drop_field(rows, {"v": {}, "w": {}}, stats, "v")
    assert frames.columns == ["episode_index", "deep"] and features == {"w": {}} and [r.feature for r in kept.collect()] == ["w"]
    with pytest.raises(ValueError):
        fields.drop_field(rows, {}, stats, "nothing")
    fixed = {(r.feature, r.dim): (r["mean"], r["std"]) for r in fields.image_constants(stats, ["v"], [0.5], [0.25]).collect()}
    assert fixed == {("v", 0): (0.5, 0.25), ("w", 0): (2.0, 1.0)}
    assert fields.updated_features({"fps": 3, "features": {"a": 1}}, {"b": 2}) == {"fps": 3, "features": {"a": 1, "b": 2}}
    frames = spark.createDataFrame([(0, k, [float(k), float(-k)]) for k in range(3)], "episode_index long, frame_index long, v array<double>")
    assert np.allclose([r.v for r in fields.smoothed(frames, "v", 2, 3).orderBy("frame_index").collect()], [[1 / 3, -1 / 3], [1, -1], [5 / 3, -5 / 3]])
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert fields.flattened(nested).columns == ["a/b", "a/c/d"] and nested.select(fields.nested_item(nested, "a/c/d")).first()[0] == "x"


def test_catalogue(spark, tmp_path):
    for name, fps in (("one", 10), ("deep/two", 20)):
        (tmp_path / name / "meta").mkdir(parents=True)
        (tmp_path / name / "meta" / "info.json").write_text(json.dumps({"fps": fps, "robot_type": "arm", "total_episodes": 3, "total_frames": 9}))
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "info.json").write_text("{}")
    found = catalogue.discovered(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.fps, r.total_frames) for r in found] == [("one", 10.0, 9), ("two", 20.0, 9)]
    for name in ("episode_000001_ds4.csv", "episode_000001_ds2.csv", "episode_000002.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    cached = catalogue.cached_csv(spark, str(tmp_path)).orderBy("episode_index").collect()
    assert [(r.episode_index, r.file.split("/")[-1], r.every) for r in cached] == [(1, "episode_000001_ds2.csv", 2), (2, "episode_000002.csv", 10**9)]
    features = {"timestamp": {"dtype": "float32", "shape": [1]}, "action": {"dtype": "float32", "shape": [2], "names": {"m": ["x", "y"]}}, "deep": {"dtype": "float32", "shape": [2, 2]}, "exist_label": {"dtype": "int64", "shape": [1]}, "s": {"dtype": "int32", "shape": [2]}, "i": {"dtype": "int64", "shape": [1]}}
    assert catalogue.signal_columns(features) == {"action": ["action_x", "action_y"], "exist_label": ["exist_label"], "s": ["s_0", "s_1"]}
    assert catalogue.vector_groups(["timestamp", "action_0", "action_1", "exist_label"]) == {"action": ["action_0", "action_1"], "exist_label": ["exist_label"]}
    assert catalogue.existence_columns(["a", "exist_label", "exist_label_dog"], {}) == (["exist_label", "exist_label_dog"], "exist_label")
    assert catalogue.existence_columns(["Yellow Duck", "b"], {"names": ["yellow_duck"]}) == (["Yellow Duck"], "exist_label")
    assert catalogue.existence_columns(["a"], {"shape": [2]}) == ([], "missing")
    assert catalogue.existence_columns(["Exist Label", "dog_exists"], None) == (["Exist Label"], "exist_label")
    assert catalogue.existence_columns(["dog_exists"], None) == (["dog_exists"], "legacy_exist")
    table = spark.createDataFrame([(0.5, 80.0, "1", 3)], "a double, grip double, exist_label_0 string, subtask_state_0 int")
    assert catalogue.served_csv(table, ["a", "grip"]).first().asDict() == {"a": 0.5, "grip": 0.8, "exist_label": "1"}
    assert catalogue.xy_places(["left_z", "left_x", "right_y", "left_y"]) == (1, 3) and catalogue.xy_places(["a", "b"]) is None


def test_log_and_boxes(spark, tmp_path):
    for k in range(3):
        flags.log(spark, f"{tmp_path}/log", k, "2024-01-01", "split", "d", [2, 1, 2])
    assert [(r.number, r.episodes) for r in flags.log_tail(spark, f"{tmp_path}/log", 2)] == [(2, [1, 2]), (1, [1, 2])] and len(flags.log_tail(spark, f"{tmp_path}/log", -5)) == 1
    records = spark.createDataFrame([(1, ((1.0, 2.0), 0.5)), (2, None)], "episode_index long, selected struct<box:struct<left:double,top:double>,confidence:double>")
    assert [(r.episode_index, r.box.top, r.source) for r in review.first_box(records).collect()] == [(1, 2.0, "reviewed")]


def test_balanced_choice(spark):
    from tempora.plans.dataset_queries import _labels

    found = review.candidates(_labels(spark, SF), ["yellow duck", "brown dog", "orange lion"], 60)
    rows = [r.asDict() for r in review.by_scenario(found, True).collect()]
    got = {}
    for r in review.balanced_sources(found, {"give": 6, "relative_pick": 3, "single_pick": 0}, 1.5, True).orderBy("pick").collect():
        got.setdefault(r.scenario, []).append((r.episode_index, r.missing_object, r.new_task))
    assert set(got) == {"give", "relative_pick"} and len(got["give"]) == 9
    for scenario, picks in got.items():
        chosen: list = []
        for episode, missing, task in picks:
            def rank(c, m):
                n = lambda f: sum(f(x, y) for x, y in chosen)  # noqa: B023, E731
                return (
                    n(lambda x, y: y == m), n(lambda x, y: x["count_bucket"] == c["count_bucket"]), n(lambda x, y: x["background"] == c["background"]), n(lambda x, y: y == m and x["count_bucket"] == c["count_bucket"]),
                    n(lambda x, y: y == m and x["background"] == c["background"]), n(lambda x, y: x["target"] == c["target"]), n(lambda x, y: x["reference"] == c["reference"]), n(lambda x, y: y == m and x["target"] == c["target"]),
                    n(lambda x, y: x["direction"] == c["direction"]), c["uncertainty"], c["episode_index"], m,
                )

            used = {x["episode_index"] for x, _ in chosen}
            c, m = min(((c, m) for c in rows if c["scenario"] == scenario and c["episode_index"] not in used for m in c["missing"]), key=lambda p: rank(*p))  # noqa: B023
            assert (c["episode_index"], m) == (episode, missing) and m in task
            chosen.append((c, m))


def test_construction(spark):
    frames = spark.createDataFrame([(e, f, 0) for e in (4, 7) for f in range(2)], "episode_index long, frame_index long, task_index long")
    tasks = spark.createDataFrame([(0, "old")], "task_index long, task string")
    plans = spark.createDataFrame([(0, 7, "Give me the cup"), (1, 4, "old"), (2, 7, "Give me the hat")], "number long, episode_index long, new_task string")
    out, every = review.constructed(frames, plans, tasks, 100)
    assert {(r.task_index, r.task) for r in every.collect()} == {(0, "old"), (1, "Give me the cup"), (2, "Give me the hat")}
    assert sorted((r.episode_index, r.frame_index, r.task_index, r.exist_label) for r in out.collect()) == [(100, 0, 1, 0), (100, 1, 1, 0), (101, 0, 0, 0), (101, 1, 0, 0), (102, 0, 2, 0), (102, 1, 2, 0)]
    decisions = spark.createDataFrame([(1, "accept", 5), (1, "reject", 9), (0, "reject", 1), (0, "accept", 2)], "number long, decision string, at long")
    assert [(r.number, r.episode_index, r.new_task) for r in review.decided(plans, decisions).orderBy("number").collect()] == [(0, 7, "Give me the cup"), (1, 7, "Give me the hat")]


def test_kmeans(spark):
    from tempora.functions.vector import kmeans

    local = np.random.default_rng(3)
    centres = 10 * local.normal(size=(3, 4))
    rows = [(i, (centres[i % 3] + 0.1 * local.normal(size=4)).tolist()) for i in range(90)]
    got = {r.id: r.cluster for r in kmeans(spark.createDataFrame(rows, "id long, v array<double>"), "v", 3, 10).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(90))
    # each row lies with the nearest of the means of the clusters
    x = np.array([v for _, v in rows])
    means = {c: x[[i for i in range(90) if got[i] == c]].mean(axis=0) for c in set(got.values())}
    assert all(min(means, key=lambda c: np.linalg.norm(x[i] - means[c])) == got[i] for i in range(90))


def test_pca(spark):
    from tempora.functions.vector import pca_2d

    local = np.random.default_rng(4)
    x = local.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(local.normal(size=(5, 5)))[0] + 7
    got = {r.id: (r.x, r.y) for r in pca_2d(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", "id").collect()}
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for k in range(2):
        axis = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([got[i][k] for i in range(60)], centred @ axis)
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, v array<double>")
    assert [tuple(r) for r in pca_2d(one, "v", "id").collect()] == [(1, 0.0, 0.0)]
    assert pca_2d(one.limit(0), "v", "id").count() == 0


def test_running_sums(spark):
    keys = [*range(2000), 10**15, 10**15 + 1, -(10**12)]  # clustered, with outliers
    rows = spark.createDataFrame([(k, i % 5 + 1) for i, k in enumerate(keys)], "k long, n long").repartition(4)
    got = {r.k: (r.at, r.total) for r in temporal.running(rows, "k", {"at": None, "total": "n"}, 16).collect()}
    at = total = 0
    for k, n in sorted(zip(keys, (i % 5 + 1 for i in range(len(keys))), strict=True)):
        assert got[k] == (at, total)
        at, total = at + 1, total + n


def test_a_version_that_was_not_finished(spark, tmp_path, monkeypatch):
    """What stands when a writer dies before it names its version."""
    frames = spark.createDataFrame([(0, 0, 1.0)], "episode_index long, frame_index long, value double")
    episodes = spark.createDataFrame([(0, ["t"], 1)], "episode_index long, tasks array<string>, length long")
    data = dataset.EpisodicDataset(frames, episodes, spark.createDataFrame([(0, "t")], "task_index long, task string"), {"fps": 1})
    dataset.write(data, str(tmp_path), "v1")
    buffer = ingest.FifoBuffer(spark, f"{tmp_path}/fifo", 2)
    buffer.add(frames, 0, ["frame_index"])

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(dataset, "append_row", dies)
    monkeypatch.setattr(ingest, "append_row", dies)
    with pytest.raises(OSError):
        dataset.write(dataset.EpisodicDataset(frames.limit(0), episodes, data.tasks, {"fps": 2}), str(tmp_path), "v2")
    with pytest.raises(OSError):
        buffer.add(frames.withColumn("value", F.lit(9.0)), 1, ["frame_index"])
    monkeypatch.undo()
    assert dataset.read(spark, str(tmp_path)).info == {"fps": 1} and buffer.read().first().value == 1.0
    buffer.add(frames.withColumn("value", F.lit(9.0)), 1, ["frame_index"])  # the batch comes again
    assert sorted((r["index"], r.value) for r in buffer.read().collect()) == [(0, 1.0), (1, 9.0)]


def test_created(spark, tmp_path):
    data = dataset.created(spark, 10, "arm", {"action": {"dtype": "float32", "shape": [2]}})
    dataset.write(data, str(tmp_path), "v1")
    back = dataset.read(spark, str(tmp_path))
    assert back.info["fps"] == 10 and back.frames.columns == ["action", "timestamp", "frame_index", "episode_index", "index", "task_index"] and back.frames.count() == 0
    with pytest.raises(ValueError):
        dataset.created(spark, 10, "arm", {"a/b": {"dtype": "float32", "shape": [1]}})
