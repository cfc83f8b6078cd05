"""Selection, grasps, JSON, comparison and the table function on small cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import jsontext
from tempora.functions import text as x
from tempora.operators import algebra, analysis, grasp, select, tables


def test_ranges_and_tokens(spark):
    assert x.episode_range(" 2:5 ") == (2, 5) and x.episode_range(None) is None and x.episode_range("  ") is None
    for wrong in ("5:5", "5:2", "-1:3", "a:b", "3", "1:2:3"):
        with pytest.raises(ValueError, match="START:END"):
            x.episode_range(wrong)
    assert x.task_tokens(" a,b\n,, c d ") == ["a", "b", "c d"]
    tasks = spark.createDataFrame([(0, "zero"), (12, "twelve")], "task_index long, task string")
    texts = lambda spec: {r.task for r in select.task_texts(spec, tasks).collect()}
    assert texts("12, 7,zero\nother") == {"twelve", "7", "zero", "other"} and texts([0, " "]) == {"zero"} and texts(None) == set()
    episodes = spark.createDataFrame([(e, t) for e, t in ((0, ["zero"]), (1, ["twelve", "zero"]), (2, []), (3, ["7"]))], "episode_index long, tasks array<string>")
    chosen = lambda *a: sorted(r.episode_index for r in select.selected_episodes(episodes, *a, tasks).collect())
    assert chosen(None, None) == [0, 1, 2, 3] and chosen("1:3", None) == [1, 2] and chosen(None, "12,7") == [1, 3] and chosen("0:1", "7") == []


def test_trim(spark):
    f = spark.createDataFrame([(e, k, 2.0 + k / 10, k) for e in (1, 2) for k in range(20)], "episode_index long, frame_index long, timestamp double, v int")
    times = spark.createDataFrame([(1, 2.449, None)], "episode_index long, start_s double, end_s double")
    cuts = select.nearest_frames(f, times)
    assert [tuple(r) for r in cuts.collect()] == [(1, 4, 19)]
    got = sorted((r.episode_index, r.frame_index, round(r.timestamp, 6), r.v) for r in select.trimmed(f, cuts).collect())
    assert got == [(1, k - 4, round((k - 4) / 10, 6), k) for k in range(4, 20)] + [(2, k, round(2 + k / 10, 6), k) for k in range(20)]


def test_json(spark):
    cases = {
        'x ```json\n{"a": [1]}\n``` y {': '{"a": [1]}', "```\n[1]\n```": "[1]", " 12 ": "12", 'so {"a": 1} it': '{"a": 1}', "{no} [1, 2] end": "[1, 2]", "{no}": None, "": None, "```json\nnope\n``` [1]": None, 'a [ {"b": "]"} ] c': '[ {"b": "]"} ]',
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r.t: r.j for r in df.select("t", jsontext.extract(F.col("t")).alias("j")).collect()} == cases | {None: None}
    schema = "struct<name:string,x:double,l:array<float>,m:map<string,double>,s:struct<y:double,z:string>>"
    nan, inf = float("nan"), float("inf")
    rows = [(("NaN", nan, [1.5, inf, None], {"a": -inf, "NaN": 2.0}, (nan, "Infinity")),), (("-Infinity", 1.0, None, None, None),)]
    df = spark.createDataFrame(rows, f"v {schema}")
    got = [json.loads(r.j) for r in df.select(jsontext.safe(F.col("v"), schema).alias("j")).collect()]
    assert got[0] == {"name": "NaN", "x": None, "l": [1.5, None, None], "m": {"a": None, "NaN": 2.0}, "s": {"y": None, "z": "Infinity"}}
    assert got[1] == {"name": "-Infinity", "x": 1.0, "l": None, "m": None, "s": None}


def test_sources_of_tracks():
    of = grasp.source_of
    assert of(["tip_y", "a", "tip_x", "pixel.x"], {})["source"] == "tip_x,tip_y"
    assert of(["uv.x", "uv.y"], {})["projection"] == "image"
    found = of(["state", "action"], {"action": (2, ["x", "y"]), "state": (3, ["w", "tip.x", "tip.y"])})
    assert found["kind"] == "vector" and found["source"] == "state[tip.x,tip.y]" and found["places"] == (1, 2)
    assert of(["state"], {"state": (2, ["a", "x", "y"])})["kind"] == "unavailable"  # the component is not there
    assert of(["action"], {"action": (16, [])})["kind"] == "arms" and of(["action"], {"action": (20, [])})["kind"] == "unavailable" and of(["action"], {"action": (20, [])}, "H10-w")["kind"] == "arms"


@pytest.mark.parametrize("span", [5, 1 << 16])
def test_grasp_points(spark, span):
    """Against the definition in numpy: a gripper that changes, one that does not, still arms, one frame."""
    rng = np.random.default_rng(9)
    episodes = {}
    for e, n in ((1, 30), (2, 25), (3, 12), (4, 1)):
        a = rng.normal(scale=0.3, size=(n, 16)).cumsum(axis=0)
        a[:, [7, 15]] = 0
        if e == 1:
            a[:, 0:7] *= 3
            a[11:, 7], a[20:, 7] = 0.7, 0.1
        if e == 2:
            a[:, 8:15] *= 4
        if e == 3:
            a[:] = 0.25
        episodes[e] = a
    df = spark.createDataFrame([(e, f, v.tolist()) for e, a in episodes.items() for f, v in enumerate(a)], "episode_index long, frame_index long, state array<double>")
    track = grasp.tracks(df, grasp.source_of(["state"], {"state": (16, [])}))
    got = {r.episode_index: r for r in grasp.grasp_points(track, span).collect()}
    points = {(r.episode_index, r.place): r for r in grasp.details(track, grasp.grasp_points(track), 10).collect()}
    for e, a in episodes.items():
        score = {arm: a[:, k : k + 7].std(axis=0).sum() + 2 * a[:, k + 7].std() for arm, k in (("left", 0), ("right", 8))}
        arm = max(score, key=score.get)
        q = np.cumsum(a[:, (0 if arm == "left" else 8) :][:, :4], axis=1)
        side = -1 if arm == "left" else 1
        xy = np.stack([side * 0.32 + side * (np.cos(q) @ grasp.LINKS), np.sin(q) @ grasp.LINKS], axis=1)
        grip = a[:, 7 if arm == "left" else 15]
        change, step = np.abs(np.diff(grip)), np.linalg.norm(np.diff(xy, axis=0), axis=1)
        at = 0 if len(a) == 1 else int(change.argmax()) + 1 if change.max() > 1e-4 else int(step.argmax()) + 1
        assert (got[e].arm, got[e].grasp_frame) == (arm, at) and np.allclose((got[e].x, got[e].y), xy[at])
        wanted = np.linspace(0, len(a) - 1, 10).astype(int) if len(a) > 10 else np.arange(len(a))
        assert [points[e, k].frame_index for k in range(len(wanted))] == wanted.tolist()
        assert [k for k in range(len(wanted)) if points[e, k].is_grasp] == [int(np.abs(wanted - at).argmin())]


def test_numbers_of_texts_and_tasks(spark):
    texts = spark.createDataFrame([(f"t{k % 37:02d}",) for k in range(37)], "task string").repartition(6)
    assert [(r.n, r.task) for r in algebra.in_text_order(texts, "task", "n").orderBy("n").collect()] == [(k, f"t{k:02d}") for k in range(37)]
    tasks = spark.createDataFrame([(k, f"t{k}") for k in (2, 5, 9, 11)], "task_index long, task string")
    rows = spark.createDataFrame([(1, 9), (2, 2), (3, 9)], "episode_index long, task_index long")
    moved, left = algebra.compacted(rows, tasks)
    assert sorted((r.episode_index, r.task_index) for r in moved.collect()) == [(1, 1), (2, 0), (3, 1)] and sorted((r.task_index, r.task) for r in left.collect()) == [(0, "t2"), (1, "t9")]


def test_comparison(spark):
    frames = lambda *rows: spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>")
    tasks = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "task_index long, task string")
    tags = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "x", "b": None})], "episode_index long, tags map<string,string>")
    a = analysis.side(frames((1, 0, [1.0]), (1, 1, [3.0, 4.0]), (2, 0, [100.0])), tasks("Pick up the Dog", "huh"), {"fps": 10}, tags, episodes=1)
    b = analysis.side(frames(), tasks("give me the dog"), {})
    got = {(r.section, r.key): (r.a, r.b, r["where"]) for r in analysis.side_by_side(a, b).collect()}
    assert got["action", "mean_0"] == (2, None, "a_only") and got["action", "mean_1"][0] == 2 and got["action", "dims"][0] == 2
    assert got["metadata", "total_frames"] == (3, 0, "both") and got["metadata", "fps"] == (10, None, "a_only") and got["vocabulary", "dog"] == (1, 1, "both")
    assert got["scenarios", "unknown"] == (1, None, "a_only") and got["scenarios", "give"] == (None, 1, "b_only") and got["tags", "a=x"][0] == 2 and got["tags", "b=None"][0] == 1


def test_table_function(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, k, float(k)) for k in range(5)] + [(2, 0, None), (2, 1, 4.0), (3, 0, None)], "episode_index long, frame_index long, value double").repartition(3)
    out = spark.sql("SELECT * FROM episode_table(TABLE(SELECT * FROM {rows}) PARTITION BY (episode_index) ORDER BY (frame_index), 2)", rows=rows).collect()
    assert [r.value for r in sorted((r for r in out if r.kind == "row" and r.episode_index == 1), key=lambda r: r.frame_index)] == [0, 0.5, 1.5, 2.5, 3.5]
    stats = {r.episode_index: (r.mean, r["count"]) for r in out if r.kind == "stats"}
    assert stats == {1: (pytest.approx(1.6), 5), 2: (4.0, 1), 3: (None, 0)}
