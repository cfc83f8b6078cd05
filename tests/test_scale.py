"""What keeps tasks bounded changes no result: pieces of episodes, selection in passes, reduced choices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import sampling, stats, temporal


def collected(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def long_episodes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for e, n in ((1, 403), (2, 1), (3, 2), (4, 64), (-7, 130)):
        x = np.where(rng.random(n) < 0.35, 0.0, rng.choice([-0.9, 0.2, 0.6], n))
        rows += [(e, f, f / 10 + (0.05 if f % 40 == 3 else 0), float(x[f]) if f % 29 else None, f * 10 + e) for f in range(n)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, value double, event long").repartition(5)


OPERATORS = {
    "delta_window": lambda df, **o: temporal.delta_window(df, ["value", "event"], [-70, -9, -1, 0, 2, 33], **o),
    "wide_window": lambda df, **o: temporal.wide_window(df, "event", [-20, -3, 0, 5, 41], **o),
    "ahead_only": lambda df, **o: temporal.wide_window(df, "event", [4, 9], **o),
    "difference": lambda df, **o: temporal.difference(df, "value", **o),
    "moving_average": lambda df, **o: temporal.moving_average(df, "event", 31, **o),
    "centered_range": lambda df, **o: temporal.centered_range(df, "value", 12, **o),
    "transitions": lambda df, **o: temporal.transitions(df, "value", 0.1, **o),
    "zero_runs": lambda df, **o: temporal.zero_runs(df, "value", longest=3, **o),
    "sync_violations": lambda df, **o: temporal.sync_violations(df, 10.0, 1e-3, **o),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_pieces_give_the_rows_of_whole_episodes(long_episodes, name):
    expected = collected(OPERATORS[name](long_episodes, span=1 << 20))
    assert expected
    for span in (1, 7, 64):
        assert collected(OPERATORS[name](long_episodes, span=span)) == expected


def test_wide_window_by_definition(long_episodes):
    n = {r.episode_index: r["count"] for r in long_episodes.groupBy("episode_index").count().collect()}
    for r in temporal.wide_window(long_episodes, "event", [-20, -3, 0, 5, 41], span=16).collect():
        e, f = r.episode_index, r.frame_index
        assert r.event_window == [min(max(f + k, 0), n[e] - 1) * 10 + e for k in (-20, -3, 0, 5, 41)]
        assert r.event_is_pad == [not 0 <= f + k < n[e] for k in (-20, -3, 0, 5, 41)]


def test_zero_runs_by_definition(long_episodes):
    values: dict = {}
    for r in long_episodes.collect():
        values.setdefault(r.episode_index, {})[r.frame_index] = r.value
    expected = []
    for e, at in values.items():
        f = 0
        while f < len(at):
            end = f
            while end < len(at) and at[end] is not None and abs(at[end]) <= 0.03:
                end += 1
            if f < end <= f + 2 and f and end < len(at) and at[f - 1] is not None and at[end] is not None:
                flank = sorted((abs(at[f - 1]), abs(at[end])))
                if flank[0] >= 0.25 and flank[1] >= 0.45:
                    expected.append((e, f, end - f, at[f - 1], at[end]))
            f = max(end, f + 1)
    got = sorted((r.episode_index, r.first, r.length, r.before, r.after) for r in temporal.zero_runs(long_episodes, "value", span=5).collect())
    assert got == sorted(expected) and len(got) > 5


def test_one_episode_spreads_over_tasks(spark):
    one = spark.range(4000).select(F.lit(1).cast("long").alias("episode_index"), F.col("id").alias("frame_index"), F.col("id").cast("double").alias("value"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = temporal.delta_window(one, ["value"], [-2, 3], span=100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in rows) < 2500


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=700), "b": np.round(rng.normal(size=900), 1), "c": rng.normal(size=50) * 10.0 ** rng.integers(-300, 300, 50), "d": np.array([3.5]), "e": np.full(40, -2.0), "f": np.array([-1.7e308, 1.7e308, 0.0]), None: rng.random(30)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("g", None)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(4)
    shares = [0.0, 0.13, 0.5, 0.9, 1.0]
    for parts, few in ((4, 1), (1024, 8), (1024, 1 << 14)):
        got = {r.key: list(r)[1:] for r in stats.quantiles(df, "x", shares, "key", parts=parts, few=few).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert np.allclose(got[k], np.quantile(v, shares), rtol=1e-9, atol=0), (k, parts)
    over_all = stats.quantiles(df.filter("key = 'b'"), "x", [0.25], parts=3, few=1).collect()
    assert len(over_all) == 1 and np.isclose(over_all[0].q0, np.quantile(groups["b"], 0.25))
    assert stats.quantiles(df.limit(0), "x", [0.5], "key").count() == 0


def test_balanced_choice_from_the_reduced_table(spark):
    rng = np.random.default_rng(6)
    rows = [(e, "s" if e % 3 else "t", str(rng.choice(["a", "a", "a", "b", "c"])), int(rng.integers(0, 2))) for e in range(300)]
    df = spark.createDataFrame(rows, "episode_index long, scenario string, kind string, size int").repartition(4)
    got: dict = {}
    for r in sampling.balanced(df, "scenario", 9, ["kind", "size"], ["episode_index"]).orderBy("pick").collect():
        got.setdefault(r.scenario, []).append(r.episode_index)
    for scenario, picks in got.items():
        left, seen, expected = [r for r in rows if r[1] == scenario], {}, []
        for _ in range(9):
            best = min(left, key=lambda r: (seen.get(("k", r[2]), 0), seen.get(("s", r[3]), 0), r[0]))
            left.remove(best)
            expected.append(best[0])
            for key in (("k", best[2]), ("s", best[3])):
                seen[key] = seen.get(key, 0) + 1
        assert picks == expected
