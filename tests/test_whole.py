"""Whole jobs on small folders, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def test_stat_embedding_has_every_episode(spark, tmp_path):
    from tempora.plans import catalog

    local = np.random.default_rng(6)
    rows = [(key, k + 1, 7, 8, *(float(x) for x in local.integers(1, 90, 4))) for key in (1, 1999, 2000, 2001, 70000) for k in range(3)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = {}
    for key in {r[0] for r in rows}:
        x = np.array([r[4:] for r in rows if r[0] == key])
        v = np.concatenate([x.mean(axis=0), x.std(axis=0), x.min(axis=0), x.max(axis=0)])
        expected |= {(key, place): round(float(y), 5) for place, y in enumerate(v / np.sqrt((v * v).sum()))}
    got = {(r.episode_index, r.place): round(r.x, 5) for r in catalog.QUERIES["stat_embedding"](spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-5 for k in got)


def test_prompt_issues_on_whole_texts(spark, tmp_path):
    from tempora.plans import catalog

    opening = "take the red cup from the table"
    rows = [(1, opening + " and wait. Then go"), (2, opening + " now"), (2, opening + " later"), (3, opening), (3, opening), (4, None), (5, "a"), (5, "b"), (5, "b, c"), (5, "d"), (6, "x."), (6, None)]
    spark.createDataFrame(rows, "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    several, many = "multi_sentence_prompt", "multiple_task_assignments"
    got = {tuple(r) for r in catalog.QUERIES["prompt_issues_whole"](spark, str(tmp_path)).select("episode_index", "type").collect()}
    assert got == {(1, several), (2, many), (5, several), (5, many), (6, several)}


def lines(spark, path, orders: int, each: int):
    rows = spark.range(orders * each).select((F.col("id") % orders).alias("l_orderkey"), (F.col("id") / orders).cast("int").alias("l_linenumber"), F.lit(7).cast("long").alias("l_partkey"), F.lit(8).cast("long").alias("l_suppkey"), *(((F.col("id") * k) % 97).cast("double").alias(c) for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 3)))
    rows.write.parquet(f"{path}/lineitem.parquet")


def test_statistics_send_rows_not_buffers(spark, tmp_path):
    """No partial aggregates before the shuffle, and more tasks where there are more rows."""
    from tempora.operators import stats, written
    from tempora.sources.adapters import order_frames

    lines(spark, tmp_path, 40, 3)
    plan = stats.episode_stats(order_frames(spark, str(tmp_path)), "action", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "HashAggregate" not in below and "Window" not in below
    before, written.TASK_ROWS = written.TASK_ROWS, 10
    try:
        assert written.dealt(order_frames(spark, str(tmp_path)), "episode_index").rdd.getNumPartitions() == 12
    finally:
        written.TASK_ROWS = before


def test_statistics_of_vectors_of_several_widths(spark):
    """Components without values have no row and no place; nulls count as none."""
    from tempora.functions import vector
    from tempora.operators import fields, stats

    rows = [(1, [1.0, 4.0, 5.0]), (1, [3.0, None]), (2, []), (2, None), (3, [0.0])]
    df = spark.createDataFrame(rows, "episode_index long, action array<double>")
    st = stats.episode_stats(df, "action", 3)
    assert sorted(tuple(r) for r in st.collect()) == [(1, 0, 1.0, 3.0, 2.0, 1.0, 2), (1, 1, 4.0, 4.0, 4.0, 0.0, 1), (1, 2, 5.0, 5.0, 5.0, 0.0, 1), (3, 0, 0.0, 0.0, 0.0, 0.0, 1)]
    found = {r.episode_index: r.embedding for r in vector.stat_embedding(st, "episode_index", 13).collect()}
    v = np.array([2, 4, 5, 1, 0, 0, 1, 4, 5, 3, 4, 5, 0])
    assert set(found) == {1, 3} and np.allclose(found[1], v / np.sqrt((v * v).sum())) and found[3] == [0.0] * 13
    other = st.withColumn("mean", F.when(F.col("dim") == 1, F.col("mean") + 1).otherwise(F.col("mean"))).filter("dim < 2")
    assert [tuple(r) for r in fields.beyond_tolerance(st, other, ["episode_index", "dim"], ["min", "mean"]).collect()] == [(1, 1, "mean", 4.0, 5.0)]
    named = st.withColumn("feature", F.lit("a"))
    assert sorted(tuple(r) for r in fields.stats_from_json(fields.stats_to_json(named)).select("episode_index", "dim", "min", "max", "mean", "std").collect()) == sorted(tuple(r)[:6] for r in st.collect())


def test_contiguous_numbers(spark):
    from tempora.operators import quality

    numbers = {1: [0, 1, 2], 2: [2, 0, 1], 3: [0, 1, 1], 4: [1, 2], 5: [0, None], 6: [0, 2, 2, 1]}
    df = spark.createDataFrame([(e, n) for e, v in numbers.items() for n in v], "episode_index long, frame_index long")
    got = {r.episode_index: (r.frames, r.contiguous) for r in quality.contiguous(df).collect()}
    assert got == {1: (3, True), 2: (3, True), 3: (3, False), 4: (2, False), 5: (2, False), 6: (4, False)}
    assert {r.episode_index for r in quality.contiguous(df, 1).collect() if r.contiguous} == {4}
    assert "count(distinct" not in quality.contiguous(df)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_folders_do_not_grow_with_the_data(spark, tmp_path):
    """Chunks widen where there are very many, and writing back keeps to them."""
    from tempora.sources import dataset as ds

    assert ds.chunk_width(0, 255_999) == (1000, 256) and ds.chunk_width(0, 256_000) == (2000, 129) and ds.chunk_width(None, None) == (1000, 1)
    frames = spark.range(700).select((F.col("id") * 1000 + 5).alias("episode_index"), F.lit(0).cast("long").alias("frame_index"), F.col("id").cast("double").alias("value"))
    episodes = frames.groupBy("episode_index").agg(F.array(F.lit("t")).alias("tasks"), F.count("*").alias("length"))
    ds.write(ds.EpisodicDataset(frames, episodes, spark.createDataFrame([(0, "t")], "task_index long, task string"), {}), str(tmp_path), "v1")
    assert len(list((tmp_path / "v1" / "frames").glob("episode_chunk=*"))) == 175
    scanned = frames.filter("episode_index in (5, 699005)").select("episode_index")
    values = scanned.select("episode_index", F.lit(0).cast("long").alias("frame_index"), F.lit(3).alias("stage"))
    assert ds.write_back(spark, str(tmp_path), "v2", values, scanned) == [0, 174]
    back = ds.read(spark, str(tmp_path)).frames
    assert back.count() == 700 and sorted(r.episode_index for r in back.filter("stage = 3").collect()) == [5, 699005]
    assert [r.value for r in ds.read(spark, str(tmp_path), [698005]).frames.collect()] == [698.0]


def test_totals_count_the_chunks_that_stand(spark, tmp_path, monkeypatch):
    """Of wider chunks, too: total_chunks is by the width that the dataset was written with."""
    from tempora.sources import dataset as ds

    frames = spark.range(10).select(F.col("id").alias("episode_index"), F.lit(0).cast("long").alias("frame_index"))
    episodes = frames.groupBy("episode_index").agg(F.array(F.lit("t")).alias("tasks"), F.count("*").alias("length"))
    data = ds.EpisodicDataset(frames, episodes, spark.createDataFrame([(0, "t")], "task_index long, task string"), {})
    monkeypatch.setattr(ds, "chunk_width", lambda first, last: (4, 3))
    ds.write(data, str(tmp_path), "v1")
    assert len(list((tmp_path / "v1" / "frames").glob("episode_chunk=*"))) == 3
    assert tuple(ds.read(spark, str(tmp_path)).totals().first()) == (10, 10, 1, 3) and data.totals().first().total_chunks == 1


def test_exported_rows_are_in_order_of_time(spark, tmp_path):
    from tempora.sources import dataset as ds

    f = spark.range(600).select((F.col("id") % 3).alias("episode_index"), (F.col("id") * 0 + 2).alias("frame_index"), (F.lit(600.0) - F.col("id")).alias("timestamp"))
    ds.export_csv(f.repartition(7), {}, f"{tmp_path}/csv")
    for e in range(3):
        (file,) = (tmp_path / "csv" / f"episode_index={e}").glob("*.csv")
        told = [float(x) for x in file.read_text().split()[1:]]
        assert len(told) == 200 and told == sorted(told)


def test_folders_of_exported_rows_are_bounded(spark, tmp_path):
    """Many episodes share folders: each lies whole in one file, in order of time, and the same schema reads all of them."""
    from tempora.sources import dataset as ds

    f = spark.range(900).select((F.col("id") % 300 * 7 - 50).alias("episode_index"), (F.col("id") / 300).cast("int").alias("frame_index"), (F.lit(9.0) - F.col("id") / 100).alias("timestamp"), F.array("id").alias("v"))
    ds.export_csv(f.repartition(7), {"v": 1}, f"{tmp_path}/csv")
    folders = list((tmp_path / "csv").glob("*=*"))
    assert 64 <= len(folders) <= ds.FOLDERS
    firsts = sorted(int(p.name.removeprefix("first_episode=")) for p in folders)
    seen = []
    for p in folders:
        (file,) = p.glob("*.csv")
        head, *lines = file.read_text().splitlines()
        rows = [(int(e), float(t)) for t, _, e in (x.split(",") for x in lines)]
        assert head == "timestamp,v_0,episode_index" and rows == sorted(rows)
        assert all(max(x for x in firsts if x <= e) == int(p.name.removeprefix("first_episode=")) for e, _ in rows)
        seen += sorted({e for e, _ in rows})
    assert sorted(seen) == [e * 7 - 50 for e in range(300)]
    back = spark.read.schema("timestamp double, v_0 long, episode_index long").csv(f"{tmp_path}/csv", header=True)
    assert sorted(tuple(r) for r in back.select("episode_index", "timestamp", "v_0").collect()) == sorted(tuple(r) for r in f.select("episode_index", "timestamp", F.col("v")[0]).collect())
    few = f.filter("episode_index < -20")  # five episodes
    for limit, named in ((4, "first_episode"), (5, "episode_index"), (None, "episode_index")):
        ds.export_csv(few, {"v": 1}, f"{tmp_path}/few-{limit}", folders=limit)
        got = list((tmp_path / f"few-{limit}").glob(f"{named}=*"))
        assert len(got) == 5 if named == "episode_index" else 1 < len(got) <= 4
        again = spark.read.schema(back.select("timestamp", "v_0", "episode_index").schema).csv(f"{tmp_path}/few-{limit}", header=True)
        assert again.count() == 15 and again.select("episode_index").distinct().count() == 5


def test_exported_csv_of_many_episodes(spark, tmp_path):
    """The query over more episodes than have folders of their own gives the rows of its SQL."""
    import duckdb

    from tempora.plans import catalog
    from tempora.sources import dataset as ds

    n = 2 * ds.FOLDERS
    e = spark.range(7 * n).select(F.col("id").alias("event_id"), (F.col("id") % n * 3).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5 % 997).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), (F.col("id") * 31 % 1009 / 8).alias("value"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES["exported_csv"])
    names = [c[0] for c in found.description]
    expected = sorted(found.fetchall())
    assert len(expected) == n
    assert sorted(tuple(r) for r in catalog.QUERIES["exported_csv"](spark, str(tmp_path)).select(*names).collect()) == expected


def test_labels_are_parsed_by_several_tasks(spark):
    from tempora.operators import review

    labels = spark.range(4000).coalesce(1).select(F.col("id").alias("episode_index"), F.lit("Pick up the lemon").alias("task"), F.lit(1).alias("uncertainty"), F.lit(True).alias("has_target"), F.lit(True).alias("has_ref"), F.create_map(F.lit("background"), F.lit("sofa")).alias("tags"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert review.candidates(labels, ["lemon", "cup"], 60).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
