"""Queries over grasps, table functions, comparisons, construction and streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import algebra as al
from ..operators import analysis as an
from ..operators import grasp as g
from ..operators import tables
from ..sources import dataset as ds
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames, table
from ..streaming import ingest
from .registry import query

# grasps

_WINDOW = "(PARTITION BY episode_index ORDER BY frame_index)"
_ARMS = f"""{EVENT_FRAMES}, q AS (SELECT episode_index, frame_index, value / 200 AS u, coalesce(lag(value / 150) OVER w, 0) AS v, (value > 120)::INT AS gl, CASE WHEN episode_index % 4 = 0 THEN 0.5 ELSE (value > 90)::INT END AS gr FROM f WINDOW w AS {_WINDOW}),
s AS (SELECT episode_index, stddev_pop(u) + stddev_pop(v) + 2 * stddev_pop(gl) AS l, stddev_pop(v) * 3 + 2 * stddev_pop(gr) AS r FROM q GROUP BY 1),
p AS (SELECT episode_index, frame_index, CASE WHEN r > l THEN 'right' ELSE 'left' END AS arm, CASE WHEN r > l THEN gr ELSE gl END AS grip,
  CASE WHEN r > l THEN 0.32 + 0.24 * cos(v) + 0.20 * cos(2 * v) + 0.16 * cos(3 * v) + 0.11 * cos(3 * v) ELSE -0.32 - (0.24 * cos(u) + 0.20 * cos(u + v) + 0.16 * cos(u + v) + 0.11 * cos(u + v)) END AS x,
  CASE WHEN r > l THEN 0.24 * sin(v) + 0.20 * sin(2 * v) + 0.16 * sin(3 * v) + 0.11 * sin(3 * v) ELSE 0.24 * sin(u) + 0.20 * sin(u + v) + 0.16 * sin(u + v) + 0.11 * sin(u + v) END AS y FROM q JOIN s USING (episode_index)),
d AS (SELECT *, abs(grip - lag(grip) OVER w) AS dg, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS dm FROM p WINDOW w AS {_WINDOW}),
e AS (SELECT episode_index, any_value(arm) AS arm, max(dg) AS most, min_by(frame_index, (-round(dg, 9), frame_index)) FILTER (dg IS NOT NULL) AS fg, min_by(frame_index, (-dm, frame_index)) FILTER (dm IS NOT NULL) AS fm FROM d GROUP BY 1),
k AS (SELECT episode_index, arm, CASE WHEN most > 1e-4 THEN fg ELSE coalesce(fm, 0) END AS grasp_frame FROM e)"""


def _armed(spark, d) -> DataFrame:
    """Users as a two-armed robot of 16 signals."""
    f, w = event_frames(spark, d), Window.partitionBy("episode_index").orderBy("frame_index")
    u, v = F.col("value") / 200, F.coalesce(F.lag(F.col("value") / 150).over(w), F.lit(0.0))
    f = f.withColumns({"u": u, "v": v, "gl": (F.col("value") > 120).cast("double"), "gr": F.when(F.col("episode_index") % 4 == 0, 0.5).otherwise((F.col("value") > 90).cast("double"))})
    zero = F.lit(0.0)
    return f.select("episode_index", "frame_index", F.array("u", "v", zero, zero, zero, zero, zero, "gl", "v", "v", "v", zero, zero, zero, zero, "gr").alias("state"))


def _track(spark, d) -> DataFrame:
    return g.tracks(_armed(spark, d), g.source_of(["episode_index", "frame_index"], {"state": (16, [])}))


@query(f"WITH {_ARMS} SELECT episode_index, k.arm, grasp_frame, round(x, 6) AS x, round(y, 6) AS y FROM k JOIN p ON p.episode_index = k.episode_index AND p.frame_index = grasp_frame".replace("SELECT episode_index, k.arm", "SELECT k.episode_index, k.arm"))
def grasp_points(spark, d):
    """The busier arm, its planar kinematics, the event of its gripper or of its motion, the point."""
    return g.grasp_points(_track(spark, d)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(f"""WITH {_ARMS}, n AS (SELECT episode_index, count(*) AS n FROM p GROUP BY 1), i AS (SELECT episode_index, unnest(CASE WHEN n > 40 THEN list_transform(range(40), lambda j: CASE WHEN j = 39 THEN n - 1 ELSE floor(j * ((n - 1) / 39::DOUBLE))::BIGINT END) ELSE range(n) END) AS frame_index, unnest(range(least(n, 40))) AS place FROM n),
z AS (SELECT i.*, row_number() OVER (PARTITION BY i.episode_index ORDER BY abs(frame_index - grasp_frame), place) = 1 AS is_grasp FROM i JOIN k USING (episode_index))
SELECT episode_index, place::INTEGER AS place, frame_index, round(x, 6) AS x, round(y, 6) AS y, is_grasp FROM z JOIN p USING (episode_index, frame_index)""")
def trajectory_details(spark, d):
    """M13."""
    track = _track(spark, d)
    return g.details(track, g.grasp_points(track), 40)


# a table function

@query(f"""WITH {EVENT_FRAMES}, x AS (SELECT episode_index, frame_index, avg(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS 2 PRECEDING) AS v FROM f)
SELECT episode_index, 'row' AS kind, frame_index, round(v, 6) AS value, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::BIGINT AS count FROM x
UNION ALL SELECT episode_index, 'stats', NULL, NULL, round(avg(v), 6), round(stddev_pop(v), 6), count(*) FROM x GROUP BY 1""")
def episode_table(spark, d):
    """A Python table function over partitioned episodes, called from SQL."""
    tables.register(spark)
    rows = event_frames(spark, d).select("episode_index", "frame_index", "value")
    out = spark.sql("SELECT * FROM episode_table(TABLE(SELECT * FROM {rows}) PARTITION BY (episode_index) ORDER BY (frame_index), 3)", rows=rows)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "mean", "std")})


# comparison of two datasets

_PROMPTS = {"view": "Pick up the yellow duck", "click": "Give me the brown dog", "purchase": "Pick up the orange lion to the left of the yellow duck", "error": "wave at the camera", "signup": "Pick up the lemon on the left"}
_PARSED = {"view": ("single_pick", ["yellow duck"]), "click": ("give", ["brown dog"]), "purchase": ("relative_pick", ["orange lion", "yellow duck"]), "error": ("unknown", []), "signup": ("directional_pick", ["lemon"])}


def _compared_side(spark, d, keep: str) -> DataFrame:
    f = event_frames(spark, d).filter(keep)
    frames = f.select("episode_index", "frame_index", F.when(F.col("episode_index") % 2 == 0, F.array("value", F.lit(1.0))).otherwise(F.array("value")).alias("action"))
    prompt = F.create_map(*(F.lit(x) for p in sorted(_PROMPTS.items()) for x in p))
    tasks = f.select("task").distinct().select(F.lit(0).alias("task_index"), prompt[F.col("task")].alias("task"))
    tags = f.select("episode_index").distinct().select("episode_index", F.create_map(F.lit("side"), F.when(F.col("episode_index") % 3 == 0, "left").otherwise("right")).alias("tags"))
    return an.side(frames, tasks, {"fps": 10}, tags)


def _side_sql(name: str, keep: str) -> str:
    scenario = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _PARSED.items()) + " END"
    objects = "CASE task " + " ".join(f"WHEN '{k}' THEN {v[1]}::VARCHAR[]" for k, v in _PARSED.items()) + " END"
    return f"""{name}f AS (SELECT * FROM f WHERE {keep}), {name}t AS (SELECT DISTINCT task FROM {name}f), {name}e AS (SELECT DISTINCT episode_index FROM {name}f ORDER BY 1 LIMIT 64),
{name}a AS (SELECT value AS x0, CASE WHEN episode_index % 2 = 0 THEN 1.0 ELSE 0.0 END AS x1 FROM {name}f JOIN {name}e USING (episode_index)),
{name} AS (SELECT 'metadata' AS section, 'total_episodes' AS key, count(DISTINCT episode_index)::DOUBLE AS value FROM {name}f UNION ALL SELECT 'metadata', 'total_frames', count(*) FROM {name}f UNION ALL SELECT 'metadata', 'total_tasks', count(*) FROM {name}t UNION ALL SELECT 'metadata', 'fps', 10
UNION ALL SELECT 'action', 'dims', 2 {' '.join(f"UNION ALL SELECT 'action', '{n}_{k}', {f}(x{k}) FROM {name}a" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for k in (0, 1))}
UNION ALL SELECT 'scenarios', {scenario}, count(*) FROM {name}t GROUP BY 2 UNION ALL SELECT DISTINCT 'vocabulary', unnest({objects}), 1 FROM {name}t
UNION ALL SELECT 'tags', 'side=' || CASE WHEN episode_index % 3 = 0 THEN 'left' ELSE 'right' END, count(DISTINCT episode_index) FROM {name}f GROUP BY 2)"""


@query(f"""WITH {EVENT_FRAMES}, {_side_sql('l', "episode_index % 5 <> 1")}, {_side_sql('r', "task <> 'click' AND episode_index % 3 <> 2")}
SELECT coalesce(l.section, r.section) AS section, coalesce(l.key, r.key) AS key, round(l.value, 6) AS a, round(r.value, 6) AS b, CASE WHEN r.value IS NULL THEN 'a_only' WHEN l.value IS NULL THEN 'b_only' ELSE 'both' END AS where
FROM l FULL JOIN r ON l.section = r.section AND l.key = r.key""".replace("AS where", 'AS "where"'))
def compared_datasets(spark, d):
    """Metadata, actions, vocabulary, scenarios and tags of two datasets side by side."""
    out = an.side_by_side(_compared_side(spark, d, "episode_index % 5 <> 1"), _compared_side(spark, d, "task <> 'click' AND episode_index % 3 <> 2"))
    return out.withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


# construction

@query(f"""WITH {ORDER_FRAMES}, o2 AS (SELECT o_orderkey AS e, o_clerk FROM orders), p AS (SELECT DISTINCT o_orderpriority AS task FROM orders), t AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS k FROM p),
r AS (SELECT o_orderkey AS e, o_orderpriority AS task FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED')), u AS (SELECT task, row_number() OVER (ORDER BY k) - 1 AS n FROM t WHERE task IN (SELECT task FROM r))
SELECT e AS episode_index, n AS task_index, task FROM r JOIN u USING (task)""".replace("o2 AS (SELECT o_orderkey AS e, o_clerk FROM orders), ", ""))
def compacted_tasks(spark, d):
    """After two kinds of episodes are rejected, the tasks that are left are numbered densely and episodes follow."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("task"))
    tasks = al.in_text_order(o.select("task").distinct(), "task", "task_index")
    rows = o.filter(~F.col("task").isin("2-HIGH", "4-NOT SPECIFIED")).join(tasks, "task").select("episode_index", "task_index")
    moved, left = al.compacted(rows, tasks)
    return moved.join(left, "task_index").select("episode_index", "task_index", "task")


# streams with state

def _arriving(spark, d, path: str, schema: str, *columns) -> DataFrame:
    """Events as three files in the order of their ids, as a stream."""
    e = event_frames(spark, d)
    last = F.max("event_id").over(Window.partitionBy("episode_index")) == F.col("event_id")
    rows = e.select("episode_index", F.col("event_id").alias("seq"), "value", last.alias("last"), *columns)
    top = rows.agg(F.max("seq")).first()[0] + 1
    for k in range(3):
        rows.filter((F.col("seq") >= top * k // 3) & (F.col("seq") < top * (k + 1) // 3)).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).parquet(f"{path}/in/*")


@query("SELECT user_id AS episode_index, row_number() OVER w - 1 AS frame_index, (row_number() OVER w - 1) / 10.0::DOUBLE AS timestamp, value, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def recorded_frames(spark, d):
    """Events recorded as they come, the number of the next frame in state."""
    path = ds.scratch(spark, "record")
    stream = _arriving(spark, d, path, "episode_index long, seq long, value double, last boolean")
    ingest.run_to(ingest.record(stream, 10), path)
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id AS episode_index, event_id AS seq, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS a, coalesce(lag(value) OVER w, first_value(value) OVER w) AS b, value AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def queued_observations(spark, d):
    """The queue in list state."""
    path = ds.scratch(spark, "queue")
    stream = _arriving(spark, d, path, "episode_index long, seq long, value double, last boolean")
    ingest.run_to(ingest.observation_queue(stream, 3), path)
    return spark.read.parquet(f"{path}/out").select("episode_index", "seq", *(F.col("queue")[k].alias(n) for k, n in enumerate("abc")))


@query(f"""WITH e AS (SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, value FROM events), p AS (SELECT episode_index, step + k AS target, step, value + k AS x FROM e, (SELECT unnest([0, 1, 2]) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, target ORDER BY step) - 1 AS n FROM p WHERE target >= step) SELECT r.episode_index, target AS step, round(sum(exp(-0.5 * n) * x) / sum(exp(-0.5 * n)), 6) AS action, count(*)::INTEGER AS predictions
FROM r JOIN e ON e.episode_index = r.episode_index AND e.step = r.target GROUP BY 1, 2""")
def ensembled_actions(spark, d):
    """Chunks of three predictions, ensembled in map state."""
    path = ds.scratch(spark, "ensemble")
    w = Window.partitionBy("episode_index").orderBy("event_id")
    step = (F.row_number().over(w) - 1).cast("long").alias("step")
    chunk = F.array(*(F.col("value") + float(k) for k in range(3))).alias("chunk")
    stream = _arriving(spark, d, path, "episode_index long, seq long, value double, last boolean, step long, chunk array<double>", step, chunk)
    ingest.run_to(ingest.ensembled(stream.select("episode_index", "step", "chunk", "last"), 0.5), path)
    return spark.read.parquet(f"{path}/out").withColumn("action", F.round("action", 6))


# selection

@query("""WITH e AS (SELECT conv_id AS episode_index, list(DISTINCT role ORDER BY role) AS tasks, count(*) AS length FROM conversations GROUP BY 1) SELECT episode_index, array_to_string(tasks, ',') AS tasks, length FROM e WHERE episode_index >= 10 AND episode_index < 100000 AND (list_contains(tasks, 'assistant') OR list_contains(tasks, 'system'))""")
def selected_by_tokens(spark, d):
    """a range and a list of numbers and texts of tasks."""
    from ..operators import select as sl

    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.array_sort(F.collect_set("role")).alias("tasks"), F.count("*").alias("length"))
    tasks = spark.createDataFrame([(0, "assistant"), (1, "user")], "task_index long, task string")
    return sl.selected_episodes(c, "10:100000", "0,\n system, 77", tasks).withColumn("tasks", F.array_join("tasks", ","))


@query(f"""WITH {EVENT_FRAMES}, c AS (SELECT episode_index, min_by(frame_index, (abs(timestamp - 500000), frame_index)) AS a, min_by(frame_index, (abs(timestamp - 2000000), frame_index)) AS b FROM f WHERE episode_index % 2 = 0 GROUP BY 1),
k AS (SELECT f.*, a FROM f LEFT JOIN c USING (episode_index) WHERE a IS NULL OR frame_index BETWEEN a AND b)
SELECT episode_index, frame_index - coalesce(a, 0) AS frame_index, round(timestamp - CASE WHEN a IS NULL THEN 0 ELSE min(timestamp) OVER (PARTITION BY episode_index) END, 6) AS timestamp, value FROM k""")
def trimmed_episodes(spark, d):
    """half of the episodes cut to the frames nearest to two times, times from 0."""
    from ..operators import select as sl

    f = event_frames(spark, d).select("episode_index", "frame_index", "timestamp", "value")
    times = f.filter("episode_index % 2 = 0").select("episode_index", F.lit(500000.0).alias("start_s"), F.lit(2000000.0).alias("end_s")).distinct()
    return sl.trimmed(f, sl.nearest_frames(f, times)).withColumn("timestamp", F.round("timestamp", 6))


@query("""WITH t AS (SELECT p_partkey AS k, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) END AS b FROM part WHERE p_partkey % 3 < 2), o AS (SELECT a AS object, k, true AS target FROM t UNION ALL SELECT b, k, false FROM t WHERE b IS NOT NULL)
SELECT object, min(k) AS first_task, bool_or(target) AS is_target FROM o GROUP BY 1""")
def object_vocabulary(spark, d):
    """The objects of prompts about parts, and which are targets."""
    from ..operators import select as sl

    p, k = table(spark, d, "part"), F.col("p_partkey")
    task = F.when(k % 3 == 0, F.concat(F.lit("Pick up the "), F.upper("p_name"), F.lit(" to the left of the "), "p_type")).when(k % 3 == 1, F.concat(F.lit("Give me "), "p_name")).otherwise(F.concat(F.lit("look at "), "p_name"))
    return sl.object_vocabulary(p.select(k.alias("task_index"), task.alias("task")))


@query(f"""WITH {EVENT_FRAMES}, t AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS task_index FROM (SELECT DISTINCT task FROM f)) SELECT episode_index, frame_index, task_index, f.task FROM f JOIN t ON t.task = f.task""")
def indexed_tasks(spark, d):
    """The index of a task's text, made from the texts."""
    from ..operators import select as sl

    f = event_frames(spark, d).select("episode_index", "frame_index", F.when(F.col("frame_index") % 2 == 0, F.col("task")).otherwise(F.concat(F.lit("tf.Tensor(b'"), "task", F.lit("', shape=(), dtype=string)"))).alias("said"))
    rows, tasks = sl.with_task_index(f, "said")
    return rows.drop("said").join(tasks, "task_index").select("episode_index", "frame_index", "task_index", "task")


@query(f"""WITH {ORDER_FRAMES}, a AS (SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index, episode_index FROM o WHERE episode_index % 2 = 0), b AS (SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index, episode_index FROM o WHERE episode_index % 2 = 1)
SELECT index, episode_index, 0 AS dataset_index, index AS "row" FROM a UNION ALL SELECT index, episode_index, 1, index + (SELECT count(*) FROM a) FROM b""")
def routed_rows(spark, d):
    """Two datasets with one numbering of their rows."""
    from ..operators import select as sl
    from ..operators import temporal as t

    o = order_frames(spark, d)
    parts = [t.global_index(o.filter(f"episode_index % 2 = {k}")) for k in (0, 1)]
    return sl.routed([parts[0].drop("action"), parts[1]]).select("index", "episode_index", "dataset_index", "row")


@query(f"WITH {ORDER_FRAMES} SELECT episode_index, frame_index FROM o WHERE episode_index IN (SELECT DISTINCT episode_index FROM o ORDER BY 1 LIMIT 50)")
def first_fifty_episodes(spark, d):
    """O03."""
    from ..operators import select as sl

    return sl.first_episodes(order_frames(spark, d).select("episode_index", "frame_index"), 50)


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT episode_index, max(timestamp) AS top, max(abs(value / 100)) AS most FROM f GROUP BY 1), s AS (SELECT f.*, CASE WHEN most > 1.5 THEN value / 100 / 100 ELSE value / 100 END AS grip,
  CASE WHEN episode_index % 3 <> 0 THEN CASE WHEN timestamp < top * 0.2 THEN 0 WHEN timestamp < top * 0.4 THEN 1 WHEN timestamp <= top * 0.6 THEN 2 WHEN timestamp < top * 0.8 THEN 3 ELSE 4 END END AS stage FROM f JOIN m USING (episode_index) WHERE episode_index % 7 <> 3),
n AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS e, sum(count(*)) OVER (ORDER BY episode_index) - count(*) AS start FROM s GROUP BY 1)
SELECT e AS episode_index, frame_index, (start + frame_index)::BIGINT AS index, round(grip, 6) AS grip, stage::INTEGER AS subtask_state, 1::BIGINT AS exist_label, 2 AS width FROM s JOIN n USING (episode_index)""")
def standardized_dataset(spark, d):
    """Standardised, stages written back, episodes deleted, repaired."""
    from ..operators import fields as fl

    f = event_frames(spark, d).select("episode_index", "frame_index", "timestamp", F.array("timestamp", F.col("value") / 100, F.lit(0.0)).alias("action"), F.lit("x").alias("head_depth"))
    top = F.max("timestamp")
    parts = {"stage0_end": 0.2, "stage2_start": 0.4, "stage2_end": 0.6, "stage4_start": 0.8}
    bounds = f.groupBy("episode_index").agg(*((top * v).alias(k) for k, v in parts.items())).withColumns({"is_give": F.lit(False), "direct_give": F.lit(False), "stage4_end": F.lit(None).cast("double"), "error": F.when(F.col("episode_index") % 3 == 0, "none")})
    out, _ = fl.standardized_in_steps(f, {"action": {"dtype": "float64", "shape": [3]}}, ["action"], bounds, f.filter("episode_index % 7 = 3").select("episode_index").distinct(), 1, 2)
    return out.select("episode_index", "frame_index", "index", F.round(F.col("action")[1], 6).alias("grip"), "subtask_state", "exist_label", F.size("action").alias("width"))
