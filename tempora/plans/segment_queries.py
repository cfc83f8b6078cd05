"""Queries over the stages of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import segment as s
from ..sources.adapters import EVENT_FRAMES, event_frames
from .registry import query

FPS, WIDTH = 10.0, 8
#: What the first event of a user stands for as a task.
TASKS = {"click": "Pick up the cube", "purchase": "Give the cube to me", "view": "Place it there"}


def _signals(spark, d) -> DataFrame:
    """Frames of users as an arm with one gripper: a smooth signal moves the arm, a slow one closes the gripper, its state follows two frames later."""
    f = event_frames(spark, d)
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    first = F.first("task").over(w)
    task = F.lit("Wave")
    for kind, text in TASKS.items():
        task = F.when(first == kind, text).otherwise(task)
    f = f.withColumns({"arm": F.round(F.avg("value").over(w.rowsBetween(-4, 0)) / 200, 6), "grip": (F.avg("value").over(w.rowsBetween(-11, 0)) > 52).cast("double"), "text": task})
    f = f.withColumn("held", F.coalesce(F.lag("grip", 2).over(w), "grip"))
    zeros = F.array_repeat(F.lit(0.0), WIDTH - 2)
    vector = lambda x, g: F.concat(F.array(x), zeros, F.array(g))
    return f.select("episode_index", "frame_index", (F.col("frame_index") / FPS).alias("timestamp"), vector(F.col("arm"), F.col("grip")).alias("action"), vector(F.lit(0.0), F.col("held")).alias("state"), F.col("text").alias("task"))


_CASES = " ".join(f"WHEN first_value(task) OVER w = '{k}' THEN '{t}'" for k, t in TASKS.items())
_FRAMES = f"""{EVENT_FRAMES},
v AS (SELECT episode_index, frame_index AS i, frame_index / 10.0::DOUBLE AS t, count(*) OVER (PARTITION BY episode_index) AS n, CASE {_CASES} ELSE 'Wave' END AS task,
  round(avg(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS 4 PRECEDING) / 200, 6) AS arm, (avg(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS 11 PRECEDING) > 52)::INT AS g
  FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
u AS (SELECT *, coalesce(lag(g, 2) OVER w, g) AS s FROM v WINDOW w AS (PARTITION BY episode_index ORDER BY i)),
k AS MATERIALIZED (SELECT *, g <> lag(g) OVER w AS flip, s <> lag(s) OVER w AS follows, max(arm) OVER r - min(arm) OVER r AS range FROM u
  WINDOW w AS (PARTITION BY episode_index ORDER BY i), r AS (PARTITION BY episode_index ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))"""


def _bounds_sql(version: str) -> str:
    """The boundaries with searches as joins of frames with the episodes' rows."""
    margin, second = s.MARGIN[version], version == "DVT2"
    return f"""{_FRAMES},
x AS (SELECT episode_index, i AS a, coalesce((SELECT min(j.i) FROM k j WHERE j.episode_index = k.episode_index AND j.follows AND j.i >= k.i), i) AS b FROM k WHERE flip),
y AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY a DESC) AS back, row_number() OVER (PARTITION BY episode_index ORDER BY a) AS place_ FROM x),
e AS (SELECT episode_index, any_value(n) AS n, any_value(task) AS task, contains(lower(any_value(task)), 'give') AS give, contains(lower(any_value(task)), 'pick') AS pick, contains(lower(any_value(task)), 'place') AS place,
  min_by(s, i) AS s0, max_by(s, i) AS s1 FROM k GROUP BY 1),
c AS (SELECT y.episode_index, count(*) AS changes, list(a ORDER BY a) AS frames, max(a) FILTER (back = 1) AS ra, max(b) FILTER (back = 1) AS rb, max(a) FILTER (back = 2) AS ga, max(b) FILTER (back = 2) AS gb, max(b) FILTER (place_ = 1) AS first_b FROM y GROUP BY 1),
h AS (SELECT e.*, coalesce(changes, 0) AS changes, frames, ra, rb, (SELECT s FROM k WHERE k.episode_index = e.episode_index AND i = first_b) AS s_then, give AND changes = 1 AND s0 = 1 AND s1 = 0 AS direct,
  CASE WHEN give THEN ga ELSE ra END AS ga, CASE WHEN give THEN gb ELSE rb END AS gb FROM e LEFT JOIN c USING (episode_index)),
m AS MATERIALIZED (SELECT *, coalesce(direct, false) AS d, (CASE WHEN give THEN 2 ELSE 1 END) + (CASE WHEN s0 = 1 AND s_then = 0 THEN 1 ELSE 0 END) AS expected,
  CASE WHEN n < 50 THEN 'too few frames (' || n || ') for 5 stages' WHEN changes = 0 AND pick THEN 'no gripper transition found (task: ''' || task || ''')' WHEN changes = 0 THEN 'no gripper transition found'
       WHEN give AND changes < 2 AND NOT coalesce(direct, false) THEN 'give task needs >=2 gripper transitions or one closed-to-open direct-give transition, found ' || changes END AS error FROM h),
p AS (SELECT m.episode_index, count(*) FILTER (t < ga / 10.0::DOUBLE - {margin}) AS b2, count(*) FILTER (t <= gb / 10.0::DOUBLE + {margin}) AS b3, count(*) FILTER (t < ra / 10.0::DOUBLE - {margin}) AS b5, count(*) FILTER (t <= rb / 10.0::DOUBLE + {margin}) AS b6
  FROM m JOIN k USING (episode_index) WHERE error IS NULL GROUP BY 1),
q AS (SELECT episode_index, CASE WHEN d THEN NULL WHEN b3 - b2 >= 10 THEN b2 ELSE greatest(0, CASE WHEN greatest(0, (b2 + b3) // 2 - 5) + 10 > n THEN n - 10 ELSE (b2 + b3) // 2 - 5 END) END AS b2,
  CASE WHEN d THEN NULL WHEN b3 - b2 >= 10 THEN b3 ELSE least(n, greatest(0, (b2 + b3) // 2 - 5) + 10) END AS b3, b5, b6 FROM p JOIN m USING (episode_index)),
r AS (SELECT episode_index, b2, b3, b6, CASE WHEN d THEN 10 ELSE b3 + 10 END AS lo, greatest(CASE WHEN d THEN 10 ELSE b3 + 10 END, b5) AS b5 FROM q JOIN m USING (episode_index)),
z AS (SELECT episode_index, b2, b3, CASE WHEN NOT give THEN NULL WHEN b6 - b5 >= 10 THEN b5 ELSE greatest(lo, CASE WHEN greatest(lo, (b5 + b6) // 2 - 5) + 10 > n THEN n - 10 ELSE (b5 + b6) // 2 - 5 END) END AS b5,
  CASE WHEN NOT give THEN NULL WHEN b6 - b5 >= 10 THEN b6 ELSE least(n, greatest(lo, (b5 + b6) // 2 - 5) + 10) END AS b6 FROM r JOIN m USING (episode_index)),
w AS MATERIALIZED (SELECT z.*, m.* EXCLUDE (episode_index), CASE WHEN d THEN b5 ELSE b2 END AS upper FROM z JOIN m USING (episode_index)),
o AS (SELECT w.episode_index, min(i) FILTER (range >= 0.1) AS moves, max(i) FILTER (range >= 0.06) AS still, CASE WHEN any_value(s0) = 1 THEN min(i) FILTER (i < upper AND s = 0) END AS opened,
  min(i) FILTER (i >= b3 AND i <= k.n - CASE WHEN place THEN 2 ELSE 4 END AND CASE WHEN place THEN next2 ELSE next4 END <= 0.08) AS rests FROM w JOIN (SELECT *, max(range) OVER (PARTITION BY episode_index ORDER BY i ROWS BETWEEN 0 PRECEDING AND 1 FOLLOWING) AS next2,
  max(range) OVER (PARTITION BY episode_index ORDER BY i ROWS BETWEEN 0 PRECEDING AND 3 FOLLOWING) AS next4 FROM k) k USING (episode_index) GROUP BY 1),
b AS (SELECT w.*, still, rests, greatest(coalesce(moves, upper), CASE WHEN pick OR give THEN coalesce(opened + 1, 0) ELSE 0 END) AS start FROM w JOIN o USING (episode_index)),
b1 AS (SELECT *, CASE WHEN upper - 10 >= 10 THEN greatest(10, least(upper - 10, start)) ELSE greatest(1, upper // 2) END AS raw1,
  CASE WHEN b3 + {0 if second else 10} <= n - 10 THEN greatest(b3 + {0 if second else 10}, least(n - 10, coalesce({"rests, " if second else ""}still + 1, b3))) ELSE (b3 + n) // 2 END AS b4 FROM b),
b2 AS (SELECT *, CASE WHEN NOT d AND b2 - raw1 < 20 THEN greatest(10, b2 - 20) ELSE raw1 END AS b1 FROM b1),
t AS (SELECT episode_index, least(b1, n - 1) / 10.0::DOUBLE AS stage0_end, least(b2, n - 1) / 10.0::DOUBLE AS stage2_start, least(b3 - 1, n - 1) / 10.0::DOUBLE AS stage2_end, least(CASE WHEN give THEN b5 ELSE b4 END, n - 1) / 10.0::DOUBLE AS stage4_start,
  CASE WHEN give THEN least(b6 - 1, n - 1) / 10.0::DOUBLE END AS stage4_end FROM b2),
bounds AS MATERIALIZED (SELECT m.episode_index, error IS NULL AND give AS is_give, error IS NULL AND d AS direct_give, CASE WHEN NOT d THEN stage2_start END AS stage2_start, CASE WHEN NOT d THEN stage2_end END AS stage2_end, stage0_end, stage4_start, stage4_end, error,
  CASE WHEN error IS NULL AND changes > expected THEN frames END AS frames, CASE WHEN give THEN changes || ' gripper transitions at frames [' || list_aggregate(frames, 'string_agg', ', ') || '], expected ' || expected || ' for give; using second-to-last for grasp, last for release'
  ELSE changes || ' gripper transitions at frames [' || list_aggregate(frames, 'string_agg', ', ') || '], using LAST' END AS told FROM m LEFT JOIN t USING (episode_index))"""


def _told(version: str) -> str:
    return f"WITH {_bounds_sql(version)} SELECT episode_index, is_give, direct_give, stage0_end, stage2_start, stage2_end, stage4_start, stage4_end, error FROM bounds"


def _found(spark, d, version: str) -> DataFrame:
    return s.boundaries(_signals(spark, d), s.Signals(FPS, WIDTH, WIDTH, version))


@query(_told("DVT1"))
def subtask_boundaries(spark, d):
    """G01."""
    return _found(spark, d, "DVT1").drop("changes", "issue")


@query(_told("DVT2"))
def subtask_boundaries_second_version(spark, d):
    """G01."""
    return _found(spark, d, "DVT2").drop("changes", "issue")


@query(f"WITH {_bounds_sql('DVT1')} SELECT episode_index, 'error' AS type, error AS reason, NULL::VARCHAR AS frames FROM bounds WHERE error IS NOT NULL UNION ALL SELECT episode_index, 'multi_gripper', told, array_to_string(frames, ',') FROM bounds WHERE frames IS NOT NULL")
def boundary_issues(spark, d):
    """G01, G02."""
    return s.boundary_issues(_found(spark, d, "DVT1")).withColumn("frames", F.array_join("frames", ","))


_STAGES = """CASE WHEN stage0_end IS NULL OR t < stage0_end THEN 0 WHEN NOT direct_give AND t < stage2_start THEN 1 WHEN NOT direct_give AND t <= stage2_end THEN 2 WHEN t < stage4_start THEN 3 WHEN NOT is_give OR t <= stage4_end THEN 4 ELSE 5 END"""


@query(f"WITH {_bounds_sql('DVT1')} SELECT k.episode_index, i AS frame_index, {_STAGES} AS stage FROM k JOIN bounds USING (episode_index)")
def assigned_stages(spark, d):
    """G03."""
    return s.assigned(_signals(spark, d), _found(spark, d, "DVT1")).select("episode_index", "frame_index", "stage")


@query(f"""WITH {_bounds_sql('DVT1')} SELECT * FROM (SELECT episode_index, unnest([stage0_end, stage2_start, stage2_end, stage4_start, stage4_end]) AS timestamp, unnest([CASE WHEN direct_give THEN 3 ELSE 1 END, 2, 3, 4, 5]) AS state FROM bounds) WHERE timestamp IS NOT NULL""")
def boundary_transitions(spark, d):
    """G05."""
    return s.as_transitions(_found(spark, d, "DVT1"))
