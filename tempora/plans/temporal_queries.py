"""Queries over windows of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames
from .registry import query

W = "(PARTITION BY episode_index ORDER BY frame_index)"
ALL = "(PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _clamped(k: int) -> str:
    inside = f"lag(value, {-k}) OVER w" if k < 0 else f"lead(value, {k}) OVER w"
    edge = f"{'first' if k < 0 else 'last'}_value(value) OVER {ALL}"
    return f"coalesce({inside}, {edge})" if k else "value"


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, task, {', '.join(f'{_clamped(k)} AS value_{"m" if k < 0 else "p"}{abs(k)}, (row_number() OVER w + ({k}) < 1 OR row_number() OVER w + ({k}) > count(*) OVER (PARTITION BY episode_index)) AS value_{"m" if k < 0 else "p"}{abs(k)}_is_pad' for k in (-2, -1, 0, 1))}
FROM f WINDOW w AS {W}""")
def delta_window(spark, d):
    names = [f"value_{'m' if k < 0 else 'p'}{abs(k)}" for k in (-2, -1, 0, 1)]
    out = t.delta_window(event_frames(spark, d), ["value"], [-2, -1, 0, 1])
    return out.select("episode_index", "frame_index", "task", *(c for n in names for c in (n, f"{n}_is_pad")))


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f),
x AS (SELECT a.episode_index, a.frame_index, k.k, b.value, (a.frame_index + k.k < 0 OR a.frame_index + k.k >= a.n) AS pad FROM n a, (SELECT unnest([-8, -4, 0, 4, 8, 16]) AS k) k
  JOIN f b ON b.episode_index = a.episode_index AND b.frame_index = greatest(0, least(a.n - 1, a.frame_index + k.k)))
SELECT episode_index, frame_index, round(sum(value), 4) AS total, count_if(pad)::BIGINT AS pads FROM x GROUP BY ALL""")
def wide_window(spark, d):
    out = t.wide_window(event_frames(spark, d), "value", [-8, -4, 0, 4, 8, 16])
    total = F.aggregate("value_window", F.lit(0.0), lambda s, x: s + x)
    return out.select("episode_index", "frame_index", F.round(total, 4).alias("total"), F.size(F.filter("value_is_pad", lambda p: p)).cast("long").alias("pads"))


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT episode_index, count(*) AS length FROM f GROUP BY 1)
SELECT episode_index, length, (sum(length) OVER (ORDER BY episode_index) - length)::BIGINT AS from_index, (sum(length) OVER (ORDER BY episode_index))::BIGINT AS to_index FROM n""")
def episode_offsets(spark, d):
    lengths = event_frames(spark, d).groupBy("episode_index").agg(F.count("*").alias("length"))
    return t.offsets_from_lengths(lengths).select("episode_index", "length", "from_index", "to_index")


@query(f"""WITH {EVENT_FRAMES}, c AS (SELECT *, CASE WHEN task IS DISTINCT FROM lag(task) OVER w OR frame_index = 0 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS {W}),
r AS (SELECT *, sum(new) OVER {W} AS run FROM c)
SELECT episode_index, run::BIGINT AS run, any_value(task) AS task, min(frame_index) AS first, max(frame_index) AS last, count(*) AS length FROM r GROUP BY episode_index, run""")
def run_length_offsets(spark, d):
    return t.islands(event_frames(spark, d), "task").select("episode_index", "run", "task", "first", "last", "length")


@query(f"""WITH {EVENT_FRAMES}, s AS (SELECT episode_index, frame_index, lead(timestamp) OVER w - timestamp AS step FROM f WINDOW w AS {W})
SELECT episode_index, frame_index, round(step, 6) AS step FROM s WHERE abs(step - 3600) > 1800""")
def timestamp_sync_violations(spark, d):
    return t.sync_violations(event_frames(spark, d), 1 / 3600, 1800).select("episode_index", "frame_index", F.round("step", 6).alias("step"))


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value FROM f WHERE frame_index % 3 = 0")
def downsample(spark, d):
    return t.every_nth(event_frames(spark, d), 3).select("episode_index", "frame_index", "value")


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f)
SELECT episode_index, frame_index, value FROM n WHERE frame_index IN (0, n // 2, n - 1)""")
def first_mid_last(spark, d):
    return t.first_middle_last(event_frames(spark, d)).select("episode_index", "frame_index", "value")


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT episode_index, count(*) AS n FROM f GROUP BY 1),
w AS (SELECT DISTINCT episode_index, round_even(i * (n - 1) / 6.0, 0)::BIGINT AS frame_index FROM n, (SELECT unnest(range(0, 7)) AS i))
SELECT episode_index, frame_index, value FROM f JOIN w USING (episode_index, frame_index)""")
def linspace_sample(spark, d):
    return t.evenly_spaced(event_frames(spark, d), 7).select("episode_index", "frame_index", "value")


@query(f"""WITH {EVENT_FRAMES}, s AS (SELECT episode_index, timestamp - lag(timestamp) OVER w AS dt FROM f WINDOW w AS {W})
SELECT episode_index, round(1 / quantile_cont(dt, 0.5), 9) AS fps FROM s WHERE dt > 0 GROUP BY 1""")
def fps_inference(spark, d):
    return t.infer_fps(event_frames(spark, d)).select("episode_index", F.round("fps", 9).alias("fps"))


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, least(count(*), greatest(3, count_if(timestamp <= 86400)))::BIGINT AS early FROM f GROUP BY 1")
def early_frames(spark, d):
    return t.early_frames(event_frames(spark, d), 86400).select("episode_index", "early")


@query(f"""WITH {EVENT_FRAMES}, c AS (SELECT episode_index, timestamp, frame_index AS state FROM f WHERE task = 'purchase')
SELECT f.episode_index, f.frame_index, coalesce(max(c.state), 0) AS state FROM f LEFT JOIN c ON c.episode_index = f.episode_index AND c.timestamp <= f.timestamp GROUP BY 1, 2""")
def step_function_join(spark, d):
    f = event_frames(spark, d)
    changes = f.filter("task = 'purchase'").select("episode_index", "timestamp", F.col("frame_index").alias("state"))
    return t.step_function(f, changes).select("episode_index", "frame_index", "state")


@query(f"""WITH {EVENT_FRAMES}, r AS (SELECT episode_index, timestamp AS rt, value AS rv FROM f WHERE task = 'view'),
m AS (SELECT f.episode_index, f.frame_index, r.rv, r.rt, abs(f.timestamp - r.rt) AS dist, row_number() OVER (PARTITION BY f.episode_index, f.frame_index ORDER BY abs(f.timestamp - r.rt), r.rt) AS k
  FROM (SELECT * FROM f WHERE task <> 'view') f LEFT JOIN r ON r.episode_index = f.episode_index)
SELECT episode_index, frame_index, CASE WHEN dist <= 20000 THEN rv END AS near_value, round(dist, 6) AS near_distance, coalesce(dist > 20000, true) AS is_pad FROM m WHERE k = 1""")
def asof_nearest(spark, d):
    f = event_frames(spark, d)
    out = t.nearest(f.filter("task <> 'view'"), f.filter("task = 'view'"), "timestamp", "value", 20000)
    return out.select("episode_index", "frame_index", "near_value", F.round("near_distance", 6).alias("near_distance"), "is_pad")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, round(value - lag(value) OVER w, 6) AS delta FROM f WINDOW w AS {W}")
def consecutive_difference(spark, d):
    return t.difference(event_frames(spark, d), "value").select("episode_index", "frame_index", F.round("delta", 6).alias("delta"))


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f),
x AS (SELECT a.episode_index, a.frame_index, b.value FROM n a, (SELECT unnest(range(-2, 3)) AS k) k JOIN f b ON b.episode_index = a.episode_index AND b.frame_index = greatest(0, least(a.n - 1, a.frame_index + k.k)))
SELECT episode_index, frame_index, round(sum(value) / 5, 4) AS smooth FROM x GROUP BY 1, 2""")
def moving_average(spark, d):
    return t.moving_average(event_frames(spark, d), "value", 5).select("episode_index", "frame_index", F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, round(max(value) OVER w - min(value) OVER w, 6) AS range FROM f
WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def centered_range(spark, d):
    return t.centered_range(event_frames(spark, d), "value", 4).select("episode_index", "frame_index", F.round("range", 6).alias("range"))


@query(f"""WITH {EVENT_FRAMES}, h AS (SELECT *, value > 50 AS high, lag(value > 50) OVER w AS before FROM f WINDOW w AS {W})
SELECT episode_index, frame_index, high FROM h WHERE before <> high""")
def transitions(spark, d):
    return t.transitions(event_frames(spark, d), "value", 50).select("episode_index", "frame_index", "high")


@query(f"""WITH {EVENT_FRAMES}, z AS (SELECT *, abs(value) <= 10 AS zero, lag(value) OVER w AS pv FROM f WINDOW w AS {W}),
c AS (SELECT *, CASE WHEN zero IS DISTINCT FROM lag(zero) OVER w OR frame_index = 0 THEN 1 ELSE 0 END AS new FROM z WINDOW w AS {W}),
r AS (SELECT *, sum(new) OVER {W} AS run FROM c),
g AS (SELECT episode_index, run, min(frame_index) AS first, max(frame_index) AS last, count(*) AS length FROM r WHERE zero GROUP BY 1, 2 HAVING count(*) <= 2)
SELECT g.episode_index, g.first, g.length, b.value AS before, a.value AS after FROM g JOIN f b ON b.episode_index = g.episode_index AND b.frame_index = g.first - 1
JOIN f a ON a.episode_index = g.episode_index AND a.frame_index = g.last + 1 WHERE least(abs(b.value), abs(a.value)) >= 20 AND greatest(abs(b.value), abs(a.value)) >= 45""")
def zero_runs(spark, d):
    return t.zero_runs(event_frames(spark, d), "value", 10, 20, 45, 2)


@query(f"""WITH {EVENT_FRAMES}, a AS (SELECT *, max(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER (PARTITION BY episode_index) AS n FROM f)
SELECT episode_index, min(CASE WHEN m <= 40 AND frame_index <= n - 4 THEN frame_index END) AS first_stable, max(CASE WHEN value > 40 THEN frame_index END) + 1 AS after_last_active, min(CASE WHEN value > 40 THEN frame_index END) AS first_active FROM a GROUP BY 1""")
def stable_window(spark, d):
    return t.stable_window(event_frames(spark, d), "value", 4, 40)


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, count_if(timestamp < 100000)::BIGINT AS left_index, count_if(timestamp <= 500000)::BIGINT AS right_index FROM f GROUP BY 1")
def time_bounds(spark, d):
    return t.time_bounds(event_frames(spark, d), 100000, 500000)


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, ceil(count(*) OVER (PARTITION BY episode_index) / 20.0)::BIGINT AS stride FROM f)
SELECT episode_index, frame_index, stride, value FROM n WHERE frame_index % stride = 0""")
def plot_points(spark, d):
    return t.at_most_points(event_frames(spark, d), 20).select("episode_index", "frame_index", "stride", "value")


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, coalesce(max(task = 'purchase') OVER (PARTITION BY episode_index ORDER BY frame_index), false) AS done_mask,
min(CASE WHEN task = 'purchase' THEN frame_index END) OVER (PARTITION BY episode_index) AS first_done FROM f""")
def done_mask(spark, d):
    return t.done_mask(event_frames(spark, d), F.col("task") == "purchase").select("episode_index", "frame_index", "done_mask", "first_done")


@query(f"""WITH {EVENT_FRAMES}, b AS (SELECT episode_index, max(timestamp) * 0.2 AS s0, max(timestamp) * 0.4 AS s2, max(timestamp) * 0.6 AS e2, max(timestamp) * 0.8 AS s4, max(timestamp) * 0.9 AS e4 FROM f GROUP BY 1)
SELECT episode_index, frame_index, CASE WHEN timestamp < s0 THEN 0 WHEN timestamp < s2 THEN 1 WHEN timestamp <= e2 THEN 2 WHEN timestamp < s4 THEN 3 WHEN timestamp <= e4 THEN 4 ELSE 5 END AS stage FROM f JOIN b USING (episode_index)""")
def stage_states(spark, d):
    f = event_frames(spark, d)
    top = F.max("timestamp")
    parts = {"stage0_end": 0.2, "stage2_start": 0.4, "stage2_end": 0.6, "stage4_start": 0.8, "stage4_end": 0.9}
    bounds = f.groupBy("episode_index").agg(*((top * v).alias(k) for k, v in parts.items()))
    return t.stage_states(f, bounds, give=True).select("episode_index", "frame_index", "stage")


@query(f"""WITH {ORDER_FRAMES}, n AS (SELECT episode_index, count(*) AS n FROM o GROUP BY 1), s AS (SELECT episode_index, sum(n) OVER (ORDER BY episode_index) - n AS start FROM n)
SELECT episode_index, frame_index, (start + frame_index)::BIGINT AS index FROM o JOIN s USING (episode_index)""")
def global_index(spark, d):
    return t.global_index(order_frames(spark, d)).select("episode_index", "frame_index", "index")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value, timestamp FROM f WHERE frame_index < 5")
def head_scan(spark, d):
    from ..sources.dataset import head

    return head(event_frames(spark, d), 5, "episode_index", "frame_index", "value", "timestamp")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, round(max(timestamp) - min(timestamp), 6) AS duration, count(*) AS frames FROM f GROUP BY 1")
def episode_duration(spark, d):
    return event_frames(spark, d).groupBy("episode_index").agg(F.round(F.max("timestamp") - F.min("timestamp"), 6).alias("duration"), F.count("*").alias("frames"))
