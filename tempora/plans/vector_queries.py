"""Queries over vectors and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as v
from ..operators import stats as s
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames, table
from .registry import query

NORMS = f"WITH {ORDER_FRAMES}, st AS (SELECT i, avg(action[i]) AS m, stddev_pop(action[i]) AS sd, min(action[i]) AS lo, max(action[i]) AS hi FROM o, (SELECT unnest(range(1, 5)) AS i) GROUP BY 1)"


def _per_row(expression: str) -> str:
    return f"{NORMS} SELECT episode_index, frame_index, (i - 1)::INTEGER AS dim, round({expression}, 6) AS x FROM o, st"


def _normalised(spark, d, f):
    frames = order_frames(spark, d)
    stats = s.column_normaliser(s.vector_stats(frames, "action", 4))
    out = frames.join(F.broadcast(stats)).select("episode_index", "frame_index", F.posexplode(f(F.col("action"), F.col("mean"), F.col("std"), F.col("min"), F.col("max"))).alias("dim", "x"))
    return out.withColumn("x", F.round("x", 6))


@query(_per_row("(action[i] - m) / (sd + 1e-8)"))
def normalize_mean_std(spark, d):
    return _normalised(spark, d, lambda a, m, sd, lo, hi: v.normalize_mean_std(a, m, sd))


@query(_per_row("(action[i] - lo) / (hi - lo + 1e-8) * 2 - 1"))
def normalize_min_max(spark, d):
    return _normalised(spark, d, lambda a, m, sd, lo, hi: v.normalize_min_max(a, lo, hi))


@query(_per_row("(action[i] - lo) / (hi - lo + 1e-8) * (hi - lo) + lo"))
def unnormalize(spark, d):
    return _normalised(spark, d, lambda a, m, sd, lo, hi: v.unnormalize_min_max(v.normalize_min_max(a, lo, hi), lo, hi))


EMB = "e AS (SELECT vec_id, label, (i - 1) AS dim, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query(f"""WITH {EMB}, m AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT label, dim::INTEGER AS dim, round(x / n, 6) AS x FROM m JOIN n USING (label)""")
def mean_pool(spark, d):
    return v.mean_pool(table(spark, d, "embeddings"), "embedding", "label").select("label", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {ORDER_FRAMES}, x AS (SELECT episode_index, i, action[i] AS x FROM o, (SELECT unnest(range(1, 5)) AS i)), st AS (SELECT episode_index, i, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1, 2),
p AS (SELECT episode_index, i - 1 AS place, m AS x FROM st UNION ALL SELECT episode_index, i + 3, sd FROM st UNION ALL SELECT episode_index, i + 7, lo FROM st UNION ALL SELECT episode_index, i + 11, hi FROM st), n AS (SELECT episode_index, sqrt(sum(x * x)) AS n FROM p GROUP BY 1)
SELECT episode_index, place::INTEGER AS place, round(x / n, 6) AS x FROM p JOIN n USING (episode_index)""")
def stat_embedding(spark, d):
    st = s.wide_stats(order_frames(spark, d), "action", 4, "episode_index")
    st = st.withColumn("stats", F.filter("stats", lambda x: x["count"] > 0)).filter(F.size("stats") > 0)
    # outer: no embedding is empty, and Spark would make each once more to see that
    return v.wide_embedding(st, "episode_index", 16).select("episode_index", F.posexplode_outer("embedding").alias("place", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT *, abs(value - lag(value) OVER w) AS dv FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
a AS (SELECT episode_index, coalesce(sum(dv) FILTER (frame_index % 2 = 0), 0) AS l, coalesce(sum(dv) FILTER (frame_index % 2 = 1), 0) AS r FROM m GROUP BY 1)
SELECT episode_index, CASE WHEN greatest(l, r) < 1e-6 THEN 'unclear' WHEN greatest(l, r) < 1.25 * least(l, r) THEN 'both' WHEN l > r THEN 'left' ELSE 'right' END AS arm FROM a""")
def active_arm(spark, d):
    from ..operators.temporal import difference

    m = difference(event_frames(spark, d), "value").withColumn("d", F.abs("delta"))
    half = lambda k: F.coalesce(F.sum(F.when(F.col("frame_index") % 2 == k, F.col("d"))), F.lit(0.0))
    return m.groupBy("episode_index").agg(half(0).alias("l"), half(1).alias("r")).select("episode_index", v.active_arm(F.col("l"), F.col("r")).alias("arm"))


LINKS = (0.24, 0.20, 0.16, 0.11)


@query("""WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e FROM embeddings)
SELECT vec_id, round(-0.32 + (0.24 * cos(a) + 0.2 * cos(a + b) + 0.16 * cos(a + b + c) + 0.11 * cos(a + b + c + e)), 6) AS x, round(0.24 * sin(a) + 0.2 * sin(a + b) + 0.16 * sin(a + b + c) + 0.11 * sin(a + b + c + e), 6) AS y FROM a""")
def forward_kinematics(spark, d):
    x, y = v.forward_kinematics([F.col("embedding")[k].cast("double") for k in range(4)], list(LINKS), -0.32)
    return table(spark, d, "embeddings").select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT *, abs(value - lag(value) OVER w) AS dv FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index AS grasp_frame, round(dv, 6) AS grasp_change FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY dv DESC, frame_index) AS r FROM m WHERE dv IS NOT NULL) WHERE r = 1""")
def grasp_event(spark, d):
    return v.grasp_event(event_frames(spark, d), "value").withColumn("grasp_change", F.round("grasp_change", 6))


@query("""SELECT l_orderkey AS step, round(sum(exp(-0.01 * l_linenumber) * l_quantity) / sum(exp(-0.01 * l_linenumber)), 6) AS ensembled, count(*) AS predictions FROM lineitem GROUP BY 1""")
def temporal_ensemble(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), "l_linenumber", "l_quantity")
    return v.ensemble(line, "step", "l_linenumber", "l_quantity").withColumn("ensembled", F.round("ensembled", 6))


@query(f"""WITH {EMB}, c AS (SELECT label, dim, avg(x) AS c FROM e GROUP BY 1, 2) SELECT e.vec_id, round(sqrt(sum((x - c) * (x - c))), 6) AS distance FROM e JOIN c ON e.label = c.label AND e.dim = c.dim GROUP BY 1""")
def centroid_distance(spark, d):
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda t: t["x"]).alias("c"))
    return e.join(centre, "label").select("vec_id", F.round(v.distance(F.col("embedding"), F.col("c")), 6).alias("distance"))


@query("SELECT vec_id, sqrt(s / 8) <= 0.2 AND m <= 0.4 AS near FROM (SELECT vec_id, list_sum(list_transform(d, lambda x: x * x)) AS s, list_max(list_transform(d, lambda x: abs(x))) AS m FROM (SELECT vec_id, list_transform(range(1, 9), lambda i: embedding[i]::DOUBLE - embedding[i + 8]::DOUBLE) AS d FROM embeddings))")
def near_pose(spark, d):
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", v.near_pose(part(1), part(9), 0.2, 0.4).alias("near"))


@query("SELECT vec_id, len(f)::INTEGER AS n, round(list_sum(f), 6) AS total FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda x: x::DOUBLE), [0.5, 0.5, 0.5, 0.5]::DOUBLE[]) AS f FROM embeddings)")
def fit_vector(spark, d):
    f = v.fit(F.transform("embedding", lambda x: x.cast("double")), 68, 0.5)
    return table(spark, d, "embeddings").select("vec_id", F.size(f).alias("n"), F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT o_orderkey AS id, round(-1 * (o_orderkey - 2048) * (2 * 3.141592653589793 / 4096) + 0.5, 9) AS sim FROM orders")
def sim_position(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(v.sim_position(F.col("o_orderkey"), F.lit(2048), -1, 0.5), 9).alias("sim"))


@query()
def pca_2d(spark, d):
    out = v.pca_2d(table(spark, d, "embeddings"), "embedding", "vec_id")
    return out.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
