"""Queries over records kept beside the frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sidecar as s
from ..operators.temporal import difference
from ..sources.adapters import EVENT_FRAMES, event_frames, table
from .registry import query


@query(f"""WITH {EVENT_FRAMES}, x AS (SELECT episode_index, frame_index, timestamp - lag(timestamp) OVER (PARTITION BY episode_index ORDER BY frame_index) AS d FROM f)
SELECT episode_index, frame_index FROM x WHERE abs(d * 0.01 - round_even(d * 0.01, 0)) / 0.01 > 20""")
def delta_multiples(spark, d):
    return difference(event_frames(spark, d), "timestamp", "delta").filter(s.off_grid(F.col("delta"), 0.01, 20.0)).select("episode_index", "frame_index")


@query("""WITH c AS (SELECT l_returnflag AS feature, l_linenumber AS width, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, first_value(width) OVER (PARTITION BY feature ORDER BY n DESC, width) AS majority FROM c)
SELECT feature, width, n, majority FROM m WHERE width <> majority""")
def shape_mismatches(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_linenumber").alias("width"))
    return s.width_mismatches(rows, "feature", "width").select("feature", "width", "n", "majority")


@query("""SELECT vec_id AS episode_index, o_orderpriority AS tag, l.toxic AS toxic FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id LEFT JOIN labels l ON l.doc_id = vec_id""")
def point_metadata(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("episode_index"))
    tags = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), "o_orderpriority")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("episode_index"), "toxic")
    return s.attach(s.attach(points, tags, "t"), labels, "l").select("episode_index", F.col("t.o_orderpriority").alias("tag"), F.col("l.toxic").alias("toxic"))


@query("""WITH p AS (SELECT l_orderkey AS e, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(o_orderpriority, 'untagged') AS tag, sum(n)::BIGINT AS rows, count(*) AS episodes FROM p LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON o_orderkey = e GROUP BY 1""")
def tagged_rows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_index"))
    tags = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("tag"))
    return s.tag_counts(rows, tags, "tag")


@query("""WITH a AS (SELECT l_orderkey AS e, l_linenumber AS det, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 13)::DOUBLE AS y FROM lineitem), p AS (SELECT a.e, a.det, b.det AS match, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS moved FROM a JOIN a b ON a.e = b.e AND a.det <= 2 AND b.det > 2)
SELECT e AS episode_index, det, match, round(moved, 6) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY e, det ORDER BY moved, match) AS k FROM (SELECT DISTINCT * FROM p)) WHERE k = 1""")
def detection_movement(spark, d):
    at = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("det"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 13).cast("double").alias("y"))
    return s.movement(at.filter("det <= 2"), at.filter("det > 2")).withColumn("moved", F.round("moved", 6))


@query("""WITH n AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS id, coalesce(nullif(c_custkey % 4, 0), n, 0) AS total FROM customer LEFT JOIN n ON c = c_custkey""")
def stated_totals(spark, d):
    stated = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("total"))
    return s.totals(stated, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "total")


@query("""WITH l AS (SELECT [p_type, p_brand, p_type] AS m, p_size % 3 AS k FROM part), e AS (SELECT unnest(list_distinct(m)) AS scenario, k FROM l) SELECT scenario, count(*) AS candidates, sum(k)::BIGINT AS missing FROM e GROUP BY 1""")
def candidate_summaries(spark, d):
    words = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("p_size") % 3).cast("int"))
    return s.memberships(table(spark, d, "part"), F.array("p_type", "p_brand", "p_type"), words)


@query("""WITH k AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0)) SELECT n AS episode_index, event_id, value FROM events JOIN k USING (user_id) WHERE value > 90""")
def reindexed_sidecars(spark, d):
    f = table(spark, d, "events").withColumnRenamed("user_id", "episode_index")
    return s.reindexed(f.filter("value > 90").select("episode_index", "event_id", "value"), f.filter("episode_index % 7 <> 0"))


@query("""SELECT user_id AS episode_index, 0 AS flags, 0::BIGINT AS flag_count, min(value) AS least FROM events GROUP BY 1""")
def cleared_flags(spark, d):
    flags = table(spark, d, "events").groupBy(F.col("user_id").alias("episode_index")).agg(F.collect_list("event_type").alias("flags"), F.count("*").alias("flag_count"), F.min("value").alias("least"))
    return s.cleared(flags).withColumn("flags", F.size("flags"))


@query("SELECT p_partkey AS id, p_name AS text FROM part")
def unwrapped_text(spark, d):
    wrapped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("tf.Tensor(b'"), "p_name", F.lit("', shape=(), dtype=string)"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.unwrap(wrapped).alias("text"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 3 <> 0) SELECT label, dim::INT AS dim, round(avg(v), 6) AS mean, count(*) AS n FROM e GROUP BY 1, 2""")
def masked_pooling(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return s.masked_mean(v, "embedding", F.col("vec_id") % 3 != 0, "label").withColumn("mean", F.round("mean", 6))


@query("""SELECT o_orderkey AS episode_index, 'prompt_action_mismatch' AS type FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'missing_target' FROM orders WHERE o_custkey % 5 = 0""")
def label_issues(spark, d):
    labels = table(spark, d, "orders").withColumnRenamed("o_orderkey", "episode_index")
    return s.label_issues(labels, F.when(F.col("o_orderstatus") == "F", "mismatch").otherwise("match"), F.col("o_custkey") % 5)


@query("""SELECT user_id AS episode_index, event_id, event_type AS reason FROM events WHERE NOT (event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE value > 95))""")
def resolved_issues(spark, d):
    found = table(spark, d, "events").select(F.col("user_id").alias("episode_index"), "event_id", F.col("event_type").alias("reason"), "value")
    return s.without_resolved(found, found.filter("value > 95"), "click").select("episode_index", "event_id", "reason")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def matching_rows(spark, d):
    return s.matching(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="F", l_shipdate=None).select("l_orderkey", "l_linenumber", "l_partkey")
