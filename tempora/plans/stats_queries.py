"""Queries over statistics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as p
from ..operators import stats as s
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames, table
from .registry import query

DIMS = f"WITH {ORDER_FRAMES}, x AS (SELECT episode_index, (i - 1)::INTEGER AS dim, action[i] AS x FROM o, (SELECT unnest(range(1, 5)) AS i))"
STATS = f"{DIMS}, st AS (SELECT episode_index, dim, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, count(x) AS count FROM x GROUP BY 1, 2)"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"{STATS} SELECT episode_index, dim, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, count FROM st")
def episode_stats(spark, d):
    return _rounded(s.episode_stats(order_frames(spark, d), "action", 4), "min", "max", "mean", "std")


@query(f"{DIMS} SELECT dim, round(min(x), 3) AS min, round(max(x), 3) AS max, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS std, count(x)::BIGINT AS count FROM x GROUP BY 1")
def merge_stats(spark, d):
    return _rounded(s.merge_stats(s.episode_stats(order_frames(spark, d), "action", 4), "dim"), "min", "max", "mean", "std", digits=3)


@query(f"""WITH {EVENT_FRAMES} SELECT task, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS count
FROM (SELECT task, CASE WHEN value > 90 THEN NULL ELSE value END AS v FROM f) GROUP BY 1""")
def nan_stats(spark, d):
    f = event_frames(spark, d).withColumn("v", F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("value")))
    return _rounded(s.nan_stats(f, "v", "task"), "min", "max", "mean", "std")


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT episode_index, count(*) AS n FROM f GROUP BY 1), r AS (SELECT *, (sum(n) OVER (ORDER BY episode_index) - n)::BIGINT AS start FROM n)
SELECT episode_index, start AS min, start + n - 1 AS max, start + (n - 1) / 2 AS mean, round(sqrt((n * n - 1) / 12), 6) AS std, n AS count FROM r""")
def range_stats(spark, d):
    from ..operators.temporal import offsets_from_lengths

    lengths = offsets_from_lengths(event_frames(spark, d).groupBy("episode_index").agg(F.count("*").alias("length")))
    return _rounded(s.range_stats(lengths, F.col("from_index"), F.col("length")).select("episode_index", "min", "max", "mean", "std", "count"), "std", digits=6)


@query("SELECT event_type AS task, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS max, round(sum(value), 3) AS total FROM events GROUP BY 1")
def timing_percentiles(spark, d):
    out = s.timings(event_frames(spark, d), "value", "task")
    return _rounded(_rounded(out, "mean", "p50", "p90"), "total", digits=3)


@query("SELECT source, lang, count(*) AS count, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1, 2")
def distribution_percent(spark, d):
    return _rounded(s.distribution(table(spark, d, "documents"), "source", "lang"), "percent", digits=6)


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT episode_index, max(timestamp) / 86400 AS days FROM f GROUP BY 1),
e AS (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64]) AS low, unnest(range(0, 8)) AS bucket),
b AS (SELECT (SELECT max(bucket) FROM e WHERE low <= days) AS bucket, count(*) AS count FROM n GROUP BY 1)
SELECT e.bucket::INTEGER AS bucket, e.low::DOUBLE AS low, coalesce(b.count, 0) AS count FROM e LEFT JOIN b USING (bucket)""")
def duration_histogram(spark, d):
    n = event_frames(spark, d).groupBy("episode_index").agg((F.max("timestamp") / 86400).alias("days"))
    return s.histogram(n, "days", [0, 1, 2, 4, 8, 16, 32, 64])


@query("SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def crosstab(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.select("o_custkey", "o_orderpriority").join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("count"))


@query("""WITH l AS (SELECT source, d.doc_id AS episode_index, toxic = 1 AS flag FROM documents d LEFT JOIN labels USING (doc_id))
SELECT source, count_if(flag)::BIGINT AS n_true, count_if(NOT flag)::BIGINT AS n_false, count_if(flag IS NULL)::BIGINT AS n_missing, count(DISTINCT CASE WHEN flag THEN episode_index END) AS episodes_any FROM l GROUP BY 1""")
def flag_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "episode_index")
    return s.flag_counts(rows, F.col("toxic") == 1, "source")


@query("""WITH i AS (SELECT user_id AS episode_index, event_type AS reason FROM events WHERE value > 95)
SELECT 'reason' AS kind, reason AS key, count(*) AS count FROM i GROUP BY 2 UNION ALL SELECT 'episode', episode_index::VARCHAR || ':' || array_to_string(list_sort(list(DISTINCT reason)), ','), 1 FROM i GROUP BY episode_index""")
def issue_reasons(spark, d):
    i = event_frames(spark, d).filter("value > 95").select("episode_index", F.col("task").alias("reason"))
    counts, reasons = s.issue_reasons(i)
    return counts.select(F.lit("reason").alias("kind"), F.col("reason").alias("key"), "count").unionByName(reasons.select(F.lit("episode").alias("kind"), F.concat_ws(":", F.col("episode_index").cast("string"), F.array_join("reasons", ",")).alias("key"), F.lit(1).cast("long").alias("count")))


@query("SELECT md5(text) AS fingerprint, count(*) AS members, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_summary(spark, d):
    return s.duplicate_summary(table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"), F.md5("text").alias("fingerprint")))


@query(f"""WITH {ORDER_FRAMES}, k AS (SELECT DISTINCT episode_index FROM o ORDER BY 1 LIMIT 64), x AS (SELECT i AS dim, coalesce(action[1 + i], 0) AS x FROM o JOIN k USING (episode_index), (SELECT unnest(range(0, 6)) AS i))
SELECT dim::INTEGER AS dim, round_even(min(x), 6) AS min, round_even(max(x), 6) AS max, round_even(avg(x), 6) AS mean, round_even(stddev_pop(x), 6) AS std, count(*) AS count FROM x GROUP BY 1""")
def ragged_action_stats(spark, d):
    out = s.padded_stats(order_frames(spark, d), "action", 6, 64)
    return out.withColumns({c: F.bround(c, 6) for c in ("min", "max", "mean", "std")})


@query("""SELECT event_type AS task, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b, count(*) FILTER (user_id % 2 = 1) - count(*) FILTER (user_id % 2 = 0) AS difference FROM events GROUP BY 1""")
def compare_ab(spark, d):
    return s.compare_sides(event_frames(spark, d).withColumn("side", F.when(F.col("episode_index") % 2 == 0, "A").otherwise("B")), "side", "task")


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT *, min(CASE WHEN task = 'purchase' THEN frame_index END) OVER (PARTITION BY episode_index) AS first FROM f)
SELECT episode_index, round(sum(value), 6) AS sum_reward, max(value) AS max_reward, max(value > 80) AS success, count(*) AS steps FROM m WHERE first IS NULL OR frame_index <= first + 1 GROUP BY 1""")
def rollout_metrics(spark, d):
    return _rounded(s.rollout_metrics(event_frames(spark, d), "value", F.col("task") == "purchase", F.col("value") > 80), "sum_reward")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, round(sum(value * (1 + frame_index % 3)) OVER w / sum(1 + frame_index % 3) OVER w, 7) AS running_mean FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)")
def running_mean(spark, d):
    return _rounded(s.running_mean(event_frames(spark, d), "value", 1 + F.col("frame_index") % 3), "running_mean", digits=7).select("episode_index", "frame_index", "running_mean")


@query("SELECT task, e // 16 AS chunk, array_to_string(list_sort(list(DISTINCT e)), ',') AS episodes, count(DISTINCT e) AS n FROM (SELECT event_type AS task, user_id AS e FROM events) GROUP BY 1, 2")
def inverted_index(spark, d):
    return s.inverted_index(event_frames(spark, d), "task", 16).select("task", "chunk", F.array_join(F.transform("episodes", lambda e: e.cast("string")), ",").alias("episodes"), "n")


@query("SELECT conv_id AS episode_index, array_to_string(list_sort(list(DISTINCT role)), ',') AS tasks, count(*) AS length FROM conversations GROUP BY 1")
def episode_tasks(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("tasks"), F.count("*").alias("length"))


@query("SELECT count(DISTINCT user_id) AS total_episodes, count(*) AS total_frames, count(DISTINCT event_type) AS total_tasks, ceil(count(DISTINCT user_id) / 1000.0)::BIGINT AS total_chunks FROM events")
def recount_totals(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count_distinct("user_id").alias("total_episodes"), F.count("*").alias("total_frames"), F.count_distinct("event_type").alias("total_tasks")).withColumn("total_chunks", F.ceil(F.col("total_episodes") / 1000))


@query("SELECT doc_id AS episode_index, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS r FROM documents) WHERE r <= 20")
def stratified_sample(spark, d):
    return p.stratified(table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"), "source"), "source", 20, 7)


@query(f"WITH {EVENT_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f) SELECT episode_index, frame_index FROM n WHERE frame_index >= 2 AND frame_index < n - 3")
def episode_sampler(spark, d):
    return p.inner_frames(event_frames(spark, d), 2, 3).select("episode_index", "frame_index")


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT episode_index, frame_index, CASE WHEN episode_index % 4 = 0 THEN 'online' ELSE 'offline' END AS source, (frame_index >= 1)::INT AS keep FROM f),
k AS (SELECT *, keep * (CASE source WHEN 'online' THEN 0.3 ELSE 0.7 END) / sum(keep) OVER (PARTITION BY source) AS w FROM m) SELECT episode_index, frame_index, source, round(w / sum(w) OVER (), 12) AS weight FROM k""")
def sampler_weights(spark, d):
    f = event_frames(spark, d).withColumn("source", F.when(F.col("episode_index") % 4 == 0, "online").otherwise("offline"))
    return _rounded(p.mixed_weights(f, "source", F.col("frame_index") >= 1, {"online": 0.3, "offline": 0.7}).select("episode_index", "frame_index", "source", "weight"), "weight", digits=12)


@query("SELECT source, count(*) AS n, greatest(least(100, count(*)), least(floor(pow(count(*), 0.75))::BIGINT, 10000)) AS size FROM documents GROUP BY 1")
def sample_size(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("size", p.sample_size(F.col("n")))


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY value DESC, frame_index) AS r FROM f) WHERE r = 1")
def top_by_confidence(spark, d):
    return p.top_by(event_frames(spark, d), "episode_index", F.desc("value"), F.col("frame_index")).select("episode_index", "frame_index", "value")


@query("SELECT o_custkey AS episode_index, o_orderkey AS variant FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_variant(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("variant"), "o_orderdate", "o_orderpriority")
    return p.top_by(o, "episode_index", F.desc("o_orderdate"), F.col("o_orderpriority"), F.col("variant")).select("episode_index", "variant")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, frame_index // 8 AS chunk, frame_index % 8 AS step FROM f")
def action_chunks(spark, d):
    return p.action_chunks(event_frames(spark, d), 8).select("episode_index", "frame_index", "chunk", "step")


@query()
def balanced_selection(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"), "lang", "source", F.floor(F.col("n_chars") / 1000).alias("bucket"))
    return p.balanced(docs.withColumn("scenario", F.col("lang")), "scenario", 25, ["source", "bucket"], ["episode_index"]).select("scenario", "episode_index", "pick")
