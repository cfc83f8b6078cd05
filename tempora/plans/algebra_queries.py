"""Queries over sets of episodes and repairs, and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as a
from ..operators import quality as q
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames, table
from .registry import ORACLES, query

DENSE = "dense_rank() OVER (ORDER BY {}) - 1"
FLIPS = f"""WITH {EVENT_FRAMES}, g AS (SELECT *, (event_id * 37) % 100 AS act FROM f),
x AS (SELECT *, coalesce((value > 50) <> lag(value > 50) OVER w, false) AS s, coalesce((act > 50) <> lag(act > 50) OVER w, false) AS a FROM g WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))"""


def _with_index(rows: str) -> str:
    """SQL that numbers the kept rows' episodes and gives the global index."""
    return f"{rows}, r AS (SELECT *, dense_rank() OVER (ORDER BY old_episode) - 1 AS episode_index FROM k) SELECT old_episode, episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM r"


@query(_with_index(f"WITH {EVENT_FRAMES}, k AS (SELECT episode_index AS old_episode, frame_index FROM f WHERE episode_index >= 10 AND episode_index < 60)"))
def split_range(spark, d):
    return a.split(event_frames(spark, d), (F.col("episode_index") >= 10) & (F.col("episode_index") < 60)).select("old_episode", "episode_index", "frame_index", "index")


@query(_with_index(f"WITH {EVENT_FRAMES}, k AS (SELECT episode_index AS old_episode, frame_index FROM f WHERE episode_index IN (SELECT episode_index FROM f WHERE task = 'purchase' AND value > 90))"))
def split_task(spark, d):
    return a.split(event_frames(spark, d), (F.col("task") == "purchase") & (F.col("value") > 90)).select("old_episode", "episode_index", "frame_index", "index")


@query(f"""WITH {EVENT_FRAMES}, k AS (SELECT 0 AS source, episode_index AS old_episode, frame_index FROM f WHERE episode_index % 3 = 0 UNION ALL SELECT 1, episode_index, frame_index FROM f WHERE episode_index % 2 = 0),
r AS (SELECT *, dense_rank() OVER (ORDER BY source, old_episode) - 1 AS episode_index FROM k)
SELECT source, old_episode, episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM r""")
def merge_union(spark, d):
    f = event_frames(spark, d)
    return a.merge([f.filter("episode_index % 3 = 0"), f.filter("episode_index % 2 = 0")]).select("source", "old_episode", "episode_index", "frame_index", "index")


@query(_with_index(f"WITH {EVENT_FRAMES}, k AS (SELECT episode_index AS old_episode, frame_index FROM f WHERE episode_index NOT IN (SELECT user_id FROM events WHERE value > 250))"))
def delete_reindex(spark, d):
    f = event_frames(spark, d)
    return a.delete(f, f.filter("value > 250").select("episode_index").distinct()).select("old_episode", "episode_index", "frame_index", "index")


SAME = """p AS (SELECT episode_index, string_agg(value::VARCHAR || task, '|' ORDER BY frame_index) AS fp FROM f GROUP BY 1)"""


@query(f"""WITH {EVENT_FRAMES}, {SAME}, b AS (SELECT * FROM p WHERE episode_index % 3 = 1) SELECT f.episode_index, count(*) AS frames FROM f JOIN p USING (episode_index) WHERE p.fp NOT IN (SELECT fp FROM b) GROUP BY 1""")
def subtract_fingerprint(spark, d):
    f = event_frames(spark, d)
    return a.subtract(f, f.filter("episode_index % 3 = 1"), ["value", "task"]).groupBy("episode_index").agg(F.count("*").alias("frames"))


@query(f"""WITH {EVENT_FRAMES}, {SAME}, g AS (SELECT episode_index + 500 AS episode_index, frame_index, CASE WHEN episode_index % 5 = 1 AND frame_index = 3 THEN value + 1 ELSE value END AS value, task FROM f WHERE episode_index % 5 < 2),
o AS (SELECT string_agg(value::VARCHAR || task, '|' ORDER BY frame_index) AS fp FROM g GROUP BY episode_index) SELECT count_if(fp IN (SELECT fp FROM o)) AS matched, count_if(fp NOT IN (SELECT fp FROM o)) AS unmatched FROM p""")
def intersect_counts(spark, d):
    """D04 against episodes with other numbers, some of them with one value changed."""
    f = event_frames(spark, d)
    other = f.filter("episode_index % 5 < 2").withColumn("value", F.when((F.col("episode_index") % 5 == 1) & (F.col("frame_index") == 3), F.col("value") + 1).otherwise(F.col("value")))
    return a.intersect_counts(f, other.withColumn("episode_index", F.col("episode_index") + 500), ["value", "task"])


@query("""WITH x AS (SELECT DISTINCT p_brand AS k FROM part WHERE p_size < 4), y AS (SELECT DISTINCT p_brand AS k FROM part WHERE p_size > 46)
SELECT coalesce(x.k, y.k) AS brand, CASE WHEN y.k IS NULL THEN 'a_only' WHEN x.k IS NULL THEN 'b_only' ELSE 'both' END AS side FROM x FULL JOIN y ON x.k = y.k""")
def vocab_venn(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "brand")
    return a.venn(part.filter("p_size < 4").select("brand").distinct(), part.filter("p_size > 46").select("brand").distinct(), "brand")


@query("WITH e AS (SELECT DISTINCT user_id AS episode_index FROM events), r AS (SELECT *, row_number() OVER (ORDER BY episode_index) - 1 AS r FROM e) SELECT episode_index, r // 16 AS chunk, r % 16 AS place FROM r")
def chunk_split(spark, d):
    return a.chunks(table(spark, d, "events").select(F.col("user_id").alias("episode_index")).distinct(), 16).select("episode_index", "chunk", "place")


@query("""WITH e AS (SELECT user_id AS e, value FROM events), fl AS (SELECT DISTINCT e FROM e WHERE value > 98), b AS (SELECT DISTINCT e FROM e WHERE value > 99), n AS (SELECT DISTINCT e FROM e WHERE value < 1),
m AS (SELECT e FROM fl EXCEPT SELECT e FROM b) SELECT coalesce(m.e, n.e) AS episode_index, m.e IS NOT NULL AS manual, n.e IS NOT NULL AS auto FROM m FULL JOIN n ON m.e = n.e""")
def flag_algebra(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_index"), "value")
    return a.flag_algebra(e.filter("value > 98"), e.filter("value > 99"), e.filter("value < 1"))


@query(f"""WITH {EVENT_FRAMES}, k AS (SELECT episode_index, timestamp, frame_index AS old, row_number() OVER w - 1 AS frame_index, timestamp - first_value(timestamp) OVER w AS t FROM f WHERE value > 20 WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index, round(t, 6) AS timestamp, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM k""")
def fix_indices(spark, d):
    return a.fix_indices(event_frames(spark, d).filter("value > 20")).select("episode_index", "frame_index", F.round("timestamp", 6).alias("timestamp"), "index")


@query(f"""WITH {EVENT_FRAMES}, k AS (SELECT episode_index, timestamp, frame_index FROM f WHERE NOT (frame_index = 0 AND episode_index % 4 = 0)),
r AS (SELECT episode_index, row_number() OVER w - 1 AS frame_index, timestamp - first_value(timestamp) OVER w AS t FROM k WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, frame_index, round(t, 6) AS timestamp FROM r""")
def trim_first_frame(spark, d):
    f = event_frames(spark, d)
    return a.trim_first(f, f.filter("episode_index % 4 = 0")).select("episode_index", "frame_index", F.round("timestamp", 6).alias("timestamp"))


@query("""WITH o AS (SELECT user_id AS episode_index, event_type AS reason, count(*) AS n FROM events WHERE value > 90 GROUP BY 1, 2), w AS (SELECT user_id AS episode_index, event_type AS reason, count(*) AS n FROM events WHERE value < 5 AND user_id % 2 = 0 GROUP BY 1, 2)
SELECT * FROM o WHERE episode_index % 2 <> 0 UNION ALL SELECT * FROM w""")
def partial_overwrite(spark, d):
    e = event_frames(spark, d)
    rows = lambda c: e.filter(c).groupBy("episode_index", F.col("task").alias("reason")).agg(F.count("*").alias("n"))
    return a.overwrite_scanned(rows("value > 90"), rows("value < 5 AND episode_index % 2 = 0"), e.filter("episode_index % 2 = 0"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS i, p_brand AS task FROM (SELECT DISTINCT p_brand FROM part)), m AS (SELECT i, task, lower(left(task, 7)) AS new FROM t),
n AS (SELECT *, min(i) OVER (PARTITION BY new) AS to_index FROM m) SELECT p_partkey AS part, to_index AS task_index, new AS task FROM part JOIN n ON n.task = p_brand""")
def prompt_lowercase_remap(spark, d):
    part = table(spark, d, "part")
    tasks = a.append_tasks(spark.createDataFrame([], "task_index long, task string"), part.select(F.col("p_brand").alias("task")))
    rows = part.join(tasks, F.col("p_brand") == F.col("task")).select(F.col("p_partkey").alias("part"), "task_index")
    moved, new = a.remap_tasks(rows, tasks, F.lower(F.substring("task", 1, 7)))
    return moved.join(new, "task_index").select("part", "task_index", "task")


@query("""WITH o AS (SELECT doc_id, quality FROM labels), r AS (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 3 = 0)
SELECT o.doc_id, coalesce(r.quality, o.quality) AS quality, r.doc_id IS NOT NULL AS reviewed FROM o FULL JOIN r ON o.doc_id = r.doc_id""")
def overlay_reviewed(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    reviewed = labels.filter("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))
    return a.overlay(labels, reviewed, "doc_id", ["quality"])


@query(f"""WITH {EVENT_FRAMES}, h AS (SELECT *, value > 50 AS high, lag(value > 50) OVER w AS before, min(timestamp) OVER (PARTITION BY episode_index) AS t0 FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
e AS (SELECT episode_index, least(count(*), greatest(3, count_if(timestamp <= t0 + 86400))) AS early FROM h GROUP BY 1)
SELECT episode_index, array_to_string(list_sort(list(frame_index)), ',') AS frames FROM h JOIN e USING (episode_index) WHERE before <> high AND frame_index < early GROUP BY 1""")
def early_transition(spark, d):
    found = q.early_transition(event_frames(spark, d), "value", 50, 86400)
    return found.select("episode_index", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query(f"""WITH {EVENT_FRAMES}, g AS (SELECT *, CASE WHEN episode_index % 2 = 0 THEN 0.01 * (frame_index % 7) ELSE value / 100 END AS act FROM f), x AS (SELECT *, abs(act - lag(act) OVER w) AS dd FROM g WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, round(avg((value > 30)::INT), 6) AS closed_ratio, max(abs(act)) AS max_action, round(max(dd), 6) AS max_delta, round(quantile_cont(value, 0.5), 6) AS median_state FROM x GROUP BY 1
HAVING avg((value > 30)::INT) >= 0.6 AND max(abs(act)) <= 0.1 AND max(dd) <= 0.1""")
def stuck_signal(spark, d):
    f = event_frames(spark, d).withColumn("act", F.when(F.col("episode_index") % 2 == 0, 0.01 * (F.col("frame_index") % 7)).otherwise(F.col("value") / 100))
    return q.stuck_closed(f, "value", "act", 30, 0.6, 0.1, 0.1).select("episode_index", F.round("closed_ratio", 6).alias("closed_ratio"), "max_action", F.round("max_delta", 6).alias("max_delta"), F.round("median_state", 6).alias("median_state"))


@query(f"{FLIPS} SELECT s.episode_index, s.frame_index FROM x s WHERE s.s AND NOT EXISTS (SELECT 1 FROM x a WHERE a.a AND a.episode_index = s.episode_index AND a.frame_index BETWEEN s.frame_index - 3 AND s.frame_index + 1)")
def transition_without_action(spark, d):
    f = event_frames(spark, d).withColumn("act", (F.col("event_id") * 37) % 100)
    return q.unmatched_transitions(f, "value", "act", 3, 1, 50, 50).select("episode_index", "frame_index")


@query(f"""WITH {EVENT_FRAMES}, z AS (SELECT episode_index, frame_index AS first, event_id % 6 AS dim FROM f WHERE value < 20),
a AS (SELECT episode_index, first, count(DISTINCT dim) AS sync FROM z GROUP BY 1, 2), m AS (SELECT episode_index, max(sync) AS most_at_once FROM a GROUP BY 1), e AS (SELECT episode_index, count(*) AS events, count(DISTINCT dim) AS joints FROM z GROUP BY 1)
SELECT episode_index, events, joints, most_at_once FROM e JOIN m USING (episode_index) WHERE events >= 6 OR most_at_once >= 4 OR (joints >= 3 AND events >= 4)""")
def zero_reset_spikes(spark, d):
    runs = event_frames(spark, d).filter("value < 20").select("episode_index", F.col("frame_index").alias("first"), (F.col("event_id") % 6).alias("dim"))
    return q.zero_resets(runs).select("episode_index", "events", "joints", "most_at_once")


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT episode_index, count(DISTINCT CASE WHEN value > 150 THEN task END) AS n FROM f GROUP BY 1) SELECT episode_index, CASE WHEN n = 0 THEN 'missing_state' ELSE 'unsegmented_state' END AS type FROM n WHERE n < 2""")
def missing_states(spark, d):
    return q.missing_states(event_frames(spark, d).withColumn("state", F.when(F.col("value") > 150, F.col("task"))), "state")


@query("SELECT doc_id AS episode_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_frames(spark, d):
    of = lambda name: table(spark, d, name).select(F.col("doc_id").alias("episode_index"))
    return q.missing_frames(of("documents"), of("labels"))


@query("""WITH c AS (SELECT conv_id AS episode_index, list(DISTINCT text) AS p FROM conversations GROUP BY 1)
SELECT episode_index, 'multi_sentence_prompt' AS type FROM c WHERE len(list_filter(p, lambda x: regexp_matches(x, '[,.]'))) > 0 UNION ALL SELECT episode_index, 'multiple_task_assignments' FROM c WHERE len(p) > 1""")
def prompt_issues(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.collect_set("text").alias("p"))
    return q.prompt_issues(c, "p")


@query()
def prompt_issues_whole(spark, d):
    """The same from three texts of each conversation, which decide however many it has."""
    t = F.col("text")
    three = F.array_compact(F.array(F.min(t), F.max(t), F.min(F.when(t.rlike("[,.]"), t))))
    return q.prompt_issues(table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(three.alias("p")), "p")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN 100 WHEN doc_id % 5 = 0 THEN 90 WHEN doc_id % 3 = 0 AND n_chars < 500 THEN 95 WHEN source = 'src1' THEN 30
WHEN lang = 'en' THEN CASE WHEN c < 0.45 THEN 85 WHEN c < 0.65 THEN 70 WHEN g < 0.10 THEN 60 ELSE 30 END ELSE CASE WHEN c < 0.25 THEN 80 WHEN c < 0.30 THEN 70 WHEN g < 0.03 THEN 65 WHEN g < 0.05 THEN 55 ELSE 10 END END AS score
FROM (SELECT *, (n_chars % 100) / 100 AS c, (n_chars % 17) / 100 AS g FROM documents)""")
def uncertainty(spark, d):
    doc = table(spark, d, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    score = q.uncertainty(i % 11 == 0, i % 7 != 0, i % 5 != 0, F.when((i % 3 == 0) & (n < 500), 0).otherwise(1), F.col("source") == "src1", F.when(F.col("lang") == "en", "self").otherwise("detector"), (n % 100) / 100, (n % 17) / 100)
    return doc.select("doc_id", score.alias("score"))


@query(f"""WITH {ORDER_FRAMES}, s AS (SELECT episode_index FROM o GROUP BY 1 HAVING max(action[1]) <= 25) SELECT episode_index, frame_index, CASE WHEN s.episode_index IS NOT NULL THEN 100.0::DOUBLE ELSE action[3] END AS gripper, action[1] AS first
FROM o LEFT JOIN s USING (episode_index)""")
def fill_stuck_gripper(spark, d):
    f = order_frames(spark, d)
    stuck = f.groupBy("episode_index").agg(F.max(F.col("action")[0]).alias("m")).filter("m <= 25")
    return q.fill_stuck(f, "action", 2, 100.0, stuck).select("episode_index", "frame_index", F.col("action")[2].alias("gripper"), F.col("action")[0].alias("first"))


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, CASE WHEN max(abs(v)) OVER (PARTITION BY episode_index) > 1.5 THEN v / 100 ELSE v END AS gripper FROM (SELECT *, CASE WHEN episode_index % 2 = 0 THEN value ELSE value / 100 END AS v FROM f)""")
def gripper_rescale(spark, d):
    f = event_frames(spark, d).withColumn("gripper", F.when(F.col("episode_index") % 2 == 0, F.col("value")).otherwise(F.col("value") / 100))
    return q.rescale_gripper(f, "gripper").select("episode_index", "frame_index", "gripper")


@query(f"""WITH {EVENT_FRAMES}, h AS (SELECT *, value > 50 AS high, lag(value > 50) OVER w AS before FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)), e AS (SELECT episode_index, frame_index AS ef, high FROM h WHERE before <> high),
c AS (SELECT f.episode_index, f.frame_index, e.ef, CASE WHEN f.frame_index >= greatest(0, e.ef - 2) THEN e.high ELSE NOT e.high END AS high FROM f JOIN e ON e.episode_index = f.episode_index AND f.frame_index >= greatest(0, e.ef - 4)),
l AS (SELECT episode_index, frame_index, arg_max(high, ef) AS high FROM c GROUP BY 1, 2)
SELECT f.episode_index, f.frame_index, CASE WHEN l.high THEN 1.0::DOUBLE WHEN NOT l.high THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS action FROM f LEFT JOIN l USING (episode_index, frame_index)""")
def backfill_action(spark, d):
    f = event_frames(spark, d).withColumn("action", F.lit(-1.0))
    return q.backfill(f, "action", "value", 2, threshold=50).select("episode_index", "frame_index", "action")


@query(f"WITH {ORDER_FRAMES} SELECT DISTINCT count(*) AS frames, min(frame_index) = 0 AND max(frame_index) = count(*) - 1 AND count(DISTINCT frame_index) = count(*) AS contiguous FROM o GROUP BY episode_index")
def contiguous_range(spark, d):
    return q.contiguous(order_frames(spark, d, spread=True)).select("frames", "contiguous").distinct()


@query(f"WITH {EVENT_FRAMES} SELECT f.episode_index, f.frame_index, f.value FROM f JOIN (SELECT episode_index, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY abs(timestamp - 300000), frame_index) AS r FROM f) WHERE r = 1) c ON c.episode_index = f.episode_index AND f.frame_index >= c.frame_index")
def trim_from_seconds(spark, d):
    f = event_frames(spark, d)
    cut = f.groupBy("episode_index").agg(F.min_by("frame_index", F.struct(F.abs(F.col("timestamp") - 300000), "frame_index")).alias("cut"))
    return f.join(cut, "episode_index").filter(F.col("frame_index") >= F.col("cut")).select("episode_index", "frame_index", "value")


_ACT = "(event_id * 37) % 100"
_STUCK = f"""WITH {EVENT_FRAMES}, x AS (SELECT *, {_ACT} AS act, abs({_ACT} - lag({_ACT}) OVER w) AS dd FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index FROM x GROUP BY 1 HAVING avg((value > 50)::INT) >= 0.35 AND max(abs(act)) <= 98 AND coalesce(max(dd), 0) <= 97"""


@query(
    " UNION ".join(
        f"SELECT episode_index, {reason} AS reason FROM ({sql})"
        for reason, sql in (
            ("'early_gripper_transition'", ORACLES["early_transition"]), ("'early_gripper_transition'", ORACLES["early_transition"].replace("value > 50", f"{_ACT} > 50")), ("'stuck_closed_gripper_no_action'", _STUCK),
            ("'state_gripper_transition_without_action'", ORACLES["transition_without_action"]), ("'joint_zero_reset_spike'", ORACLES["zero_reset_spikes"]), ("type", ORACLES["missing_states"]), ("type", ORACLES["prompt_issues"]),
        )
    )
)
def quality_scan(spark, d):
    """Q01: all detectors together, each as in its own query."""
    f = event_frames(spark, d).withColumns({"act": (F.col("event_id") * 37) % 100, "state": F.when(F.col("value") > 150, F.col("task"))})
    runs = f.filter("value < 20").select("episode_index", F.col("frame_index").alias("first"), (F.col("event_id") % 6).alias("dim"))
    prompts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("episode_index")).agg(F.collect_set("text").alias("prompts"))
    return q.scan(f, "act", "value", 50, 86400, 3, 1, {"ratio": 0.35, "action_max": 98, "delta_max": 97}, runs, "state", prompts)
