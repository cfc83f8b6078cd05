"""Queries over datasets as wholes: validation, fields, flags, analysis, review, construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as j
from ..functions import text as x
from ..operators import analysis as an
from ..operators import fields as fl
from ..operators import flags as fg
from ..operators import review as rv
from ..operators import sampling as sm
from ..operators import stats as s
from ..operators import temporal as t
from ..operators import validate as va
from ..sources import catalogue as ct
from ..sources import dataset as ds
from ..sources.adapters import EVENT_FRAMES, ORDER_FRAMES, event_frames, order_frames, table
from ..streaming import ingest
from .registry import query
from .text_queries import PROMPT_CASES, cases, cases_sql, literal

# windows by seconds


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM f),
x AS (SELECT a.episode_index, a.frame_index, k.k, b.value, b.timestamp AS b_at, (a.frame_index + k.k < 0 OR a.frame_index + k.k >= a.n) AS pad FROM n a, (SELECT unnest([-3, -1, 0, 2]) AS k) k
  JOIN f b ON b.episode_index = a.episode_index AND b.frame_index = greatest(0, least(a.n - 1, a.frame_index + k.k)))
SELECT episode_index, frame_index, round(sum(value * (k + 4)), 4) AS mixed, round(sum(b_at * (k + 4)), 3) AS times, count_if(pad)::BIGINT AS pads FROM x GROUP BY ALL""")
def delta_seconds(spark, d):
    """Windows at -0.3, -0.1, 0 and 0.2 seconds of 10 frames a second, of values and of times."""
    out = t.delta_windows(event_frames(spark, d), {"value": [-0.3, -0.1, 0.0, 0.2]}, 10)
    out = t.query_timestamps(out, [-0.3, -0.1, 0.0, 0.2], 10)
    weights = F.array(*(F.lit(float(k + 4)) for k in (-3, -1, 0, 2)))
    mixed = lambda c: F.aggregate(F.zip_with(c, weights, lambda a, b: a * b), F.lit(0.0), lambda n, v: n + v)
    return out.select("episode_index", "frame_index", F.round(mixed("value_window"), 4).alias("mixed"), F.round(mixed("query_timestamps"), 3).alias("times"), F.size(F.filter("value_is_pad", lambda p: p)).cast("long").alias("pads"))


@query(f"""WITH {EVENT_FRAMES}, m AS (SELECT *, avg(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM f)
SELECT episode_index, round(sqrt(avg((y - value) * (y - value))), 6) AS rms, round(max(abs(y - value)), 6) AS max_change FROM m GROUP BY 1""")
def change_sizes(spark, d):
    """What a mean of neighbours changes."""
    w = t.over().rowsBetween(-1, 1)
    out = t.change_sizes(event_frames(spark, d).withColumn("y", F.avg("value").over(w)), "value", "y")
    return out.withColumns({c: F.round(c, 6) for c in ("rms", "max_change")})


# validation


@query(f"""WITH {ORDER_FRAMES} SELECT episode_index, frame_index, CASE WHEN frame_index % 3 = 1 THEN 'action: length 3 instead of 4' ELSE '' END || CASE WHEN frame_index % 5 = 2 THEN 'task: null' ELSE '' END AS problems
FROM o WHERE frame_index % 3 = 1 OR frame_index % 5 = 2""")
def frame_problems(spark, d):
    """F02."""
    f = order_frames(spark, d).withColumns({"action": F.when(F.col("frame_index") % 3 == 1, F.slice("action", 1, 3)).otherwise(F.col("action")), "task": F.when(F.col("frame_index") % 5 != 2, "t")})
    found = va.frame_problems(f, {"action": {"dtype": "float64", "shape": (4,)}})
    return found.select("episode_index", "frame_index", F.array_join(F.reverse(F.array_sort("problems")), "").alias("problems")).withColumn("problems", F.regexp_replace("problems", "^(task: null)(.+)$", "$2$1"))


@query(f"""WITH {EVENT_FRAMES}, k AS (SELECT * FROM f WHERE NOT (episode_index % 4 = 1 AND frame_index = 2)), e AS (SELECT count(DISTINCT episode_index) + 10 AS last FROM k),
g AS (SELECT episode_index, episode_index < 10 OR episode_index >= (SELECT last FROM e) AS a, episode_index % 4 = 1 AS b, episode_index % 6 = 0 AS c FROM (SELECT DISTINCT episode_index FROM k))
SELECT episode_index, concat_ws('; ', CASE WHEN a THEN 'episode_index does not follow' END, CASE WHEN b THEN 'frames do not count up from 0' END, CASE WHEN c THEN 'task missing' END) AS problems FROM g WHERE a OR b OR c""")
def episode_problems(spark, d):
    """every user has more than three events."""
    f = event_frames(spark, d).filter(~((F.col("episode_index") % 4 == 1) & (F.col("frame_index") == 2)))
    f = f.withColumn("task", F.when(~((F.col("episode_index") % 6 == 0) & (F.col("frame_index") == 0)), F.col("task")))
    return va.episode_problems(f, 10).select("episode_index", F.array_join("problems", "; ").alias("problems"))


# fields and statistics


@query(f"""WITH {ORDER_FRAMES}, m AS (SELECT *, max(abs(action[3] * 30)) OVER (PARTITION BY episode_index) AS g FROM o)
SELECT episode_index, frame_index, round(action[1], 6) AS a0, round(action[2], 6) AS a1, round(CASE WHEN g > 1.5 THEN action[3] * 30 / 100 ELSE action[3] * 30 END, 6) AS a2, 3 AS width, 1::BIGINT AS exist_label FROM m""")
def standardized(spark, d):
    """Vectors of four cut to three, the third as a gripper."""
    f = order_frames(spark, d).withColumns({"head_depth": F.lit(1), "action": F.transform("action", lambda v, i: F.when(i == 2, v * 30).otherwise(v))})
    out, features = fl.standardized(f, {"action": {"dtype": "float64", "shape": [4]}, "head_depth": {"dtype": "image", "shape": [1]}}, ["action"], gripper=2, width=3)
    assert "head_depth" not in features and features["action"]["shape"] == [3]
    return out.select("episode_index", "frame_index", *(F.round(F.col("action")[k], 6).alias(f"a{k}") for k in range(3)), F.size("action").alias("width"), "exist_label")


@query(f"""WITH {ORDER_FRAMES}, a AS (SELECT episode_index, (i - 1)::INTEGER AS dim, action[i] * 2 AS x FROM o, (SELECT unnest(range(1, 5)) AS i)), b AS (SELECT episode_index, 0 AS dim, action[1] AS x FROM o),
u AS (SELECT 'action' AS feature, * FROM a UNION ALL SELECT 'state', * FROM b)
SELECT episode_index, feature, dim, round(min(x), 5) AS min, round(max(x), 5) AS max, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, count(*) AS count FROM u GROUP BY 1, 2, 3""")
def changed_stats(spark, d):
    """Statistics of a changed feature anew, those of another as they were, through JSON text and back."""
    f = order_frames(spark, d)
    named = lambda name, rows: rows.select("episode_index", F.lit(name).alias("feature"), "dim", "min", "max", "mean", "std", "count")
    old = named("action", s.vector_stats(f, "action", 4, "episode_index")).unionByName(named("state", s.vector_stats(f.withColumn("state", F.slice("action", 1, 1)), "state", 1, "episode_index")))
    new = fl.changed_stats(old, f.withColumn("action", F.transform("action", lambda v: v * 2)), {"action": 4})
    back = fl.stats_from_json(fl.stats_to_json(new))
    return back.select("episode_index", "feature", "dim", *(F.round(c, 5).alias(c) for c in ("min", "max", "mean", "std")), "count")


@query(f"""WITH {EVENT_FRAMES} SELECT u.episode_index, count(f.episode_index) AS length FROM (SELECT unnest(range(0, 200)) AS episode_index) u LEFT JOIN f USING (episode_index) GROUP BY 1""")
def counted_lengths(spark, d):
    """U11."""
    episodes = spark.range(200).select(F.col("id").alias("episode_index"), F.lit(-1).alias("length"))
    return fl.counted_lengths(episodes, event_frames(spark, d)).select("episode_index", "length")


@query("SELECT o_orderkey AS \"key\", o_totalprice AS \"price/total\", o_orderstatus AS \"state/name\", o_orderpriority AS \"state/more/priority\" FROM orders")
def flattened(spark, d):
    """To nested fields and back."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price/total"), F.col("o_orderstatus").alias("state/name"), F.col("o_orderpriority").alias("state/more/priority"))
    return fl.flattened(fl.unflattened(o))


# flags


@query("SELECT e AS episode_index FROM (SELECT DISTINCT user_id AS e FROM events) WHERE (e % 2 = 0) <> (e % 3 = 0)")
def toggled_flags(spark, d):
    """H10."""
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_index"))
    return fg.toggled(e.filter("episode_index % 2 = 0"), e.filter("episode_index % 3 = 0"))


@query("""WITH e AS (SELECT DISTINCT user_id AS e FROM events)
SELECT e AS episode_index, 'task ' || e AS task, concat_ws(',', CASE WHEN e % 4 = 0 THEN 'auto:early' END, CASE WHEN e % 6 = 0 THEN 'manual:blurred' WHEN e % 10 = 0 THEN 'manual:old' END) AS reasons FROM e WHERE e % 2 = 0""")
def flagged_reasons(spark, d):
    """Sidecars with repeated reasons, one of them changed by hand."""
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_index")).distinct()
    auto = e.filter("episode_index % 4 = 0").withColumns({"type": F.lit("auto"), "reason": F.lit("early")})
    manual = fg.with_reason(e.filter("episode_index % 10 = 0").withColumns({"type": F.lit("manual"), "reason": F.lit("old")}), e.filter("episode_index % 6 = 0"), "blurred")
    flagged = fg.all_flags(fg.without([e.filter("episode_index % 2 = 0"), e.filter("episode_index % 3 = 0")], e.filter("episode_index % 2 = 1")))
    out = fg.flag_reasons(flagged, [auto, auto, manual], e.withColumn("task", F.concat(F.lit("task "), F.col("episode_index").cast("string"))))
    return out.select("episode_index", "task", F.array_join(F.transform("reasons", lambda r: F.concat(r["type"], F.lit(":"), r["reason"])), ",").alias("reasons"))


@query("""SELECT e AS episode_index, CASE WHEN e % 5 = 0 THEN 'second' WHEN e % 3 = 0 THEN 'first' ELSE 'old' END AS task, '' AS error FROM (SELECT DISTINCT user_id AS e FROM events WHERE user_id % 7 <> 0)
UNION ALL SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'second' ELSE 'first' END, 'unknown episode' FROM events WHERE user_id % 7 = 0 AND (user_id % 5 = 0 OR user_id % 3 = 0)""")
def assigned_prompts(spark, d):
    """H17."""
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_index")).distinct()
    pending = e.filter("episode_index % 3 = 0").withColumns({"task": F.lit("first"), "number": F.lit(1)}).unionByName(e.filter("episode_index % 5 = 0").withColumns({"task": F.lit("second"), "number": F.lit(2)}))
    done, failed = fg.assigned_prompts(e.filter("episode_index % 7 != 0").withColumn("task", F.lit("old")), pending)
    return done.select("episode_index", "task", F.lit("").alias("error")).unionByName(failed)


@query("SELECT r_name AS key, max(r_regionkey)::VARCHAR AS value FROM region GROUP BY 1 UNION ALL SELECT 'shared', max(r_regionkey)::VARCHAR FROM region UNION ALL SELECT 'merged_from', string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) FROM region")
def merged_sources(spark, d):
    """H09."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("source"), F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return fg.merged_sources(r.unionByName(r.withColumn("key", F.lit("shared"))))


@query("SELECT conv_id, string_agg(text, '|' ORDER BY first) AS texts FROM (SELECT conv_id, text, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def deduped_in_order(spark, d):
    """D11."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda y: y["text"])), "|").alias("texts"))


# analysis

#: The canonical sides of the prompts: canonical, canonical task, side, reference (by hand).
_CANONICAL = {
    0: (True, "Give the yellow duck to me", None, None), 3: (True, "Pick up the green dinosaur to the left of the brown dog", "left", "brown dog"),
    5: (False, "Pick up the brown dog to the left of the yellow duck", "left", "yellow duck"), 6: (True, "Pick up the orange lion on the right", "right", None),
    8: (True, "Pick up the yellow duck", None, None), 10: (True, "Place object", None, None), 11: (True, "Place object", None, None),
}
_EXPECTED = [(k, c[0], c[5], c[6], *_CANONICAL.get(k, (False, "unknown", None, None))) for k, c in enumerate(PROMPT_CASES)]
ANALYSIS = f"""WITH c(k, task, scene, named, canonical, canonical_task, side, reference) AS (VALUES {", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else literal(v) for v in r) + ")" for r in _EXPECTED)}),
e AS (SELECT p_partkey AS e, c.*, CASE WHEN scene = 'give' THEN 5 ELSE 4 END AS most FROM part JOIN c ON p_partkey % {len(_EXPECTED)} = k),
f AS (SELECT e.e, epoch_us(l_shipdate) / 86400e6 AS t, CASE WHEN l_linenumber = 1 THEN NULL ELSE round_even(l_discount * 10 * most, 0)::INT END AS stage, l_returnflag = 'A' AS tr, l_returnflag = 'N' AS fa FROM e JOIN lineitem ON l_partkey = e.e WHERE e.e % 3 <> 0),
g AS (SELECT e, count(*) AS frames, CASE WHEN count(*) > 1 THEN max(t) - min(t) ELSE 0 END AS duration, count_if(tr) AS yes, count_if(fa) AS no, count_if(NOT tr AND NOT fa) AS none, count(stage) AS staged FROM f GROUP BY 1),
r AS (SELECT e.*, g.frames, g.duration, g.yes, g.no, g.none, g.staged, CASE WHEN named IN ('yellow duck', 'brown dog', 'orange lion', 'green dinosaur') OR g.frames IS NULL THEN named ELSE 'yellow duck' END AS target FROM e LEFT JOIN g USING (e)),
b(low, name) AS (VALUES (0, '0-5s'), (5, '5-10s'), (10, '10-15s'), (15, '15-20s'), (20, '20-30s'), (30, '30-45s'), (45, '45-60s'), (60, '60s+')),
st AS (SELECT r.e, r.scene, r.target, f.stage, count(*) AS n, any_value(r.duration / r.frames) AS each FROM r JOIN f USING (e) WHERE stage IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT 'scene' AS distribution, scene AS key, count(*)::DOUBLE AS count, (SELECT count(*) FROM r)::DOUBLE AS whole FROM r GROUP BY 2
UNION ALL SELECT 'target', target, count(*), (SELECT count(*) FROM r) FROM r GROUP BY 2
UNION ALL SELECT 'canonical_task', canonical_task, count(*), (SELECT count(*) FROM r) FROM r GROUP BY 2
UNION ALL SELECT 'task_type', scene, count(*), (SELECT count(*) FROM r) FROM r GROUP BY 2
UNION ALL SELECT 'side', side, count(*), sum(count(*)) OVER () FROM r WHERE side IS NOT NULL GROUP BY 2
UNION ALL SELECT 'reference', reference, count(*), sum(count(*)) OVER () FROM r WHERE reference IS NOT NULL GROUP BY 2
UNION ALL SELECT 'review_reason', reason, count(*), sum(count(*)) OVER () FROM (SELECT unnest(list_filter([CASE WHEN NOT canonical THEN 'non_canonical_task_text' END, CASE WHEN scene = 'unknown' THEN 'unknown_scene' END, CASE WHEN target = 'unknown' THEN 'unknown_object' END,
  CASE WHEN frames IS NULL THEN 'missing_csv' END, CASE WHEN staged = 0 THEN 'missing_stage' END], lambda y: y IS NOT NULL)) AS reason FROM r) GROUP BY 2
UNION ALL SELECT 'duration', b.name, count(x.e), (SELECT count(*) FROM g) FROM b LEFT JOIN (SELECT e, (SELECT max(low) FROM b WHERE low <= duration) AS low FROM g) x USING (low) GROUP BY 2
UNION ALL SELECT 'stage', stage::VARCHAR, sum(n), (SELECT sum(frames) FROM g) FROM st GROUP BY 2
UNION ALL SELECT 'stage_seconds', stage::VARCHAR, sum(n * each), (SELECT sum(duration) FROM g) FROM st GROUP BY 2
UNION ALL SELECT 'stage_by_scene', scene || '/' || stage, sum(n), sum(sum(n)) OVER (PARTITION BY scene) FROM st GROUP BY scene, stage
UNION ALL SELECT 'stage_by_target', target || '/' || stage, sum(n), sum(sum(n)) OVER (PARTITION BY target) FROM st GROUP BY target, stage
UNION ALL SELECT 'exist', 'yellow_duck_exist', sum(yes), sum(yes + no + none) FROM g)
"""


def _described(spark, d):
    part = cases(spark, d, [(c[0],) for c in PROMPT_CASES]).select(F.col("id").alias("episode_index"), F.col("c0").alias("task"))
    line = table(spark, d, "lineitem").filter("l_partkey % 3 != 0")
    flag = F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "N", "no")
    f = line.select(F.col("l_partkey").alias("episode_index"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400e6).alias("timestamp"), F.when(F.col("l_linenumber") != 1, F.col("l_discount") * 10).alias("stage"), flag.alias("yellow_duck_exist"))
    return an.described(part, f, ["yellow_duck_exist"])


@query(f"{ANALYSIS} SELECT distribution, key, round(count, 4) AS count, round(CASE WHEN whole > 0 THEN 100 * count / whole ELSE 0 END, 4) AS percent FROM d")
def analysis_distributions(spark, d):
    """All 13 distributions, with stages and existence labels."""
    out = an.distributions(_described(spark, d), ["yellow_duck_exist"])
    return out.withColumns({c: F.round(c, 4) for c in ("count", "percent")})


@query(f"{ANALYSIS} SELECT (SELECT count(*) FROM r) AS episodes, (SELECT count(*) FROM g) AS with_frames, (SELECT sum(frames)::BIGINT FROM g) AS frames, round((SELECT sum(duration) FROM g), 3) AS seconds")
def analysis_totals(spark, d):
    """L11."""
    return an.totals(_described(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("""WITH x AS (SELECT lang AS key, count(*)::DOUBLE AS n, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), y AS (SELECT lang AS key, count(*)::DOUBLE AS n, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 5 = 0 GROUP BY 1)
SELECT 'lang' AS distribution, coalesce(x.key, y.key) AS key, coalesce(x.n, 0) AS count_a, round(coalesce(x.p, 0), 6) AS percent_a, coalesce(y.n, 0) AS count_b, round(coalesce(y.p, 0), 6) AS percent_b FROM x FULL JOIN y ON x.key = y.key""")
def compared_distributions(spark, d):
    """L10."""
    doc = table(spark, d, "documents")
    side = lambda k: s.distribution(doc.filter(f"doc_id % {k} = 0"), "lang").select(F.lit("lang").alias("distribution"), F.col("lang").alias("key"), F.col("count").cast("double").alias("count"), "percent")
    return an.compared(side(2), side(5)).withColumns({c: F.round(c, 6) for c in ("percent_a", "percent_b")})


# review

_BOX = "struct<box:struct<left:double,top:double,right:double,bottom:double>,confidence:double>"
#: targets, refs, last as JSON ([left, top, right, bottom, confidence]), direction, arm; then place and method, by hand.
BOX_CASES = [
    ("[]", None, "[]", None, None, None, "no_target_detections"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[]", None, None, 0, "top_confidence"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[]", None, "right", 1, "right_hand_nearest"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[]", None, "left", 0, "left_hand_nearest"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[[0,0,10,10,0.9],[50,40,60,50,0.8]]", None, "left", 1, "last_frame_motion_then_left_hand_nearest"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[[3,0,13,10,0.9],[50,4,60,14,0.8]]", None, "right", 1, "right_hand_nearest"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[]", "right", None, 1, "absolute_right"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8]]", None, "[]", "left", "right", 0, "absolute_left"),
    ("[[0,0,10,10,0.9],[50,0,60,10,0.8],[70,0,80,10,0.7]]", "[[30,0,40,10,0.9]]", "[]", "right", None, 1, "relative_right_of_reference"),
    ("[[0,0,10,10,0.9],[20,0,30,10,0.8],[70,0,80,10,0.7]]", "[[60,0,65,10,0.9]]", "[]", "left", None, 1, "relative_left_of_reference"),
    ("[[0,0,10,10,0.9]]", "[[30,0,40,10,0.9]]", "[]", "right", None, None, "no_candidate_on_correct_side"),
    ("[[0,0,10,10,0.9]]", "[]", "[]", "left", None, None, "no_candidate_on_correct_side"),
]


@query(cases_sql(BOX_CASES, "c5::INTEGER AS place, c5 IS NOT NULL AS satisfied, c6 AS method"))
def selected_boxes(spark, d):
    """J10."""
    box = lambda v: F.struct(F.struct(*(v[k].alias(n) for k, n in enumerate(("left", "top", "right", "bottom")))).alias("box"), v[4].alias("confidence"))
    boxes = lambda c: F.transform(F.from_json(c, "array<array<double>>"), box).cast(f"array<{_BOX}>")
    rows = cases(spark, d, [c[:5] for c in BOX_CASES]).select("id", boxes("c0").alias("targets"), boxes("c1").alias("refs"), boxes("c2").alias("last"), F.col("c3").alias("direction"), F.col("c4").alias("arm"))
    return rv.selected_box(rows).select("id", "place", "satisfied", "method")


#: skip, direction, reference (parsed unless direction is '-'), selected, satisfied, detections (confidence, x), source; then uncertainty and reason, by hand.
REVIEW_CASES = [
    ("exist_label_zero", None, None, 1, None, "[]", None, -1, "exist_label=0"), (None, "-", None, 1, None, "[]", None, -1, "not Pick-up"), (None, None, None, 0, None, "[]", None, 100, "no detection"),
    (None, "left", None, 0, 0, "[]", None, 100, "no candidate on correct side"), (None, "left", "x", 1, 0, "[[0.9,1]]", None, 90, "relation unsatisfied (fallback)"), (None, None, None, 1, 1, "[]", None, 95, "no target candidates"),
    (None, None, None, 1, None, "[[0.1,1]]", "vlm_implicit", 30, "vlm implicit conf"), (None, None, None, 1, None, "[[0.4,1]]", "vlm_self_reported", 85, "low vlm self-conf 0.40"), (None, None, None, 1, None, "[[0.6,1]]", "vlm_self_reported", 70, "low vlm self-conf 0.60"),
    (None, None, None, 1, None, "[[0.75,1],[0.6875,2]]", "vlm_self_reported", 60, "close vlm self-conf (d=0.06)"), (None, None, None, 1, None, "[[0.75,1],[0.5,2]]", "vlm_self_reported", 30, "vlm self-conf 0.75"),
    (None, None, None, 1, None, "[[0.2,1]]", None, 80, "low conf 0.20"), (None, None, None, 1, None, "[[0.28,1]]", None, 70, "low conf 0.28"), (None, None, None, 1, None, "[[0.5,1],[0.484375,9]]", None, 65, "close top-2 (d=0.02)"),
    (None, None, None, 1, None, "[[0.5,1],[0.4609375,9]]", None, 55, "close top-2 (d=0.04)"), (None, "left", None, 1, None, "[[0.5,10],[0.25,35]]", None, 50, "absolute: x_centers close"), (None, "left", None, 1, None, "[[0.5,10],[0.25,60]]", None, 10, "ok"),
    (None, "left", "x", 1, 1, "[[0.5,10],[0.25,35]]", None, 10, "ok"), (None, None, None, 1, None, "[[0.5,10],[0.25,35]]", None, 10, "ok"),
]


@query(cases_sql(REVIEW_CASES, "c7::INTEGER AS uncertainty, c8 AS why"))
def review_reasons_told(spark, d):
    """Q13: every rung and its reason."""
    rows = cases(spark, d, [c[:7] for c in REVIEW_CASES])
    parsed = F.when(~F.col("c1").eqNullSafe(F.lit("-")), F.struct(F.col("c1").alias("direction"), F.col("c2").alias("reference")))
    seen = F.transform(F.from_json("c5", "array<array<double>>"), lambda v: F.struct(v[0].alias("confidence"), F.col("c6").alias("source"), v[1].alias("x")))
    out = rv.uncertain(rows.select("id", F.col("c0").alias("skip"), parsed.alias("parsed"), (F.col("c3") == 1).alias("selected"), (F.col("c4") == 1).alias("satisfied"), seen.alias("detections")))
    return out.select("id", "uncertainty", "why")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'prompt_action_mismatch' ELSE '' END AS warnings FROM documents")
def tag_warnings(spark, d):
    """Q14."""
    doc = table(spark, d, "documents")
    tags = F.create_map(F.lit("prompt_action_match"), F.when(F.col("lang") == "en", "mismatch").otherwise(""), F.lit("arm"), F.lit("left"))
    return doc.select("doc_id", F.array_join(rv.context_warnings(tags), ",").alias("warnings"))


@query("SELECT doc_id AS episode_index, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS record FROM documents WHERE (doc_id % 2 = 0 AND doc_id % 5 <> 0) OR doc_id % 3 = 0")
def reviewed_records(spark, d):
    """Saved and removed records."""
    e = table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"))
    changes = e.filter("episode_index % 3 = 0 or episode_index % 5 = 0").withColumns({"record": F.lit("new"), "keep": F.col("episode_index") % 3 == 0})
    return rv.reviewed(e.filter("episode_index % 2 = 0").withColumn("record", F.lit("old")), changes)


def _labels(spark, d):
    """Labels on parts: prompts in turn, uncertainty, detections and tags by the part's numbers."""
    part = table(spark, d, "part")
    rows = cases(spark, d, [(c[0],) for c in PROMPT_CASES]).join(part.select(F.col("p_partkey").alias("id"), "p_size"), "id")
    tags = F.create_map(F.lit("background"), F.when(F.col("id") % 4 == 0, " Sofa ").when(F.col("id") % 4 == 1, "table"), F.lit("object_count"), (F.col("p_size") % 6).cast("string"))
    return rows.select(F.col("id").alias("episode_index"), F.col("c0").alias("task"), (F.col("p_size") * 2 - 1).alias("uncertainty"), (F.col("id") % 7 != 0).alias("has_target"), (F.col("id") % 5 != 0).alias("has_ref"), tags.alias("tags"))


LABELS = f"""WITH c(k, kind, target, direction, reference) AS (VALUES {", ".join("(" + ", ".join(literal(v) for v in (k, c[1], c[2] and c[2].lower(), c[3], c[4])) + ")" for k, c in enumerate(PROMPT_CASES))}),
l AS (SELECT p_partkey AS e, c.*, p_partkey % 5 <> 0 AS has_ref, CASE p_partkey % 4 WHEN 0 THEN 'sofa' WHEN 1 THEN 'table' ELSE 'unknown' END AS background, CASE WHEN p_size % 6 >= 4 THEN '4_plus' ELSE (p_size % 6)::VARCHAR END AS bucket
  FROM part JOIN c ON p_partkey % {len(PROMPT_CASES)} = k WHERE p_size * 2 - 1 BETWEEN 0 AND 60 AND kind IS NOT NULL AND p_partkey % 7 <> 0),
v(o) AS (VALUES ('yellow duck'), ('brown dog'), ('orange lion')),
q AS (SELECT *, CASE kind WHEN 'give' THEN 'give' WHEN 'single' THEN 'single_pick' WHEN 'absolute' THEN 'directional_pick' ELSE 'relative_pick' END AS scenario FROM l WHERE kind <> 'relative' OR has_ref),
u AS (SELECT *, scenario AS source FROM q UNION ALL SELECT * REPLACE ('give' AS scenario), 'single_pick' FROM q WHERE scenario = 'single_pick')"""


@query(f"""{LABELS} SELECT scenario, 'candidates' AS distribution, 'all' AS key, count(*) AS count FROM u GROUP BY 1
UNION ALL SELECT scenario, 'missing', o, count(*) FROM u JOIN v ON o <> target AND (reference IS NULL OR NOT has_ref OR o <> reference) GROUP BY 1, 3
UNION ALL SELECT scenario, 'source_visual', target, count(*) FROM u GROUP BY 1, 3 UNION ALL SELECT scenario, 'source_scenario', source, count(*) FROM u GROUP BY 1, 3
UNION ALL SELECT scenario, 'reference', reference, count(*) FROM u WHERE has_ref AND reference IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT scenario, 'direction', direction, count(*) FROM u WHERE direction IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT scenario, 'background', background, count(*) FROM u GROUP BY 1, 3 UNION ALL SELECT scenario, 'object_count', bucket, count(*) FROM u GROUP BY 1, 3""")
def candidate_distributions(spark, d):
    """A22, L05, L08."""
    return rv.candidate_distributions(rv.candidates(_labels(spark, d), ["yellow duck", "brown dog", "orange lion"], 60), True)


@query()
def balanced_sources(spark, d):
    """O08; a test holds it against the choice written out."""
    found = rv.candidates(_labels(spark, d), ["yellow duck", "brown dog", "orange lion"], 60)
    return rv.balanced_sources(found, {"give": 6, "single_pick": 4, "directional_pick": 5, "relative_pick": 3}, 1.5, True)


# JSON, samples, catalogue

TYPED_CASES = [
    ('{"a": 1, "b": [1.5, 2]}', "1", None), ('{"a": 1}', None, "keys a instead of a,b"), ('{"a": 1, "b": [1], "c": 2}', None, "keys a,b,c instead of a,b"), ('{"a": "x", "b": [1, 2]}', None, "a is no bigint"),
    ('{"a": 2, "b": [1, 2, 3]}', None, "b has 3 items instead of 2"), ("[1]", None, "no JSON object"), ('{"b": [0, 1], "a": 7}', "7", None),
]


@query(cases_sql(TYPED_CASES, "c1::BIGINT AS a, c2 AS error"))
def typed_json(spark, d):
    """N06."""
    v = j.typed(F.col("c0"), "a long, b array<double>", {"b": 2})
    return cases(spark, d, [c[:1] for c in TYPED_CASES]).withColumn("v", v).select("id", F.col("v.value.a").alias("a"), F.col("v.error").alias("error"))


@query("""SELECT event_id, '{"x":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE (event_id % 7) || '.5' END || ',"name":"' || CASE WHEN event_id % 2 = 0 THEN 'NaN' ELSE event_type END || '","all":[' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '1.0' END || ',2.0],"n":' || event_id || '}' AS json FROM events""")
def safe_json(spark, d):
    """Numbers that are not finite are null, texts that say so are kept."""
    e = table(spark, d, "events")
    no = lambda k, x, y: F.when(F.col("event_id") % k == 0, F.lit(float(x))).otherwise(y)
    x, name = no(3, "nan", F.col("event_id") % 7 + 0.5), F.when(F.col("event_id") % 2 == 0, "NaN").otherwise(F.col("event_type"))
    value = F.struct(x.alias("x"), name.alias("name"), F.array(no(5, "-inf", F.lit(1.0)), F.lit(2.0)).alias("all"), F.col("event_id").alias("n"))
    return e.select("event_id", j.safe(value, "struct<x:double,name:string,all:array<double>,n:bigint>").alias("json"))


@query(f"WITH {ORDER_FRAMES} SELECT episode_index FROM o WHERE frame_index = 0 AND floor(action[3] * 100) % 2 = 0")
def exist_label_zero(spark, d):
    """Lists of labels."""
    f = order_frames(spark, d)
    label = F.floor(F.col("action")[2] * 100) % 2
    return ct.exists_not(f.withColumn("exist_label", F.array(label, F.lit(0))), "exist_label")


@query(f"""WITH {EVENT_FRAMES}, n AS (SELECT *, ceil(count(*) OVER (PARTITION BY episode_index) / 20)::BIGINT AS k FROM f) SELECT episode_index, frame_index, value AS x, timestamp AS y FROM n WHERE frame_index % k = 0""")
def trajectory_points(spark, d):
    """M13, X19."""
    f = event_frames(spark, d).withColumn("pose", F.array(F.lit(0.0), "value", F.col("timestamp").cast("double")))
    return ct.trajectory(f, "pose", ["arm_yaw", "tip.x", "tip.y"], 20)


@query(f"""WITH {ORDER_FRAMES}, q AS (SELECT episode_index, coalesce(stddev_pop(action[1]), 0) AS l, coalesce(stddev_pop(action[3]), 0) + coalesce(stddev_pop(action[2] / 1000), 0) AS r FROM o GROUP BY 1)
SELECT episode_index, CASE WHEN r > l THEN 'right' ELSE 'left' END AS arm FROM q WHERE abs(r - l) > 1e-6 OR (l = 0 AND r = 0)""")
def busier_arm(spark, d):
    """M11; sums that agree but for rounding are left out."""
    a = F.col("action")
    out = ct.busier_arm(order_frames(spark, d), [a[0]], [a[2], a[1] / 1000])
    gap = F.abs(F.col("right_score") - F.col("left_score"))
    return out.filter((gap > 1e-6) | ((F.col("left_score") == 0) & (F.col("right_score") == 0))).select("episode_index", "arm")


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, max(value) AS score, row_number() OVER (ORDER BY max(value) DESC, episode_index)::INTEGER AS place FROM f GROUP BY 1 QUALIFY place <= 20")
def review_queue(spark, d):
    """The first 20 of the queue."""
    out = sm.review_queue(event_frames(spark, d).groupBy("episode_index").agg(F.max("value").alias("score")), "score").limit(20)
    return out.withColumn("place", F.row_number().over(t.Window.orderBy(F.desc("score"), "episode_index")))


@query("""SELECT p_partkey AS id FROM part WHERE p_size > 0 ORDER BY ln((('0x' || left(md5(p_partkey::VARCHAR || ':5'), 8))::BIGINT + 1) / (2.0 ** 32 + 1)) / p_size DESC, p_partkey LIMIT 15""")
def weighted_subset(spark, d):
    """O11."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"))
    return sm.weighted_subset(p, "w", 15, 5, "id").select("id")


@query("SELECT label, v AS value, count(vec_id) AS n FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(0, 12)) AS v) LEFT JOIN (SELECT vec_id, label AS l, vec_id % 10 AS w FROM embeddings) ON l = label AND w = v GROUP BY 1, 2")
def batched_bincount(spark, d):
    """Counts of 0 to 11 in each group, 0 where there are none."""
    return s.bincount(table(spark, d, "embeddings").withColumn("value", F.col("vec_id") % 10), "label", "value", 12)


@query()
def kmeans_clusters(spark, d):
    """M17; a test holds the centres against the means of their members."""
    from ..functions.vector import kmeans

    return kmeans(table(spark, d, "embeddings"), "embedding", 8, 5).select("vec_id", "cluster")


@query("SELECT p_partkey AS id, p_size / 100.0 AS gripper, CASE WHEN p_size / 50.0 BETWEEN 0 AND 1 THEN round_even(p_size / 50.0 * 4, 0)::INTEGER END AS stage FROM part")
def unit_conversions(spark, d):
    """M20, G06."""
    from ..functions.vector import percent_gripper
    from ..operators.segment import decode_stage

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), percent_gripper(F.col("p_size").cast("double")).alias("gripper"), decode_stage(F.col("p_size") / 50, 4).alias("stage"))


# datasets written and read

def _dataset(spark, d):
    f = event_frames(spark, d).select("episode_index", "frame_index", "timestamp", "value", F.expr("CASE task WHEN 'view' THEN 0L WHEN 'click' THEN 1L ELSE 2L END").alias("task_index"))
    tasks = spark.createDataFrame([(0, "view"), (1, "click"), (2, "other")], "task_index long, task string")
    named = f.join(tasks, "task_index").groupBy("episode_index").agg(F.sort_array(F.collect_set("task")).alias("tasks"), F.count("*").alias("length"))
    return ds.EpisodicDataset(f, named, tasks, {"fps": 10})


TASK_OF = "CASE task WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' ELSE 'other' END"


@query(f"WITH {EVENT_FRAMES} SELECT episode_index, frame_index, value, {TASK_OF} AS task FROM f WHERE episode_index IN (3, 5, 8)")
def dataset_versions(spark, d):
    """Two versions written, some episodes of the second read, with their tasks."""
    path, data = ds.scratch(spark, "dataset"), _dataset(spark, d)
    ds.write(ds.EpisodicDataset(data.frames.limit(0), data.episodes.limit(0), data.tasks, data.info), path, "v1")
    ds.write(data, path, "v2")
    return ds.read(spark, path, [3, 5, 8]).with_task().select("episode_index", "frame_index", "value", "task")


@query(f"WITH {EVENT_FRAMES} SELECT count(DISTINCT episode_index) AS total_episodes, count(*)::BIGINT AS total_frames, 3::BIGINT AS total_tasks, 1::BIGINT AS total_chunks FROM f")
def dataset_totals(spark, d):
    """A23 of a dataset that was written and read, from its tables of JSON lines."""
    path = ds.scratch(spark, "dataset")
    ds.write(_dataset(spark, d), path, "v1")
    return ds.read(spark, path).totals()


def _urgent(spark, d):
    """Orders as a dataset, and those of the highest priority as the episodes that were scanned."""
    frames = order_frames(spark, d).select("episode_index", "frame_index", F.col("action")[0].alias("value"))
    lengths = frames.groupBy("episode_index").agg(F.array(F.lit("t")).alias("tasks"), F.count("*").alias("length"))
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("episode_index"))
    return ds.EpisodicDataset(frames, lengths, spark.createDataFrame([(0, "t")], "task_index long, task string"), {"fps": 10}), urgent


def _written_back(spark, d) -> str:
    """A dataset whose urgent episodes got stages, then some of them other ones."""
    path = ds.scratch(spark, "dataset")
    data, urgent = _urgent(spark, d)
    ds.write(data, path, "v1")
    stage = lambda rows, n: rows.select("episode_index", "frame_index", (F.col("frame_index") % n).cast("int").alias("subtask_state"))
    ds.write_back(spark, path, "v2", stage(data.frames.join(urgent, "episode_index", "left_semi"), 3), urgent, {"subtask_state": {"dtype": "int32", "shape": [1], "names": None}})
    again = urgent.filter("episode_index % 7 = 0")
    ds.write_back(spark, path, "v3", stage(ds.read(spark, path).frames.join(again, "episode_index", "left_semi"), 2), again)
    return path


_URGENT = f"""{ORDER_FRAMES}, s AS (SELECT episode_index, frame_index, CASE WHEN o_orderkey IS NOT NULL THEN frame_index % CASE WHEN episode_index % 7 = 0 THEN 2 ELSE 3 END END AS stage FROM o LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_orderkey = episode_index)"""


@query(f"WITH {_URGENT} SELECT episode_index, frame_index, stage::INTEGER AS subtask_state FROM s")
def written_back_stages(spark, d):
    """Stages of scanned episodes written into their chunks, twice, and read again with all others."""
    return ds.read(spark, _written_back(spark, d)).frames.select("episode_index", "frame_index", "subtask_state")


@query(f"WITH {_URGENT} SELECT episode_index, 'subtask_state' AS feature, min(stage)::DOUBLE AS min, max(stage)::DOUBLE AS max, round(avg(stage), 6) AS mean, round(stddev_pop(stage), 6) AS std, count(*) AS count FROM s WHERE stage IS NOT NULL GROUP BY 1")
def written_back_stats(spark, d):
    """The statistics that went along."""
    st = ds.read_stats(spark, _written_back(spark, d))
    return st.select("episode_index", "feature", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


@query("""WITH x AS (SELECT o_orderkey AS e, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT e AS episode_index, 'error' AS type, 'old ' || p AS reason FROM x WHERE s <> 'F' UNION ALL SELECT e, 'quality_flag', 'kept' FROM x WHERE s = 'F' AND e % 3 = 0 UNION ALL SELECT e, 'error', 'new' FROM x WHERE s = 'F' AND e % 2 = 0""")
def scanned_issues(spark, d):
    """Issues of finished orders are scanned anew; their quality flags and the issues of others stay."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    issue = lambda rows, kind, reason: rows.select("episode_index", F.lit(kind).alias("type"), reason.alias("reason"))
    done = o.filter("s = 'F'")
    issues = ds.SidecarTable(spark, ds.scratch(spark, "issues"), "episode_index long, type string, reason string", ["episode_index", "type", "reason"])
    issues.write(issue(o, "error", F.concat(F.lit("old "), F.col("p"))).unionByName(issue(done.filter("episode_index % 3 = 0"), "quality_flag", F.lit("kept"))), "v1")
    issues.replace_scanned(issue(done.filter("episode_index % 2 = 0"), "error", F.lit("new")), done, "v2", F.col("type").isin("error", "multi_gripper"))
    return issues.read()


@query("""WITH x AS (SELECT o_orderkey AS e, o_orderstatus AS s FROM orders) SELECT e AS episode_index, 0.5::DOUBLE AS time, 1 AS state FROM x WHERE s = 'F' UNION ALL SELECT e, 0.7, 2 FROM x WHERE s <> 'F' AND e % 2 = 0""")
def added_annotations(spark, d):
    """Annotations come only for episodes that have none."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderstatus").alias("s"))
    row = lambda rows, t, n: rows.select("episode_index", F.lit(t).alias("time"), F.lit(n).alias("state"))
    notes = ds.SidecarTable(spark, ds.scratch(spark, "annotations"), "episode_index long, time double, state int", ["episode_index", "time"])
    notes.write(row(o.filter("s = 'F'"), 0.5, 1), "v1")
    notes.add_missing(row(o.filter("episode_index % 2 = 0"), 0.7, 2), "v2")
    return notes.read()


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, CASE WHEN event_id % 5 = 0 THEN -1 ELSE (frame_index % 4)::INTEGER END AS subtask_state,
CASE WHEN event_id % 5 = 0 THEN 'lemon not found' ELSE ['prepare to grasp lemon', 'reach for lemon', 'grasp lemon', 'lift lemon'][frame_index % 4 + 1] END AS subtask FROM f""")
def written_texts(spark, d):
    """U02."""
    from ..operators.segment import stage_texts

    f = event_frames(spark, d).withColumns({"subtask_state": F.col("frame_index") % 4, "exist": (F.col("event_id") % 5 != 0).cast("int")})
    episodes = f.select("episode_index").distinct().withColumn("tasks", F.array(F.lit("Pick up the lemon")))
    return stage_texts(f, episodes, exist="exist")


@query("SELECT user_id AS episode_index, 'v' || (max(event_id) FILTER (event_id % 5 <> 0)) AS task FROM events GROUP BY 1")
def tolerant_lines(spark, d):
    """Lines of which every fifth is broken; the last good one of each episode counts."""
    e = table(spark, d, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")  # files in the order of their names
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"episode_index": '), F.col("user_id").cast("string"), F.lit(', "task": '))).otherwise(F.to_json(F.struct(F.col("user_id").alias("episode_index"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("task"))))
    path = ds.scratch(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    return ds.read_jsonl(spark, path, "episode_index long, task string", "episode_index")


@query(f"WITH {EVENT_FRAMES}, x AS (SELECT *, max(event_id % 6) OVER (PARTITION BY episode_index) AS top FROM f) SELECT episode_index, count(*) AS rows, round(sum(value), 4) AS first, sum(frame_index % 7)::DOUBLE AS last, round(sum((event_id % 6) / top), 4) AS stage FROM x WHERE frame_index % 2 = 0 GROUP BY 1")
def exported_csv(spark, d):
    """Every second frame of all episodes as CSV with the stage from 0 to 1, read again."""
    from ..operators.select import stage_shares

    path = ds.scratch(spark, "csv")
    f = stage_shares(event_frames(spark, d).withColumn("stage", F.col("event_id") % 6)).withColumn("action", F.array("value", F.col("frame_index") % 7))
    ds.export_csv(f, {"action": 2}, path, 2, ["stage"])
    back = spark.read.schema("timestamp double, action_0 double, action_1 double, stage double, episode_index long").csv(path, header=True)
    each = back.groupBy("episode_index")
    return each.agg(F.count("*").alias("rows"), F.round(F.sum("action_0"), 4).alias("first"), F.sum("action_1").alias("last"), F.round(F.sum("stage"), 4).alias("stage"))


@query(f"WITH {EVENT_FRAMES}, e AS (SELECT episode_index, count(*) AS n FROM f GROUP BY 1) SELECT episode_index // 1000 AS chunk, count(*) AS episodes, sum(n)::BIGINT AS frames FROM e GROUP BY 1")
def manifests(spark, d):
    """Read back from their JSON."""
    m = ds.manifest(_dataset(spark, d).episodes)
    rows = F.from_json("manifest", "array<struct<episode_index:long,length:long,tasks:array<string>>>")
    return m.select("chunk", F.explode(rows).alias("e")).groupBy("chunk").agg(F.count("*").alias("episodes"), F.sum("e.length").alias("frames"))


@query(f"WITH {EVENT_FRAMES} SELECT 0 AS dataset_index, count(*) AS n, round(sum(value), 3) AS total FROM f UNION ALL SELECT 1, count(*), round(sum(value), 3) FROM f WHERE episode_index % 2 = 0")
def several_datasets(spark, d):
    """S10."""
    f = event_frames(spark, d)
    both = ds.concatenated([f.select("episode_index", "frame_index", "value"), f.filter("episode_index % 2 = 0").drop("us")])
    return both.groupBy("dataset_index").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {EVENT_FRAMES} SELECT episode_index, frame_index, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS a, coalesce(lag(value) OVER w, first_value(value) OVER w) AS b, value AS c FROM f WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""")
def observation_queue(spark, d):
    """W03."""
    out = ingest.last_observations(event_frames(spark, d), "value", 3)
    return out.select("episode_index", "frame_index", *(F.col("value_queue")[k].alias(n) for k, n in enumerate("abc")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS task, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_metrics(spark, d):
    """The table replayed as a stream, in windows of a day."""
    path = ds.scratch(spark, "replay")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("task"), "value").repartition(3).write.parquet(f"{path}/in")
    stream = ingest.metrics(ingest.replay(spark, f"{path}/in", "ts timestamp, task string, value double"), "ts", "1 day", "4000 days")
    return ingest.last_result(stream, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "task", "n", F.round("total", 4).alias("total"))


@query(f"WITH {EVENT_FRAMES}, o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM f) SELECT i AS index, value, i % 100 AS slot FROM o WHERE i >= n - 100")
def fifo_buffer(spark, d):
    """Three batches through a buffer of 100 frames."""
    e = event_frames(spark, d).select("episode_index", "frame_index", "value", "event_id")
    n = e.count()
    buffer = ingest.FifoBuffer(spark, ds.scratch(spark, "fifo"), 100)
    numbered = t.running(e, "event_id", {"_at": None})
    for k in range(3):
        buffer.add(numbered.filter((F.col("_at") >= n * k // 3) & (F.col("_at") < n * (k + 1) // 3)).drop("_at"), k, ["event_id"])
    assert buffer.counts().first().frames == min(100, n)
    return buffer.read().select("index", "value", "slot")


@query(f"""WITH {EVENT_FRAMES}, g AS (SELECT *, event_id % 2 AS g FROM f), h AS (SELECT *, value > 50 AS high, lag(value > 50) OVER w AS before, first_value(value) OVER w AS v0, max(frame_index) OVER (PARTITION BY episode_index, g) AS last FROM g WINDOW w AS (PARTITION BY episode_index, g ORDER BY frame_index)),
c AS (SELECT episode_index, g, min(frame_index) AS at, any_value(v0) AS v0, any_value(last) AS last FROM h WHERE before <> high GROUP BY 1, 2)
SELECT c.episode_index, count(*) FILTER (c.v0 > 50 AND h.value <= 50) AS initial_opens FROM c LEFT JOIN h ON h.episode_index = c.episode_index AND h.g = c.g AND h.frame_index = least(c.at + 2, c.last) GROUP BY 1""")
def initial_opens(spark, d):
    """Two grippers, the state two frames behind the action."""
    from ..operators.segment import initial_opens as opens

    f = event_frames(spark, d).withColumn("gripper", F.col("event_id") % 2)
    w = t.Window.partitionBy("episode_index", "gripper").orderBy("frame_index")
    high = F.col("value") > 50
    changes = f.withColumn("_b", F.lag(high).over(w)).filter(F.col("_b") != high).select("episode_index", "gripper", F.col("frame_index").alias("action_frame"), (F.col("frame_index") + 2).alias("state_frame"))
    return opens(f, changes, 50)


@query(f"""WITH {ORDER_FRAMES}, x AS (SELECT episode_index, (i - 1)::INTEGER AS dim, action[i] AS x FROM o, (SELECT unnest(range(1, 5)) AS i)), s AS (SELECT episode_index, dim, min(x) AS min, avg(x) AS mean FROM x GROUP BY 1, 2)
SELECT episode_index, dim, 'mean' AS name, round(mean, 5) AS value, round(mean + CASE WHEN episode_index % 9 = 0 THEN 0.5 ELSE 1e-6 END, 5) AS reference FROM s WHERE episode_index % 9 = 0 AND 0.5 > 6e-5 + 5e-6 * abs(mean + 0.5)""")
def stats_beyond_tolerance(spark, d):
    """U12."""
    st = s.vector_stats(order_frames(spark, d), "action", 4, "episode_index")
    other = st.withColumn("mean", F.col("mean") + F.when(F.col("episode_index") % 9 == 0, 0.5).otherwise(1e-6))
    return fl.beyond_tolerance(st, other, ["episode_index", "dim"], ["min", "mean"]).withColumns({c: F.round(c, 5) for c in ("value", "reference")})


@query(f"""WITH {EVENT_FRAMES}, k AS (SELECT 0 AS source, * FROM f WHERE episode_index % 3 = 0 UNION ALL SELECT 1, * FROM f WHERE episode_index % 2 = 0), n AS (SELECT source, episode_index, count(*) AS n FROM k GROUP BY 1, 2),
m AS (SELECT source, episode_index, row_number() OVER (ORDER BY source, episode_index) - 1 AS e, sum(n) OVER (ORDER BY source, episode_index) - n AS start FROM n)
SELECT source, e AS episode_index, frame_index, (start + frame_index)::BIGINT AS index, value FROM k JOIN m USING (source, episode_index)""")
def merged_cached_rows(spark, d):
    """Rows of two caches under the numbers that a merge of their datasets gives."""
    from ..operators import algebra as al

    f = event_frames(spark, d)
    parts = [f.filter("episode_index % 3 = 0"), f.filter("episode_index % 2 = 0")]
    merged = al.merge(parts).groupBy("source", "old_episode", "episode_index").agg((F.min("index") - F.min("frame_index")).alias("from_index"))
    cached = parts[0].withColumn("source", F.lit(0)).unionByName(parts[1].withColumn("source", F.lit(1)))
    return al.remapped(cached, merged).select("source", "episode_index", "frame_index", "index", "value")
