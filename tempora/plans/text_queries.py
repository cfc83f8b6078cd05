"""Queries over prompts, JSON and other text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as j
from ..functions import text as x
from ..sources.adapters import table
from .registry import query

#: Prompts made of a part's name and brand, of each kind in turn.
PROMPT_SQL = """pr AS (SELECT p_partkey AS id, p_partkey % 8 AS kind, CASE p_partkey % 8 WHEN 0 THEN 'Give the ' || p_name || ' to me' WHEN 1 THEN 'Give me the ' || p_name || '.' WHEN 2 THEN 'Pick up the ' || p_name || ' to the left of the ' || p_brand
WHEN 3 THEN 'pick up ' || p_name || ' on the RIGHT of ' || p_brand WHEN 4 THEN 'Pick up the ' || p_name || ' on the left' WHEN 5 THEN 'Pick up the ' || p_name || ' to the right' WHEN 6 THEN 'Pick up the ' || p_name ELSE 'Look at ' || p_name || ', please' END AS prompt,
trim(p_name) AS name, trim(p_brand) AS brand FROM part)"""

#: Prompts for each branch of the rules, with what the rules give, worked out by hand: kind, target, direction, reference; scene; target object; prepositions mended.
PROMPT_CASES = [
    ("Give the yellow duck to me", "give", "yellow duck", None, None, "give", "yellow duck", None),
    ("Give me the Orange Lion.", "give", "Orange Lion", None, None, "give", "orange lion", None),
    ("give brown dog to me", "give", "brown dog", None, None, "give", "brown dog", None),
    ("Pick up the Green Dinasour to the left of the brown dog", "relative", "Green Dinasour", "left", "brown dog", "relational_pick", "green dinosaur", None),
    ("pick up green dinasour on the RIGHT of the orange lion", "relative", "green dinosaur", "right", "orange lion", "directional_pick", "orange lion", None),
    ("Pick up the brown dog on the left of the yellow duck", "relative", "brown dog", "left", "yellow duck", "relational_pick", "brown dog", "pick up the brown dog to the left of the yellow duck"),
    ("Pick up the orange lion on the right", "absolute", "orange lion", "right", None, "directional_pick", "orange lion", None),
    ("Pick up the orange lion to the right", "absolute", "orange lion", "right", None, "directional_pick", "orange lion", "pick up the orange lion on the right"),
    ("Pick up the yellow duck", "single", "yellow duck", None, None, "pick", "yellow duck", None),
    ("  Pick up the red mug...  ", "single", "red mug", None, None, "pick", "mug", None),
    ("Place the object", None, None, None, None, "place", "unknown", None),
    ("put object", None, None, None, None, "place", "unknown", None),
    ("Insert the plug into socket 3", None, None, None, None, "place", "insert_plug", None),
    ("把红色杯子递给我", None, None, None, None, "give", "把红色杯子递给我", None),
    ("拿 左 杯子", None, None, None, None, "directional_pick", "杯子", None),
    ("Look at the top shelf, please", None, None, None, None, "unknown", "look_shelf", None),
    ("", None, None, None, None, "unknown", "unknown", None),
    ("Give the cup to me. Pick up the hat to the left and stop", None, None, None, None, "give", "cup_hat", "Give the cup to me. pick up the hat on the left and stop"),
    ("Pick up THE cup", "single", "cup", None, None, "pick", "cup", None),
    ("Pick up the brown bear-toy on the left.", "absolute", "brown bear-toy", "left", None, "directional_pick", "brown_bear_toy", None),
]
STAGE_CASES = [
    ("Pick up the cup", 0, "prepare to grasp cup"), ("Pick up the cup", 9, "pick complete"), ("Pick up the cup", -1, "cup not found"), ("give the Cup to me", 3, "lift cup to me"),
    ("hand over the cup to the person", 3, "lift cup to the person"), ("Give cup", 3, "lift cup"), ("give the cup to me", 4, "release cup to hand"), ("give the cup to me", 7, "give complete"),
    ("Put the hat to the box", 0, "prepare to place object"), ("put down the hat", -1, "down the hat not found"), ("Place hat", -5, "prepare to place object"), ("Wipe the Table", 2, "execute wipe the table"),
    ("Wipe the Table", 4, "wipe the table complete"), ("Grab a pen", 1, "reach for a pen"), ("grasp the handle", 0, "prepare to grasp handle"), ("  Lift the box to the table ", 2, "grasp box"),
]
NUMBER_CASES = [(0, "0"), (999, "999"), (1000, "1K"), (1999, "2K"), (1500, "2K"), (2500, "2K"), (-1500, "-2K"), (999_999, "1000K"), (1_000_000, "1M"), (7_300_000_000, "7B"), (10**12, "1T"), (42 * 10**14, "4Q"), (10**18, "1.0")]
CASE_CASES = [("Red Mug", "CUP", "RED MUG"), ("red mug", "Blue Cup", "Red Mug"), ("red mug", "Blue cup", "Red mug"), ("RED mug", "blue cup", "red mug"), (" red-mug ", "Cup", "Red-Mug"), ("", "Cup", ""), ("mug", "", "mug"), ("mug", "bLUE", "mug")]
TEMPLATE_CASES = [
    ("Give the Cup to me.", "red mug", "Give the Red Mug to me."), ("Give me the cup", "MUG", "Give me the mug"), ("Pick up the CUP to the left of the hat", "mug", "Pick up the MUG to the left of the hat"),
    ("Pick up the cup to the left of the mug", "Mug", ""), ("Pick up the cup on the right", "mug", "Pick up the mug on the right"), ("Pick up the cup", "mug", "Pick up the mug"), ("Wipe the cup", "mug", ""), ("Pick up the cup", " ", ""),
]
NAME_CASES = [(" Grey  Dog ", "brown dog"), ("brown bear", "brown dog"), ("Cup", "cup"), ("N/A", None), ("", None), ("none", None), ("yellow duck", "yellow duck")]
BACKGROUND_CASES = [("Round Table", "round_table"), ("couch", "sofa"), ("长桌", "square_table"), ("TV stand", "tv_cabinet"), ("Kitchen counter!", "kitchen_counter"), ("unclear", None), (" ", None)]
MATCH_CASES = [("Yes", "match"), ("no", "mismatch"), ("it is the same object", "match"), ("Totally different", "mismatch"), ("maybe", "unclear"), ("N/A", None), ("wrong one, not a match", "mismatch")]


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def cases_sql(rows, select: str) -> str:
    """One row for each part with the case whose turn it is."""
    values = ", ".join("(" + ", ".join(literal(v) for v in (k, *r)) + ")" for k, r in enumerate(rows))
    names = ", ".join(f"c{k}" for k in range(len(rows[0])))
    return f"WITH c(k, {names}) AS (VALUES {values}) SELECT p_partkey AS id, {select} FROM part JOIN c ON p_partkey % {len(rows)} = k"


def cases(spark, d, rows):
    """id and the columns c0, c1, ... of the case whose turn it is."""
    of = F.array(*(F.struct(*(F.lit(v).alias(f"c{k}") for k, v in enumerate(r))) for r in rows))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return part.withColumn("c", F.get(of, (F.col("id") % len(rows)).cast("int"))).select("id", "c.*")


def _prompts(spark, d):
    part = table(spark, d, "part")
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 8
    c = lambda *p: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in p))
    prompt = (
        F.when(k == 0, c("Give the ", n, " to me")).when(k == 1, c("Give me the ", n, ".")).when(k == 2, c("Pick up the ", n, " to the left of the ", b)).when(k == 3, c("pick up ", n, " on the RIGHT of ", b))
        .when(k == 4, c("Pick up the ", n, " on the left")).when(k == 5, c("Pick up the ", n, " to the right")).when(k == 6, c("Pick up the ", n)).otherwise(c("Look at ", n, ", please"))
    )
    return part.select(F.col("p_partkey").alias("id"), prompt.alias("prompt"))


_TEXTS = [(c[0],) for c in PROMPT_CASES]


@query(cases_sql(PROMPT_CASES, "c1 AS kind, CASE WHEN c1 = 'give' THEN 'give' END AS action, c2 AS target, c3 AS direction, c4 AS reference"))
def parse_task(spark, d):
    """X01."""
    return cases(spark, d, _TEXTS).select("id", *(c.alias(n) for n, c in x.parse_prompt(F.col("c0")).items()))


@query(cases_sql(PROMPT_CASES, "c5 AS scene"))
def scene_infer(spark, d):
    """X03."""
    return cases(spark, d, _TEXTS).select("id", x.scene(F.col("c0")).alias("scene"))


@query(cases_sql(PROMPT_CASES, "c6 AS target"))
def target_infer(spark, d):
    """X04."""
    return cases(spark, d, _TEXTS).select("id", x.target_object(F.col("c0")).alias("target"))


@query(cases_sql(PROMPT_CASES, "coalesce(c7, c0) AS fixed, CASE WHEN c7 IS NULL THEN 0 ELSE 1 END::BIGINT AS changes"))
def preposition_fix(spark, d):
    """X08."""
    return cases(spark, d, _TEXTS).select("id", *(c.alias(n) for n, c in x.fix_prepositions(F.col("c0")).items()))


CANONICAL_SQL = """WITH o(o) AS (VALUES ('yellow duck'), ('brown dog'), ('orange lion'), ('green dinosaur')), f AS (
SELECT 'Give the ' || o || ' to me' AS task, true AS canonical, 'give' AS scene, o AS target, NULL AS side, NULL AS reference, lower('Give the ' || o || ' to me') AS said FROM o
UNION ALL SELECT 'Pick up the ' || o, true, 'pick', o, NULL, NULL, lower('Pick up the ' || o) FROM o
UNION ALL SELECT 'Pick up the ' || o || ' on the ' || s, true, 'directional_pick', o, s, NULL, lower('Pick up the ' || o || ' on the ' || s) FROM o, (VALUES ('left'), ('right')) s(s)
UNION ALL SELECT 'Pick up the ' || o.o || ' to the ' || s || ' of the ' || r.o, w = 'to', 'relational_pick', o.o, s, r.o, lower('Pick up the ' || o.o || ' ' || w || ' the ' || s || ' of the ' || r.o) FROM o, o r, (VALUES ('left'), ('right')) s(s), (VALUES ('to'), ('on')) w(w)
UNION ALL SELECT 'Place object', true, 'place', 'unknown', NULL, NULL, x FROM (VALUES ('place object'), ('put object'), ('place the object'), ('put the object')) x(x)),
a AS (SELECT conv_id, turn, (SELECT list(said ORDER BY said) FROM f) AS l FROM conversations)
SELECT DISTINCT conv_id AS id, turn, coalesce(canonical, false) AS canonical, coalesce(scene, 'unknown') AS scene, coalesce(target, 'unknown') AS target, side, reference, coalesce(task, 'unknown') AS task
FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'no canonical prompt' ELSE l[((conv_id * 7 + turn) % len(l) + 1)::INT] END AS said FROM a) LEFT JOIN f USING (said)"""


@query(CANONICAL_SQL)
def canonical_tasks(spark, d):
    """Every form of the closed grammar, in odd spacing and case, and prompts that it lacks."""
    objects, sides = x.OBJECTS, ("left", "right")
    said = [f"give the {o} to me" for o in objects] + [f"pick up the {o}" for o in objects] + [f"pick up the {o} on the {s}" for o in objects for s in sides]
    said += [f"pick up the {o} {w} the {s} of the {r}" for o in objects for r in objects for s in sides for w in ("to", "on")] + ["place object", "put object", "place the object", "put the object"]
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn")
    text = F.get(F.array(*(F.lit(t.replace("pick up", "  Pick  UP").replace("dinosaur", "Dinasour")) for t in sorted(said))), ((F.col("id") * 7 + F.col("turn")) % len(said)).cast("int"))
    text = F.when((F.col("id") + F.col("turn")) % 5 == 0, "no canonical prompt").otherwise(text)
    return c.select("id", "turn", *(v.alias(n) for n, v in x.canonical_task(text).items())).distinct()


@query(f"""WITH {PROMPT_SQL} SELECT CASE WHEN kind < 2 THEN 'give' WHEN kind = 6 THEN 'pick' WHEN kind IN (4, 5) THEN 'pick_absolute' WHEN kind IN (2, 3) THEN 'pick_relative' END AS scenario, count(*) AS count FROM pr GROUP BY 1""")
def scenario_counts(spark, d):
    p = x.parse_prompt(F.col("prompt"))
    return _prompts(spark, d).select(x.scenario(p["kind"]).alias("scenario")).groupBy("scenario").agg(F.count("*").alias("count"))


@query(f"""WITH {PROMPT_SQL} SELECT id, regexp_replace(prompt, 'the ([a-z]+)', 'a \\1', 'g') AS rewritten, len(regexp_extract_all(prompt, 'the ([a-z]+)'))::BIGINT AS replacements, regexp_matches(prompt, 'the ([a-z]+)') AS changed FROM pr""")
def prompt_rewrite(spark, d):
    return _prompts(spark, d).select("id", *(c.alias(n) for n, c in x.rewrite(F.col("prompt"), "the ([a-z]+)", "a $1").items()))


@query(f"""WITH {PROMPT_SQL}, s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(prompt)), '[\\s./:-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pr) SELECT id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM s""")
def slug(spark, d):
    return _prompts(spark, d).select("id", x.slug(F.col("prompt")).alias("slug"))


@query(f"WITH {PROMPT_SQL} SELECT regexp_matches(prompt, '[,.]') AS several, count(*) AS count FROM pr GROUP BY 1")
def multi_sentence(spark, d):
    return _prompts(spark, d).groupBy(x.several_sentences(F.col("prompt")).alias("several")).agg(F.count("*").alias("count"))


@query(cases_sql(STAGE_CASES, "c1::INTEGER AS stage, c2 AS text"))
def stage_text(spark, d):
    """X12, U02."""
    return cases(spark, d, [c[:2] for c in STAGE_CASES]).select("id", F.col("c1").alias("stage"), x.stage_text(F.col("c0"), F.col("c1")).alias("text"))


@query(cases_sql(CASE_CASES, "c2 AS word"))
def matched_case(spark, d):
    """X10."""
    return cases(spark, d, [c[:2] for c in CASE_CASES]).select("id", x.match_case(F.col("c0"), F.col("c1")).alias("word"))


@query(cases_sql(TEMPLATE_CASES, "c2 AS prompt"))
def retargeted_prompts(spark, d):
    """X10."""
    return cases(spark, d, [c[:2] for c in TEMPLATE_CASES]).select("id", x.prompt_with_target(F.col("c0"), F.col("c1")).alias("prompt"))


@query(cases_sql(NAME_CASES, "c1 AS name"))
def object_names(spark, d):
    """X05."""
    return cases(spark, d, [c[:1] for c in NAME_CASES]).select("id", x.object_name(F.col("c0")).alias("name"))


@query(cases_sql(BACKGROUND_CASES, "c1 AS background"))
def background_names(spark, d):
    """X16."""
    return cases(spark, d, [c[:1] for c in BACKGROUND_CASES]).select("id", x.background(F.col("c0")).alias("background"))


@query(cases_sql(MATCH_CASES, "c1 AS match"))
def action_matches(spark, d):
    """X16."""
    return cases(spark, d, [c[:1] for c in MATCH_CASES]).select("id", x.action_match(F.col("c0")).alias("match"))


@query("SELECT p_partkey AS id, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size - 10 <= 0 THEN '0' WHEN p_size - 10 >= 4 THEN '4_plus' ELSE (p_size - 10)::VARCHAR END AS bucket FROM part")
def count_buckets(spark, d):
    """X16."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.count_bucket(F.col("p_size") - 10).alias("bucket"))


@query(f"""WITH {PROMPT_SQL} SELECT id, CASE WHEN kind < 2 THEN 'Give me the ' || name WHEN kind < 7 THEN 'Pick up the ' || name || CASE WHEN kind = 6 THEN '' WHEN kind = 4 THEN ' on the left' WHEN kind = 5 THEN ' on the right' WHEN kind = 2 THEN ' to the left of the ' || brand ELSE ' to the right of the ' || brand END END AS prompt FROM pr""")
def prompt_generation(spark, d):
    p = x.parse_prompt(F.col("prompt"))
    new = F.when(p["kind"].isNotNull(), x.prompt(p["action"], p["target"], p["direction"], p["reference"]))
    return _prompts(spark, d).select("id", new.alias("prompt"))


@query(cases_sql(NUMBER_CASES, "c1 AS human"))
def human_numbers(spark, d):
    """X17."""
    return cases(spark, d, [c[:1] for c in NUMBER_CASES]).select("id", x.human(F.col("c0").cast("long")).alias("human"))


@query("SELECT doc_id AS episode, format('data/chunk-{:03d}/episode_{:06d}.parquet', doc_id // 300, doc_id) AS path FROM documents")
def path_format(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("episode"), x.episode_path(F.col("doc_id"), 300).alias("path"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("SELECT p_partkey AS id, CASE v WHEN 'yes' THEN true WHEN 'no' THEN false WHEN '0.7' THEN true WHEN '0.2' THEN false END AS truth FROM (SELECT p_partkey, (['yes', 'no', '0.7', '0.2', 'maybe'])[(p_partkey % 5 + 1)::INT] AS v FROM part)")
def truthiness(spark, d):
    v = F.element_at(F.array(*(F.lit(y) for y in ("yes", "no", "0.7", "0.2", "maybe"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.truth(v).alias("truth"))


COUNT_CASES = [("two ducks", 2), ("Exactly 7 objects, 8 at most", 7), ("none", 0), ("TEN", 10), ("stone, 4", 4), ("many", None), ("one or three", 1), ("", None)]
COLOUR_CASES = [(" Dark   Blue ", "dark blue"), ("unclear", None), ("RED", "red"), ("x" * 70, "x" * 64), ("N/A", None)]


@query(cases_sql(COUNT_CASES, "c1::BIGINT AS number"))
def count_text(spark, d):
    """X16."""
    return cases(spark, d, [c[:1] for c in COUNT_CASES]).select("id", x.count_text(F.col("c0")).alias("number"))


@query(cases_sql(COLOUR_CASES, "c1 AS colour"))
def colours(spark, d):
    """X16."""
    return cases(spark, d, [c[:1] for c in COLOUR_CASES]).select("id", x.colour(F.col("c0")).alias("colour"))


@query("SELECT DISTINCT w AS word, min(p_partkey) AS first, count(*) AS uses FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def vocabulary(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.groupBy("word").agg(F.min("p_partkey").alias("first"), F.count("*").alias("uses"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props WHEN 4 THEN props WHEN 3 THEN '[' || props || ', 2]' END AS json FROM events""")
def json_extract(spark, d):
    """Fenced, bare, inside words, an array after a bracket that is no JSON, and cut off."""
    n, p = F.col("event_id") % 5, F.col("props")
    told = lambda before, after: F.concat(F.lit(before), p, F.lit(after))
    text = F.when(n == 0, told("text ```JSON ", " ``` end {")).when(n == 1, told(" ", "\n")).when(n == 2, told("so: ", " it is")).when(n == 3, told("in {braces} [", ", 2] done")).otherwise(told("[", ""))
    e = table(spark, d, "events").withColumn("json", j.extract(text))
    return e.select("event_id", F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$[0].k")).cast("long").alias("k"), "json")


@query("""SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS background, 'old' AS arm FROM (SELECT DISTINCT user_id FROM events)""")
def record_merge(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    base = F.create_map(F.lit("background"), F.lit("old"), F.lit("arm"), F.lit("old"))
    update = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("background"), F.lit("new"), F.lit("arm"), F.lit("new"))).otherwise(F.create_map(F.lit("arm"), F.lit("new")))
    return ids.withColumn("m", j.merge(base, update, ["background"])).select("id", j.lookup(F.col("m"), "Back-Ground").alias("background"), F.col("m")["arm"].alias("arm"))


@query("SELECT user_id AS id, len(x)::INTEGER AS n, list_sum(x)::BIGINT AS total FROM (SELECT DISTINCT user_id, [user_id, user_id + 1] AS x FROM events)")
def flag_files(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    a, b = F.format_string("[%d, %d]", "id", F.col("id") + 1), F.format_string('{"flagged_episodes": [%d, %d], "summary": {}}', "id", F.col("id") + 1)
    flagged = ids.withColumn("f", j.flags(F.when(F.col("id") % 2 == 0, a).otherwise(b)))
    return flagged.select("id", F.size("f").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))
