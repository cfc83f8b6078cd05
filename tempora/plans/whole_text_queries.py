"""Rules for texts over whole columns of the tables: their texts as they are, and prompts that are made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as j
from ..functions import text as x
from ..sources.adapters import table
from .registry import query


def _texts(spark, d) -> DataFrame:
    """All texts of documents and conversations with a name for each."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(turns)


_TEXTS = "a AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)"
_has = lambda words, low="low": "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def _part_prompts(spark, d) -> DataFrame:
    """A prompt of each known form about every part."""
    p = table(spark, d, "part")
    name, kind, n = F.col("p_name"), F.lower("p_type"), F.col("p_partkey") % 7
    forms = (
        ("Give the ", name, " to me"), ("give me ", name), ("Pick up the ", name, " to the Left of the ", kind, ".."), ("PICK UP ", name, " on the right of ", kind), (" Pick up the ", name, " on the LEFT. "), ("Pick up ", name, " to the right"), ("Put the ", name, " away"),
    )
    prompt = F.lit(None).cast("string")
    for k, words in enumerate(forms):
        prompt = F.when(n == k, F.concat(*(F.lit(w) if isinstance(w, str) else w for w in words))).otherwise(prompt)
    return p.select(F.col("p_partkey").alias("id"), prompt.alias("prompt"))


@query("""SELECT p_partkey AS id, ['give', 'give', 'relative', 'relative', 'absolute', 'absolute', NULL][p_partkey % 7 + 1] AS kind, CASE WHEN p_partkey % 7 < 2 THEN 'give' END AS action, CASE WHEN p_partkey % 7 < 6 THEN p_name END AS target,
['', '', 'left', 'right', 'left', 'right', ''][p_partkey % 7 + 1] AS direction, CASE WHEN p_partkey % 7 IN (2, 3) THEN lower(p_type) ELSE '' END AS reference FROM part""")
def parsed_part_prompts(spark, d):
    """X01."""
    p = x.parse_prompt(F.col("prompt"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return _part_prompts(spark, d).select("id", p["kind"].alias("kind"), p["action"].alias("action"), p["target"].alias("target"), none(p["direction"]).alias("direction"), none(p["reference"]).alias("reference"))


@query(f"""WITH {_TEXTS}, l AS (SELECT id, lower(coalesce(text, '')) AS low FROM a)
SELECT id, CASE WHEN {_has(x.GIVE)} THEN 'give' WHEN {_has(x.PICK)} AND {_has(x.DIRECTIONS)} THEN 'directional_pick' WHEN {_has(x.PICK)} THEN 'pick' WHEN {_has(x.PLACE)} THEN 'place' ELSE 'unknown' END AS scene FROM l""")
def scenes_of_texts(spark, d):
    """X03."""
    return _texts(spark, d).select("id", x.scene(F.col("text")).alias("scene"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'give' WHEN 1 THEN 'give' WHEN 2 THEN 'directional_pick' WHEN 3 THEN 'directional_pick' WHEN 4 THEN 'directional_pick' WHEN 5 THEN 'directional_pick' ELSE 'place' END AS scene FROM part""")
def scenes_of_part_prompts(spark, d):
    """X03."""
    return _part_prompts(spark, d).select("id", x.scene(F.col("prompt")).alias("scene"))


@query(f"""WITH {_TEXTS}, l AS (SELECT id, replace(regexp_replace(lower(coalesce(text, '')), '[\\s_./:-]+', ' ', 'g'), 'dinasour', 'dinosaur') AS low FROM a)
SELECT id, CASE {' '.join(f"WHEN contains(low, '{w}') THEN '{n}'" for w, n in [*((o, o) for o in x.OBJECTS), *x.ALIASES.items()])} END AS object FROM l""")
def objects_in_texts(spark, d):
    """X04, X05."""
    return _texts(spark, d).select("id", x.known_object(F.col("text")).alias("object"))


_SYNONYM = " ".join(f"WHEN o IN ({', '.join(repr(a) for a in (n, *aliases))}) THEN '{n}'" for n, aliases in x.SYNONYMS.items())


@query(f"""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS o FROM part UNION ALL SELECT 1000000000 + c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'gray dog' WHEN c_custkey % 3 = 1 THEN NULL ELSE lower(c_mktsegment) END FROM customer)
SELECT id, CASE {_SYNONYM} WHEN o IN ('', 'none', 'null', 'n/a') THEN NULL ELSE o END AS name FROM n""")
def normalised_names(spark, d):
    """Names with other case and spaces."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t "))), F.lit("\n")).alias("o"))
    c = table(spark, d, "customer")
    other = F.when(F.col("c_custkey") % 3 == 0, "Gray  Dog").when(F.col("c_custkey") % 3 == 1, "N/A").otherwise(F.col("c_mktsegment"))
    return p.unionByName(c.select((F.col("c_custkey") + 1000000000).alias("id"), other.alias("o"))).select("id", x.object_name(F.col("o")).alias("name"))


@query(f"""WITH {_TEXTS}, l AS (SELECT id, lower(text) AS low FROM a)
SELECT id, CASE {' '.join(f"WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_])') THEN {n}" for w, n in x.COUNTS.items())} ELSE try_cast(nullif(regexp_extract(low, '([0-9]+)', 1), '') AS BIGINT) END::BIGINT AS count FROM l""")
def counts_in_texts(spark, d):
    """X16."""
    return _texts(spark, d).select("id", x.count_text(F.col("text")).alias("count"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['flag', 'discount', 'mixed']) AS field, unnest([l_returnflag, (l_discount * 10)::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN ' Yes ' ELSE l_linestatus END]) AS v FROM lineitem)
SELECT field, v IS NOT NULL AS given, lower(trim(v)) AS value, CASE WHEN lower(trim(v)) IN ('true', 'yes', 'y', 't') THEN true WHEN lower(trim(v)) IN ('false', 'no', 'n', 'f') THEN false ELSE try_cast(trim(v) AS DOUBLE) > 0.5 END AS truth, count(*) AS rows FROM t GROUP BY ALL""".replace("l_orderkey, l_linenumber, l_partkey, l_suppkey, ", "").replace("(l_discount * 10)::VARCHAR", "CASE WHEN l_discount > 0.05 THEN '0.75' ELSE '0.25' END"))
def truths(spark, d):
    """flags, numbers and words of all lines."""
    line = table(spark, d, "lineitem")
    fields = {"flag": F.col("l_returnflag"), "discount": F.when(F.col("l_discount") > 0.05, "0.75").otherwise("0.25"), "mixed": F.when(F.col("l_linenumber") % 2 == 0, " Yes ").otherwise(F.col("l_linestatus"))}
    rows = line.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("v")) for n, c in fields.items()))).alias("s")).select("s.*")
    return rows.groupBy("field", F.col("v").isNotNull().alias("given"), F.lower(F.trim("v")).alias("value"), x.truth(F.col("v")).alias("truth")).agg(F.count("*").alias("rows"))


@query("""WITH n AS (SELECT o_orderkey AS id, (o_custkey + 1) * (10::BIGINT ** (o_orderkey % 11))::BIGINT AS n FROM orders)
SELECT id, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN round_even(n / 1e3::DOUBLE, 0)::BIGINT || 'K' WHEN n < 1000000000 THEN round_even(n / 1e3::DOUBLE / 1e3::DOUBLE, 0)::BIGINT || 'M' WHEN n < 1000000000000 THEN round_even(n / 1e3::DOUBLE / 1e3::DOUBLE / 1e3::DOUBLE, 0)::BIGINT || 'B' ELSE round_even(n / 1e3::DOUBLE / 1e3::DOUBLE / 1e3::DOUBLE / 1e3::DOUBLE, 0)::BIGINT || 'T' END AS text FROM n""")
def numbers_for_people(spark, d):
    """X17."""
    n = ((F.col("o_custkey") + 1) * F.pow(F.lit(10), F.col("o_orderkey") % 11).cast("long")).cast("long")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), x.human(n).alias("text"))


_KEY = "regexp_replace(regexp_replace(c, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_NOTHING = "('', 'null', 'none', 'unknown', 'unclear', 'n/a')"


@query(f"""WITH l AS (SELECT p_partkey AS id, lower(CASE p_partkey % 4 WHEN 0 THEN 'Dining Table' WHEN 1 THEN 'unclear' WHEN 2 THEN p_name ELSE p_type END) AS c FROM part)
SELECT id, CASE WHEN c IN {_NOTHING} THEN NULL WHEN c = 'dining table' THEN 'square_table' ELSE {_KEY} END AS background, CASE WHEN c IN {_NOTHING} THEN NULL ELSE left(c, 64) END AS colour, CASE WHEN c IN {_NOTHING} AND c <> 'unclear' THEN NULL ELSE 'unclear' END AS match FROM l""")
def tags_of_parts(spark, d):
    """Names of parts as backgrounds, colours and answers."""
    value = F.when(F.col("p_partkey") % 4 == 0, " Dining Table ").when(F.col("p_partkey") % 4 == 1, "Unclear").when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.background(value).alias("background"), x.colour(value).alias("colour"), x.action_match(value).alias("match"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE CASE WHEN turn % 4 = 0 THEN length(text) END END::BIGINT AS n, CASE turn % 4 WHEN 1 THEN 'keys n instead of n,parts' WHEN 2 THEN 'parts has 1 items instead of 2' WHEN 3 THEN 'no JSON object' END AS error FROM conversations WHERE text IS NOT NULL""")
def typed_turns(spark, d):
    """Turns as JSON with a key that lacks, a list of another length, or cut off."""
    c = table(spark, d, "conversations").filter("text is not null")
    n, kind = F.length("text").cast("long").alias("n"), F.col("turn") % 4
    good = F.to_json(F.struct(n, F.array(F.lit(1.5), F.lit(2.0)).alias("parts")))
    line = F.when(kind == 0, good).when(kind == 1, F.to_json(F.struct(n))).when(kind == 2, F.to_json(F.struct(n, F.array(F.lit(1.5)).alias("parts")))).otherwise(F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit("]")))
    v = j.typed(line, "n long, parts array<double>", {"parts": 2})
    return c.withColumn("_v", v).select("conv_id", "turn", F.col("_v.value.n").alias("n"), F.col("_v.error").alias("error"))
