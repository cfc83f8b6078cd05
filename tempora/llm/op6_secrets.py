"""Secret scans with a trigram index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams (an OR of ANDs, in lower case): the trigrams of the
literal strings that any match must hold. The index has postings for the trigrams that the queries name; postings are
intersected clause by clause, and only documents that satisfy a rule's query are verified with its expression. A rule
without mandatory trigrams scans all documents.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind: (expression, ignore case, group with a least length or 0 for the match, least length). Fixed patterns: the
#: first three are the base; the others are published formats of keys and tokens.
RULES: dict[str, tuple[str, bool, int, int]] = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", False, 0, 20),
    "hex": (r"[0-9a-f]{24,}", False, 0, 24),  # the runs of 24 and more; shorter ones are dropped in any case
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, 1),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", False, 0, 1),
    "google": (r"AIza[A-Za-z0-9_-]{35}", False, 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False, 0, 1),
}
BASE = ("assign", "access", "hex")
#: Literal strings that one place of an expression may stand for at most; beyond, the place counts as unknown.
ALTERNATIVES = 24
#: Matches that are placed in one fold.
PART = 256


def _literals(node) -> set[str] | None:
    """All strings that a part of an expression can match, if they are few."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value)}
    if kind == "IN":
        if all(str(x[0]) == "LITERAL" for x in value) and len(value) <= ALTERNATIVES:
            return {chr(x[1]) for x in value}
        return None
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        each = [_sequence(x) for x in value[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if kind == "MAX_REPEAT" and value[1] == 1:
        one = _sequence(value[2])
        return None if one is None else one | ({""} if value[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _literals(node)
        if one is None or len(out) * len(one) > ALTERNATIVES:
            return None
        out = {a + b for a, b in itertools.product(out, one)}
    return out


def trigram_query(expression: str) -> list[set[str]]:
    """Clauses of trigrams in lower case: a match holds all trigrams of one clause at least. Empty: nothing is mandatory."""
    found: list[set[str]] = []
    now = {""}

    def close() -> None:
        if now and min(map(len, now)) >= 3:
            found.append(set(now))

    nodes = list(re._parser.parse(expression))
    while nodes:
        node = nodes.pop(0)
        if str(node[0]) == "SUBPATTERN" and _literals(node) is None:  # a group whose parts are looked at on their own
            nodes[:0] = list(node[1][-1])
            continue
        if str(node[0]) == "MAX_REPEAT" and node[1][0] == node[1][1] and node[1][0] <= 8:
            nodes[:0] = list(node[1][2]) * node[1][0]
            continue
        one = _literals(node)
        if one is not None and len(now) * len(one) <= ALTERNATIVES:
            now = {a + b for a, b in itertools.product(now, one)}
        else:
            close()
            now = one if one is not None else {""}
    close()
    if not found:
        return []
    best = max(found, key=lambda strings: (min(map(len, strings)), -len(strings)))  # one stretch is enough; the longest
    clauses = [{s.lower()[k : k + 3] for k in range(len(s) - 2)} for s in best]
    return [c for c in clauses if not any(d < c for d in clauses)]


def _matches(kind: str, text: str = "text") -> Column:
    """array<struct<kind, start, end>> of a rule's matches, in code points: what lies between them gives their places."""
    expression, ignore, group, least = RULES[kind]
    java = F.lit(("(?i)" if ignore else "") + expression)
    gaps, hits = F.split(text, ("(?i)" if ignore else "") + expression, -1), F.regexp_extract_all(text, java, F.lit(0))
    value = F.regexp_extract_all(text, java, F.lit(group)) if group else hits
    empty = lambda fields: F.array().cast(f"array<struct<{fields}>>")
    zero = F.lit(0).cast("bigint")
    all_ = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("value")), lambda x: x["hit"].isNotNull())
    size = lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint")

    def step(a, x):
        end = a["at"] + size(x)
        span = F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    # places are sums of lengths; in parts, as a list that grows by one is copied each time
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(all_) / PART).cast("int") - 1)), lambda k: F.slice(all_, k * PART + 1, PART))
    placed = F.aggregate(
        parts,
        F.struct(zero.alias("at"), F.slice(F.transform(parts, lambda p: F.struct(zero.alias("at"), p.alias("part"))), 1, 0).alias("out")),
        lambda a, p: F.struct((a["at"] + F.aggregate(p, zero, lambda n, y: n + size(y))).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p.alias("part")))).alias("out")),
        lambda a: a["out"],
    )
    walked = F.flatten(F.transform(placed, lambda q: F.aggregate(q["part"], F.struct(q["at"].alias("at"), empty("start:bigint,end:bigint").alias("out")), step, lambda a: a["out"])))
    order = list(RULES).index(kind)
    return F.transform(walked, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str | None = None) -> DataFrame:
    """doc_id and spans (array of start, order, kind, end by start, then the order of RULES) of each document; or all its columns, and the spans in the new column ``keep``.

    Places are code points, the end exclusive. Matches of a rule are leftmost and do not overlap; those whose value is
    too short are dropped. Null and empty texts have no spans. Each row has its own result, rows that repeat an id too;
    a null id stays null. Other columns are not read, and go along untouched with ``keep``.
    """
    others = [docs[c].alias(f"_{k}") for k, c in enumerate(docs.columns)] if keep else []
    base = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"), docs[doc_id].alias("doc_id"), *others)
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    queries = {kind: trigram_query(rule[0]) for kind, rule in RULES.items()}
    grams = sorted({g for clauses in queries.values() for c in clauses for g in c})
    # the index: postings of the trigrams that the queries name
    low = base.select("row", F.lower("text").alias("low"))
    postings = low.select("row", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))).alias("gram"))
    clauses = [(g, kind, k, len(c)) for kind, cs in queries.items() for k, c in enumerate(cs) for g in sorted(c)]
    named = docs.sparkSession.createDataFrame(clauses, "gram string, kind string, clause int, need int")
    meets = postings.join(F.broadcast(named), "gram").groupBy("row", "kind", "clause", "need").agg(F.count_distinct("gram").alias("have")).filter("have = need")
    rules = meets.groupBy(F.col("row")).agg(F.collect_set("kind").alias("kinds"))
    rows = base.join(rules, "row", "left").drop("row")
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    found = []
    for kind, (expression, _, _, _) in RULES.items():
        if queries[kind]:
            found.append(F.when(F.array_contains("kinds", kind), _matches(kind)).otherwise(none))
        else:
            found.append(F.when(F.rlike("text", F.lit(expression)), _matches(kind)).otherwise(none))
    spans = F.array_sort(F.concat(*found))
    if keep:
        return rows.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)), spans.alias(keep))
    return rows.select("doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
