"""JSON in text: extraction, aliases, merging of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extract(text: Column) -> Column:
    """The JSON of a fenced block or else of the text: all of it, or from the first { or [ to the last one that closes it, or the array in it; null if none of these is JSON."""
    block = r"(?is)```(?:json)?\s*(.*?)\s*```"
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    base = trim(F.when(text.rlike(block), F.regexp_extract(text, block, 1)).otherwise(text))
    parsed = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    return F.coalesce(parsed(base), *(parsed(F.regexp_extract(base, p, 0)) for p in (r"(?s)\{.*\}|\[.*\]", r"(?s)\[.*\]")))


def lookup(record: Column, *names: str) -> Column:
    """The first name that a map has, whatever its case and separators."""
    keys = F.transform_keys(record, lambda k, _: F.regexp_replace(F.lower(k), "[^a-z0-9]+", ""))
    return F.coalesce(*(F.try_element_at(keys, F.lit("".join(c for c in n.lower() if c.isalnum()))) for n in names))


def merge(base: Column, update: Column, fields: list[str]) -> Column:
    """A map with the chosen fields of another put over its own."""
    chosen = F.map_filter(update, lambda k, _: k.isin(fields))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(chosen), k))
    return F.map_concat(kept, chosen)


def flags(text: Column) -> Column:
    """Flagged episodes, from a list or from an object that holds it."""
    return F.coalesce(F.from_json(text, "array<bigint>"), F.from_json(text, "struct<flagged_episodes:array<bigint>>")["flagged_episodes"])


def typed(text: Column, schema: str, lengths: dict[str, int] | None = None) -> Column:
    """JSON text as a value of a schema with exactly its keys; other keys, other types, and lists of other lengths than those stated for a field are errors that say so."""
    kind = T.StructType.fromDDL(schema)
    raw = F.from_json(text, "map<string,string>")
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    names = F.array(*(F.lit(f.name) for f in kind.fields))
    keys = F.when(F.array_sort(F.map_keys(raw)) != F.array_sort(names), F.concat(F.lit("keys "), F.array_join(F.array_sort(F.map_keys(raw)), ","), F.lit(" instead of "), F.array_join(F.array_sort(names), ",")))
    types = [F.when(raw[f.name].isNotNull() & value[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in kind.fields]
    sizes = [F.when(F.size(value[n]) != k, F.concat(F.lit(f"{n} has "), F.size(value[n]).cast("string"), F.lit(f" items instead of {k}"))) for n, k in (lengths or {}).items()]
    wrong = F.coalesce(F.when(raw.isNull(), F.lit("no JSON object")), keys, *types, *sizes)
    return F.struct(F.when(wrong.isNull(), value).alias("value"), wrong.alias("error"))


def _finite(value: Column, kind: T.DataType) -> Column:
    """``value`` with null for each number that JSON lacks, however deep; texts stay as they are."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(value) < float("inf"), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    return value


def safe(value: Column, kind: T.DataType | str) -> Column:
    """A value of a known type (or its DDL) as JSON text; numbers that JSON lacks are null."""
    kind = T.StructType.fromDDL(f"_ {kind}")[0].dataType if isinstance(kind, str) else kind
    return F.to_json(_finite(value, kind), {"ignoreNullFields": "false"})
