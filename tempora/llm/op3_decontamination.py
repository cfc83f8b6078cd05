"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by size (powers of two of their shingles). Each partition has its own sketch size, so that an item
is represented by its k least hashes under one permutation with k = a quarter of the partition's largest size + SPARE.
A document that holds 0.75 of an item lacks a quarter of its shingles at most, so it holds k - a quarter of them among
the k of the sketch: documents with that many hits are the candidates, and none is lost. Candidates are verified by
counting the item's shingles in the whole document, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHINGLE, SPARE = 5, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a text, A-Z in lower case: what lies between white space."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, out: str, hashed: bool) -> DataFrame:
    """``df`` with its runs of five words (fewer words: the whole sequence) as text or as hashes."""
    df = df.withColumn("_words", words_of(text))
    n = F.size("_words")
    if hashed:
        df = df.withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w)))
        run = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(SHINGLE)))
        whole = F.xxhash64("_words")
    else:
        run = lambda i: F.array_join(F.slice("_words", i + 1, SHINGLE), " ")
        whole = F.array_join("_words", " ")
    runs = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), run)).when(n > 0, F.array(whole))
    return df.withColumn(out, runs).drop("_words")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", threshold: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of each document that holds ``threshold`` of an item's shingles.

    Shingles are distinct runs of five words between white space, A-Z in lower case; a text with fewer words is one
    shingle, which only a text of the same words holds; null and empty texts have none and match nothing. Each row is a
    document or item of its own, whatever its id, null included; rows that repeat both id and text are one. Other
    columns are not read. ``threshold`` is above 0.
    """
    return _found(docs, items, text, doc_id, item_text, item_id, threshold).drop("row", "item")


def _found(docs: DataFrame, items: DataFrame, text: str, doc_id: str, item_text: str, item_id: str, threshold: float) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn("item", F.xxhash64("item_id", "text"))
    in_item = Window.partitionBy("item")
    # the items' shingles, as text and as the same hashes that documents get
    both = with_shingles(with_shingles(items, "text", "shingle", False), "text", "hash", True)
    parts = both.select("item_id", "item", F.explode(F.arrays_zip("shingle", "hash")).alias("x")).select("item_id", "item", "x.shingle", "x.hash").distinct()
    parts = parts.withColumn("n", F.count("*").over(in_item)).withColumn("place", F.row_number().over(in_item.orderBy(F.xxhash64("hash", F.lit(1)), "shingle")))
    miss = F.col("n") - F.ceil(F.lit(threshold) * F.col("n"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the size partition
    k = F.least("n", F.ceil((1 - threshold) * largest) + SPARE)
    sketch = parts.filter(F.col("place") <= k).select("item", "hash", (k - miss).alias("need"))
    held = with_shingles(docs, "text", "hash", True).select("row", F.explode(F.array_distinct("hash")).alias("hash"))
    hits = held.join(sketch, "hash").groupBy("row", "item", "need").agg(F.countDistinct("hash").alias("hits"))
    pairs = hits.filter(F.col("hits") >= F.col("need")).select("row", "item")
    # exact: all shingles of the candidate documents, as text
    wanted = pairs.groupBy("row").agg(F.collect_set("item").alias("items"))
    found = with_shingles(docs.join(wanted, "row"), "text", "shingle", False).select("doc_id", "row", "items", F.explode(F.array_distinct("shingle")).alias("shingle"))
    shared = found.join(parts.select("item_id", "item", "shingle", "n"), "shingle").filter(F.array_contains("items", F.col("item")))
    counted = shared.groupBy("doc_id", "row", "item_id", "item", F.col("n").alias("n_item_shingles")).agg(F.countDistinct("shingle").alias("n_shared"))
    return counted.filter(F.col("n_shared") >= threshold * F.col("n_item_shingles")).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_SHINGLES = """
SELECT {id}, row, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS shingle
FROM (SELECT {id}, row_number() OVER () AS row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT DISTINCT {id}, text FROM {table}))
"""
ORACLE = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     i AS MATERIALIZED ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT row, count(*) AS n FROM i GROUP BY row)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n::DOUBLE AS containment
FROM d JOIN i USING (shingle) JOIN n ON n.row = i.row
GROUP BY d.row, doc_id, i.row, item_id, n HAVING count(*) >= 0.75 * n
"""
