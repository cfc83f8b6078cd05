"""Queries over boxes, detections and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as a
from ..sources.adapters import table
from .registry import query

#: Boxes made of a part's numbers, in the three coordinate spaces in turn.
BOX_SQL = """b AS (SELECT p_partkey AS id, l * k AS l, t * k AS t, (l + w) * k AS r, (t + h) * k AS b FROM (SELECT p_partkey, (p_partkey % 50) / 100.0::DOUBLE AS l, (p_partkey % 30) / 100.0::DOUBLE AS t, (p_size % 40) / 100.0::DOUBLE AS w, p_size / 200.0::DOUBLE AS h,
CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 900.0 END::DOUBLE AS k FROM part))"""


def _boxes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    scale = F.when(k % 2 == 0, 1.0).otherwise(900.0)
    left, top, wide, high = (k % 50) / 100.0, (k % 30) / 100.0, (size % 40) / 100.0, size / 200.0
    box = F.struct((left * scale).alias("left"), (top * scale).alias("top"), ((left + wide) * scale).alias("right"), ((top + high) * scale).alias("bottom"))
    return table(spark, d, "part").select(k.alias("id"), box.alias("box"))


@query(f"WITH {BOX_SQL} SELECT id, round((l + r) / 2, 6) AS x, round((t + b) / 2, 6) AS y, round((r - l) * (b - t), 6) AS area FROM b")
def bbox_geometry(spark, d):
    x, y = a.center(F.col("box"))
    return _boxes(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(a.area(F.col("box")), 6).alias("area"))


@query(f"""WITH {BOX_SQL}, s AS (SELECT id, CASE WHEN greatest(l, r, t, b) <= 1 THEN 640 WHEN greatest(l, r, t, b) <= 1000 THEN 0.64 ELSE 1 END AS kx, CASE WHEN greatest(l, r, t, b) <= 1 THEN 480 WHEN greatest(l, r, t, b) <= 1000 THEN 0.48 ELSE 1 END AS ky, l, t, r, b FROM b),
p AS (SELECT id, least(greatest(l * kx, 0), 640) AS l, least(greatest(t * ky, 0), 480) AS t, least(greatest(r * kx, 0), 640) AS r, least(greatest(b * ky, 0), 480) AS b FROM s) SELECT id, round(l, 4) AS l, round(t, 4) AS t, round(r, 4) AS r, round(b, 4) AS b FROM p WHERE r > l AND b > t""")
def bbox_normalise(spark, d):
    p = _boxes(spark, d).select("id", a.to_pixels(F.col("box"), 640.0, 480.0).alias("p")).filter("p IS NOT NULL")
    return p.select("id", F.round("p.left", 4).alias("l"), F.round("p.top", 4).alias("t"), F.round("p.right", 4).alias("r"), F.round("p.bottom", 4).alias("b"))


@query("""WITH t AS (SELECT l_orderkey AS e, l_partkey AS det, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 13)::DOUBLE AS y FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT l_orderkey AS e, l_partkey AS ref, (l_partkey % 89)::DOUBLE AS rx, (l_suppkey % 11)::DOUBLE AS ry FROM lineitem WHERE l_returnflag <> 'N'),
p AS (SELECT t.e AS episode_index, det, ref, sqrt((x - rx) ** 2 + (y - ry) ** 2) AS distance, x, rx FROM t JOIN r ON t.e = r.e), s AS (SELECT * FROM p WHERE CASE WHEN episode_index % 2 = 0 THEN x < rx ELSE x > rx END)
SELECT episode_index, det, ref, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY distance, det, ref) AS k FROM s) WHERE k = 1""")
def bbox_select(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "episode_index")
    at = lambda m, n: (F.col("l_partkey").alias("det"), (F.col("l_partkey") % m).cast("double").alias("x"), (F.col("l_suppkey") % n).cast("double").alias("y"))
    targets, refs = line.filter("l_returnflag = 'N'").select("episode_index", *at(97, 13)), line.filter("l_returnflag <> 'N'").select("episode_index", *at(89, 11))
    found = a.closest_pair(targets, refs, F.when(F.col("episode_index") % 2 == 0, "left").otherwise("right"))
    return found.select("episode_index", "det", "ref", F.round("distance", 6).alias("distance"))


@query("""WITH v AS (SELECT c_nationkey AS episode_index, list(DISTINCT c_mktsegment) AS p FROM customer WHERE c_acctbal > 7000 GROUP BY 1)
SELECT episode_index, array_to_string(list_sort(list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda x: NOT list_contains(p, x))), ',') AS missing FROM v""")
def missing_vocabulary(spark, d):
    have = table(spark, d, "customer").filter("c_acctbal > 7000").groupBy(F.col("c_nationkey").alias("episode_index")).agg(F.collect_set("c_mktsegment").alias("p"))
    out = a.missing_from_vocabulary(have, "p", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return out.select("episode_index", F.array_join(F.sort_array("missing"), ",").alias("missing"))


@query("""WITH p AS (SELECT o_totalprice AS x, (o_custkey % 101)::DOUBLE AS y FROM orders), s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT least(floor((x - x0) / (x1 - x0) * 16)::BIGINT, 15) AS px, 15 - least(floor((y - y0) / (y1 - y0) * 16)::BIGINT, 15) AS py, count(*) AS n FROM p, s GROUP BY 1, 2""")
def heatmap_bins(spark, d):
    points = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 101).cast("double").alias("y"))
    return a.heatmap(points, "x", "y", 16)


@query("""SELECT d.doc_id AS episode_index, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)""")
def episodes_with_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "episode_index")


@query("""SELECT d.doc_id AS episode_index, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN n_chars < 100 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents d LEFT JOIN labels USING (doc_id)""")
def review_reasons(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, F.lit("low_quality")), F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality").isNull(), F.lit("unlabelled")), F.when(F.col("n_chars") < 100, F.lit("short"))))
    return joined.select(F.col("doc_id").alias("episode_index"), F.array_join(reasons, ",").alias("reasons"))
