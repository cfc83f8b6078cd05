"""Relational tables as episodic data: an episode key, a dense frame index, seconds from the episode's start, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.written import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_index, frame_index, timestamp, us, value, task, event_id: the events of a user are an episode."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index"), micros("ts").alias("us"), "value", F.col("event_type").alias("task"), "event_id")
    w = Window.partitionBy("episode_index").orderBy("us", "event_id")
    return e.select("episode_index", (F.row_number().over(w) - 1).cast("long").alias("frame_index"), ((F.col("us") - F.first("us").over(w)) / 1e6).alias("timestamp"), "us", "value", "task", "event_id")


EVENT_FRAMES = """f AS (SELECT user_id AS episode_index, row_number() OVER w - 1 AS frame_index, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS timestamp,
  epoch_us(ts) AS us, value, event_type AS task, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

ACTION = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def order_frames(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """episode_index, frame_index, action (4 values): the lines of an order are an episode; ties go to the other columns.

    With ``spread``, the number of tasks grows with the rows, whatever the session's number is.
    """
    line = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey") if spread else table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", *ACTION)
    return line.select(F.col("l_orderkey").alias("episode_index"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"), F.array(*ACTION).alias("action"))


ORDER_FRAMES = """o AS (SELECT l_orderkey AS episode_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS frame_index,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS action FROM lineitem)"""
