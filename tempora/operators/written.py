"""Tables that several steps read are written once, to a folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str | None:
    """What spark.checkpoint.dir names; None in a single process without it, an error elsewhere."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and (context.master.startswith("local-") or not context.master.startswith("local")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return folder


#: Rows of a task that sorts or aggregates them, about.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys, over as many tasks as leave each about ``TASK_ROWS`` rows, so that what a task holds does not grow with the table."""
    n = -(-df.count() // TASK_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if n > usual else df.repartition(*keys)


def written(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder: it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark) or tempfile.mkdtemp(prefix="checkpoint-"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # shuffles of this run are of no use once the table stands
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
