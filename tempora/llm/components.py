"""Connected components of an edge table; nothing is gathered on the driver.

A task first joins the edges that it has among themselves and sends on a star around the least node of each of its groups,
one edge for each node but that. A round then lets every edge point to the least node that its end points to, and edges of
one node meet and are joined again. Both keep what is connected connected: an end and the node that it points to stay so
through the end's own edges, which point further down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpointed, released

#: Edges that a task joins at a time, about: what bounds its memory.
EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of the groups that the edges connect, and the least node of its group."""
    name, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(name)), at[: len(a)], at[len(a) :]
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            break
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        to = np.arange(len(name))
        np.minimum.at(to, np.maximum(u, v), np.minimum(u, v))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    moved = label != np.arange(len(name))
    return name[moved], name[label[moved]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = least = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return stars(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size - least >= EDGES:
            held = [joined()]
            size = least = len(held[0][0])
            if size >= 2 * EDGES:  # as many nodes: these go on by themselves
                yield pa.record_batch({"a": pa.array(held[0][0]), "b": pa.array(held[0][1])})
                held, size, least = [], 0, 0
    if held:
        a, b = joined()
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _joined(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(released(_starred), "a long, b long")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as written, and how many there are with the sum of their hashes."""
    seen = Observation()
    out = checkpointed(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the least id that each id in the edges is linked with, itself included."""
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a != b")
    now, mark = _written(_joined(_joined(pairs).repartition("a")))
    while mark[0]:  # until a round changes nothing, or there is nothing
        least = now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("end"), "m")
        # a node that most edges end in is a skewed key of this join, which Spark splits
        lower = now.join(least, F.col("b") == F.col("end"), "left")
        seen, before = Observation(), mark
        lower = lower.observe(seen, F.count("m").alias("lowered")).select("a", F.coalesce("m", "b").alias("b"))
        now, mark = _written(_joined(_joined(lower).repartition("a")))
        # ends that point no further, and edges that meet no other of their node
        if mark == before and not seen.get["lowered"]:
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
