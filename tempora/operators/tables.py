"""Table functions over whole episodes, callable from SQL: rows of an episode in, rows and statistics out."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="episode_index long, kind string, frame_index long, value double, mean double, std double, count long")
class EpisodeTable:
    """The trailing mean of ``value`` over the last frames, row by row, and at the end of the episode its statistics.

    Called as ``episode_table(TABLE(frames) PARTITION BY (episode_index) ORDER BY (frame_index), 3)``: it holds the last
    few values and running sums, so an episode of any length streams through it.
    """

    def __init__(self):
        self.held: deque[float] = deque()
        self.episode, self.n, self.mean, self.square = None, 0, 0.0, 0.0

    def eval(self, row: Row, window: int) -> Iterator[tuple]:
        self.episode = row["episode_index"]
        if row["value"] is None:
            yield self.episode, "row", row["frame_index"], None, None, None, None
            return
        self.held.append(float(row["value"]))
        if len(self.held) > window:
            self.held.popleft()
        x = math.fsum(self.held) / len(self.held)
        self.n += 1
        step = x - self.mean
        self.mean += step / self.n
        self.square += step * (x - self.mean)
        yield self.episode, "row", row["frame_index"], x, None, None, None

    def terminate(self) -> Iterator[tuple]:
        if self.episode is not None:
            told = (self.mean, math.sqrt(self.square / self.n)) if self.n else (None, None)
            yield self.episode, "stats", None, None, *told, self.n


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL of this session."""
    spark.udtf.register("episode_table", EpisodeTable)
