"""Streams of frames: recording with state, a bounded buffer, metrics, replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.dataset import append_row, latest

FRAMES = "episode_index long, frame_index long, timestamp double, value double, last boolean"
QUEUE = "episode_index long, seq long, queue array<double>"
ENSEMBLED = "episode_index long, step long, action double, predictions int"
#: The state store that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Idle(StatefulProcessor):
    """State that goes when the watermark has passed the last row of its key by ``idle`` milliseconds (None: it stays)."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keep()

    def keep(self) -> None:
        """Names the states."""

    def forget(self) -> None:
        """Clears them."""

    def again(self, batch: pd.DataFrame) -> None:
        """Older timers go, one for the last of these rows is set."""
        self.stop()
        if self.idle is not None:
            self.handle.registerTimer(int(batch["event_ms"].max()) + self.idle)

    def stop(self) -> None:
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield from ()

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame, processor: _Idle, schema: str, time: str | None) -> DataFrame:
    """``processor`` over the episodes of a stream; with a column ``time``, which must have a watermark, abandoned ones are forgotten."""
    if time is not None:
        stream = stream.withColumn("event_ms", F.unix_millis(time))
    return stream.groupBy("episode_index").transformWithStateInPandas(processor, schema, "Append", "EventTime" if time is not None else "None")


class _Recorder(_Idle):
    def __init__(self, fps: float, idle: int | None):
        super().__init__(idle)
        self.fps = fps

    def keep(self) -> None:
        self.next = self.handle.getValueState("next", "n long")

    def forget(self) -> None:
        self.next.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else 0
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        number = np.arange(n, n + len(batch))
        if batch["last"].any():
            self.forget()
            self.stop()
        else:
            self.next.update((int(n + len(batch)),))
            self.again(batch)
        yield pd.DataFrame({"episode_index": key[0], "frame_index": number, "timestamp": number / self.fps, "value": batch["value"].to_numpy(), "last": batch["last"].to_numpy()})


def record(stream: DataFrame, fps: float, time: str | None = None, idle: int = 3_600_000) -> DataFrame:
    """Numbers the frames of each episode as they come (in the order of ``seq`` within a batch), timestamp = frame / fps.

    The state of an episode is its next frame number. It goes when a row marked ``last`` has come, and that of an abandoned
    episode when the watermark of the column ``time`` has passed its last row by ``idle`` milliseconds.
    """
    return _with_state(stream, _Recorder(fps, None if time is None else idle), FRAMES, time)


class _Queue(_Idle):
    def __init__(self, n: int, idle: int | None):
        super().__init__(idle)
        self.n = n

    def keep(self) -> None:
        self.last = self.handle.getListState("last", "value double")

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.last.get()]
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for value in batch["value"].tolist():
            held = [*held, value][-self.n :] if held else [value] * self.n
            out.append(list(held))
        if batch["last"].any():
            self.forget()
            self.stop()
        else:
            self.last.put([(float(v),) for v in held])
            self.again(batch)
        yield pd.DataFrame({"episode_index": key[0], "seq": batch["seq"].to_numpy(), "queue": out})


def observation_queue(stream: DataFrame, n: int, time: str | None = None, idle: int = 3_600_000) -> DataFrame:
    """The last n values of an episode at each row that comes; before there are n, the first one repeats.

    The queue lives in list state and goes with a row marked ``last``, or as in ``record``.
    """
    return _with_state(stream, _Queue(n, None if time is None else idle), QUEUE, time)


class _Ensembler(_Idle):
    def __init__(self, coefficient: float, idle: int | None):
        super().__init__(idle)
        self.coefficient = coefficient

    def keep(self) -> None:
        self.sums = self.handle.getMapState("sums", "step long", "total double, weight double, n int")

    def forget(self) -> None:
        self.sums.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("step", kind="stable")
        held = {k[0]: tuple(v) for k, v in self.sums.iterator()}
        out = []
        for step, chunk in zip(batch["step"].tolist(), batch["chunk"].tolist(), strict=True):
            for k, x in enumerate(chunk):
                total, weight, n = held.get(step + k, (0.0, 0.0, 0))
                w = float(np.exp(-self.coefficient * n))  # the oldest prediction of a step weighs most
                held[step + k] = (total + w * x, weight + w, n + 1)
            total, weight, n = held.pop(step)
            out.append((key[0], step, total / weight, n))
            held = {k: v for k, v in held.items() if k > step}
        self.forget()
        if batch["last"].any():
            self.stop()
        else:
            for k, v in held.items():
                self.sums.updateValue((int(k),), (float(v[0]), float(v[1]), int(v[2])))
            self.again(batch)
        yield pd.DataFrame(out, columns=["episode_index", "step", "action", "predictions"])


def ensembled(stream: DataFrame, coefficient: float = 0.01, time: str | None = None, idle: int = 3_600_000) -> DataFrame:
    """Each step's action as the mean of all predictions made for it so far, the i-th with weight exp(-coefficient * i).

    stream: episode_index, step, chunk (predictions for this step and those that follow), last. Map state holds the sums of
    the steps to come, and goes as in ``record``.
    """
    return _with_state(stream, _Ensembler(coefficient, None if time is None else idle), ENSEMBLED, time)


def run_to(stream: DataFrame, path: str) -> None:
    """All that a bounded source holds now, written as Parquet below ``path`` and nowhere else; a second run goes on where the first one ended."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)


class FifoBuffer:
    """The last ``capacity`` frames that a stream has brought, with an index that goes on over batches.

    Each batch writes a new version (bounded by the capacity) and then adds a line that names it; nothing is deleted, so
    a crash in between leaves the version before. A batch that comes again after a failure finds its number there and
    changes nothing.
    """

    POINTER = "number long, last long"

    def __init__(self, spark: SparkSession, path: str, capacity: int):
        self.spark, self.path, self.capacity = spark, path, capacity

    def _current(self) -> tuple[int, int] | None:
        """Batch and last index of the newest version."""
        row = latest(self.spark, f"{self.path}/versions", self.POINTER)
        return tuple(row) if row else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={self._current()[0]}")

    def add(self, batch: DataFrame, number: int, order: list[str]) -> None:
        now = self._current()
        if now and now[0] >= number:
            return
        last = now[1] if now else -1
        # a batch adds its last ``capacity`` rows at most; earlier ones would be dropped in any case
        newest = batch.orderBy(*(F.desc(c) for c in order)).limit(self.capacity)
        n = batch.count()
        numbered = newest.withColumn("index", (F.lit(last + n + 1) - F.row_number().over(Window.orderBy(*(F.desc(c) for c in order)))).cast("long"))
        rows = numbered.unionByName(self.read().drop("slot")) if now else numbered
        kept = rows.filter(F.col("index") > last + n - self.capacity).withColumn("slot", F.col("index") % self.capacity)
        kept.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        append_row(self.spark, f"{self.path}/versions", self.POINTER, (number, last + n))

    def counts(self) -> DataFrame:
        """Distinct episodes and frames in the buffer."""
        return self.read().agg(F.count_distinct("episode_index").alias("episodes"), F.count("*").alias("frames"))

    def sink(self, stream: DataFrame, order: list[str], checkpoint: str):
        return stream.writeStream.foreachBatch(lambda df, k: self.add(df, k, order)).option("checkpointLocation", checkpoint)


def metrics(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Counts and sums in windows of event time; rows later than ``late`` are dropped by the watermark."""
    marked = stream.withWatermark(time, late)
    return marked.groupBy(F.window(time, window), "task").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "task", "n", "total")


def last_observations(df: DataFrame, column: str, n: int) -> DataFrame:
    """The last n values of an episode at each frame; before there are n, the first one repeats."""
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    first = F.first(column).over(w)
    return df.withColumn(f"{column}_queue", F.array(*(F.coalesce(F.lag(column, k).over(w), first) if k else F.col(column) for k in range(n - 1, -1, -1))))


def last_result(stream: DataFrame, path: str) -> DataFrame:
    """What a bounded stream of complete results ends with: each batch writes its result to a folder of its own, the last one counts."""
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")
        done.append(number)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out/{max(done)}")


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored files as a stream, one file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
