"""Streaming: files to catalogue, coalesced progress, idle batches, running centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.functions.media import kind_of


def watched(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files below a folder as a stream: path, modificationTime, length, kind; unsupported files are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.col("path")
    hidden = path.rlike(r"/\.[^/]+|/node_modules/")
    return files.where(~hidden).select("path", "modificationTime", "length", kind_of(path).alias("kind"), F.md5("content").alias("file_hash")).where("kind is not null")


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``apply`` (upsert and requeue), once per batch number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coalesced(events: DataFrame, every: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """At most one progress row a window and task type: the last one."""
    rows = events.withWatermark("ts", late) if late else events
    last = F.max_by(F.struct("id", "status", "value"), F.struct("ts", "id"))
    out = rows.groupBy(F.window("ts", every).alias("w"), "task_type").agg(last.alias("s"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "task_type", F.col("s.id").alias("id"), F.col("s.status").alias("status"), F.col("s.value").alias("value"), "n")


def idle_batches(events: DataFrame, gap: str = "3 seconds", late: str | None = None) -> DataFrame:
    """Batches that an idle gap closes, by session window."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "task_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "task_type", "n", "first_id")


#: Rows and idle time that close a batch.
BATCH, IDLE = 200, "3 seconds"


def closed_batches(events: DataFrame, size: int = BATCH, idle: str = IDLE) -> DataFrame:
    """(start, end, task_type, n, first_id): batches that end at ``size`` rows or with an idle gap, whichever comes first.

    Of a table. A gap is found by the row before; runs between gaps are cut at each ``size``-th row.
    """
    by = Window.partitionBy("task_type").orderBy("ts", "id")
    fresh = F.coalesce((F.col("ts") - F.lag("ts").over(by) >= F.expr(f"INTERVAL {idle}")).cast("int"), F.lit(1))
    rows = events.select("id", "ts", "task_type", fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(by))
    place = F.row_number().over(Window.partitionBy("task_type", "run").orderBy("ts", "id")) - 1
    cut = rows.withColumn("cut", F.floor(place / size))
    return cut.groupBy("task_type", "run", "cut").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.min_by("id", F.struct("ts", "id")).alias("first_id")).select("start", "end", "task_type", "n", "first_id")


class _Batches(StatefulProcessor):
    """Pending rows of a key: how many, and the first; a timer closes a batch when its key has been idle."""

    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n long, first_id long, due long")

    def _out(self, key: tuple, rows: list[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
        if rows:
            n, first, why = zip(*rows)
            yield pd.DataFrame({"task_type": key[0], "n": n, "first_id": first, "closed_by": why})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, first, due = self.pending.get() if self.pending.exists() else (0, -1, -1)
        out = []
        for part in rows:
            ids = part.sort_values(["ts", "id"]).id.to_numpy()
            while len(ids):
                first = int(ids[0]) if n == 0 else first
                take = min(self.size - n, len(ids))
                n, ids = n + take, ids[take:]
                if n == self.size:
                    out.append((n, first, "size"))
                    n = 0
        if due >= 0:
            self.handle.deleteTimer(due)
        if n:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.pending.update((n, first, due))
        else:
            self.pending.clear()
        yield from self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            n, first, _ = self.pending.get()
            self.pending.clear()
            yield from self._out(key, [(n, first, "idle")])

    def close(self) -> None:
        pass


def batches(events: DataFrame, size: int = BATCH, idle_ms: int = 3000) -> DataFrame:
    """Of a stream (id, ts, task_type): (task_type, n, first_id, closed_by size or idle), closed by the clock, so the last batch
    comes without further rows. The session's state store must be RocksDB's, as timers ask."""
    out = "task_type string, n long, first_id long, closed_by string"
    return events.groupBy("task_type").transformWithStateInPandas(_Batches(size, idle_ms), out, "append", "ProcessingTime")


class _Progress(StatefulProcessor):
    """The last row of a key that hasn't been told yet, and when the next may be."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "id long, value double, due long")  # due: the timer; id -1: nothing waits

    def _row(self, key: tuple, id: int, value: float) -> pd.DataFrame:
        return pd.DataFrame({"task_type": [key[0]], "id": [id], "value": [value]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            top = part.sort_values(["ts", "id"]).iloc[-1]
            if last is None or (top.ts, top.id) >= (last.ts, last.id):
                last = top
        if self.held.exists():  # told a moment ago: this one waits for the timer
            self.held.update((int(last.id), float(last.value), self.held.get()[2]))
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self.every_ms
        self.handle.registerTimer(due)
        self.held.update((-1, 0.0, due))
        yield self._row(key, int(last.id), float(last.value))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        id, value, _ = self.held.get()
        if id < 0:
            self.held.clear()
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self.every_ms
        self.handle.registerTimer(due)
        self.held.update((-1, 0.0, due))
        yield self._row(key, id, value)

    def close(self) -> None:
        pass


def progress(events: DataFrame, every_ms: int = 250) -> DataFrame:
    """Of a stream (id, ts, task_type, value): at most one row of a task type in ``every_ms``, and always the last one."""
    return events.groupBy("task_type").transformWithStateInPandas(_Progress(every_ms), "task_type string, id long, value double", "append", "ProcessingTime")


def windowed(events: DataFrame, length: str = "32 seconds", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "n", "total")


def running_centroids(faces: DataFrame) -> DataFrame:
    """Unit centroid and size of each person after every micro-batch, kept as state."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = (state.get[0], np.array(state.get[1])) if state.exists else (0, None)
        for pdf in pdfs:
            for e in pdf.embedding:
                e = np.asarray(e, float)
                total = e if total is None else total * n + e
                n += 1
                total = total / (np.linalg.norm(total) or 1.0)
        state.update((n, total.tolist()))
        yield pd.DataFrame({"person_id": [key[0]], "n": [n], "centroid": [total.tolist()]})

    out, kept = "person_id long, n long, centroid array<double>", "n long, total array<double>"
    return faces.groupBy("person_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
