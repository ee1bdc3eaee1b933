"""Tasks, the leases of their readers and their removal as one stateful operator of a stream.

Per task the state holds its status and times, and a map of open leases. A timer
of event time is set to the end of the retention; a task that is still being
read then stays until its last lease is given back. A removal is a row of the
result, as those who hold the task's files must hear of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import tasks

#: kind: a status, `acquire` or `release`; lease: of the latter two.
CHANGES = "task_id long, seq long, kind string, lease string, at timestamp"
#: event: `status` with the task's state, or `removed`; at: of the change, or of the removal.
EVENTS = "task_id long, seq long, event string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, readers int, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class Lifecycle(StatefulProcessor):
    """Folds the changes of one task in the order of seq."""

    def __init__(self, retention_seconds: int):
        self.retention = 1000 * retention_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, created long, started long, completed long, seq long")
        self.leases = handle.getMapState("leases", "lease string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.task.get() if self.task.exists() else None
        status, created, started, completed, last = now if now is not None else (None, None, None, None, -1)
        out, touched = [], False
        changes = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, kind, lease, at in zip(changes["seq"], changes["kind"], changes["lease"], changes["at"], strict=True):
            seq, ms = int(seq), _ms(at)
            if seq <= last:
                continue
            if kind in tasks.STATUSES:
                if completed is None or status not in tasks.TERMINAL:
                    status, touched = kind, True
                    created = ms if created is None else created
                    started = ms if kind == "processing" and started is None else started
                    completed = ms if kind in tasks.TERMINAL else completed
                last = seq
            elif status is not None:  # a lease of a task that is not there, or was removed, is none
                if kind == "acquire":
                    self.leases.updateValue((lease,), (seq,))
                elif kind == "release" and self.leases.containsKey((lease,)):
                    self.leases.removeKey((lease,))
                last, touched = seq, True
        if not touched:
            return
        self.task.update((status, created, started, completed, last))
        readers = sum(1 for _ in self.leases.keys())
        out.append(self._row(key, last, "status", status, created, started, completed, readers, completed or started or created))
        due = None if completed is None or not self.retention else completed + self.retention
        if due is not None:
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            elif not readers:
                out.append(self._remove(key, last, status, created, started, completed, due))
        yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.task.exists():
            return
        status, created, started, completed, last = self.task.get()
        if completed is not None and completed + self.retention <= expiredTimerInfo.getExpiryTimeInMs() and not any(True for _ in self.leases.keys()):
            yield self._remove(key, last, status, created, started, completed, completed + self.retention)

    def _remove(self, key, seq, status, created, started, completed, due) -> pd.DataFrame:
        self.task.clear()
        self.leases.clear()
        return self._row(key, seq, "removed", status, created, started, completed, 0, due)

    def _row(self, key, seq, event, status, created, started, completed, readers, at) -> pd.DataFrame:
        time = lambda ms: pd.Series([pd.NaT if ms is None else pd.Timestamp(ms, unit="ms")], dtype="datetime64[ns]")
        return pd.DataFrame({"task_id": [key[0]], "seq": [seq], "event": [event], "status": [status], "created_at": time(created), "started_at": time(started), "completed_at": time(completed), "readers": pd.Series([readers], dtype="int32"), "at": time(at)})

    def close(self) -> None:
        pass


def lifecycle(changes: DataFrame, retention_seconds: int = tasks.RETENTION_SECONDS, delay: str = "1 hour") -> DataFrame:
    """EVENTS of a stream of CHANGES; output mode update.

    Changes of a task count in the order of seq; one that comes after a later
    one was seen has no effect. A terminal status is never left. A finished task
    is removed when the watermark has passed its retention and nobody reads it:
    at the timer, or when the last lease is given back after it. With a
    retention of 0 nothing is removed. The session needs the state store STORE.
    """
    rows = changes.select("task_id", "seq", "kind", "lease", "at").withWatermark("at", delay)
    return rows.groupBy("task_id").transformWithStateInPandas(Lifecycle(retention_seconds), EVENTS, "update", "eventTime")


def run(changes: DataFrame, out: str, checkpoint: str, retention_seconds: int = tasks.RETENTION_SECONDS, delay: str = "1 hour") -> DataFrame:
    """All there is now, as a table of EVENTS with the number of their batch below out; goes on from the checkpoint when called again."""
    spark: SparkSession = changes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = lifecycle(changes, retention_seconds, delay).writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(f"{EVENTS}, batch int").parquet(out)


def live(events: DataFrame) -> DataFrame:
    """The tasks that are there, in their latest state."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("event", "status", "created_at", "started_at", "completed_at", "readers"), F.struct("batch", F.col("event") == "removed", "seq")).alias("s"))
    return last.where("s.event = 'status'").select("task_id", "s.status", "s.created_at", "s.started_at", "s.completed_at", "s.readers")
