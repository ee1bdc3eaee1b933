"""Folder ingestion and task state as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import tasks


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New files below a folder, gated by suffix: the counterpart of submitting uploads."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return tasks.gate(files.withColumn("name", F.regexp_extract("path", "[^/]*$", 0)))


def run_available(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, in batches; a rerun from the checkpoint goes on after the last one."""
    stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_status(changes: DataFrame) -> DataFrame:
    """The latest state of each task from its status changes (task_id, seq, status, at); a terminal state is never left."""
    w = Window.partitionBy("task_id").orderBy("seq")
    ended = F.max(F.col("status").isin(*tasks.TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    valid = changes.withColumn("__e", F.coalesce(ended, F.lit(0))).where("__e = 0")
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("at")))
    done = F.min(F.when(F.col("status").isin(*tasks.TERMINAL), F.col("at")))
    return valid.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.min("at").alias("created_at"), first("processing").alias("started_at"), done.alias("completed_at"))


def event_counts(events: DataFrame, delay: str = "1 hour", size: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts and sums by event type in windows of event time; later events than the watermark allows are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


STATE = "status string, created_at timestamp, started_at timestamp, completed_at timestamp, seq long"


def live_states(changes: DataFrame, delay: str = "1 hour", retention_seconds: int = tasks.RETENTION_SECONDS) -> DataFrame:
    """The state of each task that a batch changes, from a stream of status changes (task_id, seq, status, at timestamp).

    What fold_status() says of all changes, kept from batch to batch: a terminal
    state is never left, and changes older than those that were seen, in seq,
    have no effect. When the watermark passes the end of a finished task's
    retention, its state goes; output mode update.
    """
    key = changes.schema["task_id"].dataType.simpleString()

    def fold(task: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, created, started, completed, last = state.get if state.exists else (None, None, None, None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        before = (status, created, started, completed)
        for seq, new, at in zip(rows["seq"], rows["status"], rows["at"], strict=True):
            if completed is not None or (last is not None and seq <= last):
                continue
            status, last, created = new, int(seq), at if created is None else min(created, at)
            started = (at if started is None else min(started, at)) if new == "processing" else started
            completed = at if new in tasks.TERMINAL else completed
        state.update((status, created, started, completed, last))
        if completed is not None:
            state.setTimeoutTimestamp(max(int(completed.timestamp() * 1000) + 1000 * retention_seconds, state.getCurrentWatermarkMs() + 1))
        if (status, created, started, completed) != before:
            yield pd.DataFrame({"task_id": [task[0]], "status": [status], "created_at": [created], "started_at": pd.Series([started], dtype="datetime64[ns]"), "completed_at": pd.Series([completed], dtype="datetime64[ns]")})

    rows = changes.select("task_id", "seq", "status", "at").withWatermark("at", delay)
    out = f"task_id {key}, status string, created_at timestamp, started_at timestamp, completed_at timestamp"
    return rows.groupBy("task_id").applyInPandasWithState(fold, out, STATE, "update", GroupStateTimeout.EventTimeTimeout)
