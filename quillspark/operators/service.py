"""Answers of the task service as tables: a request is a row, and so is its answer (http_status, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import Settings
from . import tasks

# Messages of the service.
SUBMITTED, NOT_READY, FAILED, NOT_FOUND = "Task submitted successfully", "Task result is not ready yet", "Task execution failed", "Task not found"
PROTOCOL_VERSION = 1


def _error(status: int, detail: Column, kind: str) -> tuple[Column, Column]:
    return F.lit(status), F.to_json(F.struct(detail.alias("detail"), F.lit(kind).alias("error_type")))


def payload(base_url: str, columns: list[str], message: Column | None = None) -> Column:
    """The status of a task as JSON, from the columns of tasks.status_payload() that are there; null ones are written, but for queued_ahead."""
    named = ("task_id", "status", "backend", "file_names", "created_at", "started_at", "completed_at", "error", "status_url", "result_url")
    fields = [F.col(c).cast("string").alias(c) if c == "task_id" else F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in named]
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rest = ([F.col("queued_ahead")] if "queued_ahead" in columns else []) + ([message.alias("message")] if message is not None else [])
    if not rest:
        return whole
    more = F.to_json(F.struct(*rest), {"ignoreNullFields": "true"})
    return F.when(more == "{}", whole).otherwise(F.concat(F.left(whole, F.length(whole) - 1), F.lit(","), F.substr(more, F.lit(2))))


def submit(requests: DataFrame, base_url: str) -> DataFrame:
    """requests (task_id, file_names, created_at, and the columns of tasks.option_errors()) with http_status and body.

    Valid ones (202) are new tasks: pending, in the order of created_at and task_id by submit_order, which begins at 1;
    tasks.queued_ahead() counts by it. Others are 400 and have no order.
    """
    checked = tasks.option_errors(requests).withColumn("invalid", F.col("error"))
    rows = checked.withColumn("status", F.when(F.col("invalid").isNull(), F.lit("pending"))).withColumn("error", F.lit(None).cast("string"))
    shown = tasks.status_payload(rows.withColumn("stamp", F.col("created_at")), base_url)
    status, body = _error(400, F.col("invalid"), "bad_request")
    shown = shown.withColumn("http_status", F.when(F.col("invalid").isNotNull(), status).otherwise(F.lit(202)))
    shown = shown.withColumn("body", F.when(F.col("invalid").isNotNull(), body).otherwise(payload(base_url, shown.columns, F.lit(SUBMITTED))))
    return tasks.numbered(shown, F.col("invalid").isNull(), ["stamp", "task_id"], "submit_order").drop("stamp", "invalid")


def status(asked: DataFrame, known: DataFrame, base_url: str) -> DataFrame:
    """asked (task_id) with http_status and body: the status of a known task, or 404."""
    shown = tasks.status_payload(known.withColumn("known", F.lit(True)), base_url)
    rows = asked.select("task_id").join(shown, "task_id", "left")
    missing, body = _error(404, F.lit(NOT_FOUND), "not_found")
    lost = F.col("known").isNull()
    return rows.select("task_id", F.when(lost, missing).otherwise(F.lit(200)).alias("http_status"), F.when(lost, body).otherwise(payload(base_url, shown.columns)).alias("body"))


def result(asked: DataFrame, known: DataFrame, results: DataFrame, base_url: str) -> DataFrame:
    """asked (task_id) with http_status and body: 404, 202 while a task runs, 409 if it failed, else the body of results (task_id, body)."""
    shown = tasks.status_payload(known.withColumn("known", F.lit(True)), base_url)
    rows = asked.select("task_id").join(shown, "task_id", "left").join(results.select("task_id", F.col("body").alias("own")), "task_id", "left")
    missing, lost = _error(404, F.lit(NOT_FOUND), "not_found")
    gone, away = _error(503, F.lit("Task was removed before result loading"), "service_unavailable")
    state = F.col("status")
    code = F.when(F.col("known").isNull(), missing).when(~state.isin(*tasks.TERMINAL), F.lit(202)).when(state == "failed", F.lit(409)).when(F.col("own").isNull(), gone).otherwise(F.lit(200))
    message = F.when(state == "failed", F.lit(FAILED)).otherwise(F.lit(NOT_READY))
    body = F.when(code == 404, lost).when(code.isin(202, 409), payload(base_url, shown.columns, message)).when(code == 503, away).otherwise(F.col("own"))
    return rows.select("task_id", code.alias("http_status"), body.alias("body"))


def merged(status_body: Column, result_body: Column) -> Column:
    """Two JSON objects as one, as the answer of a synchronous request: the fields of the status, then those of the result."""
    return F.concat(F.left(status_body, F.length(status_body) - 1), F.lit(","), F.substr(result_body, F.lit(2)))


def health(known: DataFrame, settings: Settings, version: str, in_flight: DataFrame | None = None) -> DataFrame:
    """One row with the service's fields: tasks by status, limits, and what is left of them.

    in_flight: rows of requests to the model (state: queued or active). Figures of a memory allocator are null: executors report theirs to Spark.
    """
    # fixed values: the names of the fields
    stats = tasks.status_counts(known)
    flying = in_flight.agg(F.count_if(F.col("state") == "queued").alias("queue"), F.count_if(F.col("state") == "active").alias("active")) if in_flight is not None else known.sparkSession.createDataFrame([(0, 0)], "queue long, active long")
    left = lambda limit, used: F.greatest(F.lit(limit).cast("long") - used, F.lit(0).cast("long"))
    # both sides have one row
    return stats.crossJoin(flying).select(
        F.lit("healthy").alias("status"), F.lit(version).alias("version"), F.lit(PROTOCOL_VERSION).alias("protocol_version"),
        F.col("pending").alias("queued_tasks"), F.col("processing").alias("processing_tasks"), F.col("completed").alias("completed_tasks"), F.col("failed").alias("failed_tasks"),
        F.lit(settings.max_concurrent_tasks).alias("max_concurrent_requests"), F.lit(settings.in_flight_tasks).alias("max_in_flight_tasks"),
        left(settings.in_flight_tasks, F.col("pending") + F.col("processing")).alias("available_admission_permits"),
        F.lit(settings.upload_limit_mib << 20).alias("max_upload_size_bytes"), F.lit(settings.page_window).alias("processing_window_size"),
        F.lit(settings.model_requests).alias("vlm_max_concurrency"), left(settings.model_requests, F.col("active")).alias("available_vlm_permits"),
        F.col("queue").alias("vlm_queue_depth"), F.col("active").alias("active_vlm_requests"), F.lit(settings.queue_size).alias("vlm_queue_capacity"), F.lit(settings.task_limit).alias("max_vlm_requests_per_task"),
        *[F.lit(None).cast("long").alias(f"allocator_{k}_bytes") for k in ("allocated", "resident", "retained")],
        F.lit(settings.retention_seconds).alias("task_retention_seconds"), F.lit(settings.sweep_seconds).alias("task_cleanup_interval_seconds"),
    )
