"""Task log (O70-O74): append-only task events and their latest state.

The original keeps a mutable dict per task. Here every change is an event
row carrying the fields it sets (``set_fields``); the state of a task is,
per field, the value of the latest event (by ``(ts, seq)``) that set it.
That is one ``groupBy(task_id)`` of ``max_by ... FILTER`` aggregates:
partial aggregation combines map-side, so even a task holding a third of
all events ships one row per map task into the shuffle. An explicit NULL
wins like any other value (``max_by`` returns the value of the max row).

An update for a task that does not exist yet is ignored by the original.
A create sets every field, so it out-ranks all earlier updates; groups with
no create at all are dropped -- no join needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import q

STATE_FIELDS = ["type", "status", "message", "progress", "data", "error", "completed_at"]
ALL_FIELDS = STATE_FIELDS + ["created_at"]

# Task messages and progress texts of the two workflows.
CREATED = "Task created and queued"
PROGRESS = {"url_to_article": ("Processing URL to article workflow", "Step 1/3: Crawling URL"),
            "url_to_wechat": ("Processing URL to WeChat workflow", "Step 1/4: Crawling URL")}
ARTICLE_DONE = "Article created successfully"
ARTICLE_FAILED = "Failed to create article"
PUBLISH_DONE = "Article created and published successfully"
PUBLISH_PARTIAL = "Article created, but publishing failed"
PUBLISH_FAILED = "Failed to process workflow"
UNKNOWN_ERROR = "Unknown error"
PROCESSING_ERROR = "Task processing error"


def _arr(values) -> str:
    return "array(" + ", ".join(q(v) for v in values) + ")"


def create_events(requests: DataFrame, url: str = "url", seq: str = "seq", ts: str | None = None,
                  task_type: str = "url_to_article") -> DataFrame:
    """One create event per request. The id is ``sha2(url || '#' ||
    seq)`` instead of a random uuid, so a retried job creates the same ids."""
    t = f"`{ts}`" if ts else "CAST(NULL AS TIMESTAMP_NTZ)"
    return requests.selectExpr(
        f"sha2(concat(coalesce(`{url}`, ''), '#', CAST(`{seq}` AS STRING)), 256) AS task_id",
        f"CAST(`{seq}` AS BIGINT) AS seq", f"{t} AS ts", f"{q(task_type)} AS type", "'pending' AS status",
        f"{q(CREATED)} AS message", "CAST(NULL AS STRING) AS progress", "CAST(NULL AS STRING) AS error",
        "CAST(NULL AS STRING) AS data", "CAST(NULL AS TIMESTAMP_NTZ) AS completed_at",
        f"{_arr(ALL_FIELDS)} AS set_fields")


def events_from_log(events: DataFrame, task_type: str = "url_to_article") -> DataFrame:
    """The driver's ``events`` table read as a task log: task = user,
    signup creates, view/click processing, purchase completed, error
    failed."""
    proc_msg, _ = PROGRESS[task_type]
    status = ("CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' "
              "WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END")
    return events.selectExpr(
        "CAST(user_id AS STRING) AS task_id", "event_id AS seq", "CAST(ts AS TIMESTAMP_NTZ) AS ts",
        f"CASE WHEN event_type = 'signup' THEN {q(task_type)} END AS type",
        f"{status} AS status",
        f"CASE event_type WHEN 'signup' THEN {q(CREATED)} WHEN 'purchase' THEN {q(ARTICLE_DONE)} "
        f"WHEN 'error' THEN {q(ARTICLE_FAILED)} ELSE {q(proc_msg)} END AS message",
        "CAST(NULL AS STRING) AS progress",
        f"CASE WHEN event_type = 'error' THEN {q(UNKNOWN_ERROR)} END AS error",
        "CAST(NULL AS STRING) AS data",
        "CASE WHEN event_type IN ('purchase', 'error') THEN CAST(ts AS TIMESTAMP_NTZ) END AS completed_at",
        f"CASE WHEN event_type = 'signup' THEN {_arr(ALL_FIELDS)} "
        f"WHEN event_type = 'purchase' THEN array('status', 'message', 'completed_at') "
        f"WHEN event_type = 'error' THEN array('status', 'message', 'completed_at', 'error') "
        f"ELSE array('status', 'message') END AS set_fields")


def _latest(field: str) -> F.Column:
    return F.expr(f"max_by({field}, named_struct('ts', ts, 'seq', seq)) "
                  f"FILTER (WHERE array_contains(set_fields, {q(field)}))").alias(field)


def latest_state(events: DataFrame) -> DataFrame:
    """One row per created task with the 10 state keys."""
    aggs = [_latest(f) for f in STATE_FIELDS]
    aggs += [F.expr("max_by(ts, named_struct('ts', ts, 'seq', seq)) "
                    "FILTER (WHERE array_contains(set_fields, 'created_at'))").alias("created_at"),
             F.expr("max(ts)").alias("updated_at"),
             F.expr("max(array_contains(set_fields, 'created_at'))").alias("_created")]
    g = events.groupBy("task_id").agg(*aggs)
    return g.where("_created").select("task_id", *STATE_FIELDS, "created_at", "updated_at")


def status_view(state: DataFrame, task_id: str | None = None) -> DataFrame:
    """The status projection; a point look-up when ``task_id`` is
    given (an empty result means "Task not found")."""
    s = state if task_id is None else state.where(F.col("task_id") == task_id)
    return s.select("task_id", "status", "message", "progress", "created_at", "updated_at")


def result_view(state: DataFrame, task_id: str | None = None) -> DataFrame:
    """Result projection, returned whatever the status."""
    s = state if task_id is None else state.where(F.col("task_id") == task_id)
    return s.select("task_id", "status", "data", "error", "created_at", "completed_at")


def outcome_events(results: DataFrame, task_id: str = "task_id", seq: str = "seq",
                   ts: str | None = None, workflow: str = "url_to_article") -> DataFrame:
    """A finished workflow row -> its task update: completed with the
    whole result as ``data``, or failed with the error (``Unknown error``
    when none). ``results`` has ``success``, ``error``, ``workflow_json``
    (and ``publish_success`` for the publishing workflow); a row whose
    workflow itself broke off has its message in ``processing_error``, when
    the table has such a column."""
    t = f"`{ts}`" if ts else "CAST(NULL AS TIMESTAMP_NTZ)"
    if workflow == "url_to_wechat":
        done = f"CASE WHEN publish_success THEN {q(PUBLISH_DONE)} ELSE {q(PUBLISH_PARTIAL)} END"
        failed = q(PUBLISH_FAILED)
    else:
        done, failed = q(ARTICLE_DONE), q(ARTICLE_FAILED)
    broke = "processing_error" if "processing_error" in results.columns else "CAST(NULL AS STRING)"
    ok = f"({broke} IS NULL AND coalesce(success, false))"
    return results.selectExpr(
        f"`{task_id}` AS task_id", f"CAST(`{seq}` AS BIGINT) AS seq", f"{t} AS ts", "CAST(NULL AS STRING) AS type",
        f"CASE WHEN {ok} THEN 'completed' ELSE 'failed' END AS status",
        f"CASE WHEN {broke} IS NOT NULL THEN {q(PROCESSING_ERROR)} WHEN {ok} THEN {done} ELSE {failed} END AS message",
        "CAST(NULL AS STRING) AS progress",
        f"CASE WHEN {ok} THEN NULL ELSE coalesce({broke}, error, {q(UNKNOWN_ERROR)}) END AS error",
        f"CASE WHEN {ok} THEN workflow_json END AS data",
        f"{t} AS completed_at",
        f"CASE WHEN {ok} THEN array('status', 'message', 'data', 'completed_at') "
        "ELSE array('status', 'message', 'error', 'completed_at') END AS set_fields")


def processing_events(tasks: DataFrame, seq: str = "seq", ts: str | None = None,
                      workflow: str = "url_to_article") -> DataFrame:
    """The PROCESSING update each task gets when its workflow starts
    (progress is set once, to step 1, and never advances)."""
    msg, progress = PROGRESS[workflow]
    t = f"`{ts}`" if ts else "CAST(NULL AS TIMESTAMP_NTZ)"
    return tasks.selectExpr(
        "task_id", f"CAST(`{seq}` AS BIGINT) AS seq", f"{t} AS ts", "CAST(NULL AS STRING) AS type",
        "'processing' AS status", f"{q(msg)} AS message", f"{q(progress)} AS progress",
        "CAST(NULL AS STRING) AS error", "CAST(NULL AS STRING) AS data",
        "CAST(NULL AS TIMESTAMP_NTZ) AS completed_at", "array('status', 'message', 'progress') AS set_fields")
