"""Check queries for the task log and the streams."""

from __future__ import annotations

from ..operators import tasks as T
from ..sources.tables import read_table, table_path
from ..streaming.streams import run_crawl_stream, run_task_state_stream
from . import derived as D
from .oracle import dq
from .suite import _O22, register


def _o_events(event_type: str = "event_type") -> str:
    status = (f"CASE {event_type} WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' "
              f"WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END")
    proc, _ = T.PROGRESS["url_to_article"]
    allf = "[" + ", ".join(dq(f) for f in T.ALL_FIELDS) + "]"
    return (f"SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, ts, "
            f"CASE WHEN {event_type} = 'signup' THEN 'url_to_article' END AS type, {status} AS status, "
            f"CASE {event_type} WHEN 'signup' THEN {dq(T.CREATED)} WHEN 'purchase' THEN {dq(T.ARTICLE_DONE)} "
            f"WHEN 'error' THEN {dq(T.ARTICLE_FAILED)} ELSE {dq(proc)} END AS message, "
            f"NULL::VARCHAR AS progress, CASE WHEN {event_type} = 'error' THEN {dq(T.UNKNOWN_ERROR)} END AS error, "
            f"NULL::VARCHAR AS data, CASE WHEN {event_type} IN ('purchase', 'error') THEN ts END AS completed_at, "
            f"CASE WHEN {event_type} = 'signup' THEN {allf} WHEN {event_type} = 'purchase' "
            f"THEN ['status', 'message', 'completed_at'] WHEN {event_type} = 'error' "
            f"THEN ['status', 'message', 'completed_at', 'error'] ELSE ['status', 'message'] END AS set_fields "
            f"FROM events")


def _o_state(event_type: str = "event_type") -> str:
    fields = ", ".join(
        f"first({f} ORDER BY ts DESC, seq DESC) FILTER (WHERE list_contains(set_fields, {dq(f)})) AS {f}"
        for f in T.STATE_FIELDS)
    return (f"SELECT task_id, {fields}, first(ts ORDER BY ts DESC, seq DESC) FILTER "
            f"(WHERE list_contains(set_fields, 'created_at')) AS created_at, max(ts) AS updated_at "
            f"FROM ({_o_events(event_type)}) GROUP BY task_id "
            f"HAVING bool_or(list_contains(set_fields, 'created_at'))")


def _task_log(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.selectExpr("event_id", "ts", "user_id", f"{D.TASK_LOG_EVENT_TYPE} AS event_type", "value", "props")


_STATE_COLS = ["task_id"] + T.STATE_FIELDS + ["created_at", "updated_at"]


@register("o70_create_task",
          "SELECT sha256(url || '#' || CAST(page_id AS VARCHAR)) AS task_id, page_id AS seq, 'url_to_article' AS type, "
          f"'pending' AS status, {dq(T.CREATED)} AS message, "
          f"to_json([{', '.join(dq(f) for f in T.ALL_FIELDS)}]) AS set_fields FROM pages")
def o70_create_task(spark, sf):
    pages = read_table(spark, sf, "pages").selectExpr("url", "page_id AS seq")
    return T.create_events(pages).selectExpr("task_id", "seq", "type", "status", "message",
                                             "to_json(set_fields) AS set_fields")


@register("o71_task_state", _o_state(D.TASK_LOG_EVENT_TYPE))
def o71_task_state(spark, sf):
    """Task log where some ids are never created: their updates vanish."""
    return T.latest_state(T.events_from_log(_task_log(spark, sf))).select(*_STATE_COLS)


@register("o71_task_state_events", _o_state())
def o71_task_state_events(spark, sf):
    return T.latest_state(T.events_from_log(read_table(spark, sf, "events"))).select(*_STATE_COLS)


@register("o72_status_view", f"SELECT task_id, status, message, progress, created_at, updated_at "
                             f"FROM ({_o_state(D.TASK_LOG_EVENT_TYPE)})")
def o72_status_view(spark, sf):
    return T.status_view(T.latest_state(T.events_from_log(_task_log(spark, sf))))


@register("o73_result_view", f"SELECT task_id, status, data, error, created_at, completed_at "
                             f"FROM ({_o_state(D.TASK_LOG_EVENT_TYPE)})")
def o73_result_view(spark, sf):
    return T.result_view(T.latest_state(T.events_from_log(_task_log(spark, sf))))


@register("o80_crawl_stream", _O22)
def o80_crawl_stream(spark, sf):
    """The crawl as a stream over the pages files; equal to the batch O22."""
    return run_crawl_stream(spark, table_path(sf, "pages")).selectExpr(
        "page_id", "url", "crawl_error", "title", "content", "to_json(images) AS images",
        "to_json(links) AS links", "to_json(metadata) AS metadata",
        "CAST(content_length AS BIGINT) AS content_length")


@register("o81_task_state_stream", _o_state())
def o81_task_state_stream(spark, sf):
    """Task state maintained by a streaming aggregate; equal to batch O71."""
    return run_task_state_stream(spark, table_path(sf, "events")).select(*_STATE_COLS)
