"""Check queries for the workflows, requests, task outcomes and the result
sink (O02, O04, O60-O64, O74)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import tasks as T
from ..operators.responses import replies_from_conversations
from ..plans.workflow import result_preview, step_envelope, url_to_article, url_to_publication
from ..session import scratch_path
from ..sources import sinks
from ..sources.requests import validate_requests
from ..sources.tables import read_table
from . import derived as D
from . import oracle as O
from . import oracle_steps as P
from .oracle import dq
from .suite import _oracle_clean, pages_with, register
from .suite_steps import _O_FIRST

STYLE_P = D.STYLE.replace("doc_id", "page_id")
AUDIENCE_P = D.AUDIENCE.replace("doc_id", "page_id")
WORDS_P = D.WORDS.replace("doc_id", "page_id")


def _spark_requests(spark, sf) -> DataFrame:
    return pages_with(spark, sf, D.CONTAINER_HTML).selectExpr(
        "page_id AS key", "url", "html", f"{STYLE_P} AS style",
        f"{AUDIENCE_P} AS audience", f"{WORDS_P} AS words")


def _spark_article(spark, sf) -> DataFrame:
    return url_to_article(_spark_requests(spark, sf), analysis_replies=replies_from_conversations(spark, sf),
                          style="style", audience="audience", word_count="words")


def _o_workflow(words: str = WORDS_P) -> str:
    crawl = (_oracle_clean(D.CONTAINER_HTML)
             + f"SELECT page_id, url, {O.d_title('pre')} AS title, {O.d_container('clean')} AS content FROM d")
    src = (f"SELECT c.*, r.rtext, r.rstatus FROM ({crawl}) c LEFT JOIN ({_O_FIRST}) r ON c.page_id = r.rkey")
    a = P.d_analysis_select("title", "content", "rtext", "rstatus", src, "page_id, url, title, content")
    wsrc = (f"SELECT a.*, {STYLE_P} AS wstyle, {AUDIENCE_P} AS waud, {words} AS wwords, "
            f"NULL::VARCHAR AS wtext, NULL::VARCHAR AS wstatus FROM ({a}) a")
    w = P.d_write_select(wsrc, "page_id, url, title, content, analysis_branch, analysis_json, analysis_error",
                         "wstyle", "waud", "wwords", "wtext", "wstatus")
    empty = "coalesce(len(json_keys(analysis_json)), 0) = 0"
    return (f"SELECT *, failed_at IS NULL AS success, CASE WHEN failed_at IS NULL THEN article_json0 END AS article_json, "
            f"CASE WHEN analysis_branch <> 'no_content' AND {empty} THEN 'Failed to analyze content' "
            f"WHEN analysis_error IS NOT NULL OR analysis_branch = 'no_content' THEN analysis_error "
            f"WHEN article_error IS NOT NULL THEN article_error END AS error FROM ("
            f"SELECT *, article_json AS article_json0, CASE WHEN analysis_branch = 'no_content' OR {empty} "
            f"OR json_type(analysis_json, '$.error') IS NOT NULL THEN 'analyze' "
            f"WHEN article_error IS NOT NULL THEN 'write' END AS failed_at FROM ({w}))")


_O60 = _o_workflow()


@register("o60_url_to_article",
          f"SELECT page_id, success, error, title, CAST(length(content) AS BIGINT) AS content_length, "
          f"json_extract_string(analysis_json, '$.summary') AS analysis_summary, "
          f"json_extract_string(article_json, '$.title') AS article_title, "
          f"CAST(json_extract(article_json, '$.word_count') AS BIGINT) AS article_word_count, "
          f"json_extract_string(article_json, '$.style') AS article_style FROM ({_O60})")
def o60_url_to_article(spark, sf):
    return _spark_article(spark, sf).selectExpr(
        "key AS page_id", "success", "error", "crawl_result.title AS title",
        "CAST(content_length AS BIGINT) AS content_length",
        "get_json_object(analysis_json, '$.summary') AS analysis_summary",
        "article.title AS article_title", "article.word_count AS article_word_count",
        "article.style AS article_style")


_O61 = P.d_publish_select(
    f"SELECT *, 'Desk ' || CAST(page_id % 3 AS VARCHAR) AS author, (page_id % 2 = 0) AS draft0, "
    f"'wechat' AS platform0 FROM ({_o_workflow('1000')})",
    "page_id, success AS wf_success", "author", "draft0", "platform0")


@register("o61_url_to_publication",
          f"SELECT page_id, wf_success AS success, CASE WHEN wf_success THEN coalesce(success, false) END "
          f"AS publish_success, CASE WHEN wf_success THEN article_id END AS article_id, CASE WHEN wf_success THEN draft_id END AS draft_id, "
          f"CASE WHEN wf_success THEN message END AS message FROM ({_O61})")
def o61_url_to_publication(spark, sf):
    req = _spark_requests(spark, sf).selectExpr("*", "concat('Desk ', CAST(key % 3 AS STRING)) AS author",
                                                "key % 2 = 0 AS draft")
    r = url_to_publication(req, analysis_replies=replies_from_conversations(spark, sf), style="style",
                           audience="audience", author="author", draft_only="draft")
    return r.selectExpr("key AS page_id", "success", "publish_success", "publish_result.article_id AS article_id",
                        "publish_result.draft_id AS draft_id", "publish_result.message AS message")


@register("o63_step_envelope",
          f"WITH w AS ({_O60}) "
          f"SELECT page_id, 'crawl' AS step, 'CrawlerAgent' AS name, 'assistant' AS role, 'success' AS status, "
          f"to_json(MAP {{'url': url, 'content_length': CAST(length(content) AS VARCHAR)}}) AS metadata FROM w "
          f"UNION ALL SELECT page_id, 'analyze', 'AnalyzerAgent', 'assistant', "
          f"CASE WHEN failed_at = 'analyze' THEN 'failed' ELSE 'success' END, "
          f"CASE WHEN failed_at = 'analyze' THEN '{{}}' ELSE to_json(MAP {{'title': title}}) END FROM w "
          f"UNION ALL SELECT page_id, 'write', 'WriterAgent', 'assistant', "
          f"CASE WHEN failed_at IS NULL THEN 'success' ELSE 'failed' END, "
          f"CASE WHEN failed_at IS NULL THEN to_json(MAP {{'style': json_extract_string(article_json, '$.style'), "
          f"'word_count': CAST(json_extract(article_json, '$.word_count') AS VARCHAR)}}) ELSE '{{}}' END "
          f"FROM w WHERE failed_at IS NULL OR failed_at = 'write'")
def o63_step_envelope(spark, sf):
    return step_envelope(_spark_article(spark, sf)).selectExpr(
        "key AS page_id", "step", "name", "role", "status", "to_json(metadata) AS metadata")


@register("o64_result_preview",
          f"SELECT page_id, json_extract_string(article_json, '$.title') AS title, "
          f"CAST(length(json_extract_string(article_json, '$.content')) AS BIGINT) AS content_chars, "
          f"CAST(0 AS BIGINT) AS n_images, CAST(0 AS BIGINT) AS n_links, "
          f"substr(json_extract_string(analysis_json, '$.summary'), 1, 200) AS summary, "
          f"CAST(json_array_length(analysis_json, '$.key_points') AS BIGINT) AS n_key_points, "
          f"array_to_string(CAST(json_extract(analysis_json, '$.themes') AS VARCHAR[]), ', ') AS themes, "
          f"substr(json_extract_string(article_json, '$.content'), 1, 500) AS content_preview FROM ({_O60})")
def o64_result_preview(spark, sf):
    return result_preview(_spark_article(spark, sf)).withColumnRenamed("key", "page_id")


@register("o74_outcome_event",
          f"SELECT sha256(url || '#' || CAST(page_id AS VARCHAR)) AS task_id, "
          f"CASE WHEN success THEN 'completed' ELSE 'failed' END AS status, "
          f"CASE WHEN success THEN {dq(T.ARTICLE_DONE)} ELSE {dq(T.ARTICLE_FAILED)} END AS message, "
          f"CASE WHEN success THEN NULL ELSE coalesce(error, {dq(T.UNKNOWN_ERROR)}) END AS error, "
          f"success AS has_data FROM ({_O60})")
def o74_outcome_event(spark, sf):
    r = _spark_article(spark, sf).selectExpr("*", "sha2(concat(url, '#', CAST(key AS STRING)), 256) AS task_id")
    return T.outcome_events(r, seq="key").selectExpr("task_id", "status", "message", "error",
                                                      "data IS NOT NULL AS has_data")


_REQ = (f"SELECT page_id, {D.REQ_URL} AS url, {D.REQ_STYLE} AS article_style, {D.REQ_AUDIENCE} AS target_audience, "
        f"{D.REQ_WORDS} AS word_count, {D.REQ_IMAGES} AS extract_images, {D.REQ_LINKS} AS extract_links FROM pages")


@register("o02_request_validation",
          "SELECT page_id, url, coalesce(article_style, 'professional') AS article_style, "
          "coalesce(target_audience, 'general') AS target_audience, CAST(coalesce(word_count, 1000) AS BIGINT) AS word_count, "
          "coalesce(extract_images, true) AS extract_images, coalesce(extract_links, true) AS extract_links, "
          "to_json(list_filter([CASE WHEN url IS NULL THEN 'url: Field required' "
          "WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'url: URL scheme should be ''http'' or ''https''' "
          "WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'url: Input should be a valid URL, empty host' END, "
          "CASE WHEN coalesce(article_style, 'professional') NOT IN ('professional', 'casual', 'news') "
          "THEN 'article_style: Input should be ''professional'', ''casual'' or ''news''' END, "
          "CASE WHEN coalesce(target_audience, 'general') NOT IN ('general', 'technical', 'business') "
          "THEN 'target_audience: Input should be ''general'', ''technical'' or ''business''' END, "
          "CASE WHEN coalesce(word_count, 1000) < 300 THEN 'word_count: Input should be greater than or equal to 300' "
          "WHEN coalesce(word_count, 1000) > 5000 THEN 'word_count: Input should be less than or equal to 5000' END], "
          f"lambda e: e IS NOT NULL)) AS errors FROM ({_REQ})")
def o02_request_validation(spark, sf):
    req = read_table(spark, sf, "pages", spread_rows=True).selectExpr(
        "page_id", f"{D.REQ_URL} AS url", f"{D.REQ_STYLE} AS article_style", f"{D.REQ_AUDIENCE} AS target_audience",
        f"{D.REQ_WORDS} AS word_count", f"{D.REQ_IMAGES} AS extract_images", f"{D.REQ_LINKS} AS extract_links")
    return validate_requests(req).selectExpr(
        "page_id", "url", "article_style", "target_audience", "word_count", "extract_images", "extract_links",
        "to_json(errors) AS errors")


@register("o04_result_sink",
          f"SELECT page_id, success, error, json_extract_string(article_json, '$.title') AS article_title FROM ({_O60})")
def o04_result_sink(spark, sf):
    """Store the nested workflow results whole (parquet) and read back."""
    path = scratch_path(spark, "results")
    sinks.write_results(_spark_article(spark, sf), path)
    return spark.read.parquet(path).selectExpr("key AS page_id", "success", "error", "article.title AS article_title")


@register("o71_workflow_task_state",
          f"SELECT sha256(url || '#' || CAST(page_id * 3 AS VARCHAR)) AS task_id, 'url_to_article' AS type, "
          f"CASE WHEN success THEN 'completed' ELSE 'failed' END AS status, "
          f"CASE WHEN success THEN {dq(T.ARTICLE_DONE)} ELSE {dq(T.ARTICLE_FAILED)} END AS message, "
          f"{dq(T.PROGRESS['url_to_article'][1])} AS progress, "
          f"CASE WHEN success THEN NULL ELSE coalesce(error, {dq(T.UNKNOWN_ERROR)}) END AS error, "
          f"success AS has_data FROM ({_O60})")
def o71_workflow_task_state(spark, sf):
    """Requests -> create, processing and outcome events -> task state."""
    from ..plans.workflow import task_events_for
    req = _spark_requests(spark, sf)
    results = url_to_article(req, analysis_replies=replies_from_conversations(spark, sf),
                             style="style", audience="audience", word_count="words")
    state = T.latest_state(task_events_for(req, results))
    return state.selectExpr("task_id", "type", "status", "message", "progress", "error", "data IS NOT NULL AS has_data")
