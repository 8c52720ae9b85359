"""Composed workflows.

``url_to_article`` chains crawl -> analyze -> write over a table of
requests. A row stops at the first step that fails, keeping the results of
the steps that completed; the row is never dropped (a failure is a value,
not an exception). Every step is a projection or a key join, so the whole
workflow is one Spark job: the html column is consumed by the crawl
projection, and only extracted columns reach the reply joins' shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import q
from ..operators.analyze import analyze
from ..operators.crawl import crawl
from ..operators.publish import publish
from ..operators.responses import PAIR, attach_reply_pair
from ..operators.write import write
from ..session import stage as stage_table

# The failure message when the analysis comes back empty, and
# the agents' names in ``step_envelope``.
ANALYZE_FAILED = "Failed to analyze content"

_CRAWL = ("named_struct('url', url, 'title', title, 'content', content, 'images', images, "
          "'links', links, 'metadata', metadata)")


def url_to_article(requests: DataFrame, key: str = "key", url: str = "url", html: str = "html",
                   analysis_replies: DataFrame | None = None, article_replies: DataFrame | None = None,
                   style: str | None = None, audience: str | None = None, word_count=None,
                   extract_images=True, extract_links=True, stage: bool = False) -> DataFrame:
    """O60. ``requests`` carries ``key``, ``url`` and the fetched ``html``
    (plus optional per-row option columns named by the arguments).
    ``stage=True`` writes the crawl output (no html) to a table in the
    shared checkpoint folder and continues from it.

    Adds ``success``, ``error``, ``crawl_result`` (struct),
    ``analysis_json``, ``article_json``, ``article`` and ``workflow_json``
    (the whole nested result as JSON, as stored in a task's ``data``)."""
    c = crawl(requests, url=url, html=html, extract_images=extract_images, extract_links=extract_links)
    if stage:
        c = stage_table(c, "crawl-stage")
    c = attach_reply_pair(c, analysis_replies, article_replies, key)
    a = analyze(c, PAIR[0], key=key, title="title", content="content", with_prompt=False)
    w = write(a, PAIR[1], key=key, style=style, audience=audience, word_count=word_count,
              with_prompt=False)
    analysis_empty = "coalesce(size(json_object_keys(analysis_json)), 0) = 0"
    err = (f"CASE WHEN crawl_error IS NOT NULL THEN crawl_error "
           f"WHEN analysis_branch <> 'no_content' AND {analysis_empty} THEN {q(ANALYZE_FAILED)} "
           f"WHEN analysis_error IS NOT NULL OR analysis_branch = 'no_content' THEN analysis_error "
           f"WHEN article_error IS NOT NULL THEN article_error END")
    failed_at = (f"CASE WHEN crawl_error IS NOT NULL THEN 'crawl' "
                 f"WHEN analysis_branch = 'no_content' OR {analysis_empty} "
                 f"OR coalesce(array_contains(json_object_keys(analysis_json), 'error'), false) THEN 'analyze' "
                 f"WHEN article_error IS NOT NULL THEN 'write' END")
    s = w.selectExpr("*", f"{failed_at} AS failed_at", f"{err} AS error")
    analysis_out = ("CASE WHEN failed_at = 'crawl' THEN NULL WHEN analysis_branch = 'no_content' "
                    "THEN to_json(named_struct('error', analysis_error)) ELSE analysis_json END")
    article_out = ("CASE WHEN failed_at IN ('crawl', 'analyze') THEN NULL WHEN article_error IS NOT NULL "
                   "AND article_json IS NULL THEN to_json(named_struct('error', article_error)) ELSE article_json END")
    crawl_out = f"CASE WHEN crawl_error IS NULL THEN {_CRAWL} END"
    s = s.selectExpr("*", "failed_at IS NULL AS success", f"{crawl_out} AS crawl_result",
                     f"{analysis_out} AS analysis_result", f"{article_out} AS article_result")
    keep = [cn for cn in requests.columns if cn != html]
    return s.selectExpr(
        *[f"`{cn}`" for cn in keep], "success", "error", "failed_at", "crawl_result", "content_length",
        "analysis_result AS analysis_json", "article_result AS article_json",
        "CASE WHEN failed_at IS NULL THEN article END AS article",
        "to_json(named_struct('success', failed_at IS NULL, 'error', error, "
        "'crawl_result', CASE WHEN crawl_error IS NULL THEN crawl_result "
        "ELSE named_struct('url', CAST(NULL AS STRING), 'title', CAST(NULL AS STRING), "
        "'content', CAST(NULL AS STRING), 'images', CAST(NULL AS ARRAY<STRING>), 'links', CAST(NULL AS ARRAY<STRING>), "
        "'metadata', CAST(NULL AS MAP<STRING, STRING>)) END, "
        "'analysis_result', try_parse_json(analysis_result), 'article_result', try_parse_json(article_result))) "
        "AS workflow_json")


def url_to_publication(requests: DataFrame, key: str = "key", url: str = "url", html: str = "html",
                       analysis_replies: DataFrame | None = None, article_replies: DataFrame | None = None,
                       style: str | None = None, audience: str | None = None,
                       author: str | None = None, draft_only: str | bool = False,
                       configured: bool = True) -> DataFrame:
    """O60 with 1,000 words, images on and links off, then publish the
    articles of workflows that succeeded. A publish failure keeps ``success``
    and sets ``publish_success`` false; both publish fields are part of
    ``workflow_json``. A failed workflow has no publish part."""
    r = url_to_article(requests, key, url, html, analysis_replies, article_replies, style, audience,
                       word_count=1000, extract_images=True, extract_links=False)
    p = publish(r, article_json="article_json", author=author, draft_only=draft_only, configured=configured)
    carried = [f"`{c}`" for c in r.columns if c != "workflow_json"]
    # a workflow that failed is returned as it is: nothing was published
    p = p.selectExpr(*carried, "workflow_json", "draft_only",
                     "CASE WHEN success THEN publish_error END AS publish_error",
                     "CASE WHEN success THEN payload END AS payload",
                     "CASE WHEN success THEN publish_result END AS publish_result",
                     "CASE WHEN success THEN coalesce(publish_result.success, false) END AS publish_success")
    data = ("CASE WHEN success THEN to_json(map_concat(variant_get(parse_json(workflow_json), '$', 'map<string,variant>'), "
            "map('publish_success', CAST(publish_success AS VARIANT), 'publish_result', "
            "parse_json(to_json(publish_result))))) ELSE workflow_json END AS workflow_json")
    return p.selectExpr(*carried, data, "draft_only", "publish_error", "payload", "publish_result", "publish_success")


def step_envelope(results: DataFrame, key: str = "key") -> DataFrame:
    """One audit row per step that ran: agent name, status and its
    metadata map (url + content_length / title / style + word_count /
    platform)."""
    steps = (
        "array("
        "named_struct('step', 'crawl', 'name', 'CrawlerAgent', 'ran', true, "
        "'ok', failed_at IS NULL OR failed_at <> 'crawl', "
        "'metadata', map('url', crawl_result.url, 'content_length', CAST(content_length AS STRING))), "
        "named_struct('step', 'analyze', 'name', 'AnalyzerAgent', 'ran', failed_at IS NULL OR failed_at <> 'crawl', "
        "'ok', failed_at IS NULL OR failed_at NOT IN ('crawl', 'analyze'), "
        "'metadata', map('title', crawl_result.title)), "
        "named_struct('step', 'write', 'name', 'WriterAgent', 'ran', failed_at IS NULL OR failed_at = 'write', "
        "'ok', failed_at IS NULL, "
        "'metadata', map('style', article.style, 'word_count', CAST(article.word_count AS STRING)))"
        + (", named_struct('step', 'publish', 'name', 'PublisherAgent', 'ran', failed_at IS NULL, "
           "'ok', coalesce(publish_result.success, false), "
           # the platform is told whether or not publishing worked, but for a rejected article
           "'metadata', CASE WHEN publish_error IS NULL THEN map('platform', coalesce(publish_result.platform, 'wechat')) "
           "ELSE map() END)"
           if "publish_result" in results.columns else "")
        + ")")
    # steps that did not run are dropped inside the array (a row filter on
    # these derived columns would be pushed through every projection)
    return (results.selectExpr(f"`{key}`", f"inline(filter({steps}, s -> s.ran))")
            .selectExpr(f"`{key}`", "step", "name", "'assistant' AS role",
                        "CASE WHEN ok THEN 'success' ELSE 'failed' END AS status",
                        "CASE WHEN ok OR step = 'publish' THEN metadata ELSE map() END AS metadata"))


def result_preview(results: DataFrame, key: str = "key") -> DataFrame:
    """The demo's display projection of a finished workflow."""
    return results.selectExpr(
        f"`{key}`", "article.title AS title", "CAST(length(article.content) AS BIGINT) AS content_chars",
        "CAST(size(crawl_result.images) AS BIGINT) AS n_images", "CAST(size(crawl_result.links) AS BIGINT) AS n_links",
        "substring(get_json_object(analysis_json, '$.summary'), 1, 200) AS summary",
        "CAST(json_array_length(get_json_object(analysis_json, '$.key_points')) AS BIGINT) AS n_key_points",
        "array_join(from_json(get_json_object(analysis_json, '$.themes'), 'array<string>'), ', ') AS themes",
        "substring(article.content, 1, 500) AS content_preview")


def task_events_for(requests: DataFrame, results: DataFrame, key: str = "key", url: str = "url",
                    workflow: str = "url_to_article") -> DataFrame:
    """The task log of a batch of requests run through a workflow: for each
    request a create event, the PROCESSING update and the outcome update,
    ordered by ``seq`` (3*key, +1, +2). ``latest_state`` of the union gives
    what the status and result endpoints would report."""
    from ..operators.tasks import create_events, outcome_events, processing_events
    req = requests.selectExpr(f"`{url}` AS url", f"CAST(`{key}` AS BIGINT) * 3 AS seq")
    created = create_events(req, task_type=workflow)
    started = processing_events(created.selectExpr("task_id", "seq + 1 AS seq"), workflow=workflow)
    ids = f"sha2(concat(coalesce(`{url}`, ''), '#', CAST(CAST(`{key}` AS BIGINT) * 3 AS STRING)), 256)"
    done = outcome_events(results.selectExpr("*", f"{ids} AS _task_id", f"CAST(`{key}` AS BIGINT) * 3 + 2 AS _seq"),
                          task_id="_task_id", seq="_seq", workflow=workflow)
    return created.unionByName(started).unionByName(done)
