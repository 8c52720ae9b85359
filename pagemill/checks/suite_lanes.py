"""Check queries for the rare lanes, with expected values stated literally.

Inputs are strings chosen by the row's id (``page_id % n``); the oracle SQL
says outright what each of them must give, so nothing is shared with the
Spark side but the input text and the fixed constants.
"""

from __future__ import annotations

import json

from ..operators import analyze as A
from ..operators import publish as PB
from ..operators import tasks as T
from ..operators.analyze import analyze
from ..operators.crawl import crawl
from ..operators.publish import publish
from ..operators.write import write
from ..plans.workflow import step_envelope, url_to_publication
from ..sources.requests import validate_requests
from ..sources.tables import read_table
from .oracle import dq
from .suite import pages_with, register


def by_id(column: str, cases: list[str]) -> str:
    """A CASE over ``column % len(cases)`` of SQL expressions, in both dialects."""
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()


def html_case(bodies: list[str]) -> str:
    """Pages of these bodies; single quotes are not used in them."""
    return by_id("page_id", [f"'{b}'" for b in bodies])


# --- O11/O12: nesting, tag names, unclosed elements, references
SHAPES = [
    ("<html><body><nav>a<nav>b<nav>c<nav>d<nav>e<nav>f</nav></nav></nav></nav></nav></nav><p>ok</p></body></html>", "ok", []),
    ("<html><body><nav><nav-item>menu</nav-item></nav><p>ok</p></body></html>", "ok", []),
    ("<html><body><article-card>teaser</article-card><article>real</article></body></html>", "real", []),
    ("<html><body><p>kept</p><header>Top<p>gone</p></body></html>", "kept", ["unclosed_boilerplate"]),
    ("<html><body><aside>x<footer>y</aside>after</body></html>", "after", ["unclosed_boilerplate"]),
    ("<html><body><p>&#0000000065;&#x000000042;</p></body></html>", "AB", []),
    ("<p>no body</p>", "no body", ["no_body_element"]),
]


@register("o11_hard_shapes", "SELECT page_id, " + by_id("page_id", [lit(c) for _, c, _ in SHAPES]) + " AS content, "
          + by_id("page_id", [lit(json.dumps(f, separators=(",", ":"))) for *_, f in SHAPES]) + " AS flags FROM pages")
def o11_hard_shapes(spark, sf):
    return crawl(pages_with(spark, sf, html_case([h for h, *_ in SHAPES]))).selectExpr(
        "page_id", "content", "to_json(shape_flags) AS flags")


# --- O11-O14, O16: tags that cross the edge of a removed element or of the container
CROSSED = [
    ("<div><nav>menu</div>after</nav>", "after", [], []),
    ("<p><nav>menu<a href=/in>i</a></p>after<a href=/out>o</a></nav>x", "after\n\no\n\nx", [], ["https://{host}/out"]),
    ("<nav><div>a</nav>b<img src=/b.png></div>c</nav>d<img src=/d.png>", "d", ["https://{host}/d.png"], []),
    ("<article><div>a</article>b</div>c</article>d", "a\n\nb\n\nc", [], []),
    ("<section><div class=content>a</section>b</div>c</section>", "a\n\nb", [], []),
    ("<article><table><tr><td>a</article>b</table>c</article>d", "a\n\nb\n\nc", [], []),
    ("<article>a</section></p>b</article>c", "a\n\nb", [], []),
    ("<table><tr><td><header>h</td></tr></table>z", "z", [], []),
    ("<main><aside><ul><li>x</aside></ul>y</aside>z</main>w", "y\n\nz", [], []),
    ("<article><p>a<div>b</p></article>c</div>d</article>e", "a\n\nb\n\nc\n\nd", [], []),
]


def _of_host(urls: list[str]) -> str:
    return lit(json.dumps([u.format(host="h.example.com") for u in urls], separators=(",", ":")))


@register("o11_crossed_elements", "SELECT page_id, " + by_id("page_id", [lit(c) for _, c, *_ in CROSSED]) + " AS content, "
          + by_id("page_id", [_of_host(i) for *_, i, _ in CROSSED]) + " AS images, "
          + by_id("page_id", [_of_host(x) for *_, x in CROSSED]) + " AS links, true AS crossed FROM pages")
def o11_crossed_elements(spark, sf):
    pages = pages_with(spark, sf, html_case([f"<html><body>{h}</body></html>" for h, *_ in CROSSED]))
    return crawl(pages.selectExpr("page_id", "'https://h.example.com/p' AS url", "html")).selectExpr(
        "page_id", "content", "to_json(images) AS images", "to_json(links) AS links", "array_contains(shape_flags, 'crossed_elements') AS crossed")


# --- O14/O16/O20: attributes are read as (name, value) pairs
TAGS = [
    ('<img alt="see src=fake.png here" src="https://e.com/real.png">', ["https://e.com/real.png"], [], {}),
    ('<img alt="x"src="https://e.com/y.png">', ["https://e.com/y.png"], [], {}),
    ('<a title="go href=/bad now" href="https://e.com/good">g</a><a-btn href="https://e.com/no">n</a-btn>', [], ["https://e.com/good"], {}),
    ('<meta name="description" content="holds name=author here"><meta content=B name=author>', [], [],
     {"description": "holds name=author here", "author": "B"}),
    ('<img SRC=https://e.com/a/b.png data-src="https://e.com/z.png" src="https://e.com/second.png">', ["https://e.com/a/b.png"], [], {}),
]


@register("o14_attribute_shapes", "SELECT page_id, " + ", ".join(
    by_id("page_id", [lit(json.dumps(t[k], separators=(",", ":"))) for t in TAGS]) + f" AS {n}"
    for k, n in ((1, "images"), (2, "links"), (3, "metadata"))) + " FROM pages")
def o14_attribute_shapes(spark, sf):
    html = html_case([f"<html><body>{t}</body></html>" for t, *_ in TAGS])
    return crawl(pages_with(spark, sf, html)).selectExpr(
        "page_id", "to_json(images) AS images", "to_json(links) AS links", "to_json(metadata) AS metadata")


# --- O43/O45/O53: the reply's own values survive, no reply ends the job
_SUM, _TH = "@SUMMARY@", json.dumps(A.FALLBACK_THEMES, separators=(",", ":"))
REPLIES = [
    ('{"title":"T","content":"C d","tags":"ai, data"}',
     f'{{"title":"T","content":"C d","summary":{_SUM},"tags":"ai, data","word_count":2,"style":"professional"}}', None, PB.PUBLISHED),
    ('{"title":"T","content":"C d","tags":["a",1,null],"subtitle":"S","seo":{"k":[1,2]}}',
     f'{{"title":"T","content":"C d","summary":{_SUM},"tags":["a",1,null],"word_count":2,"seo":{{"k":[1,2]}},"subtitle":"S","style":"professional"}}',
     None, PB.PUBLISHED),
    ('{"title":"T","content":"C","summary":null}',
     f'{{"title":"T","content":"C","summary":null,"tags":{_TH},"word_count":1,"style":"professional"}}', None,
     "Publishing error: 'NoneType' object is not subscriptable"),
    ('{"title":"T","content":"C","word_count":"about 900","tags":null,"style":"odd"}',
     f'{{"title":"T","content":"C","summary":{_SUM},"tags":null,"word_count":"about 900","style":"professional"}}', None, PB.PUBLISHED),
    ('{"title":null,"content":"C d e"}',
     f'{{"title":null,"content":"C d e","summary":{_SUM},"tags":{_TH},"word_count":3,"style":"professional"}}', None, PB.MISSING_FIELDS),
    ('{"title":"T","content":5}', None, "'int' object has no attribute 'split'", PB.NO_ARTICLE),
]


@register("o45_reply_shapes", "SELECT doc_id, replace(" + by_id("doc_id", [lit(j) for _, j, *_ in REPLIES])
          + f", '{_SUM}', CAST(to_json(substr('Analysis of: ' || doc_id, 1, 200)) AS VARCHAR)) AS article_json, "
          + by_id("doc_id", [lit(e) for *_, e, _ in REPLIES]) + " AS article_error, "
          + by_id("doc_id", [lit(m) for *_, m in REPLIES]) + " AS message FROM documents")
def o45_reply_shapes(spark, sf):
    d = read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id AS key", "CAST(doc_id AS STRING) AS title", "'some content' AS content",
        by_id("doc_id", [lit(r) for r, *_ in REPLIES]) + " AS reply", "'ok' AS reply_status")
    w = write(analyze(d, None, with_prompt=False), ("reply", "reply_status"), with_prompt=False)
    return publish(w).selectExpr("key AS doc_id", "article_json", "article_error", "publish_result.message AS message")


# --- O36: a good reply before an error, then the latest
@register("o36_retries", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Analysis of: t' WHEN 1 THEN 'Second try ' || doc_id "
          "ELSE 'Third try ' || doc_id END AS summary FROM documents")
def o36_retries(spark, sf):
    d = read_table(spark, sf, "documents", spread_rows=True)
    replies = d.selectExpr("doc_id AS key", "inline(array(named_struct('response_text', concat('Broken ', doc_id, '. x'), 'status', 'error', 'seq', 9), "
                           "named_struct('response_text', IF(doc_id % 3 = 0, NULL, concat('Second try ', doc_id, '. y')), 'status', 'ok', 'seq', 2), "
                           "named_struct('response_text', concat('Third try ', doc_id, '. z'), 'status', IF(doc_id % 3 = 2, 'ok', 'error'), 'seq', 3)))")
    a = analyze(d.selectExpr("doc_id AS key", "'t' AS title", "'c' AS content"), replies, with_prompt=False)
    return a.selectExpr("key AS doc_id", "analysis.summary AS summary")


# --- O61/O63/O74: failed fetch, model error, failed writing, failed and good publishing
LANES = [  # success, failed_at, error, publish_success, publish message
    (False, "crawl", "Failed to crawl URL: ", None, None),
    (False, "analyze", "model refused", None, None),
    (False, "write", "'NoneType' object is not subscriptable", None, None),
    (True, None, None, False, "Publishing error: 'NoneType' object is not subscriptable"),
    (True, None, None, True, PB.DRAFT_SAVED),
]


def _publication(spark, sf):
    pages = pages_with(spark, sf, by_id("page_id", ["NULL"] + ["'<html><body><article>Body text</article></body></html>'"] * 4))
    key = pages.selectExpr("page_id AS key", "page_id % 5 AS lane")
    analysis = key.where("lane IN (1, 2)").selectExpr(
        "key", "IF(lane = 1, '{\"error\": \"model refused\"}', '{\"summary\": null}') AS response_text", "'ok' AS status")
    article = key.where("lane = 3").selectExpr(
        "key", "'{\"title\": \"T\", \"content\": \"C\", \"summary\": null}' AS response_text", "'ok' AS status")
    return url_to_publication(pages.selectExpr("page_id AS key", "url", "html"), analysis_replies=analysis,
                              article_replies=article, draft_only=True)


def _lane(k: int) -> str:
    return by_id("page_id", [lit(x[k]) for x in LANES])


_O_ERROR = f"CASE WHEN page_id % 5 = 0 THEN 'Failed to crawl URL: ' || url ELSE {_lane(2)} END"


@register("o61_publication_lanes", f"SELECT page_id, {_lane(0)} AS success, {_lane(1)} AS failed_at, {_O_ERROR} AS error, "
          f"{_lane(3)} AS publish_success, {_lane(4)} AS message, {_lane(0)} AS stored_publish, {_lane(3)} AS stored_success FROM pages")
def o61_publication_lanes(spark, sf):
    return _publication(spark, sf).selectExpr(
        "key AS page_id", "success", "failed_at", "error", "publish_success", "publish_result.message AS message",
        "array_contains(json_object_keys(workflow_json), 'publish_result') AS stored_publish",
        "CAST(get_json_object(workflow_json, '$.publish_success') AS BOOLEAN) AS stored_success")


@register("o63_publication_envelope", "SELECT page_id, step, CASE WHEN page_id % 5 = n THEN 'failed' ELSE 'success' END AS status, "
          "CASE WHEN step = 'publish' THEN 'wechat' END AS platform FROM pages, "
          "(VALUES ('crawl', 0), ('analyze', 1), ('write', 2), ('publish', 3)) s(step, n) WHERE page_id % 5 >= n")
def o63_publication_envelope(spark, sf):
    return step_envelope(_publication(spark, sf)).selectExpr("key AS page_id", "step", "status", "metadata['platform'] AS platform")


@register("o74_publication_outcome", f"SELECT CAST(page_id AS VARCHAR) AS task_id, CASE WHEN page_id % 5 > 2 AND page_id % 7 > 0 THEN 'completed' ELSE 'failed' END AS status, "
          f"CASE WHEN page_id % 7 = 0 THEN 'Task processing error' WHEN page_id % 5 < 3 THEN {dq(T.PUBLISH_FAILED)} "
          f"WHEN page_id % 5 = 3 THEN {dq(T.PUBLISH_PARTIAL)} ELSE {dq(T.PUBLISH_DONE)} END AS message, "
          f"CASE WHEN page_id % 7 = 0 THEN 'broke off' ELSE {_O_ERROR} END AS error, "
          f"CASE WHEN page_id % 7 > 0 THEN {_lane(3)} END AS stored_success FROM pages")
def o74_publication_outcome(spark, sf):
    r = _publication(spark, sf).selectExpr("*", "CAST(key AS STRING) AS task_id", "IF(key % 7 = 0, 'broke off', NULL) AS processing_error")
    return T.outcome_events(r, seq="key", workflow="url_to_wechat").selectExpr(
        "task_id", "status", "message", "error", "CAST(get_json_object(data, '$.publish_success') AS BOOLEAN) AS stored_success")


# --- O02: every request model, accepted and rejected
MODEL_CASES = [  # model, input columns (SQL), errors by page_id % 3
    ("crawl", "IF(page_id % 3 = 0, NULL, IF(page_id % 3 = 1, 'ftp://x.y/z', 'https://x.y/z')) AS url",
     [["url: Field required"], ["url: URL scheme should be 'http' or 'https'"], []]),
    ("analyze", "IF(page_id % 3 = 0, NULL, 't') AS title, IF(page_id % 3 < 2, NULL, 'c') AS content",
     [["title: Field required", "content: Field required"], ["content: Field required"], []]),
    ("write", "IF(page_id % 3 = 0, '[1]', '{\"a\":1}') AS analysis_result, IF(page_id % 3 = 1, 'many', '300') AS word_count",
     [["analysis_result: Input should be a valid dictionary"],
      ["word_count: Input should be a valid integer, unable to parse string as an integer"], []]),
    ("publish", "IF(page_id % 3 = 0, NULL, IF(page_id % 3 = 1, 'text', '{\"title\":\"T\"}')) AS article",
     [["article: Field required"], ["article: Input should be a valid dictionary"], []]),
    ("url_to_wechat", "'https://x.y' AS url, IF(page_id % 3 = 0, 'poetic', 'news') AS article_style, 250 AS word_count, "
     "IF(page_id % 3 = 1, 'children', NULL) AS target_audience",
     [["article_style: Input should be 'professional', 'casual' or 'news'"],
      ["target_audience: Input should be 'general', 'technical' or 'business'"], []]),
]


@register("o02_request_models", " UNION ALL ".join(
    f"SELECT page_id, '{m}' AS model, {by_id('page_id', [lit(json.dumps(e, separators=(',', ':'))) for e in errors])} AS errors, "
    f"page_id % 3 = 2 AS valid FROM pages" for m, _, errors in MODEL_CASES))
def o02_request_models(spark, sf):
    pages, out = read_table(spark, sf, "pages", spread_rows=True), None
    for model, columns, _ in MODEL_CASES:
        v = validate_requests(pages.selectExpr("page_id", f"inline(array(struct({columns})))"), model)
        v = v.selectExpr("page_id", f"'{model}' AS model", "to_json(errors) AS errors", "valid")
        out = v if out is None else out.unionByName(v)
    return out


# --- O02: hosts and ports of urls. Messages of the validation library.
URL_CASES = [("http://exa mple.com/", "invalid domain character"), ("http://[::1", "invalid IPv6 address"), ("http://[::1]:80/x", None),
             ("http://a.com:99999/", "invalid port number"), ("https:example.com", None), (" http://a.com ", None), ("http://1.2.3.256/", "invalid IPv4 address"),
             ("http://u:p@a.com:80/", None), ("http:///?q", "empty host"), ("a.com/x", "relative URL without a base")]


@register("o02_url_rules", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN NULL ELSE " + by_id("page_id // 2", [
    "NULL" if e is None else lit(f"url: Input should be a valid URL, {e}") for _, e in URL_CASES]) + " END AS error FROM pages")
def o02_url_rules(spark, sf):
    """Every second page's own url, the others' replaced by an odd one."""
    odd = "CASE " + " ".join(f"WHEN page_id div 2 % {len(URL_CASES)} = {i} THEN {lit(u)}" for i, (u, _) in enumerate(URL_CASES)) + " END"
    pages = read_table(spark, sf, "pages").selectExpr("page_id", f"IF(page_id % 2 = 0, url, {odd}) AS url")
    return validate_requests(pages, "crawl").selectExpr("page_id", "get(errors, 0) AS error")
