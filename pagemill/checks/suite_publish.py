"""Check queries for publishing and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import q
from ..operators.publish import publish, to_html_sql
from ..operators.responses import replies_from_conversations
from ..session import scratch_path
from ..sources import sinks
from ..sources.tables import read_table
from . import derived as D
from . import oracle_steps as P
from .suite import register
from .suite_steps import _O_FIRST, _O_JSON_A, _O_JSON_W, _o_write, _spark_write, json_analysis_replies, \
    json_article_replies

_PUB_COLS = ("publish_error", "draft_only", "payload.title AS payload_title", "payload.content AS payload_content",
             "payload.digest AS payload_digest", "payload.show_cover_pic AS show_cover_pic",
             "publish_result.success AS success", "publish_result.platform AS platform",
             "publish_result.article_id AS article_id", "publish_result.draft_id AS draft_id",
             "publish_result.message AS message")


def _spark_published(spark, sf, analysis_replies, write_replies) -> DataFrame:
    w = _spark_write(spark, sf, analysis_replies, write_replies)
    w = w.selectExpr("*", f"{D.AUTHOR.replace('doc_id', 'key')} AS author",
                     f"{D.DRAFT.replace('doc_id', 'key')} AS draft", f"{D.PLATFORM.replace('doc_id', 'key')} AS platform")
    return publish(w, author="author", draft_only="draft", platform="platform")


def _o_published(analysis_replies, write_replies) -> str:
    src = _o_write(analysis_replies, write_replies)
    opts = (f"{D.AUTHOR} AS author, {D.DRAFT} AS draft0, {D.PLATFORM} AS platform0")
    return P.d_publish_select(f"SELECT *, {opts} FROM ({src})", "doc_id", "author", "draft0", "platform0")


_O_PUB_JSON = _o_published(_O_JSON_A, _O_JSON_W)
_O_PUB_CONV = _o_published(_O_FIRST, None)


@register("o50_article_validation", f"SELECT doc_id, publish_error FROM ({_O_PUB_JSON})")
def o50_article_validation(spark, sf):
    return _spark_published(spark, sf, json_analysis_replies(spark, sf), json_article_replies(spark, sf)) \
        .selectExpr("key AS doc_id", "publish_error")


@register("o51_platform_routing", f"SELECT doc_id, success, platform, message FROM ({_O_PUB_CONV})")
def o51_platform_routing(spark, sf):
    return _spark_published(spark, sf, replies_from_conversations(spark, sf), None).selectExpr(
        "key AS doc_id", "publish_result.success AS success", "publish_result.platform AS platform",
        "publish_result.message AS message")


@register("o52_article_html", f"SELECT doc_id, {P.d_to_html('text')} AS html FROM documents")
def o52_article_html(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr("doc_id", f"{to_html_sql('text')} AS html")


@register("o52_article_html_markdown", f"SELECT doc_id, {P.d_to_html(D.MD_TEXT)} AS html FROM documents")
def o52_article_html_markdown(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr("doc_id", f"{to_html_sql(D.MD_TEXT)} AS html")


@register("o53_digest", f"SELECT doc_id, payload_digest FROM ({_O_PUB_JSON})")
def o53_digest(spark, sf):
    return _spark_published(spark, sf, json_analysis_replies(spark, sf), json_article_replies(spark, sf)) \
        .selectExpr("key AS doc_id", "payload.digest AS payload_digest")


@register("o54_payload", f"SELECT doc_id, payload_title, payload_content, payload_digest, show_cover_pic "
                         f"FROM ({_O_PUB_CONV})")
def o54_payload(spark, sf):
    return _spark_published(spark, sf, replies_from_conversations(spark, sf), None).selectExpr(
        "key AS doc_id", "payload.title AS payload_title", "payload.content AS payload_content",
        "payload.digest AS payload_digest", "payload.show_cover_pic AS show_cover_pic")


@register("o55_publish", f"SELECT doc_id, publish_error, draft_only, success, platform, article_id, draft_id, message "
                         f"FROM ({_O_PUB_JSON})")
def o55_publish(spark, sf):
    return _spark_published(spark, sf, json_analysis_replies(spark, sf), json_article_replies(spark, sf)) \
        .selectExpr("key AS doc_id", "publish_error", "draft_only", "publish_result.success AS success",
                    "publish_result.platform AS platform", "publish_result.article_id AS article_id",
                    "publish_result.draft_id AS draft_id", "publish_result.message AS message")


_O_OUTBOX = (f"SELECT coalesce(article_id, draft_id) AS item_id, 'news' AS kind, success, draft_only, "
             f"payload_title AS title, payload_digest AS digest, doc_id AS seq FROM ({_O_PUB_CONV})")


@register("o03_outbox_sink", _O_OUTBOX)
def o03_outbox_sink(spark, sf):
    """Write the outbox (partitioned by draft_only) and read it back."""
    path = scratch_path(spark, "outbox")
    sinks.write_outbox(_spark_published(spark, sf, replies_from_conversations(spark, sf), None), path,
                       order_col="key")
    return sinks.read_outbox(spark, path).selectExpr("item_id", "kind", "success", "draft_only", "title",
                                                     "digest", "seq")


@register("o05_outbox_listing",
          f"SELECT item_id, title, seq FROM ({_O_OUTBOX}) WHERE success AND kind = 'news' ORDER BY seq DESC, item_id "
          f"LIMIT 20 OFFSET 20")
def o05_outbox_listing(spark, sf):
    """Second page (offset 20, count 20) of the news items, newest first."""
    path = scratch_path(spark, "outbox")
    sinks.write_outbox(_spark_published(spark, sf, replies_from_conversations(spark, sf), None), path,
                       order_col="key")
    return sinks.list_items(sinks.read_outbox(spark, path), "news", offset=20, count=20) \
        .selectExpr("item_id", "title", "seq")


@register("o03_outbox_batches", _O_OUTBOX)
def o03_outbox_batches(spark, sf):
    """Articles published in three batches by their id, the second one
    repeated, another one broken off before its commit: each is listed once."""
    path, p = scratch_path(spark, "outbox"), _spark_published(spark, sf, replies_from_conversations(spark, sf), None)
    for n, rest in enumerate((0, 1, 1, 2)):
        sinks.write_outbox(p.where(f"key % 3 = {rest}"), path, order_col="key", batch=f"00{n}")
    sinks.outbox_rows(p.where("key % 3 = 0"), "key").selectExpr("*", "'x' AS row_id").write.partitionBy("draft_only").parquet(
        f"{path}/items/batch=b-broken")
    return sinks.read_outbox(spark, path).selectExpr("item_id", "kind", "success", "draft_only", "title", "digest", "seq")


# articles as the model may return them: (fields, error, message, digest). Messages of the Python errors.
TYPE_CASES = [
    ('"title":"T","content":"C","summary":5', None, "Publishing error: 'int' object is not subscriptable", None),
    ('"title":"T","content":"C","summary":null', None, "Publishing error: 'NoneType' object is not subscriptable", None),
    ('"title":"T","content":"C","summary":["a","b"]', None, "Article published successfully", '["a","b"]'),
    ('"title":"T","content":"C","summary":[]', None, "Article published successfully", "T"),
    ('"title":"T","content":["a"]', None, "Publishing error: 'list' object has no attribute 'split'", None),
    ('"title":"T","content":{"a":1},"summary":""', None, "Publishing error: 'dict' object has no attribute 'split'", None),
    ('"title":0,"content":"C"', "Article missing required fields", "Article missing required fields", None),
    ('"title":"T","content":false', "Article missing required fields", "Article missing required fields", None),
    ('"title":7,"content":"C","summary":"s"', None, "Publishing error: 'int' object is not subscriptable", None),
    ('"title":["x"],"content":"C"', None, "Article published successfully", '["x"]'),
    ('"title":[],"content":"C"', "Article missing required fields", "Article missing required fields", None),
    ('"title":"T","content":1.5,"summary":true', None, "Publishing error: 'bool' object is not subscriptable", None),
]


def _case(k: int, literal=lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'") -> str:
    return f"CASE doc_id % {len(TYPE_CASES)} " + " ".join(f"WHEN {i} THEN {literal(c[k])}" for i, c in enumerate(TYPE_CASES)) + " END"


@register("o55_value_types", f"SELECT doc_id, {_case(1)} AS publish_error, {_case(2)} AS message, {_case(3)} AS digest, "
                             f"{_case(2)} = 'Article published successfully' AS success FROM documents")
def o55_value_types(spark, sf):
    """Titles, contents and summaries of every JSON type."""
    articles = read_table(spark, sf, "documents").selectExpr("doc_id", f"concat('{{', {_case(0, q)}, '}}') AS article_json")
    return publish(articles).selectExpr("doc_id", "publish_error", "publish_result.message AS message", "payload.digest AS digest",
                                        "publish_result.success AS success")
