"""Check queries for the analysis and writing steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_span_sql, sentences_sql, word_count_sql
from ..operators.analyze import analysis_prompt_sql, analyze, fallback_analysis_sql
from ..operators.responses import PAIR, attach_reply_pair, replies_from_conversations
from ..operators.write import audience_sql, style_sql, write
from ..sources.tables import read_table
from . import derived as D
from . import oracle_steps as P
from .oracle import dq
from .suite import register

DOC_IN = "SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content FROM documents"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as analysis input: key, title (first line), content."""
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id AS key", "split_part(text, chr(10), 1) AS title", "text AS content")


def json_analysis_replies(spark, sf) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(
        "doc_id AS key", f"{D.ANALYSIS_REPLY} AS response_text", f"{D.REPLY_STATUS} AS status")


def json_article_replies(spark, sf) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(
        "doc_id AS key", f"{D.ARTICLE_REPLY} AS response_text", "'ok' AS status")


def last_replies(spark, sf) -> DataFrame:
    """The last assistant turn of each conversation (the writing reply)."""
    conv = read_table(spark, sf, "conversations").where("role = 'assistant'")
    return (conv.groupBy("conv_id").agg(F.expr("max_by(text, turn)").alias("response_text"))
            .selectExpr("conv_id AS key", "response_text", "'ok' AS status"))


# DuckDB sources for the same replies
_O_FIRST = ("SELECT conv_id AS rkey, arg_min(text, turn) AS rtext, 'ok' AS rstatus FROM conversations "
            "WHERE role = 'assistant' GROUP BY conv_id")
_O_LAST = ("SELECT conv_id AS rkey, arg_max(text, turn) AS rtext, 'ok' AS rstatus FROM conversations "
           "WHERE role = 'assistant' GROUP BY conv_id")
_O_JSON_A = f"SELECT doc_id AS rkey, {D.ANALYSIS_REPLY} AS rtext, {D.REPLY_STATUS} AS rstatus FROM documents"
_O_JSON_W = f"SELECT doc_id AS rkey, {D.ARTICLE_REPLY} AS rtext, 'ok' AS rstatus FROM documents"


def _o_analysis(replies: str | None) -> str:
    if replies is None:
        src = f"SELECT d.*, NULL::VARCHAR AS rtext, NULL::VARCHAR AS rstatus FROM ({DOC_IN}) d"
    else:
        src = f"SELECT d.*, r.rtext, r.rstatus FROM ({DOC_IN}) d LEFT JOIN ({replies}) r ON d.doc_id = r.rkey"
    return P.d_analysis_select("title", "content", "rtext", "rstatus", src, "doc_id, title, content")


def _o_write(analysis_replies: str | None, write_replies: str | None, detail: str = "brief") -> str:
    a = _o_analysis(analysis_replies)
    opts = f"{D.STYLE.replace('doc_id', 'a.doc_id')} AS wstyle, {D.AUDIENCE.replace('doc_id', 'a.doc_id')} AS waud, " \
           f"{D.WORDS.replace('doc_id', 'a.doc_id')} AS wwords"
    if write_replies is None:
        src = f"SELECT a.*, {opts}, NULL::VARCHAR AS wtext, NULL::VARCHAR AS wstatus FROM ({a}) a"
    else:
        src = (f"SELECT a.*, {opts}, w.rtext AS wtext, w.rstatus AS wstatus FROM ({a}) a "
               f"LEFT JOIN ({write_replies}) w ON a.doc_id = w.rkey")
    return P.d_write_select(src, "doc_id", "wstyle", "waud", "wwords", "wtext", "wstatus", detail)


def _spark_write(spark, sf, analysis_replies, write_replies, detail="brief") -> DataFrame:
    a = analyze(attach_reply_pair(docs(spark, sf), analysis_replies, write_replies, "key"), PAIR[0], with_prompt=False)
    a = a.selectExpr("*", f"{D.STYLE.replace('doc_id', 'key')} AS wstyle",
                     f"{D.AUDIENCE.replace('doc_id', 'key')} AS waud", f"{D.WORDS.replace('doc_id', 'key')} AS wwords")
    w = write(a, None if write_replies is None else PAIR[1], style="wstyle", audience="waud", word_count="wwords", detail=detail)
    return w.drop(*[c for pair in PAIR for c in pair])


# ------------------------------------------------------------------ O30-O36
@register("o30_analysis_prompt", f"SELECT doc_id, {P.d_analysis_prompt('title', 'content')} AS prompt FROM ({DOC_IN})")
def o30_analysis_prompt(spark, sf):
    return docs(spark, sf).selectExpr("key AS doc_id", f"{analysis_prompt_sql('title', 'content')} AS prompt")


@register("o31_context_truncation",
          "SELECT doc_id, substr(text, 1, 4000) AS context, CAST(length(substr(text, 1, 4000)) AS BIGINT) AS context_chars, "
          "CAST(length(text) AS BIGINT) AS text_chars FROM documents")
def o31_context_truncation(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id", "substring(text, 1, 4000) AS context",
        "CAST(length(substring(text, 1, 4000)) AS BIGINT) AS context_chars", "CAST(length(text) AS BIGINT) AS text_chars")


@register("o32_json_span", f"SELECT doc_id, {P.d_span(D.ANALYSIS_REPLY)} AS span FROM documents")
def o32_json_span(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr("doc_id", f"{json_span_sql(D.ANALYSIS_REPLY)} AS span")


@register("o33_analysis_parse",
          f"SELECT doc_id, analysis_branch, json_extract_string(analysis_json, '$.summary') AS summary, "
          f"to_json(CAST(json_extract(analysis_json, '$.key_points') AS VARCHAR[])) AS key_points, "
          f"json_extract_string(analysis_json, '$.sentiment') AS sentiment "
          f"FROM ({_o_analysis(_O_JSON_A)})")
def o33_analysis_parse(spark, sf):
    return analyze(docs(spark, sf), json_analysis_replies(spark, sf), with_prompt=False).selectExpr(
        "key AS doc_id", "analysis_branch", "analysis.summary AS summary",
        "to_json(analysis.key_points) AS key_points", "analysis.sentiment AS sentiment")


@register("o34_sentences",
          f"SELECT conv_id, turn, to_json({P.d_sentences('text')}) AS sentences, "
          f"CAST(len({P.d_sentences('text')}) AS BIGINT) AS n FROM conversations WHERE role = 'assistant'")
def o34_sentences(spark, sf):
    return read_table(spark, sf, "conversations", spread_rows=True).where("role = 'assistant'").selectExpr(
        "conv_id", "turn", f"to_json({sentences_sql('text')}) AS sentences",
        f"CAST(size({sentences_sql('text')}) AS BIGINT) AS n")


@register("o35_fallback_analysis",
          f"SELECT conv_id, turn, {P.d_fallback_analysis_json('text', dq('Conversation ') + ' || CAST(conv_id AS VARCHAR)')} "
          f"AS analysis FROM conversations WHERE role = 'assistant'")
def o35_fallback_analysis(spark, sf):
    return read_table(spark, sf, "conversations", spread_rows=True).where("role = 'assistant'").selectExpr(
        "conv_id", "turn",
        f"to_json({fallback_analysis_sql('text', 'concat(' + chr(39) + 'Conversation ' + chr(39) + ', CAST(conv_id AS STRING))')}) AS analysis")


@register("o36_analyze", f"SELECT doc_id, analysis_branch, analysis_error, analysis_json FROM ({_o_analysis(_O_FIRST)})")
def o36_analyze(spark, sf):
    return analyze(docs(spark, sf), replies_from_conversations(spark, sf), with_prompt=False).selectExpr(
        "key AS doc_id", "analysis_branch", "analysis_error", "analysis_json")


@register("o36_analyze_json_replies",
          f"SELECT doc_id, analysis_branch, analysis_error, analysis_json FROM ({_o_analysis(_O_JSON_A)})")
def o36_analyze_json_replies(spark, sf):
    return analyze(docs(spark, sf), json_analysis_replies(spark, sf), with_prompt=False).selectExpr(
        "key AS doc_id", "analysis_branch", "analysis_error", "analysis_json")


# ------------------------------------------------------------------ O40-O47
@register("o40_style_lookup",
          f"SELECT doc_id, {D.STYLE} AS style, " + ", ".join(
              f"{P._style(D.STYLE, i)} AS {n}" for i, n in enumerate(["tone", "structure", "language", "features"]))
          + " FROM documents")
def o40_style_lookup(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id", f"{D.STYLE} AS style",
        *[f"{style_sql(D.STYLE, i)} AS {n}" for i, n in enumerate(["tone", "structure", "language", "features"])])


@register("o41_audience_lookup",
          f"SELECT doc_id, {D.AUDIENCE} AS audience, {P._audience(D.AUDIENCE)} AS description FROM documents")
def o41_audience_lookup(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id", f"{D.AUDIENCE} AS audience", f"{audience_sql(D.AUDIENCE)} AS description")


@register("o42_writing_prompt", f"SELECT doc_id, article_prompt FROM ({_o_write(_O_JSON_A, None)})")
def o42_writing_prompt(spark, sf):
    return _spark_write(spark, sf, json_analysis_replies(spark, sf), None).selectExpr(
        "key AS doc_id", "article_prompt")


@register("o42_writing_prompt_full", f"SELECT doc_id, article_prompt FROM ({_o_write(_O_FIRST, None, 'full')})")
def o42_writing_prompt_full(spark, sf):
    return _spark_write(spark, sf, replies_from_conversations(spark, sf), None, "full").selectExpr(
        "key AS doc_id", "article_prompt")


@register("o43_article_parse",
          f"SELECT doc_id, article_branch, article_error, article_json FROM ({_o_write(None, _O_JSON_W)})")
def o43_article_parse(spark, sf):
    return _spark_write(spark, sf, None, json_article_replies(spark, sf)).selectExpr(
        "key AS doc_id", "article_branch", "article_error", "article_json")


@register("o44_fallback_article",
          f"SELECT doc_id, article_branch, article_error, article_json FROM ({_o_write(_O_FIRST, _O_LAST)})")
def o44_fallback_article(spark, sf):
    return _spark_write(spark, sf, replies_from_conversations(spark, sf), last_replies(spark, sf)).selectExpr(
        "key AS doc_id", "article_branch", "article_error", "article_json")


@register("o45_field_defaults",
          f"SELECT doc_id, article_branch, article_error, article_json FROM ({_o_write(_O_JSON_A, _O_JSON_W)})")
def o45_field_defaults(spark, sf):
    return _spark_write(spark, sf, json_analysis_replies(spark, sf), json_article_replies(spark, sf)).selectExpr(
        "key AS doc_id", "article_branch", "article_error", "article_json")


@register("o46_word_count", f"SELECT doc_id, {P.d_word_count('text')} AS word_count FROM documents")
def o46_word_count(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr(
        "doc_id", f"CAST({word_count_sql('text')} AS BIGINT) AS word_count")


@register("o47_write", f"SELECT doc_id, article_branch, article_error, article_json FROM ({_o_write(_O_FIRST, None)})")
def o47_write(spark, sf):
    return _spark_write(spark, sf, replies_from_conversations(spark, sf), None).selectExpr(
        "key AS doc_id", "article_branch", "article_error", "article_json")
