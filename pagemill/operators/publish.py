"""Publishing step (O50-O55): validate, route, render HTML, assemble the
payload, and produce the publish result.

Re-aimed: instead of calling a platform API per article, payload rows go to
an outbox table (``sources.sinks.write_outbox``). The id the platform would
return is replaced by ``sha2`` of the payload, so re-running a job yields
the same ids (idempotent retries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import expr, pystrip_sql, q, var
from .write import UNHASHABLE, pytype_sql

# The HTML wrapper around rendered paragraphs.
HTML_OPEN = ("\n<div style=\"font-family: -apple-system, BlinkMacSystemFont, 'Segoe UI', Roboto, "
             "'Helvetica Neue', Arial, sans-serif; font-size: 16px; line-height: 1.6; color: #333;\">\n")
HTML_CLOSE = "\n</div>\n"

# Platforms, messages (also the "not supported" and
# "Publishing error" texts below) and digest length.
SUPPORTED_PLATFORMS = ["wechat"]
DIGEST_CHARS = 120
NO_ARTICLE = "No article provided"
MISSING_FIELDS = "Article missing required fields"
NOT_CONFIGURED = "WeChat not configured. Please set WECHAT_APP_ID and WECHAT_APP_SECRET in .env file"
DRAFT_SAVED = "Article saved as draft successfully"
PUBLISHED = "Article published successfully"


def _escape_sql(e: str) -> str:
    """HTML-escape text (``&`` first)."""
    out = f"replace({e}, '&', '&amp;')"
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {q(ch)}, {q(ent)})"
    return out


def to_html_sql(content: str, escape: bool = False) -> str:
    """Blocks split on a blank line, stripped, blanks dropped; '# ',
    '## ', '### ' become h1-h3 (prefix cut, rest kept as is); other blocks
    are paragraphs with line breaks as <br>. Like the original, no HTML
    escaping by default; ``escape=True`` escapes each block's text."""
    a, b, p = var(), var(), var("p")
    blocks = f"filter(transform(split({content}, '\\n\\n', -1), {a} -> {pystrip_sql(a)}), {b} -> {b} <> '')"
    if escape:
        e = var()
        blocks = f"transform({blocks}, {e} -> {_escape_sql(e)})"
    tag = (f"CASE WHEN {p} LIKE '# %' THEN concat('<h1>', substring({p}, 3), '</h1>') "
           f"WHEN {p} LIKE '## %' THEN concat('<h2>', substring({p}, 4), '</h2>') "
           f"WHEN {p} LIKE '### %' THEN concat('<h3>', substring({p}, 5), '</h3>') "
           f"ELSE concat('<p>', replace({p}, '\\n', '<br>'), '</p>') END")
    return f"concat({q(HTML_OPEN)}, array_join(transform({blocks}, {p} -> {tag}), '\\n'), {q(HTML_CLOSE)})"


def _truthy_sql(v: str, t: str) -> str:
    """``bool(x)`` of a JSON value of Python type ``t`` (absent: false)."""
    return (f"CASE {t} WHEN 'str' THEN variant_get({v}, '$', 'string') <> '' WHEN 'bool' THEN variant_get({v}, '$', 'boolean') "
            f"WHEN 'int' THEN variant_get({v}, '$', 'double') <> 0 WHEN 'float' THEN variant_get({v}, '$', 'double') <> 0 "
            f"WHEN 'list' THEN to_json({v}) <> '[]' WHEN 'dict' THEN to_json({v}) <> '{{}}' ELSE false END")


def _sliced_sql(v: str, t: str, n: int) -> str:
    """``x[:n]`` of a string or, as JSON text, of a list."""
    return (f"CASE {t} WHEN 'str' THEN substring(variant_get({v}, '$', 'string'), 1, {n}) "
            f"WHEN 'list' THEN to_json(slice(variant_get({v}, '$', 'array<variant>'), 1, {n})) END")


def _slice_error_sql(t: str) -> str:
    """What ``x[:n]`` raises for the Python type ``t`` (NULL: nothing)."""
    return (f"CASE WHEN {t} IN ('NoneType', 'int', 'float', 'bool') THEN concat(chr(39), {t}, chr(39), ' object is not subscriptable') "
            f"WHEN {t} = 'dict' THEN {q(UNHASHABLE)} END")


def publish(df: DataFrame, article_json: str = "article_json", author: str | None = None,
            draft_only: str | bool = False, platform: str | None = None,
            configured: bool = True, thumb_media_id: str | None = None) -> DataFrame:
    """Add ``publish_error`` (validation), ``payload`` (struct) and
    ``publish_result`` (struct of schemas.PUBLISH).

    ``author`` / ``platform`` name a per-row column when ``df`` has one of
    that name, else they are constants (platform default 'wechat'; the
    author has no branded default); ``draft_only`` is a bool or a column
    name. ``configured=False`` models a destination that is not set up.
    """
    aj = f"`{article_json}`"  # one parse below gives keys and values

    def col_or_const(v, default):
        if v is None:
            return default
        return f"`{v}`" if v in df.columns else q(v)

    auth = col_or_const(author, "CAST(NULL AS STRING)")
    plat = col_or_const(platform, "'wechat'")
    draft = (("true" if draft_only else "false") if isinstance(draft_only, bool)
             else f"coalesce(`{draft_only}`, false)")
    thumb = f"`{thumb_media_id}`" if thumb_media_id else "CAST(NULL AS STRING)"
    cols = [f"`{c}`" for c in df.columns]
    s = df.selectExpr(
        *cols,
        f"try_variant_get(try_parse_json({aj}), '$', 'map<string,variant>') AS _m",
        f"{plat} AS _platform", f"{draft} AS _draft", f"{auth} AS _author", f"{thumb} AS _thumb")
    fields = ("title", "content", "summary")
    s = s.selectExpr("*", "coalesce(size(_m), 0) <= 0 AS _empty", *[f"_m['{k}'] AS _{k}" for k in fields])
    s = s.selectExpr("*", *[f"{pytype_sql(f'_{k}')} AS _{k[0]}t" for k in fields])
    supported = "coalesce(_platform IN (" + ", ".join(q(p) for p in SUPPORTED_PLATFORMS) + "), false)"
    # what the original raises, in its order: the digest is cut before the
    # platform is asked, the title and content after
    raised = (f"coalesce({_slice_error_sql('_st')}, " + ("" if configured else f"{q(NOT_CONFIGURED)}, ") + f"{_slice_error_sql('_tt')}, "
              "CASE WHEN _ct <> 'str' THEN concat(chr(39), _ct, chr(39), ' object has no attribute ', chr(39), 'split', chr(39)) END)")
    s = s.selectExpr(
        "*",
        f"CASE WHEN _empty THEN {q(NO_ARTICLE)} "
        f"WHEN NOT {_truthy_sql('_title', '_tt')} OR NOT {_truthy_sql('_content', '_ct')} THEN {q(MISSING_FIELDS)} "
        f"END AS publish_error",
        f"{raised} AS _raised", f"{_sliced_sql('_title', '_tt', DIGEST_CHARS)} AS _title_cut",
        f"CASE WHEN {_truthy_sql('_summary', '_st')} THEN {_sliced_sql('_summary', '_st', DIGEST_CHARS)} END AS _digest_arg",
        "CASE _tt WHEN 'str' THEN variant_get(_title, '$', 'string') ELSE to_json(_title) END AS _title_text",
        "CASE _ct WHEN 'str' THEN variant_get(_content, '$', 'string') END AS _content_text")
    s = s.selectExpr(
        "*",
        f"CASE WHEN publish_error IS NULL AND {supported} AND coalesce(_raised, {q(NOT_CONFIGURED)}) = {q(NOT_CONFIGURED)} AND _ct = 'str' "
        f"AND _title_cut IS NOT NULL THEN named_struct("
        f"'title', _title_text, 'author', _author, 'content', {to_html_sql('_content_text')}, "
        f"'digest', coalesce(_digest_arg, _title_cut), "
        f"'show_cover_pic', CASE WHEN _thumb IS NOT NULL AND _thumb <> '' THEN 1 ELSE 0 END, "
        f"'thumb_media_id', CASE WHEN _thumb <> '' THEN _thumb END) END AS payload")
    pid = "sha2(concat_ws(chr(10), payload.title, coalesce(payload.author, ''), payload.content, payload.digest), 256)"
    null = "CAST(NULL AS STRING)"
    result = (
        f"CASE WHEN publish_error IS NOT NULL THEN named_struct('success', false, 'platform', {null}, "
        f"'article_id', {null}, 'article_url', {null}, 'draft_id', {null}, 'message', publish_error) "
        f"WHEN NOT {supported} THEN named_struct("
        f"'success', false, 'platform', _platform, 'article_id', {null}, 'article_url', {null}, "
        f"'draft_id', {null}, 'message', concat('Platform ', chr(39), coalesce(_platform, 'None'), chr(39), ' not supported yet')) "
        f"WHEN _raised IS NOT NULL THEN named_struct('success', false, 'platform', 'wechat', 'article_id', {null}, "
        f"'article_url', {null}, 'draft_id', {null}, 'message', "
        f"IF(_raised = {q(NOT_CONFIGURED)}, _raised, concat('Publishing error: ', _raised))) "
        f"WHEN _draft THEN named_struct('success', true, 'platform', 'wechat', 'article_id', {null}, "
        f"'article_url', {null}, 'draft_id', {pid}, 'message', {q(DRAFT_SAVED)}) "
        f"ELSE named_struct('success', true, 'platform', 'wechat', 'article_id', {pid}, "
        f"'article_url', {null}, 'draft_id', {null}, 'message', {q(PUBLISHED)}) END")
    return s.selectExpr(*cols, "publish_error", "_draft AS draft_only",
                        "payload", f"{result} AS publish_result")


def to_html(col: str, escape: bool = False):
    return expr(to_html_sql(col, escape))
