"""Analysis step (O30-O36): prompt column, reply join, strict parse or
deterministic fallback.

Reply handling (per row):
  no reply / status 'no_model' / 'error'     -> fallback from ''
  reply without a {...} span                 -> fallback from the reply text
  span that json.loads would reject          -> fallback from ''
  valid span                                 -> the parsed object, as is
An empty content gives the error "No content provided".

The analysis travels as ``analysis_json`` (the object as JSON text, so that
key presence survives) plus the typed ``analysis`` struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas
from ..functions.text import json_span_sql, let, q, sentences_sql, strict_json_object_sql
from .responses import attach_replies

# The analysis prompt, around the title and the first 4,000
# characters of content.
ANALYSIS_PROMPT_HEAD = "Analyze the following content and provide a comprehensive analysis:\n\nTitle: "
ANALYSIS_PROMPT_MID = "\n\nContent:\n"
ANALYSIS_PROMPT_TAIL = (
    "\n\nPlease provide a detailed analysis in JSON format with these keys:\n"
    "- summary: A concise summary\n"
    "- key_points: List of 3-7 main points\n"
    "- themes: Main themes (list)\n"
    "- sentiment: Overall sentiment\n"
    "- structure: Content structure analysis (dict)\n"
    "- recommendations: Writing recommendations (list)")
CONTEXT_CHARS = 4000

# The fallback analysis.
FALLBACK_KEY_POINTS = ["Main content focus", "Supporting details", "Key takeaways"]
FALLBACK_THEMES = ["Information", "Knowledge", "Content"]
FALLBACK_SENTIMENT = "neutral"
FALLBACK_STRUCTURE = ("article", ["introduction", "body", "conclusion"], "linear")
FALLBACK_RECOMMENDATIONS = ["Expand on key points", "Add supporting examples",
                            "Include relevant data and statistics"]
NO_CONTENT = "No content provided"


def _arr(values) -> str:
    return "array(" + ", ".join(q(v) for v in values) + ")"


def py_str_sql(e: str) -> str:
    """``str(x)`` for a string column (None -> 'None')."""
    return f"coalesce({e}, 'None')"


def analysis_prompt_sql(title: str, content: str) -> str:
    """O30 + O31: the prompt; content cut to 4,000 code points."""
    return (f"concat({q(ANALYSIS_PROMPT_HEAD)}, {py_str_sql(title)}, {q(ANALYSIS_PROMPT_MID)}, "
            f"substring({content}, 1, {CONTEXT_CHARS}), {q(ANALYSIS_PROMPT_TAIL)})")


def fallback_analysis_sql(text: str, title: str) -> str:
    """summary = first sentence (else 'Analysis of: <title>'),
    key_points = sentences 2-4 when there are at least two, else constants."""
    t_, d_, f_ = FALLBACK_STRUCTURE

    def body(s):
        return (f"named_struct('summary', CASE WHEN size({s}) > 0 THEN {s}[0] "
                f"ELSE concat('Analysis of: ', {py_str_sql(title)}) END, "
                f"'key_points', CASE WHEN size({s}) > 1 THEN slice({s}, 2, 3) ELSE {_arr(FALLBACK_KEY_POINTS)} END, "
                f"'themes', {_arr(FALLBACK_THEMES)}, 'sentiment', {q(FALLBACK_SENTIMENT)}, "
                f"'structure', named_struct('type', {q(t_)}, 'sections', {_arr(d_)}, 'flow', {q(f_)}), "
                f"'recommendations', {_arr(FALLBACK_RECOMMENDATIONS)})")
    return let(sentences_sql(text), body)


def analyze(df: DataFrame, responses: DataFrame | None = None, key: str = "key",
            title: str = "title", content: str = "content",
            with_prompt: bool = True) -> DataFrame:
    """Add ``analysis_prompt`` (optional), ``analysis_branch``,
    ``analysis_error``, ``analysis_json`` and ``analysis``.

    ``responses``: (key, response_text, status) replies to the prompts, or
    None when no model is configured.
    """
    cols = [f"`{c}`" for c in df.columns]
    j = attach_replies(df, responses, key)
    s = j.selectExpr(*cols, "_rtext", "_rstatus", f"{json_span_sql('_rtext')} AS _span")
    no_content = f"(`{content}` IS NULL OR `{content}` = '')"
    s = s.selectExpr(*cols, "_rtext", "_span",
                     f"CASE WHEN {no_content} THEN 'no_content' "
                     f"WHEN _rstatus <> 'ok' OR _rtext IS NULL THEN 'fallback_empty' "
                     f"WHEN _span IS NULL THEN 'fallback_text' "
                     f"WHEN {strict_json_object_sql('_span')} THEN 'parsed' "
                     f"ELSE 'fallback_empty' END AS analysis_branch")
    fb_text = f"CASE WHEN analysis_branch = 'fallback_text' THEN _rtext ELSE '' END"
    s = s.selectExpr(*cols, "analysis_branch",
                     f"CASE WHEN analysis_branch = 'no_content' THEN NULL "
                     f"WHEN analysis_branch = 'parsed' THEN _span "
                     f"ELSE to_json({fallback_analysis_sql(fb_text, f'`{title}`')}) END AS analysis_json")
    out = [*cols]
    if with_prompt:
        out.append(f"{analysis_prompt_sql(f'`{title}`', f'`{content}`')} AS analysis_prompt")
    return s.selectExpr(
        *out, "analysis_branch",
        f"CASE WHEN analysis_branch = 'no_content' THEN {q(NO_CONTENT)} "
        f"WHEN {_has_key('analysis_json', 'error')} THEN coalesce(get_json_object(analysis_json, '$.error'), 'None') "
        f"END AS analysis_error",
        "analysis_json",
        f"from_json(analysis_json, {q(schemas.ANALYSIS)}) AS analysis")


def _has_key(js: str, key: str) -> str:
    return f"coalesce(array_contains(json_object_keys({js}), {q(key)}), false)"


def analysis_prompts(df: DataFrame, key: str = "key", title: str = "title",
                     content: str = "content") -> DataFrame:
    """The outgoing request table for the model: ``(key, prompt)`` for every
    row with content (rows without content never reach the model). Replies
    come back as ``(key, response_text, status)`` for :func:`analyze`."""
    return df.selectExpr(f"`{key}` AS key", f"{analysis_prompt_sql(f'`{title}`', f'`{content}`')} AS prompt",
                         f"`{content}` IS NOT NULL AND `{content}` <> '' AS has_content") \
        .selectExpr("key", "CASE WHEN has_content THEN prompt END AS prompt")
