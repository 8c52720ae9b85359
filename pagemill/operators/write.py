"""Writing step (O40-O47): style/audience look-ups, prompt, reply join,
strict parse with defaults, or the deterministic fallback article.

The analysis arrives as JSON text (``analysis_json``); fields are read from
it as VARIANT so that "key absent", "JSON null" and "wrong type" stay
distinct -- the original's behaviour differs on each: an absent summary
reads as '', a null one makes ``summary[:200]`` raise, and a non-string in
``key_points`` makes ``', '.join`` raise. Those raises become an
``article_error`` on the row, as they do in the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas
from ..functions.text import (json_span_sql, nonblank_lines_sql, pystrip_sql, q,
                              strict_json_object_sql, var, word_count_sql)
from .responses import attach_replies

# Style templates (tone, structure, language, features) and
# audience profiles; unknown names fall back to professional / general.
STYLE_TEMPLATES = {
    "professional": ("formal and authoritative", "well-organized with clear sections",
                     "precise and technical terminology", "data-driven, objective, evidence-based"),
    "casual": ("friendly and conversational", "flexible and engaging",
               "everyday language with relatable examples", "personal anecdotes, humor, accessibility"),
    "news": ("objective and factual", "inverted pyramid (most important first)",
             "clear, concise, and neutral", "who, what, when, where, why, how"),
}
AUDIENCE_PROFILES = {
    "general": "general public with varied backgrounds and interests",
    "technical": "technical professionals with specialized knowledge",
    "business": "business professionals focused on practical applications",
}
DEFAULT_STYLE, DEFAULT_AUDIENCE = "professional", "general"

# The writing prompt ("brief" is the live form; "full" is the
# longer form that also lists structure, language, features and
# recommendations).
BRIEF_HEAD = "Based on the following content analysis, write a comprehensive article:\n\nANALYSIS:\nSummary: "
BRIEF_REQ = "\n\nREQUIREMENTS:\n- Style: "
BRIEF_TAIL = (" words\n\nWrite a complete article with:\n1. A compelling SEO-friendly title\n"
              "2. Well-structured content (introduction, body, conclusion)\n3. Covers all key points\n"
              "4. Meets the word count target\n\n"
              "Provide output in JSON format with keys: title, content, summary, tags (list), word_count")
FULL_REQ = "\n\nWRITING REQUIREMENTS:\n- Style: "
FULL_TAIL = (" words\n\nPlease write a complete article that:\n1. Has a compelling and SEO-friendly title\n"
             "2. Follows the specified style guidelines\n3. Targets the appropriate audience\n"
             "4. Covers all key points from the analysis\n"
             "5. Has proper structure with introduction, body, and conclusion\n"
             "6. Includes relevant examples and supporting details\n7. Meets the word count target\n\n"
             "Provide the output in the specified JSON format.")

# Reply texts the fallback article is built from.
NO_MODEL_TEXT = "No model available"
FAILED_TEXT = "Failed to generate"
DEFAULT_TITLE = "Untitled Article"
DEFAULT_CONTENT = "Content not generated"
NO_ANALYSIS = "No analysis result provided"
UNHASHABLE = "unhashable type: 'slice'"


def _map(d: dict, idx: int | None = None) -> str:
    items = []
    for k, v in d.items():
        items += [q(k), q(v if idx is None else v[idx])]
    return "map(" + ", ".join(items) + ")"


def style_sql(style: str, idx: int) -> str:
    """One attribute of the style template (constant map, no join)."""
    return (f"coalesce(try_element_at({_map(STYLE_TEMPLATES, idx)}, {style}), "
            f"{q(STYLE_TEMPLATES[DEFAULT_STYLE][idx])})")


def audience_sql(audience: str) -> str:
    """Audience description, unknown -> general."""
    return f"coalesce(try_element_at({_map(AUDIENCE_PROFILES)}, {audience}), {q(AUDIENCE_PROFILES[DEFAULT_AUDIENCE])})"


def pytype_sql(v: str) -> str:
    """Python type name of a VARIANT value (NULL when the key is absent)."""
    s = f"schema_of_variant({v})"
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN is_variant_null({v}) THEN 'NoneType' "
            f"WHEN {s} = 'STRING' THEN 'str' WHEN {s} = 'BOOLEAN' THEN 'bool' "
            f"WHEN {s} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'int' "
            f"WHEN {s} LIKE 'DECIMAL%' OR {s} IN ('DOUBLE', 'FLOAT') THEN 'float' "
            f"WHEN {s} LIKE 'OBJECT%' THEN 'dict' WHEN {s} LIKE 'ARRAY%' THEN 'list' ELSE 'object' END")


def _vstr(v: str) -> str:
    """Text of a VARIANT: strings unquoted, anything else as JSON."""
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN variant_get({v}, '$', 'string') ELSE to_json({v}) END"


def _str_of(v: str, t: str) -> str:
    """``str(x)`` of a JSON value (absent handled by caller)."""
    return (f"CASE WHEN {t} = 'NoneType' THEN 'None' WHEN {t} = 'bool' THEN "
            f"CASE WHEN variant_get({v}, '$', 'boolean') THEN 'True' ELSE 'False' END "
            f"ELSE {_vstr(v)} END")


def _join(v: str, t: str) -> str:
    """``', '.join(x)`` -> named_struct(err, txt); absent key -> ''."""
    elems = f"variant_get({v}, '$', 'array<variant>')"
    e = var("e")
    kinds = f"transform({elems}, {e} -> {pytype_sql(e)})"
    bad = f"array_position(transform({kinds}, {e} -> {e} = 'str'), false)"
    strs = f"transform({elems}, {e} -> variant_get({e}, '$', 'string'))"
    return (f"CASE WHEN {t} IS NULL THEN named_struct('err', CAST(NULL AS STRING), 'txt', '') "
            f"WHEN {t} IN ('NoneType', 'int', 'float', 'bool') "
            f"THEN named_struct('err', 'can only join an iterable', 'txt', CAST(NULL AS STRING)) "
            f"WHEN {t} = 'str' THEN named_struct('err', CAST(NULL AS STRING), 'txt', "
            f"array_join(split(variant_get({v}, '$', 'string'), ''), ', ')) "
            f"WHEN {t} = 'dict' THEN named_struct('err', CAST(NULL AS STRING), 'txt', "
            f"array_join(json_object_keys(to_json({v})), ', ')) "
            f"WHEN {bad} > 0 THEN named_struct('err', concat('sequence item ', CAST({bad} - 1 AS STRING), "
            f"': expected str instance, ', element_at({kinds}, CAST({bad} AS INT)), ' found'), 'txt', CAST(NULL AS STRING)) "
            f"ELSE named_struct('err', CAST(NULL AS STRING), 'txt', array_join({strs}, ', ')) END")


def _slice(v: str, t: str, n: int, absent: str) -> str:
    """``x[:n]`` of a string-ish JSON value -> named_struct(err, txt)."""
    return (f"CASE WHEN {t} IS NULL THEN named_struct('err', CAST(NULL AS STRING), 'txt', {absent}) "
            f"WHEN {t} IN ('NoneType', 'int', 'float', 'bool') THEN named_struct('err', "
            f"concat(chr(39), {t}, chr(39), ' object is not subscriptable'), 'txt', CAST(NULL AS STRING)) "
            f"WHEN {t} = 'dict' THEN named_struct('err', {q(UNHASHABLE)}, "
            f"'txt', CAST(NULL AS STRING)) "
            f"WHEN {t} = 'str' THEN named_struct('err', CAST(NULL AS STRING), 'txt', "
            f"substring(variant_get({v}, '$', 'string'), 1, {n})) "
            f"ELSE named_struct('err', CAST(NULL AS STRING), 'txt', {_vstr(v)}) END")


def writing_prompt_sql(detail: str = "brief") -> str:
    """O42 over the staged columns (_summary_txt, _kp, _th, _rec, style,
    audience, word count)."""
    if detail == "brief":
        return (f"concat({q(BRIEF_HEAD)}, _summary_txt, '\\nKey Points: ', _kp.txt, '\\nThemes: ', _th.txt, "
                f"{q(BRIEF_REQ)}, _style, ' - ', {style_sql('_style', 0)}, "
                f"'\\n- Target Audience: ', {audience_sql('_audience')}, "
                f"'\\n- Target Word Count: ', CAST(_words AS STRING), {q(BRIEF_TAIL)})")
    return (f"concat({q(BRIEF_HEAD)}, _summary_txt, '\\nKey Points: ', _kp.txt, '\\nThemes: ', _th.txt, "
            f"'\\nRecommendations: ', _rec.txt, {q(FULL_REQ)}, _style, ' (', {style_sql('_style', 0)}, ')', "
            f"'\\n- Structure: ', {style_sql('_style', 1)}, '\\n- Language: ', {style_sql('_style', 2)}, "
            f"'\\n- Features: ', {style_sql('_style', 3)}, '\\n- Target Audience: ', {audience_sql('_audience')}, "
            f"'\\n- Target Word Count: ', CAST(_words AS STRING), {q(FULL_TAIL)})")


def _col_or_lit(x, default) -> str:
    if x is None:
        return q(default) if isinstance(default, str) else str(default)
    if isinstance(x, int):
        return str(x)
    return f"`{x}`"


def write(df: DataFrame, responses: DataFrame | None = None, key: str = "key",
          analysis_json: str = "analysis_json", style: str | None = None,
          audience: str | None = None, word_count: str | int | None = None,
          detail: str = "brief", with_prompt: bool = True) -> DataFrame:
    """Add ``article_prompt`` (optional), ``article_branch``,
    ``article_error``, ``article_json`` and ``article``.

    ``style`` / ``audience`` / ``word_count`` name per-row columns (None ->
    professional / general / 1000; an int is a constant word count).
    ``responses``: (key, response_text, status) replies, None = no model.
    """
    cols = [f"`{c}`" for c in df.columns]
    j = attach_replies(df, responses, key)
    s = j.selectExpr(*cols, "_rtext", "_rstatus",
                     f"{_col_or_lit(style, DEFAULT_STYLE)} AS _style",
                     f"{_col_or_lit(audience, DEFAULT_AUDIENCE)} AS _audience",
                     f"{_col_or_lit(word_count, 1000)} AS _words",
                     f"try_parse_json(`{analysis_json}`) AS _av",
                     f"{json_span_sql('_rtext')} AS _span")
    s = s.selectExpr("*", "variant_get(_av, '$.summary', 'variant') AS _sv",
                     "variant_get(_av, '$.key_points', 'variant') AS _kv",
                     "variant_get(_av, '$.themes', 'variant') AS _tv",
                     "variant_get(_av, '$.recommendations', 'variant') AS _rv")
    s = s.selectExpr("*", f"{pytype_sql('_sv')} AS _st", f"{pytype_sql('_kv')} AS _kt",
                     f"{pytype_sql('_tv')} AS _tt", f"{pytype_sql('_rv')} AS _rt")
    s = s.selectExpr(
        "*",
        f"CASE WHEN _st IS NULL THEN '' ELSE {_str_of('_sv', '_st')} END AS _summary_txt",
        f"{_join('_kv', '_kt')} AS _kp", f"{_join('_tv', '_tt')} AS _th", f"{_join('_rv', '_rt')} AS _rec",
        f"{_slice('_sv', '_st', 200, q(''))} AS _sum200",
        f"{_slice('_sv', '_st', 100, q('Article'))} AS _sum100",
        f"CASE WHEN _av IS NULL OR size(json_object_keys(`{analysis_json}`)) = 0 THEN true ELSE false END AS _empty",
        f"CASE WHEN _rstatus = 'no_model' THEN 'no_model' WHEN _rstatus <> 'ok' OR _rtext IS NULL THEN 'model_error' "
        f"WHEN _span IS NULL THEN 'fallback_text' WHEN {strict_json_object_sql('_span')} THEN 'parsed' "
        f"ELSE 'invalid_json' END AS _branch")
    prompt_err = "CASE WHEN _empty THEN NULL ELSE coalesce(_kp.err, _th.err) END"
    detail_prompt = writing_prompt_sql(detail)
    s = s.selectExpr(
        "*", f"{detail_prompt} AS _prompt", f"{prompt_err} AS _perr",
        f"CASE _branch WHEN 'no_model' THEN {q(NO_MODEL_TEXT)} WHEN 'fallback_text' THEN _rtext "
        f"WHEN 'parsed' THEN NULL ELSE {q(FAILED_TEXT)} END AS _ftext")
    # fallback article (its raises precede the defaulting block)
    lines = nonblank_lines_sql("_ftext")
    s = s.selectExpr("*", f"{lines} AS _lines")
    title0 = "CASE WHEN size(_lines) > 0 THEN _lines[0] ELSE _sum100.txt END"
    fb_err = ("CASE WHEN size(_lines) = 0 AND _sum100.err IS NOT NULL THEN _sum100.err "
              "WHEN _sum200.err IS NOT NULL THEN _sum200.err "
              "WHEN _tt IN ('NoneType', 'int', 'float', 'bool') THEN concat(chr(39), _tt, chr(39), ' object is not subscriptable') "
              "WHEN _tt = 'dict' THEN " + q(UNHASHABLE) + " END")
    tags5 = ("CASE WHEN _tt IS NULL THEN cast(array() AS array<string>) "
             "WHEN _tt = 'str' THEN slice(split(variant_get(_tv, '$', 'string'), ''), 1, 5) "
             "ELSE slice(transform(variant_get(_tv, '$', 'array<variant>'), x -> "
             "CASE WHEN schema_of_variant(x) = 'STRING' THEN variant_get(x, '$', 'string') ELSE to_json(x) END), 1, 5) END")
    s = s.selectExpr("*", f"CASE WHEN _branch <> 'parsed' THEN {title0} END AS _title0",
                     f"CASE WHEN _branch <> 'parsed' THEN {fb_err} END AS _fberr",
                     f"CASE WHEN _branch <> 'parsed' THEN {tags5} END AS _tags5")
    fb_title = (f"CASE WHEN lower(_title0) LIKE 'title:%' THEN {pystrip_sql('substring(_title0, 7)')} "
                f"ELSE _title0 END")
    fb_json = (f"to_json(named_struct('title', {fb_title}, 'content', _ftext, 'summary', _sum200.txt, "
               f"'tags', _tags5, 'word_count', CAST({word_count_sql('_ftext')} AS BIGINT), 'style', _style))")
    # parsed article: the reply's own keys and values, defaults for missing
    # keys, style always overwritten
    # the reply as it is, value types kept: key -> variant, a JSON null is a variant null
    s = s.selectExpr("*", "CASE WHEN _branch = 'parsed' THEN variant_get(parse_json(_span), '$', 'map<string,variant>') END AS _pm")
    s = s.selectExpr("*", "_pm['content'] AS _cv")
    s = s.selectExpr("*", f"{pytype_sql('_cv')} AS _ct")
    content_final = f"CASE WHEN _ct IS NULL THEN {q(DEFAULT_CONTENT)} WHEN _ct = 'str' THEN variant_get(_cv, '$', 'string') END"
    parsed_err = (f"CASE WHEN _sum200.err IS NOT NULL THEN _sum200.err "
                  f"WHEN _ct <> 'str' THEN concat(chr(39), _ct, chr(39), "
                  f"' object has no attribute ', chr(39), 'split', chr(39)) END")
    defaults = {"title": q(DEFAULT_TITLE), "content": q(DEFAULT_CONTENT), "summary": "_sum200.txt",
                "tags": None, "word_count": f"CAST({word_count_sql(content_final)} AS BIGINT)"}
    entries = [f"named_struct('key', {q(k)}, 'value', coalesce(_pm[{q(k)}], "
               + ("_tv, CAST(cast(array() AS array<string>) AS VARIANT)" if d is None else f"CAST({d} AS VARIANT)") + "))"
               for k, d in defaults.items()]
    known = ", ".join(q(k) for k in [*defaults, "style"])
    k = var("k")
    extras = (f"transform(array_sort(filter(map_keys(_pm), {k} -> {k} NOT IN ({known}))), "
              f"{k} -> named_struct('key', {k}, 'value', _pm[{k}]))")
    parsed_json = (f"to_json(map_from_entries(concat(array({', '.join(entries)}), {extras}, "
                   f"array(named_struct('key', 'style', 'value', CAST(_style AS VARIANT))))))")
    err = (f"CASE WHEN _empty THEN {q(NO_ANALYSIS)} WHEN _perr IS NOT NULL THEN _perr "
           f"WHEN _branch <> 'parsed' THEN _fberr ELSE {parsed_err} END")
    out = [*cols]
    if with_prompt:
        out.append("CASE WHEN _empty OR _perr IS NOT NULL THEN NULL ELSE _prompt END AS article_prompt")
    s = s.selectExpr(*out, f"CASE WHEN _empty THEN 'no_analysis' ELSE _branch END AS article_branch",
                     f"{err} AS _err",
                     f"CASE WHEN _branch = 'parsed' THEN {parsed_json} ELSE {fb_json} END AS _ajson",
                     "_branch = 'parsed' AND map_contains_key(_pm, 'error') AS _errkey",
                     "CASE WHEN _branch = 'parsed' THEN get_json_object(_span, '$.error') END AS _errval")
    keep = [c for c in s.columns if not c.startswith("_")]
    return s.selectExpr(
        *[f"`{c}`" for c in keep],
        "CASE WHEN _err IS NOT NULL THEN _err WHEN _errkey THEN coalesce(_errval, 'None') END AS article_error",
        "CASE WHEN _err IS NULL THEN _ajson END AS article_json",
        f"CASE WHEN _err IS NULL THEN from_json(_ajson, {q(schemas.ARTICLE)}) END AS article")
