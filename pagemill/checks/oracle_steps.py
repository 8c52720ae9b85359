"""DuckDB formulations of the analysis, writing and publishing rules."""

from __future__ import annotations

from ..functions.text import WS_CLASS
from ..operators import analyze as A
from ..operators import write as W
from .oracle import NL, d_strip, dq

# DuckDB json_type -> Python type name
_PYTYPE = {"NULL": "NoneType", "BIGINT": "int", "UBIGINT": "int", "DOUBLE": "float",
           "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict", "VARCHAR": "str"}


def d_bind(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def d_span(t: str) -> str:
    s, e = "instr(q_t, '{')", "(length(q_t) - instr(reverse(q_t), '}') + 1)"
    return d_bind(t, "q_t", f"CASE WHEN {s} > 0 AND instr(reverse(q_t), '}}') > 0 AND {e} > {s} "
                            f"THEN substr(q_t, {s}, {e} - {s} + 1) END")


def d_strict(span: str) -> str:
    w = f"('[' || {span} || ']')"
    return f"({span} IS NOT NULL AND json_valid({w}) AND json_array_length({w}) = 1)"


def d_sentences(t: str) -> str:
    return (f"list_filter(list_transform(string_split({t}, '.'), lambda q_s1: {d_strip('q_s1')}), "
            f"lambda q_s2: q_s2 <> '')")


def d_lines(t: str) -> str:
    return (f"list_filter(list_transform(string_split({t}, {NL}), lambda q_l1: {d_strip('q_l1')}), "
            f"lambda q_l2: q_l2 <> '')")


def d_word_count(t: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({t}, {dq(WS_CLASS + '+')}), lambda q_w: q_w <> '')) AS BIGINT)"


def _lst(values) -> str:
    return "[" + ", ".join(dq(v) for v in values) + "]"


def d_fallback_analysis_json(text: str, title: str) -> str:
    t_, d_, f_ = A.FALLBACK_STRUCTURE
    body = (f"to_json({{'summary': CASE WHEN len(q_se) > 0 THEN q_se[1] "
            f"ELSE 'Analysis of: ' || coalesce({title}, 'None') END, "
            f"'key_points': CASE WHEN len(q_se) > 1 THEN q_se[2:4] ELSE {_lst(A.FALLBACK_KEY_POINTS)} END, "
            f"'themes': {_lst(A.FALLBACK_THEMES)}, 'sentiment': {dq(A.FALLBACK_SENTIMENT)}, "
            f"'structure': {{'type': {dq(t_)}, 'sections': {_lst(d_)}, 'flow': {dq(f_)}}}, "
            f"'recommendations': {_lst(A.FALLBACK_RECOMMENDATIONS)}}})")
    return d_bind(d_sentences(text), "q_se", body)


def d_analysis_prompt(title: str, content: str) -> str:
    return (f"{dq(A.ANALYSIS_PROMPT_HEAD)} || coalesce({title}, 'None') || {dq(A.ANALYSIS_PROMPT_MID)} "
            f"|| substr({content}, 1, {A.CONTEXT_CHARS}) || {dq(A.ANALYSIS_PROMPT_TAIL)}")


def d_analysis_cols(title: str, content: str, rtext: str, rstatus: str) -> str:
    """SELECT-list fragment: analysis_branch, analysis_json, analysis_error
    (expects to be used over a relation with a precomputed ``span``)."""
    branch = (f"CASE WHEN {content} IS NULL OR {content} = '' THEN 'no_content' "
              f"WHEN {rstatus} IS NULL OR {rstatus} <> 'ok' OR {rtext} IS NULL THEN 'fallback_empty' "
              f"WHEN span IS NULL THEN 'fallback_text' WHEN {d_strict('span')} THEN 'parsed' "
              f"ELSE 'fallback_empty' END")
    return branch


def d_analysis_select(title: str, content: str, rtext: str, rstatus: str, src: str, keep: str) -> str:
    """A query over ``src`` adding analysis_branch / analysis_json /
    analysis_error."""
    b = d_analysis_cols(title, content, rtext, rstatus)
    fb_text = f"CASE WHEN analysis_branch = 'fallback_text' THEN {rtext} ELSE '' END"
    return (f"SELECT {keep}, analysis_branch, analysis_json, "
            f"CASE WHEN analysis_branch = 'no_content' THEN {dq(A.NO_CONTENT)} "
            f"WHEN json_type(analysis_json, '$.error') IS NOT NULL "
            f"THEN coalesce(json_extract_string(analysis_json, '$.error'), 'None') END AS analysis_error "
            f"FROM (SELECT *, CASE WHEN analysis_branch = 'no_content' THEN NULL "
            f"WHEN analysis_branch = 'parsed' THEN span "
            f"ELSE {d_fallback_analysis_json(fb_text, title)} END AS analysis_json "
            f"FROM (SELECT *, {b} AS analysis_branch FROM (SELECT *, {d_span(rtext)} AS span FROM ({src}))))")


# ------------------------------------------------------------------ writing
def _pyt(jt: str) -> str:
    return "CASE " + " ".join(f"WHEN {jt} = {dq(k)} THEN {dq(v)}" for k, v in _PYTYPE.items()) + " END"


def _style(style: str, idx: int) -> str:
    return ("CASE " + " ".join(f"WHEN {style} = {dq(k)} THEN {dq(v[idx])}" for k, v in W.STYLE_TEMPLATES.items())
            + f" ELSE {dq(W.STYLE_TEMPLATES[W.DEFAULT_STYLE][idx])} END")


def _audience(aud: str) -> str:
    return ("CASE " + " ".join(f"WHEN {aud} = {dq(k)} THEN {dq(v)}" for k, v in W.AUDIENCE_PROFILES.items())
            + f" ELSE {dq(W.AUDIENCE_PROFILES[W.DEFAULT_AUDIENCE])} END")


def d_write_select(src: str, keep: str, style: str, audience: str, words: str,
                   rtext: str, rstatus: str, detail: str = "brief") -> str:
    """A query over ``src`` (with ``analysis_json``) adding article_prompt,
    article_branch, article_error, article_json."""
    aj = "analysis_json"
    jt = {k: f"json_type({aj}, '$.{k}')" for k in ("summary", "key_points", "themes", "recommendations")}

    def join(k):
        t = jt[k]
        err = (f"CASE WHEN {t} IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') "
               f"THEN 'can only join an iterable' END")
        txt = (f"CASE WHEN {t} IS NULL THEN '' WHEN {t} = 'ARRAY' "
               f"THEN array_to_string(CAST(json_extract({aj}, '$.{k}') AS VARCHAR[]), ', ') END")
        return err, txt

    def sl(n, absent):
        t = jt["summary"]
        err = (f"CASE WHEN {t} IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') "
               f"THEN '''' || {_pyt(t)} || ''' object is not subscriptable' END")
        txt = (f"CASE WHEN {t} IS NULL THEN {dq(absent)} WHEN {t} = 'VARCHAR' "
               f"THEN substr(json_extract_string({aj}, '$.summary'), 1, {n}) END")
        return err, txt

    kp_err, kp_txt = join("key_points")
    th_err, th_txt = join("themes")
    rc_err, rc_txt = join("recommendations")
    s200_err, s200_txt = sl(200, "")
    s100_err, s100_txt = sl(100, "Article")
    summary_txt = (f"CASE WHEN {jt['summary']} IS NULL THEN '' WHEN {jt['summary']} = 'NULL' THEN 'None' "
                   f"WHEN {jt['summary']} = 'VARCHAR' THEN json_extract_string({aj}, '$.summary') "
                   f"ELSE CAST(json_extract({aj}, '$.summary') AS VARCHAR) END")
    if detail == "brief":
        prompt = (f"{dq(W.BRIEF_HEAD)} || {summary_txt} || {NL} || 'Key Points: ' || ({kp_txt}) || {NL} "
                  f"|| 'Themes: ' || ({th_txt}) || {dq(W.BRIEF_REQ)} || {style} || ' - ' || ({_style(style, 0)}) "
                  f"|| {NL} || '- Target Audience: ' || ({_audience(audience)}) || {NL} "
                  f"|| '- Target Word Count: ' || CAST({words} AS VARCHAR) || {dq(W.BRIEF_TAIL)}")
    else:
        prompt = (f"{dq(W.BRIEF_HEAD)} || {summary_txt} || {NL} || 'Key Points: ' || ({kp_txt}) || {NL} "
                  f"|| 'Themes: ' || ({th_txt}) || {NL} || 'Recommendations: ' || ({rc_txt}) "
                  f"|| {dq(W.FULL_REQ)} || {style} || ' (' || ({_style(style, 0)}) || ')' "
                  f"|| {NL} || '- Structure: ' || ({_style(style, 1)}) || {NL} || '- Language: ' || ({_style(style, 2)}) "
                  f"|| {NL} || '- Features: ' || ({_style(style, 3)}) || {NL} || '- Target Audience: ' "
                  f"|| ({_audience(audience)}) || {NL} || '- Target Word Count: ' || CAST({words} AS VARCHAR) "
                  f"|| {dq(W.FULL_TAIL)}")
    empty = f"({aj} IS NULL OR len(json_keys({aj})) = 0)"
    perr = f"CASE WHEN {empty} THEN NULL ELSE coalesce({kp_err}, {th_err}) END"
    branch = (f"CASE WHEN {rstatus} IS NULL THEN 'no_model' WHEN {rstatus} <> 'ok' OR {rtext} IS NULL "
              f"THEN 'model_error' WHEN span2 IS NULL THEN 'fallback_text' WHEN {d_strict('span2')} THEN 'parsed' "
              f"ELSE 'invalid_json' END")
    ftext = (f"CASE br WHEN 'no_model' THEN {dq(W.NO_MODEL_TEXT)} WHEN 'fallback_text' THEN {rtext} "
             f"WHEN 'parsed' THEN NULL ELSE {dq(W.FAILED_TEXT)} END")
    tt = jt["themes"]
    fb_err = (f"CASE WHEN len(q_ln) = 0 AND ({s100_err}) IS NOT NULL THEN {s100_err} "
              f"WHEN ({s200_err}) IS NOT NULL THEN {s200_err} "
              f"WHEN {tt} IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') "
              f"THEN '''' || {_pyt(tt)} || ''' object is not subscriptable' END")
    tags5 = (f"CASE WHEN {tt} IS NULL THEN []::VARCHAR[] "
             f"ELSE CAST(json_extract({aj}, '$.themes') AS VARCHAR[])[1:5] END")
    title0 = f"CASE WHEN len(q_ln) > 0 THEN q_ln[1] ELSE {s100_txt} END"
    fb_title = (f"CASE WHEN starts_with(lower({title0}), 'title:') THEN {d_strip(f'({title0})[7:]')} "
                f"ELSE {title0} END")
    fb_json = (f"to_json({{'title': {fb_title}, 'content': ftext, 'summary': {s200_txt}, 'tags': {tags5}, "
               f"'word_count': {d_word_count('ftext')}, 'style': {style}}})")
    fb = d_bind(d_lines("ftext"), "q_ln", f"{{'err': {fb_err}, 'js': {fb_json}}}")
    pj = "span2"
    pjt = {k: f"json_type({pj}, '$.{k}')" for k in ("title", "content", "summary", "tags", "word_count", "error")}
    themes_all = (f"CASE WHEN {tt} IS NULL THEN []::VARCHAR[] WHEN {tt} = 'ARRAY' "
                  f"THEN CAST(json_extract({aj}, '$.themes') AS VARCHAR[]) END")
    content_final = (f"CASE WHEN {pjt['content']} IS NOT NULL THEN json_extract_string({pj}, '$.content') "
                     f"ELSE {dq(W.DEFAULT_CONTENT)} END")
    parsed_err = (f"CASE WHEN ({s200_err}) IS NOT NULL THEN {s200_err} "
                  f"WHEN {pjt['content']} IS NOT NULL AND {pjt['content']} <> 'VARCHAR' "
                  f"THEN '''' || {_pyt(pjt['content'])} || ''' object has no attribute ''split''' END")
    parsed_json = (f"to_json({{'title': CASE WHEN {pjt['title']} IS NULL THEN {dq(W.DEFAULT_TITLE)} "
                   f"WHEN {pjt['title']} = 'VARCHAR' THEN json_extract_string({pj}, '$.title') "
                   f"ELSE CAST(json_extract({pj}, '$.title') AS VARCHAR) END, "
                   f"'content': {content_final}, "
                   f"'summary': CASE WHEN {pjt['summary']} IS NOT NULL THEN json_extract_string({pj}, '$.summary') "
                   f"ELSE {s200_txt} END, "
                   f"'tags': CASE WHEN {pjt['tags']} IS NOT NULL THEN CAST(json_extract({pj}, '$.tags') AS VARCHAR[]) "
                   f"ELSE {themes_all} END, "
                   f"'word_count': CASE WHEN {pjt['word_count']} IS NOT NULL "
                   f"THEN TRY_CAST(json_extract({pj}, '$.word_count') AS BIGINT) ELSE {d_word_count(content_final)} END, "
                   f"'style': {style}}})")
    err = (f"CASE WHEN {empty} THEN {dq(W.NO_ANALYSIS)} WHEN perr IS NOT NULL THEN perr "
           f"WHEN br <> 'parsed' THEN fb.err ELSE {parsed_err} END")
    inner = (f"SELECT *, {perr} AS perr, {branch} AS br FROM "
             f"(SELECT *, {d_span(rtext)} AS span2 FROM ({src}))")
    mid = (f"SELECT *, CASE WHEN br <> 'parsed' THEN {fb} END AS fb, "
           f"CASE WHEN br = 'parsed' THEN {parsed_json} END AS pjs, {prompt} AS pr FROM "
           f"(SELECT *, {ftext} AS ftext FROM ({inner}))")
    mid = f"SELECT *, {err} AS e0 FROM ({mid})"
    return (f"SELECT {keep}, CASE WHEN {empty} OR perr IS NOT NULL THEN NULL ELSE pr END AS article_prompt, "
            f"CASE WHEN {empty} THEN 'no_analysis' ELSE br END AS article_branch, "
            f"CASE WHEN e0 IS NOT NULL THEN e0 WHEN br = 'parsed' AND {pjt['error']} IS NOT NULL "
            f"THEN coalesce(json_extract_string(span2, '$.error'), 'None') END AS article_error, "
            f"CASE WHEN e0 IS NULL THEN CASE WHEN br = 'parsed' THEN pjs ELSE fb.js END END AS article_json "
            f"FROM ({mid})")


# ------------------------------------------------------------------ publishing
def d_to_html(content: str) -> str:
    from ..operators import publish as PB
    blocks = (f"list_filter(list_transform(string_split({content}, {NL} || {NL}), lambda q_b: {d_strip('q_b')}), "
              f"lambda q_c: q_c <> '')")
    tag = ("CASE WHEN starts_with(q_p, '# ') THEN '<h1>' || q_p[3:] || '</h1>' "
           "WHEN starts_with(q_p, '## ') THEN '<h2>' || q_p[4:] || '</h2>' "
           "WHEN starts_with(q_p, '### ') THEN '<h3>' || q_p[5:] || '</h3>' "
           f"ELSE '<p>' || replace(q_p, {NL}, '<br>') || '</p>' END")
    return f"{dq(PB.HTML_OPEN)} || array_to_string(list_transform({blocks}, lambda q_p: {tag}), {NL}) || {dq(PB.HTML_CLOSE)}"


def d_publish_select(src: str, keep: str, author: str, draft: str, platform: str) -> str:
    """A query over ``src`` (with ``article_json``) adding the payload and
    publish-result columns."""
    from ..operators import publish as PB
    aj = "article_json"
    title, content, summary = (f"json_extract_string({aj}, '$.{k}')" for k in ("title", "content", "summary"))
    has_summary = f"json_type({aj}, '$.summary') IS NOT NULL"
    empty = f"({aj} IS NULL OR len(json_keys({aj})) = 0)"
    perr = (f"CASE WHEN {empty} THEN {dq(PB.NO_ARTICLE)} WHEN coalesce({title}, '') = '' OR coalesce({content}, '') = '' "
            f"THEN {dq(PB.MISSING_FIELDS)} END")
    digest_arg = f"CASE WHEN NOT ({has_summary}) THEN '' ELSE substr({summary}, 1, {PB.DIGEST_CHARS}) END"
    digest = f"CASE WHEN ({digest_arg}) <> '' THEN {digest_arg} ELSE substr({title}, 1, {PB.DIGEST_CHARS}) END"
    ok = (f"perr IS NULL AND plat = 'wechat' AND NOT ({has_summary} AND json_type({aj}, '$.summary') = 'NULL')")
    html = d_to_html(content)
    pid = f"sha256({title} || {NL} || coalesce({author}, '') || {NL} || ({html}) || {NL} || ({digest}))"
    return (f"SELECT {keep}, perr AS publish_error, draft AS draft_only, "
            f"CASE WHEN {ok} THEN {title} END AS payload_title, CASE WHEN {ok} THEN {html} END AS payload_content, "
            f"CASE WHEN {ok} THEN {digest} END AS payload_digest, CASE WHEN {ok} THEN 0 END AS show_cover_pic, "
            f"CASE WHEN perr IS NULL AND plat = 'wechat' AND {ok} THEN true ELSE false END AS success, "
            f"CASE WHEN perr IS NOT NULL THEN NULL WHEN plat <> 'wechat' THEN plat ELSE 'wechat' END AS platform, "
            f"CASE WHEN {ok} AND NOT draft THEN {pid} END AS article_id, "
            f"CASE WHEN {ok} AND draft THEN {pid} END AS draft_id, "
            f"CASE WHEN perr IS NOT NULL THEN perr WHEN plat <> 'wechat' THEN 'Platform ''' || plat || ''' not supported yet' "
            f"WHEN NOT ({ok}) THEN 'Publishing error: ''NoneType'' object is not subscriptable' "
            f"WHEN draft THEN {dq(PB.DRAFT_SAVED)} ELSE {dq(PB.PUBLISHED)} END AS message "
            f"FROM (SELECT *, {perr} AS perr, {platform} AS plat, {draft} AS draft FROM ({src}))")
