"""DuckDB (RE2) formulations of the extraction rules, for the oracle SQL.

Written independently of the Spark side: lists are split/transformed/
filtered instead of regex-joined, containers use lazy per-tag patterns
(RE2 has no back-references), entities are decoded by nested replace with
``&amp;`` last, and URL resolution is a list pipeline with ``list_reduce``.
"""

from __future__ import annotations

from ..functions.text import WS_CLASS
from ..functions.urls import IMAGE_EXCLUDE, IMAGE_EXTENSIONS, USES_NETLOC, USES_RELATIVE

NL = "chr(10)"


def dq(s: str) -> str:
    """DuckDB string literal (no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


def d_in(e: str, values) -> str:
    return f"{e} IN ({', '.join(dq(v) for v in values)})"


def d_strip(e: str) -> str:
    return f"regexp_replace({e}, {dq('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"


# the entities present in the driver pages and the derived inputs
_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"),
             ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'")]


def d_decode(e: str) -> str:
    out = e
    for ent, ch in _ENTITIES:
        out = f"replace({out}, {dq(ent)}, {dq(ch)})"
    return f"replace({out}, '&amp;', '&')"


def d_lines(e: str) -> str:
    return (f"list_filter(list_transform(string_split({e}, {NL}), lambda q_ln: {d_strip('q_ln')}), "
            f"lambda q_ln: q_ln <> '')")


def d_text(frag: str) -> str:
    """Tags to newlines, decode, split, strip, drop blanks, join by blank line."""
    no_tags = f"regexp_replace({frag}, '<[^>]*>', {NL}, 'g')"
    return f"array_to_string({d_lines(d_decode(no_tags))}, {NL} || {NL})"


def d_preclean(html: str) -> str:
    pat = (r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?(?:</script\s*>|$)"
           r"|<style\b[^>]*>.*?(?:</style\s*>|$)")
    return f"regexp_replace({html}, {dq(pat)}, '<!>', 'g')"


def d_boiler(pre: str) -> str:
    pat = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ["nav", "header", "footer", "aside", "iframe"])
    return f"regexp_replace({pre}, {dq('(?is)' + pat)}, {NL}, 'g')"


def d_attr(tag: str, name: str) -> str:
    raw = f"regexp_extract({tag}, {dq(r'(?is)\s' + name + r'''\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)''')}, 1)"
    unq = (f"CASE WHEN starts_with({raw}, '\"') OR starts_with({raw}, '''') "
           f"THEN {raw}[2:length({raw}) - 1] ELSE {raw} END")
    return d_decode(unq)


def d_tags(html: str, name: str) -> str:
    return f"regexp_extract_all({html}, {dq(r'(?is)<' + name + r'''\b(?:[^>"']|"[^"]*"|'[^']*')*>''')})"


def d_title(pre: str) -> str:
    t_re = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
    inner = f"regexp_extract({pre}, {dq(t_re)}, 1)"
    og_tag = f"list_filter({d_tags(pre, 'meta')}, lambda m: {d_attr('m', 'property')} = 'og:title')[1]"
    og = f"coalesce({d_attr(og_tag, 'content')}, '')"
    h1 = f"regexp_extract({pre}, {dq(r'(?is)<h1\b[^>]*>(.*?)(?:</h1\s*>|$)')}, 1)"
    h1_text = f"regexp_replace({h1}, '<[^>]*>', '', 'g')"
    return (f"CASE WHEN regexp_matches({pre}, {dq(t_re)}) AND {inner} <> '' AND NOT contains({inner}, '<') "
            f"THEN {d_strip(d_decode(inner))} "
            f"WHEN {og} <> '' THEN {d_strip(og)} "
            f"WHEN regexp_matches({pre}, {dq(r'(?is)<h1\b')}) "
            f"THEN {d_strip(d_decode(h1_text))} "
            f"ELSE 'Untitled' END")


def d_container(clean: str) -> str:
    """Inner HTML of article / main / body (lazy match; the derived pages do
    not nest containers), else the page without its head."""
    def inner(tag, tail=r"</{t}\s*>"):
        return f"regexp_extract({clean}, {dq(r'(?is)<' + tag + r'\b[^>]*>(.*?)(?:' + tail.format(t=tag) + ')')}, 1)"
    no_head = f"regexp_replace({clean}, {dq(r'(?is)<head\b[^>]*>.*?</head\s*>')}, {NL}, 'g')"
    return (f"CASE WHEN regexp_matches({clean}, {dq(r'(?is)<article\b')}) THEN {d_text(inner('article'))} "
            f"WHEN regexp_matches({clean}, {dq(r'(?is)<main\b')}) THEN {d_text(inner('main'))} "
            f"WHEN regexp_matches({clean}, {dq(r'(?is)<body\b')}) THEN {d_text(inner('body', r'</{t}\s*>|$'))} "
            f"WHEN {d_text(no_head)} <> '' THEN {d_text(no_head)} ELSE {d_text(clean)} END")


# ------------------------------------------------------------------ urljoin
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def d_clean_url(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"


def d_parts(c: str) -> str:
    """urlsplit of a cleaned URL as a DuckDB struct."""
    scheme = f"regexp_extract({c}, {dq(SCHEME_RE)}, 1)"
    rest = f"CASE WHEN {scheme} <> '' THEN {c}[length({scheme}) + 2:] ELSE {c} END"
    return (f"list_transform([{rest}], lambda q_rest: {{'scheme': lower({scheme}), "
            f"'netloc': CASE WHEN starts_with(q_rest, '//') THEN regexp_extract(q_rest, '^//([^/?#]*)', 1) ELSE '' END, "
            f"'after': CASE WHEN starts_with(q_rest, '//') THEN regexp_replace(q_rest, '^//[^/?#]*', '') ELSE q_rest END}})[1]")


def d_split_after(p: str) -> str:
    """path / query / fragment of the part after the netloc."""
    bf = f"regexp_extract({p}.after, '^([^#]*)', 1)"
    return (f"{{'scheme': {p}.scheme, 'netloc': {p}.netloc, "
            f"'path': regexp_extract({bf}, '^([^?]*)', 1), "
            f"'query': regexp_extract({bf}, '^[^?]*[?](.*)$', 1), "
            f"'fragment': regexp_extract({p}.after, '^[^#]*#(.*)$', 1)}}")


def d_url_struct(u: str) -> str:
    return f"list_transform([{d_parts(d_clean_url(u))}], lambda q_p: {d_split_after('q_p')})[1]"


def d_unsplit(scheme, netloc, path, query, fragment) -> str:
    body = (f"CASE WHEN {netloc} <> '' THEN '//' || {netloc} || "
            f"CASE WHEN {path} = '' OR starts_with({path}, '/') THEN {path} ELSE '/' || {path} END "
            f"WHEN starts_with({path}, '//') THEN '//' || {path} "
            f"WHEN {scheme} <> '' AND {d_in(scheme, USES_NETLOC)} AND ({path} = '' OR starts_with({path}, '/')) "
            f"THEN '//' || {path} ELSE {path} END")
    out = f"CASE WHEN {scheme} <> '' THEN {scheme} || ':' || ({body}) ELSE ({body}) END"
    out = f"CASE WHEN {query} <> '' THEN ({out}) || '?' || {query} ELSE ({out}) END"
    return f"CASE WHEN {fragment} <> '' THEN ({out}) || '#' || {fragment} ELSE ({out}) END"


def d_urljoin(base: str, b: str, ref: str) -> str:
    """urljoin(base, ref); ``b`` is ``d_url_struct(base)`` (a column). The
    parsed reference is bound once through a one-element list_transform."""
    r, scheme, r0 = "q_z.r", "q_z.scheme", "q_r0.r"
    bad = (lambda nl: f"((contains({nl}, '[') OR contains({nl}, ']')) AND NOT "
                      f"regexp_matches({nl}, '^[^\\[\\]]*\\[[0-9A-Fa-f:.]+\\][^\\[\\]]*$'))")
    has_scheme = f"regexp_extract({d_clean_url(ref)}, {dq(SCHEME_RE)}, 1) <> ''"
    base_parts = f"string_split({b}.path, '/')"
    base_dir = f"CASE WHEN {base_parts}[-1] <> '' THEN {base_parts}[1:len({base_parts}) - 1] ELSE {base_parts} END"
    rel = f"string_split({r0}.path, '/')"
    merged = f"list_concat({base_dir}, {rel})"
    merged = f"list_filter({merged}, lambda q_s, q_i: q_s <> '' OR q_i = 1 OR q_i = len({merged}))"
    segs = f"CASE WHEN starts_with({r0}.path, '/') THEN {rel} ELSE {merged} END"
    red = (f"list_reduce(q_sg, lambda q_acc, q_g: CASE WHEN q_g = '..' THEN q_acc[1:len(q_acc) - 1] "
           f"WHEN q_g = '.' THEN q_acc ELSE list_append(q_acc, q_g) END, []::VARCHAR[])")
    red = f"CASE WHEN q_sg[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END"
    rpath = (f"list_transform([array_to_string(list_transform([{segs}], lambda q_sg: {red})[1], '/')], "
             f"lambda q_rp: CASE WHEN q_rp = '' THEN '/' ELSE q_rp END)[1]")
    netloc = f"CASE WHEN {d_in(scheme, USES_NETLOC)} THEN {b}.netloc ELSE {r}.netloc END"
    query_inh = f"CASE WHEN {r}.query <> '' THEN {r}.query ELSE {b}.query END"
    body = (f"CASE WHEN {ref} = '' THEN {base} "
            f"WHEN {bad(b + '.netloc')} OR {bad(r + '.netloc')} THEN NULL "
            f"WHEN {scheme} <> {b}.scheme OR NOT {d_in(scheme, USES_RELATIVE)} THEN {ref} "
            f"WHEN {d_in(scheme, USES_NETLOC)} AND {r}.netloc <> '' "
            f"THEN {d_unsplit(scheme, r + '.netloc', r + '.path', r + '.query', r + '.fragment')} "
            f"WHEN {r}.path = '' THEN {d_unsplit(scheme, netloc, b + '.path', query_inh, r + '.fragment')} "
            f"ELSE {d_unsplit(scheme, netloc, 'q_z.rpath', r + '.query', r + '.fragment')} END")
    bind = (f"list_transform([{{'r': {d_url_struct(ref)}, 'hs': {has_scheme}}}], lambda q_r0: "
            f"{{'r': q_r0.r, 'scheme': CASE WHEN q_r0.hs THEN q_r0.r.scheme ELSE {b}.scheme END, "
            f"'rpath': CASE WHEN q_r0.r.path <> '' THEN {rpath} END}})")
    return f"list_transform({bind}, lambda q_z: {body})[1]"


def d_distinct(lst: str) -> str:
    return f"list_transform([{lst}], lambda q_l: list_filter(q_l, lambda q_x, q_j: list_position(q_l, q_x) = q_j))[1]"


def d_image_ok(u: str) -> str:
    excl = "|".join(p.replace(".", r"\.") for p in IMAGE_EXCLUDE)
    ext = "(" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + ")$"
    return (f"(NOT regexp_matches(lower({u}), {dq(excl)}) AND "
            f"(regexp_matches(lower({u}), {dq(ext)}) OR contains({u}, '?')))")


def d_link_ok(u: str) -> str:
    return f"lower(regexp_extract({d_clean_url(u)}, {dq(SCHEME_RE)}, 1)) IN ('http', 'https')"


def d_images(clean: str, base: str, b: str) -> str:
    first = (f"coalesce(nullif({d_attr('t', 'src')}, ''), nullif({d_attr('t', 'data-src')}, ''), "
             f"nullif({d_attr('t', 'data-original')}, ''))")
    refs = f"list_filter(list_transform({d_tags(clean, 'img')}, lambda t: {first}), lambda r: r IS NOT NULL)"
    urls = f"list_filter(list_transform({refs}, lambda r: {d_urljoin(base, b, 'r')}), lambda u: u IS NOT NULL AND {d_image_ok('u')})"
    return d_distinct(urls)


def d_links(clean: str, base: str, b: str) -> str:
    refs = (f"list_filter(list_transform({d_tags(clean, 'a')}, lambda t: nullif({d_attr('t', 'href')}, '')), "
            f"lambda r: r IS NOT NULL)")
    urls = f"list_filter(list_transform({refs}, lambda r: {d_urljoin(base, b, 'r')}), lambda u: u IS NOT NULL AND {d_link_ok('u')})"
    return d_distinct(urls)


def d_metadata_json(clean: str) -> str:
    metas = d_tags(clean, "meta")
    parts = []
    for key, attr, val in [("description", "name", "description"), ("author", "name", "author"),
                           ("publish_date", "property", "article:published_time"),
                           ("keywords", "name", "keywords")]:
        first = f"list_filter({metas}, lambda m: {d_attr('m', attr)} = {dq(val)})[1]"
        parts.append(f"({dq(key)}, nullif(coalesce({d_attr(first, 'content')}, ''), ''))")
    entries = f"list_filter([{', '.join(parts)}], lambda e: e[2] IS NOT NULL)"
    return f"to_json(map_from_entries({entries}))"
