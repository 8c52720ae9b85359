"""HTML extraction as Spark SQL string/array expressions.

The page is never parsed into a tree. Extraction follows the order of the
original extractor: the title is read from the page as fetched, then
boilerplate subtrees are removed, and the main text, images, links and
metadata are read from what is left.

Exactness: results equal a real HTML parser's whenever the removed elements
and the chosen container are well formed (properly closed). Removed elements
may nest to any depth; one that is never closed runs to the end of the
removed element around it, or of the body, and is reported in the row's
``shape_flags``. A container holding elements of its own name
(``<div class="content">`` with inner divs) is matched by counting start and
end tags. Where tags cross the edge of a removed element or of the container
(``<nav><div></nav></div>``), the page goes through a second lane, which walks
all its tags with a stack of open elements, as a repairing parser does
(``spans_sql``).

``extract`` computes every intermediate once, in its own projection (a
value referenced twice is never inlined twice), and per-tag work runs as
``transform`` chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .text import decode_entities_sql, join_lines_sql, let, pystrip_sql, q, var
from .urls import is_valid_image_url_sql, is_valid_link_url_sql, resolve_urls_sql, url_parts_sql

# attribute region of a start tag; quoted values may hold '>'
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# lazy form for "find this attribute inside the tag": word runs are taken
# whole (one step each), so the engine's per-step recursion stays shallow
# even for very long tags; it may stop before any whitespace character
ATTRS_LAZY = r"""(?:[^>"'\s]++|\s|"[^"]*+"|'[^']*+')*?"""

# a tag name ends at white space, "/" or ">" (a word boundary would also stop at "-")
END = r"(?=[\s/>])"

# Any tag, marker, doctype or processing instruction.
TAG_RE = r"</?[A-Za-z][^\s/>]*+" + ATTRS + r">|<![^>]*+>|<\?[^>]*+>"

# Comments, scripts and styles, left to right as a tokenizer meets them.
# Each becomes the empty marker "<!>": it separates text nodes (as the
# removed node did) but contributes no text.
RAW_RE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)" + END + ATTRS + r">.*?(?:</\1\s*>|\z)"
MARK = "<!>"

# Subtrees removed as boilerplate.
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer", "aside", "iframe"]
# (scripts and styles are removed earlier, with comments, by RAW_RE)
_BOILER = "(" + "|".join(t for t in BOILERPLATE_TAGS if t not in ("script", "style")) + ")" + END
_BODY_END = "</(?:body|html)" + END
BOILER_CUT = "(?i)(?=</?" + _BOILER + "|" + _BODY_END + ")"

# Main-container selectors, in priority order.
CONTAINER_SELECTORS = ["article", "main", '[role="main"]', ".content", ".post-content", "#content"]


def _value_is(value: str) -> str:
    """An attribute value equal to ``value`` (case-sensitive), any quoting."""
    return f"""(?-i:"{value}"|'{value}'|{value}(?=[\\s/>]))"""


def _class_has(token: str) -> str:
    return (f"""(?-i:"(?:[^"]*\\s)?{token}(?:\\s[^"]*)?"|'(?:[^']*\\s)?{token}(?:\\s[^']*)?'"""
            f"""|{token}(?=[\\s/>]))""")


def open_tag_re(name: str) -> str:
    return r"(?is)<(" + name + ")" + END + ATTRS + ">"


def _open_with_attr(attr_name: str, value_re: str) -> str:
    return (r"(?is)<([a-z][^\s/>]*)" + ATTRS_LAZY + r"\s" + attr_name + r"\s*=\s*" + value_re
            + ATTRS + ">")


SELECTOR_RE = {
    "article": open_tag_re("article"),
    "main": open_tag_re("main"),
    '[role="main"]': _open_with_attr("role", _value_is("main")),
    ".content": _open_with_attr("class", _class_has("content")),
    ".post-content": _open_with_attr("class", _class_has("post-content")),
    "#content": _open_with_attr("id", _value_is("content")),
    "body": open_tag_re("body"),
}

TITLE_RE = r"(?is)<title" + END + ATTRS + r">(.*?)</title\s*>"
H1_OPEN = r"(?is)<h1" + END + ATTRS + ">"
H1_RE = r"(?is)<h1" + END + ATTRS + r">(.*?)(?:</h1\s*>|\z)"
_LIST_TAGS_RE = r"(?is)<(?:img|a|meta)" + END + ATTRS + ">"
HEAD_RE = r"(?is)<head" + END + ATTRS + r">.*?(?:</head\s*>|\z)|<title" + END + ATTRS + r">.*?</title\s*>"


# How a repairing parser nests. An end tag closes the innermost
# element of its name and all within it, unless one of a higher rank is open
# inside (names without a rank have 100); it is ignored then, or if no such
# element is open.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
            "table": 190, "head": 200, "body": 200, "html": 220}
# Elements without content.
VOID_TAGS = ["area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex",
             "link", "meta", "param", "source", "track", "wbr"]
# Start tags, and the innermost open elements that they end.
_BLOCKS = ["address", "blockquote", "center", "dir", "div", "dl", "fieldset", "form", "h1", "h2", "h3", "h4", "h5", "h6",
           "menu", "ol", "p", "pre", "table", "ul"]
START_ENDS = {**{b: ["p", "head"] for b in _BLOCKS}, "body": ["head"], "a": ["a"], "li": ["li", "p"], "dt": ["dt", "dd", "p"], "dd": ["dt", "dd", "p"],
              "option": ["option"], "td": ["td", "th", "p"], "th": ["td", "th", "p"], "tr": ["td", "th", "tr", "p"],
              **{g: ["td", "th", "tr", "thead", "tbody", "tfoot", "p"] for g in ("thead", "tbody", "tfoot")}}

# a page as tags, markers and text, nothing left out
_TOKEN_RE = TAG_RE + "|[^<]++|<"
# names of tags whose nesting is to be looked at
_CROSSING_RE = "(?i)<(?!/?(?:" + "|".join(VOID_TAGS + BOILERPLATE_TAGS) + ")" + END + r")(/?[a-z][^\s/>]*+)"
# in a list of names with a blank behind each: a start tag and its end tag side by side
_PAIR_RE = r"(?<![^ ])([^ /]++) /\1 "


# ------------------------------------------------------------------ SQL builders
def preclean_sql(html: str) -> str:
    """Comments, scripts and styles replaced by a neutral marker."""
    return f"regexp_replace({html}, {q(RAW_RE)}, {q(MARK)})"


def boilerplate_sql(pre: str) -> str:
    """``named_struct('html', rest, 'open', bool, 'gone', text)``: ``pre``
    without its nav/header/footer/aside/iframe subtrees (scripts and styles are
    already gone), whether one of them is never closed, and what was removed. The page is cut before
    each of their tags and a stack of open names walks the pieces; an end tag
    closes the innermost element of its name and all within it, others are
    ignored. A removed subtree leaves a line feed."""
    st, c, n, p, f = var("st"), var("c"), var("n"), var("p"), var("f")
    start = f"regexp_extract({c}, {q('(?i)^</?' + _BOILER)}, 1)"
    keep = lambda stack, text: (f"IF(size({stack}) = 0, concat({st}.out, array({text})), {st}.out), "  # noqa: E731
                                f"'gone', IF(size({stack}) = 0, {st}.gone, concat({st}.gone, array({c})))")
    plain = let(f"IF({c} RLIKE {q('(?i)^' + _BODY_END)}, cast(array() AS array<string>), {st}.st)",
                lambda s: f"named_struct('st', {s}, 'open', {st}.open OR size({s}) < size({st}.st), 'out', {keep(s, c)})")
    opened = (f"named_struct('st', concat({st}.st, array({n})), 'open', {st}.open, "
              f"'out', IF(size({st}.st) = 0, concat({st}.out, array({q(chr(10))})), {st}.out), 'gone', concat({st}.gone, array({c})))")
    closed = let(f"slice({st}.st, 1, size({st}.st) - int({p}))", lambda s: (
        f"named_struct('st', {s}, 'open', {st}.open OR {p} > 1, "
        f"'out', {keep(s, f'regexp_replace({c}, {q(r"^</[^>]*+>?")}, {q(chr(10))})')})"))
    step = (f"transform(array(lower({start})), {n} -> CASE WHEN {n} = '' THEN {plain} WHEN NOT startswith({c}, '</') THEN {opened} "
            f"ELSE transform(array(array_position(reverse({st}.st), {n})), {p} -> CASE WHEN {p} = 0 THEN named_struct('st', {st}.st, "
            f"'open', {st}.open, 'out', {keep(st + '.st', c)}) ELSE {closed} END)[0] END)[0]")
    empty = "cast(array() AS array<string>)"
    return (f"CASE WHEN {pre} RLIKE {q('(?i)<' + _BOILER)} THEN aggregate(split({pre}, {q(BOILER_CUT)}, -1), "
            f"named_struct('st', {empty}, 'open', false, 'out', {empty}, 'gone', {empty}), ({st}, {c}) -> {step}, "
            f"{f} -> named_struct('html', array_join({f}.out, ''), 'open', {f}.open OR size({f}.st) > 0, 'gone', array_join({f}.gone, ''))) "
            f"ELSE named_struct('html', {pre}, 'open', false, 'gone', '') END")


def crossed_sql(part: str) -> str:
    """Whether tags cross the edge of ``part``: an end tag in it closes what was
    opened before it, or an element that end tags of a lower rank do not close
    is still open behind it. Names of nav/header/footer/aside/iframe are left
    out; their nesting is known."""
    tags, n, s, x = var("tags"), var("n"), var("s"), var("x")
    ranked = ", ".join(q(t) for t in END_RANK if t not in ("head", "body", "html"))
    names = f"lower(concat(array_join(regexp_extract_all({part}, {q(_CROSSING_RE)}, 1), ' '), ' '))"
    for _ in range(3):  # leaves, then what holds leaves only: a pair changes no depth around it
        names = f"regexp_replace({names}, {q(_PAIR_RE)}, '')"
    depth = (f"aggregate({tags}, named_struct('d', 0, 'low', 0), ({s}, {x}) -> CASE WHEN {x} = {n} THEN named_struct('d', {s}.d + 1, 'low', {s}.low) "
             f"WHEN {x} = concat('/', {n}) THEN named_struct('d', {s}.d - 1, 'low', least({s}.low, {s}.d - 1)) ELSE {s} END)")
    found = let(depth, lambda d: f"{d}.low < 0 OR ({d}.d > 0 AND {n} IN ({ranked}))")
    return (f"transform(array(split(rtrim({names}), ' ')), {tags} -> exists(filter(array_distinct(transform({tags}, {x} -> ltrim('/', {x}))), "
            f"{n} -> {n} <> ''), {n} -> {found}))[0]")


def tag_names_sql(tokens: str) -> str:
    """Per token ``name`` of a start tag, ``/name`` of an end tag, '' of
    anything else, of elements without content and of tags that close themselves."""
    t, n = var("t"), var("n")
    void = ", ".join(q(v) for v in VOID_TAGS)
    return (f"transform(transform({tokens}, {t} -> IF({t} RLIKE '/>$', '', lower(regexp_extract({t}, {q(r'^<(/?[A-Za-z][^\s/>]*+)')}, 1)))), "
            f"{n} -> IF({n} IN ({void}), '', {n}))")


def spans_sql(names: str, wanted) -> str:
    """array<struct<a, b>>: the places in ``names`` (of ``tag_names_sql``) from
    the start tag of each outermost wanted element to the tag that closes it.
    ``wanted(name, place)`` is SQL. All tags are walked with a stack of open
    elements by the rules of ``END_RANK`` and ``START_ENDS``; html, head and
    body open once, further start tags of theirs and their end tags count for nothing."""
    z, e, f, n, r, k, m, w = (var(c) for c in "zefnrkmw")
    empty = "cast(array() AS array<string>)"
    rank = lambda name: f"CASE {name} " + " ".join(f"WHEN {q(t)} THEN {v}" for t, v in END_RANK.items()) + " ELSE 100 END"
    groups: dict = {}
    for tag, old in START_ENDS.items():
        groups.setdefault(tuple(old), []).append(tag)
    # open elements that a start tag ends: those from the top up to the first other one
    ended = " ".join(f"WHEN {e} IN ({', '.join(q(t) for t in tags)}) THEN "
                     + let(f"array_position(transform(reverse({z}.st), {w} -> {w} IN ({', '.join(q(o) for o in old)})), false)",
                           lambda p: f"IF({p} = 0, size({z}.st), int({p}) - 1)")
                     for old, tags in groups.items())
    once = f"{e} IN ('html', 'head', 'body') AND array_contains({z}.st, {e})"
    state = lambda st, d, lvl, a, spans: (f"named_struct('i', {z}.i + 1, 'st', {st}, 'd', {d}, 'lvl', {lvl}, 'a', {a}, 'spans', {spans})")
    same = state(f"{z}.st", f"{z}.d", f"{z}.lvl", f"{z}.a", f"{z}.spans")
    opened = let(f"slice({z}.st, 1, size({z}.st) - (CASE {ended} ELSE 0 END))", lambda s: (
        f"IF({z}.lvl = 0 AND ({wanted(e, z + '.i')}), {state(f'concat({s}, array({e}))', z + '.d', f'size({s}) + 1', z + '.i', z + '.spans')}, "
        f"{state(f'concat({s}, array({e}))', z + '.d', z + '.lvl', z + '.a', z + '.spans')})"))
    # the tag's place from the top of the stack, 0 where it closes nothing
    place = (f"transform(array(substring({e}, 2)), {n} -> transform(array(reverse({z}.st)), {r} -> transform(array(int(array_position({r}, {n}))), "
             f"{k} -> IF({k} > 0 AND exists(slice({r}, 1, {k}), {m} -> {rank(m)} > {rank(n)}), 0, {k}))[0])[0])[0]")
    closed = let(f"size({z}.st) - {place}", lambda s: (
        f"IF({z}.lvl > {s}, {state(f'slice({z}.st, 1, {s})', z + '.d', '0', z + '.a', f"concat({z}.spans, array(named_struct('a', {z}.a, 'b', {z}.i)))")}, "
        f"{state(f'slice({z}.st, 1, {s})', z + '.d', z + '.lvl', z + '.a', z + '.spans')})"))
    step = (f"CASE WHEN {e} = '' THEN {same} WHEN {once} THEN {state(z + '.st', z + '.d + 1', z + '.lvl', z + '.a', z + '.spans')} "
            f"WHEN {z}.d > 0 AND {e} IN ('/html', '/head', '/body') THEN {state(z + '.st', z + '.d - 1', z + '.lvl', z + '.a', z + '.spans')} "
            f"WHEN startswith({e}, '/') THEN {closed} ELSE {opened} END")
    return (f"aggregate({names}, named_struct('i', 0, 'st', {empty}, 'd', 0, 'lvl', 0, 'a', 0, "
            f"'spans', cast(array() AS array<struct<a: int, b: int>>)), ({z}, {e}) -> {step}, "
            f"{f} -> IF({f}.lvl = 0, {f}.spans, concat({f}.spans, array(named_struct('a', {f}.a, 'b', {f}.i)))))")


def without_spans_sql(tokens: str, spans: str) -> str:
    """``tokens`` with a line feed for the first token of each span and '' for its others."""
    t, i, x = var("t"), var("i"), var("x")

    def cut(found):
        start = f"coalesce(get(filter({found}, {x} -> {i} BETWEEN {x}.a AND {x}.b), 0).a, -1)"
        return (f"transform({tokens}, ({t}, {i}) -> "
                + let(start, lambda a: f"CASE WHEN {a} = -1 THEN {t} WHEN {a} = {i} THEN {q(chr(10))} ELSE '' END") + ")")
    # bound once: inside the lambda it would be found again for every token
    return let(spans, cut)


def strip_boilerplate_sql(pre: str) -> str:
    """``pre`` without its boilerplate subtrees."""
    return f"({boilerplate_sql(pre)}).html"


def text_of_sql(fragment: str) -> str:
    """``get_text(separator='\\n', strip=True)`` plus the line clean-up:
    every tag splits text, lines are stripped, blank lines dropped, the rest
    joined by blank lines."""
    return join_lines_sql(decode_entities_sql(f"regexp_replace({fragment}, {q(TAG_RE)}, {q(chr(10))})"))


def inline_text_sql(fragment: str) -> str:
    """``get_text().strip()`` -- no separator (used for ``<h1>``)."""
    return pystrip_sql(decode_entities_sql(f"regexp_replace({fragment}, {q(TAG_RE)}, '')"))


def tags_sql(html: str, name: str) -> str:
    """All start tags ``<name ...>`` in document order."""
    return f"regexp_extract_all({html}, {q(open_tag_re(name))}, 0)"


# one attribute: its name and, after "=", its value in quotes or bare
_ATTR_RE = r"""([^\s"'>/=][^\s>/=]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?"""


def parse_tags_sql(tag_list: str, names: list[str]) -> str:
    """array<struct<name: decoded value, '' when absent>> per start tag. Each
    tag is read once, left to right, as (name, value) pairs, so nothing inside
    a quoted value counts; of repeated attributes the first does."""
    a, b, c, d, x = var("t"), var("t"), var("t"), var("t"), var("x")
    pairs = (f"named_struct('n', transform(regexp_extract_all({a}, {q(_ATTR_RE)}, 1), {x} -> lower({x})), "
             f"'v', regexp_extract_all({a}, {q(_ATTR_RE)}, 2))")
    body = f"transform({tag_list}, {d} -> regexp_replace({d}, {q(r'^<[^\s/>]*+')}, ''))"
    raw = ", ".join(f"'a{i}', coalesce(get({b}.v, int(array_position({b}.n, {q(n)})) - 1), '')" for i, n in enumerate(names))
    bare = lambda v: f"IF({v} RLIKE {q("^[\"']")}, substring({v}, 2, length({v}) - 2), {v})"
    dec = ", ".join(f"{q(n)}, {decode_entities_sql(bare(f'{c}.a{i}'))}" for i, n in enumerate(names))
    return (f"transform(transform(transform({body}, {a} -> {pairs}), {b} -> named_struct({raw})), "
            f"{c} -> named_struct({dec}))")


def first_value_sql(parsed: str, key_attr: str, key: str, value_attr: str = "content") -> str:
    """``value_attr`` of the first parsed tag whose ``key_attr`` equals
    ``key`` ('' when absent); later tags are never consulted."""
    m = var("m")
    return f"coalesce(get(filter({parsed}, {m} -> {m}.`{key_attr}` = {q(key)}), 0).`{value_attr}`, '')"


def balanced_inner_sql(rest: str, chunks: str, name: str) -> str:
    """Inner HTML of an element whose start tag ended just before ``rest``;
    ``chunks`` is ``rest`` cut before every start/end tag of the same name.
    Depth is counted until it returns to zero; unclosed elements run to the
    end."""
    st, ch, f = var("st"), var("ch"), var("f")
    delta = (f"CASE WHEN {ch} RLIKE concat('(?is)^<\\\\Q', {name}, '\\\\E(?=[\\\\s/>])') THEN 1 "
             f"WHEN {ch} RLIKE concat('(?is)^</\\\\Q', {name}, '\\\\E(?=[\\\\s/>])') THEN -1 ELSE 0 END")
    step = (f"CASE WHEN {st}.d = 0 THEN {st} "
            f"WHEN {st}.d + {delta} = 0 THEN named_struct('d', 0, 'k', {st}.k) "
            f"ELSE named_struct('d', {st}.d + {delta}, 'k', {st}.k + 1) END")
    agg = f"aggregate({chunks}, named_struct('d', 1, 'k', 0), ({st}, {ch}) -> {step})"
    return (f"transform(array({agg}), {f} -> CASE WHEN {f}.d > 0 THEN {rest} "
            f"ELSE array_join(slice({chunks}, 1, {f}.k), '') END)[0]")


# Metadata keys, the attribute naming them, and its value.
META_KEYS = [("description", "name", "description"),
             ("author", "name", "author"),
             ("publish_date", "property", "article:published_time"),
             ("keywords", "name", "keywords")]


def metadata_sql(parsed_meta: str) -> str:
    """MAP of the four keys; a key is absent when its first tag has an empty
    ``content`` (values are not stripped)."""
    k, v = var("k"), var("v")
    keys = ", ".join(q(key) for key, _, _ in META_KEYS)
    vals = ", ".join(first_value_sql(parsed_meta, a, val) for _, a, val in META_KEYS)
    return f"map_filter(map_from_arrays(array({keys}), array({vals})), ({k}, {v}) -> {v} <> '')"


# ------------------------------------------------------------------ staged extraction
def _flag_sql(flag) -> str | bool:
    if isinstance(flag, bool):
        return flag
    return f"coalesce({flag}, true)"


def extract(df: DataFrame, html: str, url: str, extract_images=True, extract_links=True,
            keep_boilerplate: bool = False, external_only: bool = False,
            keep: list[str] | None = None) -> DataFrame:
    """Add ``title, content, images, links, metadata, shape_flags`` from ``html``.

    ``extract_images`` / ``extract_links``: bool, or the name of a per-row
    boolean column (off -> empty list). ``keep`` are the columns carried
    along (default: all but ``html``).
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != html])
    K = [f"`{c}`" for c in keep]

    s = df.selectExpr(*K, f"`{url}` AS _url", f"{url_parts_sql(f'`{url}`')} AS _bp",
                      f"{preclean_sql(f'`{html}`')} AS _pre")
    # title inputs, read before boilerplate removal
    s = s.selectExpr(*K, "_url", "_bp", "_pre",
                     f"regexp_instr(_pre, {q(TITLE_RE)}) > 0 AS _t_found",
                     f"regexp_extract(_pre, {q(TITLE_RE)}, 1) AS _t_inner",
                     f"{parse_tags_sql(tags_sql('_pre', 'meta'), ['property', 'content'])} AS _pmeta",
                     f"regexp_instr(_pre, {q(H1_OPEN)}) > 0 AS _h1_found",
                     f"regexp_extract(_pre, {q(H1_RE)}, 1) AS _h1",
                     f"{boilerplate_sql('_pre')} AS _boil")
    og = first_value_sql("_pmeta", "property", "og:title")
    title = (f"CASE WHEN _t_found AND _t_inner <> '' AND NOT _t_inner LIKE '%<%' "
             f"THEN {pystrip_sql(decode_entities_sql('_t_inner'))} "
             f"WHEN {og} <> '' THEN {pystrip_sql(og)} "
             f"WHEN _h1_found THEN {inline_text_sql('_h1')} ELSE 'Untitled' END")
    sel = lambda page: "CASE " + " ".join(
        f"WHEN regexp_instr({page}, {q(SELECTOR_RE[s_])}) > 0 THEN {q(SELECTOR_RE[s_])}" for s_ in CONTAINER_SELECTORS + ["body"]) + " END"
    carry = [*K, "_url", "_bp", "_pre", "_clean", "_open"]
    s = s.selectExpr("*", "_boil.html AS _clean", "_boil.open AS _open")
    s = s.selectExpr(*carry, f"{title} AS title", f"{sel('_clean')} AS _sel_re", f"{crossed_sql('_boil.gone')} AS _crossed")
    carry.append("title")
    # the chosen container: its start tag, tag name and the text after it
    s = s.selectExpr(*carry, "_sel_re", "_crossed",
                     "regexp_instr(_clean, _sel_re) AS _pos",
                     "regexp_extract(_clean, _sel_re, 0) AS _otag",
                     "lower(regexp_extract(_clean, _sel_re, 1)) AS _name")
    s = s.selectExpr(*carry, "_sel_re", "_crossed", "_name",
                     "CASE WHEN _pos > 0 THEN substring(_clean, _pos + length(_otag)) END AS _rest")
    s = s.selectExpr(*carry, "_sel_re", "_crossed", "_name", "_rest",
                     "split(_rest, concat('(?i)(?=</?\\\\Q', _name, '\\\\E(?=[\\\\s/>]))'), -1) AS _chunks")
    s = s.selectExpr(*carry, "_sel_re", "_crossed", "_name",
                     f"CASE WHEN _sel_re IS NOT NULL THEN {balanced_inner_sql('_rest', '_chunks', '_name')} END AS _inner")
    # the second lane, for pages whose tags cross the edge of a removed element or of the container
    s = s.selectExpr(*carry, "_sel_re", "_inner",
                     f"_crossed OR (_name <> 'body' AND {crossed_sql('_inner')}) AS _crossed")
    s = s.selectExpr(*carry, "_sel_re", "_inner", "coalesce(_crossed, false) AS _crossed",
                     f"CASE WHEN _crossed THEN regexp_extract_all(_pre, {q(_TOKEN_RE)}, 0) END AS _tokens")
    lane = ["_sel_re", "_inner", "_crossed"]
    s = s.selectExpr(*carry, *lane, "_tokens", f"CASE WHEN _crossed THEN {tag_names_sql('_tokens')} END AS _names")
    removed = ", ".join(q(t) for t in BOILERPLATE_TAGS)
    s = s.selectExpr(*carry, *lane, "_tokens", "_names",
                     f"CASE WHEN _crossed THEN {spans_sql('_names', lambda n, i: f'{n} IN ({removed})')} END AS _spans")
    s = s.selectExpr(*carry, *lane, "_names", f"CASE WHEN _crossed THEN {without_spans_sql('_tokens', '_spans')} END AS _kept")
    carry.remove("_clean")
    s = s.selectExpr(*carry, "_inner", "_crossed", "_names", "_kept", "_sel_re", "IF(_crossed, array_join(_kept, ''), _clean) AS _clean")
    carry.append("_clean")
    s = s.selectExpr(*carry, "_inner", "_crossed", "_names", "_kept", f"IF(_crossed, {sel('_clean')}, _sel_re) AS _sel_re")
    g = var("g")
    s = s.selectExpr(*carry, "_inner", "_crossed", "_names", "_kept", "_sel_re",
                     f"CASE WHEN _crossed THEN int(array_position(transform(_kept, {g} -> {g} RLIKE concat('^', _sel_re)), true)) - 1 END AS _at")
    s = s.selectExpr(*carry, "_inner", "_crossed", "_kept", "_sel_re", "_at",
                     f"CASE WHEN _at >= 0 THEN get({spans_sql('_names', lambda n, i: f'{i} = _at')}, 0) END AS _span")
    s = s.selectExpr(*carry, "_sel_re", "_crossed",
                     "CASE WHEN NOT _crossed THEN _inner WHEN _span IS NULL THEN '' "
                     "ELSE array_join(slice(_kept, _at + 2, _span.b - _at), '') END AS _inner")
    no_head = f"regexp_replace(_clean, {q(HEAD_RE)}, {q(chr(10))})"
    content = (f"CASE WHEN _sel_re IS NOT NULL THEN {text_of_sql('_inner')} "
               f"WHEN {text_of_sql(no_head)} <> '' THEN {text_of_sql(no_head)} "
               f"ELSE {text_of_sql('_clean')} END")
    s = s.selectExpr(*carry, "_crossed", f"{content} AS content")

    # one scan per page collects every start tag the lists and metadata
    # need; each list then filters it by tag name
    # (keep_boilerplate reads the link/image tags before removal)
    ltags = (f"regexp_extract_all(_pre, {q(_LIST_TAGS_RE)}, 0)" if keep_boilerplate
             else "CAST(NULL AS ARRAY<STRING>)")
    flags = ("array_compact(array(IF(_open, 'unclosed_boilerplate', NULL), "
             f"IF(_clean RLIKE {q('(?is)<body' + END)}, NULL, 'no_body_element'), IF(_crossed, 'crossed_elements', NULL))) AS shape_flags")
    s = s.selectExpr(*K, "_url", "_bp", "title", "content", flags,
                     f"regexp_extract_all(_clean, {q(_LIST_TAGS_RE)}, 0) AS _tags", f"{ltags} AS _ltags")
    src = "_ltags" if keep_boilerplate else "_tags"
    empty = "cast(array() AS array<string>)"

    def of(tags_col, name):
        t = var("g")
        return f"filter({tags_col}, {t} -> {t} RLIKE {q('(?i)^<' + name + END)})"

    def gated(flag, build):
        f = _flag_sql(flag)
        if f is True:
            return build()
        if f is False:
            return empty
        return f"CASE WHEN {f} THEN {build()} ELSE {empty} END"

    def images():
        names = ["src", "data-src", "data-original"]
        x, r, u = var("x"), var("r"), var("u")
        first = "coalesce(" + ", ".join(f"nullif({x}.`{n}`, '')" for n in names) + ")"
        refs = f"filter(transform({parse_tags_sql(of(src, 'img'), names)}, {x} -> {first}), " \
               f"{r} -> {r} IS NOT NULL)"
        urls = resolve_urls_sql("_bp", "_url", refs)
        return f"array_distinct(filter({urls}, {u} -> {u} IS NOT NULL AND {is_valid_image_url_sql(u)}))"

    def links():
        x, r, u = var("x"), var("r"), var("u")
        refs = f"filter(transform({parse_tags_sql(of(src, 'a'), ['href'])}, " \
               f"{x} -> nullif({x}.href, '')), {r} -> {r} IS NOT NULL)"
        urls = resolve_urls_sql("_bp", "_url", refs)
        ok = is_valid_link_url_sql(u, "_bp.netloc", external_only)
        return f"array_distinct(filter({urls}, {u} -> {u} IS NOT NULL AND {ok}))"

    s = s.selectExpr(*K, "title", "content", "shape_flags",
                     f"{gated(extract_images, images)} AS images",
                     f"{gated(extract_links, links)} AS links",
                     f"{parse_tags_sql(of('_tags', 'meta'), ['name', 'property', 'content'])} AS _meta")
    return s.selectExpr(*K, "title", "content", "images", "links", f"{metadata_sql('_meta')} AS metadata", "shape_flags")
