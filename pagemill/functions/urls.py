"""URL resolution and the image/link predicates, as Spark SQL expressions.

``resolve_urls_sql`` follows ``urllib.parse.urljoin`` of CPython 3.13: the
same scheme detection, netloc split, query/fragment inheritance and
dot-segment removal. Spark has no built-in for it. The work runs as a chain
of ``transform`` stages over the array of references, each stage's lambda
variable holding the previous stage's struct, so every regex runs once per
reference.
"""

from __future__ import annotations

from pyspark.sql import Column

from .text import expr, let, q, var

# Schemes for which urljoin resolves relative references.
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file",
                 "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu",
                 "sftp", "svn", "svn+ssh", "ws", "wss"]
# Schemes whose URLs carry a //netloc part.
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais",
               "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
               "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs",
               "git", "git+ssh", "ws", "wss", "itms-services"]

# Substrings that mark tracking pixels and icons, and the
# accepted image file endings.
IMAGE_EXCLUDE = ["1x1", "pixel", "tracker", "beacon", "icon", "favicon", "logo",
                 "blank.gif", "transparent.png"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]

EXCLUDE_RE = "|".join(p.replace(".", r"\.") for p in IMAGE_EXCLUDE)
EXT_RE = "(?:" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + r")\z"

SPLIT_RE = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
            r"(?:\?([^#]*))?(?:#(.*))?\z")
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC_OK = r"^[^\[\]]*\[[0-9A-Fa-f:.]+\][^\[\]]*$"
_LSTRIP_RE = r"^[\x{00}-\x{20}]+"
_UNSAFE_RE = r"[\t\r\n]"


def _in(e: str, values: list[str]) -> str:
    return f"{e} IN ({', '.join(q(v) for v in values)})"


def clean_sql(u: str) -> str:
    """lstrip C0 controls and space; drop tab, CR and LF anywhere."""
    return f"regexp_replace(regexp_replace({u}, {q(_LSTRIP_RE)}, ''), {q(_UNSAFE_RE)}, '')"


def _bad_sql(nl: str) -> str:
    return f"(({nl} LIKE '%[%' OR {nl} LIKE '%]%') AND NOT {nl} RLIKE {q(_NETLOC_OK)})"


def _split_fields(c: str) -> str:
    return ", ".join([f"'scheme', lower(regexp_extract({c}, {q(SPLIT_RE)}, 1))"] +
                     [f"'{n}', regexp_extract({c}, {q(SPLIT_RE)}, {i})"
                      for i, n in [(2, "netloc"), (3, "path"), (4, "query"), (5, "fragment")]])


def url_parts_sql(u: str) -> str:
    """``urlsplit`` of one URL as a struct (absent parts are ''), plus the
    ``bad`` flag and the path split on '/'. Compute once per row."""
    def second(p):
        return (f"named_struct('scheme', {p}.scheme, 'netloc', {p}.netloc, 'path', {p}.path, "
                f"'query', {p}.query, 'fragment', {p}.fragment, 'bad', {_bad_sql(p + '.netloc')}, "
                f"'parts', split({p}.path, '/', -1))")
    return let(let(clean_sql(u), lambda c: f"named_struct({_split_fields(c)})"), second)


def _unsplit(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    def body(p):
        return (f"CASE WHEN {netloc} <> '' THEN concat('//', {netloc}, "
                f"CASE WHEN {p} = '' OR {p} LIKE '/%' THEN {p} ELSE concat('/', {p}) END) "
                f"WHEN {p} LIKE '//%' THEN concat('//', {p}) "
                f"WHEN {scheme} <> '' AND {_in(scheme, USES_NETLOC)} AND ({p} = '' OR {p} LIKE '/%') "
                f"THEN concat('//', {p}) ELSE {p} END")
    s1 = let(path, body)
    s2 = f"CASE WHEN {scheme} <> '' THEN concat({scheme}, ':', {s1}) ELSE {s1} END"
    s3 = let(s2, lambda o: f"CASE WHEN {query} <> '' THEN concat({o}, '?', {query}) ELSE {o} END")
    return let(s3, lambda o: f"CASE WHEN {fragment} <> '' THEN concat({o}, '#', {fragment}) ELSE {o} END")


_FIELDS = ["ref", "scheme", "netloc", "path", "query", "fragment", "bad"]


def _keep(x: str, names=_FIELDS) -> str:
    return ", ".join(f"'{n}', {x}.{n}" for n in names)


def resolve_urls_sql(bp: str, base: str, refs: str) -> str:
    """``[urljoin(base, r) for r in refs]``; an element is NULL where
    urlsplit would raise (the original then loses the whole page; here only
    that reference is lost). ``bp`` is ``url_parts_sql(base)`` (a column)."""
    r, a, b, c, d, e = (var("u") for _ in range(6))
    s1 = f"transform({refs}, {r} -> named_struct('ref', {r}, 'c', {clean_sql(r)}))"
    s2 = (f"transform({s1}, {a} -> named_struct('ref', {a}.ref, "
          f"'has_scheme', regexp_extract({a}.c, {q(SCHEME_RE)}, 1) <> '', {_split_fields(a + '.c')}))")
    s3 = (f"transform({s2}, {b} -> named_struct('ref', {b}.ref, "
          f"'scheme', CASE WHEN {b}.has_scheme THEN {b}.scheme ELSE {bp}.scheme END, "
          f"'netloc', {b}.netloc, 'path', {b}.path, 'query', {b}.query, 'fragment', {b}.fragment, "
          f"'bad', {_bad_sql(b + '.netloc')}))")
    base_dir = (f"CASE WHEN element_at({bp}.parts, -1) <> '' "
                f"THEN slice({bp}.parts, 1, size({bp}.parts) - 1) ELSE {bp}.parts END")
    s_, i_ = var("s"), var("i")
    merged = let(f"concat({base_dir}, split({c}.path, '/', -1))",
                 lambda mm: f"filter({mm}, ({s_}, {i_}) -> {s_} <> '' OR {i_} = 0 OR {i_} = size({mm}) - 1)")
    segs = f"CASE WHEN {c}.path LIKE '/%' THEN split({c}.path, '/', -1) ELSE {merged} END"
    s4 = (f"transform({s3}, {c} -> named_struct({_keep(c)}, "
          f"'segs', CASE WHEN {c}.path <> '' THEN {segs} END))")
    acc, sg = var("acc"), var("sg")
    dots = (f"aggregate({d}.segs, cast(array() AS array<string>), ({acc}, {sg}) -> "
            f"CASE WHEN {sg} = '..' THEN CASE WHEN size({acc}) > 0 THEN slice({acc}, 1, size({acc}) - 1) "
            f"ELSE {acc} END WHEN {sg} = '.' THEN {acc} ELSE concat({acc}, array({sg})) END)")
    dots = (f"CASE WHEN element_at({d}.segs, -1) IN ('.', '..') "
            f"THEN concat({dots}, array('')) ELSE {dots} END")
    s5 = (f"transform({s4}, {d} -> named_struct({_keep(d)}, "
          f"'rpath', CASE WHEN {d}.segs IS NOT NULL THEN array_join({dots}, '/') END))")
    netloc_scheme = _in(f"{e}.scheme", USES_NETLOC)
    final = (f"CASE WHEN {e}.ref IS NULL THEN NULL "
             f"WHEN {base} = '' THEN {e}.ref "
             f"WHEN {e}.ref = '' THEN {base} "
             f"WHEN {bp}.bad OR {e}.bad THEN NULL "
             f"WHEN {e}.scheme <> {bp}.scheme OR NOT {_in(e + '.scheme', USES_RELATIVE)} THEN {e}.ref "
             f"WHEN {netloc_scheme} AND {e}.netloc <> '' "
             f"THEN {_unsplit(e + '.scheme', e + '.netloc', e + '.path', e + '.query', e + '.fragment')} "
             f"WHEN {e}.path = '' THEN "
             + _unsplit(f"{e}.scheme", f"CASE WHEN {netloc_scheme} THEN {bp}.netloc ELSE {e}.netloc END",
                        f"{bp}.path", f"CASE WHEN {e}.query <> '' THEN {e}.query ELSE {bp}.query END",
                        f"{e}.fragment")
             + " ELSE "
             + _unsplit(f"{e}.scheme", f"CASE WHEN {netloc_scheme} THEN {bp}.netloc ELSE {e}.netloc END",
                        f"CASE WHEN {e}.rpath = '' THEN '/' ELSE {e}.rpath END", f"{e}.query", f"{e}.fragment")
             + " END")
    return f"transform({s5}, {e} -> {final})"


def resolve_url_sql(base: str, ref: str) -> str:
    """Scalar ``urljoin(base, ref)`` (tests and one-off use)."""
    return let(url_parts_sql(base), lambda bp: f"{resolve_urls_sql(bp, base, f'array({ref})')}[0]")


def url_scheme_sql(u: str) -> str:
    return f"lower(regexp_extract({clean_sql(u)}, {q(SCHEME_RE)}, 1))"


def is_valid_image_url_sql(u: str) -> str:
    """No tracking/icon marker in the lowercased URL, and an image ending or
    a '?' anywhere."""
    return (f"(NOT lower({u}) RLIKE {q(EXCLUDE_RE)} AND "
            f"(lower({u}) RLIKE {q(EXT_RE)} OR {u} LIKE '%?%'))")


def is_valid_link_url_sql(u: str, base_netloc: str | None = None, external_only: bool = False) -> str:
    """Scheme is http or https. ``external_only`` adds the host check the
    original leaves commented out."""
    ok = f"{url_scheme_sql(u)} IN ('http', 'https')"
    if external_only and base_netloc is not None:
        ok = f"({ok} AND regexp_extract({clean_sql(u)}, {q(SPLIT_RE)}, 2) <> {base_netloc})"
    return ok


def resolve_url(base: str, ref: str) -> Column:
    return expr(resolve_url_sql(base, ref))


def is_valid_image_url(u: str) -> Column:
    return expr(is_valid_image_url_sql(u))


def is_valid_link_url(u: str) -> Column:
    return expr(is_valid_link_url_sql(u))
