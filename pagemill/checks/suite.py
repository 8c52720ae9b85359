"""Registered check queries (Spark) and their oracle SQL (DuckDB).

Every query reads whole driver tables (or strings derived from them by one
SQL expression both engines share, see ``derived``) and returns flat,
aliased columns so the two sides hash the same values: arrays and maps are
compared as their JSON text, counts as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import html as H
from ..functions.urls import (is_valid_image_url_sql, is_valid_link_url_sql, resolve_urls_sql,
                              url_parts_sql)
from ..operators.crawl import crawl
from ..sources.charsets import decode_pages
from ..sources.tables import read_pages
from . import derived as D
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict = {}


def json_as_varchar(sql: str) -> str:
    """Wrap every ``to_json(...)`` of DuckDB SQL in ``CAST(... AS VARCHAR)``:
    DuckDB types it JSON, Spark's to_json is a plain string."""
    out, i, key = [], 0, "to_json("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, quote = 0, j + len(key) - 1, False
        while k < len(sql):
            ch = sql[k]
            if ch == "'":
                quote = not quote
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = json_as_varchar(sql[j + len(key):k])
        out.append(sql[i:j] + "CAST(to_json(" + inner + ") AS VARCHAR)")
        i = k + 1


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = json_as_varchar(oracle)
        return fn
    return deco


def pages_with(spark: SparkSession, sf: str, html_sql: str | None = None) -> DataFrame:
    df = read_pages(spark, sf, spread_rows=True)
    if html_sql is None:
        return df
    return df.selectExpr("page_id", "url", f"{html_sql} AS html")


def _oracle_pages(html_sql: str | None = None) -> str:
    h = "html" if html_sql is None else html_sql
    return f"SELECT page_id, url, {h} AS html FROM pages"


def _oracle_clean(html_sql: str | None = None) -> str:
    """CTE chain: pre-cleaned and boilerplate-free html plus the base URL
    parts."""
    return (f"WITH p AS ({_oracle_pages(html_sql)}), "
            f"c AS (SELECT page_id, url, {O.d_url_struct('url')} AS b, {O.d_preclean('html')} AS pre FROM p), "
            f"d AS (SELECT page_id, url, b, pre, {O.d_boiler('pre')} AS clean FROM c) ")


# ------------------------------------------------------------------ O10-O13
@register("o10_title", _oracle_clean(D.TITLE_HTML) + f"SELECT page_id, {O.d_title('pre')} AS title FROM d")
def o10_title(spark, sf):
    return crawl(pages_with(spark, sf, D.TITLE_HTML), extract_images=False,
                 extract_links=False).select("page_id", "title")


@register("o11_boilerplate", _oracle_clean() + f"SELECT page_id, {O.d_text('clean')} AS page_text FROM d")
def o11_boilerplate(spark, sf):
    """Text of the whole page after boilerplate removal."""
    return pages_with(spark, sf).selectExpr(
        "page_id", f"{H.text_of_sql(H.strip_boilerplate_sql(H.preclean_sql('html')))} AS page_text")


@register("o12_container", _oracle_clean(D.CONTAINER_HTML) + f"SELECT page_id, {O.d_container('clean')} AS content FROM d")
def o12_container(spark, sf):
    return crawl(pages_with(spark, sf, D.CONTAINER_HTML), extract_images=False,
                 extract_links=False).select("page_id", "content")


@register("o13_text", _oracle_clean() + f"SELECT page_id, {O.d_container('clean')} AS content, "
                                        f"CAST(length({O.d_container('clean')}) AS BIGINT) AS content_length FROM d")
def o13_text(spark, sf):
    return crawl(pages_with(spark, sf), extract_images=False, extract_links=False).selectExpr(
        "page_id", "content", "CAST(content_length AS BIGINT) AS content_length")


# --- O01: pages as bytes, page_id % 4 -> UTF-8, UTF-16 behind a mark, declared and undeclared windows-1252
BYTES_HTML = "replace(html, '<article>', '<article><p>K\u00e4se ' || CAST(page_id AS STRING) || ' na\u00efve</p>')"
_AS_BYTES = (r"CASE WHEN page_id % 4 = 1 THEN unhex(concat('FFFE', hex(encode(html, 'UTF-16LE')))) "
             r"WHEN page_id % 4 = 0 OR html RLIKE '[^\\x00-\\x7f\\xa0-\\xff]' THEN encode(html, 'UTF-8') "
             r"ELSE encode(regexp_replace(html, '(?i)<meta charset[^>]*>', "
             r"IF(page_id % 4 = 2, '<meta charset=ISO-8859-1>', '')), 'ISO-8859-1') END")


@register("o01_page_bytes", _oracle_clean(BYTES_HTML) + f"SELECT page_id, {O.d_container('clean')} AS content, {O.d_title('pre')} AS title FROM d")
def o01_page_bytes(spark, sf):
    pages = pages_with(spark, sf, BYTES_HTML).selectExpr("page_id", "url", f"{_AS_BYTES} AS html")
    return crawl(decode_pages(pages), extract_images=False, extract_links=False).select("page_id", "content", "title")


# ------------------------------------------------------------------ O14-O21
def _candidates(spark, sf, html_sql, kind: str) -> DataFrame:
    """Resolved references before filtering, one row per reference."""
    df = pages_with(spark, sf, html_sql).selectExpr(
        "page_id", "url", f"{url_parts_sql('url')} AS _bp",
        f"{H.strip_boilerplate_sql(H.preclean_sql('html'))} AS _clean")
    if kind == "img":
        names = ["src", "data-src", "data-original"]
        first = "coalesce(" + ", ".join(f"nullif(x.`{n}`, '')" for n in names) + ")"
        refs = f"filter(transform({H.parse_tags_sql(H.tags_sql('_clean', 'img'), names)}, x -> {first}), r -> r IS NOT NULL)"
    else:
        refs = f"filter(transform({H.parse_tags_sql(H.tags_sql('_clean', 'a'), ['href'])}, x -> nullif(x.href, '')), r -> r IS NOT NULL)"
    return df.selectExpr("page_id", f"posexplode({refs}) AS (pos, ref)", "url", "_bp") \
        .selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "ref",
                    f"{resolve_urls_sql('_bp', 'url', 'array(ref)')}[0] AS resolved")


def _oracle_candidates(html_sql, kind: str) -> str:
    if kind == "img":
        first = (f"coalesce(nullif({O.d_attr('t', 'src')}, ''), nullif({O.d_attr('t', 'data-src')}, ''), "
                 f"nullif({O.d_attr('t', 'data-original')}, ''))")
        refs = f"list_filter(list_transform({O.d_tags('clean', 'img')}, lambda t: {first}), lambda r: r IS NOT NULL)"
    else:
        refs = (f"list_filter(list_transform({O.d_tags('clean', 'a')}, lambda t: nullif({O.d_attr('t', 'href')}, '')), "
                f"lambda r: r IS NOT NULL)")
    return (_oracle_clean(html_sql)
            + f", e AS (SELECT page_id, url, b, unnest({refs}) AS ref, generate_subscripts({refs}, 1) - 1 AS pos FROM d) "
            + f"SELECT page_id, CAST(pos AS BIGINT) AS pos, ref, {O.d_urljoin('url', 'b', 'ref')} AS resolved FROM e")


@register("o14_images", _oracle_clean(D.IMG_HTML)
          + f"SELECT page_id, to_json({O.d_images('clean', 'url', 'b')}) AS images FROM d")
def o14_images(spark, sf):
    return crawl(pages_with(spark, sf, D.IMG_HTML), extract_links=False).selectExpr(
        "page_id", "to_json(images) AS images")


@register("o15_image_filter", f"SELECT page_id, pos, resolved, {O.d_image_ok('resolved')} AS keep "
                              f"FROM ({_oracle_candidates(D.IMG_HTML, 'img')})")
def o15_image_filter(spark, sf):
    return _candidates(spark, sf, D.IMG_HTML, "img").selectExpr(
        "page_id", "pos", "resolved", f"{is_valid_image_url_sql('resolved')} AS keep")


@register("o16_links", _oracle_clean(D.LINK_HTML)
          + f"SELECT page_id, to_json({O.d_links('clean', 'url', 'b')}) AS links FROM d")
def o16_links(spark, sf):
    return crawl(pages_with(spark, sf, D.LINK_HTML), extract_images=False).selectExpr(
        "page_id", "to_json(links) AS links")


@register("o17_link_filter", f"SELECT page_id, pos, resolved, {O.d_link_ok('resolved')} AS keep "
                             f"FROM ({_oracle_candidates(D.LINK_HTML, 'a')}) WHERE resolved IS NOT NULL")
def o17_link_filter(spark, sf):
    return _candidates(spark, sf, D.LINK_HTML, "a").where("resolved IS NOT NULL").selectExpr(
        "page_id", "pos", "resolved", f"{is_valid_link_url_sql('resolved')} AS keep")


@register("o18_resolve_url", _oracle_candidates(D.LINK_HTML, "a"))
def o18_resolve_url(spark, sf):
    return _candidates(spark, sf, D.LINK_HTML, "a")


@register("o19_ordered_distinct", _oracle_clean(D.IMG_HTML)
          + f"SELECT page_id, to_json({O.d_images('clean', 'url', 'b')}) AS images, "
            f"CAST(len({O.d_tags('clean', 'img')}) AS BIGINT) AS n_tags, "
            f"CAST(len({O.d_images('clean', 'url', 'b')}) AS BIGINT) AS n FROM d")
def o19_ordered_distinct(spark, sf):
    """Image lists keep the first occurrence of each URL (pages with
    page_id % 8 = 7 carry two references to one URL)."""
    df = pages_with(spark, sf, D.IMG_HTML).selectExpr(
        "*", f"size({H.tags_sql(H.strip_boilerplate_sql(H.preclean_sql('html')), 'img')}) AS n_tags")
    return crawl(df, extract_links=False).selectExpr(
        "page_id", "to_json(images) AS images", "CAST(n_tags AS BIGINT) AS n_tags",
        "CAST(size(images) AS BIGINT) AS n")


@register("o20_metadata", _oracle_clean(D.META_HTML)
          + f"SELECT page_id, {O.d_metadata_json('clean')} AS metadata FROM d")
def o20_metadata(spark, sf):
    return crawl(pages_with(spark, sf, D.META_HTML), extract_images=False, extract_links=False).selectExpr(
        "page_id", "to_json(metadata) AS metadata")


@register("o21_optional_lists",
          _oracle_clean(D.IMG_HTML.replace("replace(html,", f"replace({D.LINK_HTML},", 1))
          + f"SELECT page_id, to_json(CASE WHEN page_id % 2 = 0 THEN {O.d_images('clean', 'url', 'b')} "
            f"ELSE []::VARCHAR[] END) AS images, "
            f"to_json(CASE WHEN page_id % 3 = 0 THEN {O.d_links('clean', 'url', 'b')} ELSE []::VARCHAR[] END) AS links "
            f"FROM d")
def o21_optional_lists(spark, sf):
    """Per-row flags: images on even ids, links on multiples of 3; off gives []."""
    html = D.IMG_HTML.replace("replace(html,", f"replace({D.LINK_HTML},", 1)
    df = pages_with(spark, sf, html).selectExpr("*", "page_id % 2 = 0 AS want_images",
                                                "page_id % 3 = 0 AS want_links")
    return crawl(df, extract_images="want_images", extract_links="want_links").selectExpr(
        "page_id", "to_json(images) AS images", "to_json(links) AS links")


_O22 = (_oracle_clean()
        + f", r AS (SELECT page_id, url, {O.d_title('pre')} AS title, {O.d_container('clean')} AS content, "
          f"{O.d_images('clean', 'url', 'b')} AS images, {O.d_links('clean', 'url', 'b')} AS links, "
          f"{O.d_metadata_json('clean')} AS metadata FROM d) "
          "SELECT page_id, url, NULL::VARCHAR AS crawl_error, title, content, to_json(images) AS images, "
          "to_json(links) AS links, metadata, CAST(length(content) AS BIGINT) AS content_length FROM r")


@register("o22_crawl", _O22)
def o22_crawl(spark, sf):
    return crawl(pages_with(spark, sf)).selectExpr(
        "page_id", "url", "crawl_error", "title", "content", "to_json(images) AS images",
        "to_json(links) AS links", "to_json(metadata) AS metadata",
        "CAST(content_length AS BIGINT) AS content_length")



@register("o11_shape_flags",
          _oracle_clean(D.CONTAINER_HTML)
          + "SELECT page_id, regexp_matches(clean, '(?is)<(nav|header|footer|aside|iframe)\\b') AS residual_boilerplate, "
            "NOT regexp_matches(clean, '(?is)<body\\b') AS no_body_element FROM d")
def o11_shape_flags(spark, sf):
    """Pages whose shape the expression extractor flags for review."""
    from ..operators.crawl import extraction_flags
    return extraction_flags(pages_with(spark, sf, D.CONTAINER_HTML)).select(
        "page_id", "residual_boilerplate", "no_body_element")


def _o_attr_container() -> str:
    def inner(tag, attr_re):
        return (f"regexp_extract(clean, {O.dq('(?is)<' + tag + r'\b[^>]*\s' + attr_re + r'[^>]*>(.*?)</' + tag + r'\s*>')}, 1)")
    return ("CASE page_id % 4 "
            f"WHEN 0 THEN {O.d_text(inner('div', 'role=\"main\"'))} "
            f"WHEN 1 THEN {O.d_text(inner('section', 'class=\"[^\"]*content[^\"]*\"'))} "
            f"WHEN 2 THEN {O.d_text(inner('div', 'class=' + chr(39) + 'post-content' + chr(39)))} "
            f"ELSE {O.d_text(inner('div', 'id=\"content\"'))} END")


@register("o12_container_attributes",
          _oracle_clean(D.CONTAINER_ATTR_HTML) + f"SELECT page_id, {_o_attr_container()} AS content FROM d")
def o12_container_attributes(spark, sf):
    """The attribute selectors: [role="main"], .content, .post-content, #content."""
    return crawl(pages_with(spark, sf, D.CONTAINER_ATTR_HTML), extract_images=False,
                 extract_links=False).select("page_id", "content")
