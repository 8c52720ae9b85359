"""Crawl step: fetched pages -> crawl records.

All work is a narrow projection: no shuffle, one pass per page. The html
column is consumed by the extraction and never carried further, so later
joins and shuffles move only the extracted columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import html as H

CRAWL_COLUMNS = ["title", "content", "images", "links", "metadata", "shape_flags"]


def crawl(df: DataFrame, url: str = "url", html: str = "html",
          extract_images=True, extract_links=True,
          keep_boilerplate: bool = False, external_only: bool = False) -> DataFrame:
    """Add ``crawl_error, title, content, images, links, metadata,
    shape_flags, content_length``; drop ``html``. ``shape_flags`` names the
    shapes whose extraction may differ from a tree-building parser's:
    ``unclosed_boilerplate`` and ``no_body_element``.

    ``extract_images`` / ``extract_links`` are booleans or the name of a
    per-row boolean column (off -> empty list). ``keep_boilerplate`` reads
    links and images before nav/header/footer/aside/iframe removal (the
    original reads them after, so navigation links never appear).
    A failed fetch (NULL or empty body) keeps its row, with ``crawl_error``
    set and the crawl columns NULL.
    """
    keep = [c for c in df.columns if c != html]
    marked = df.selectExpr("*", f"`{html}` IS NULL OR `{html}` = '' AS _failed")
    ext = H.extract(marked, html, url, extract_images, extract_links,
                    keep_boilerplate, external_only, keep=keep + ["_failed"])
    return ext.selectExpr(
        *[f"`{c}`" for c in keep],
        f"CASE WHEN _failed THEN concat('Failed to crawl URL: ', coalesce(`{url}`, 'None')) END AS crawl_error",
        *[f"CASE WHEN NOT _failed THEN {c} END AS {c}" for c in CRAWL_COLUMNS],
        "CASE WHEN NOT _failed THEN length(content) END AS content_length")


def extraction_flags(df: DataFrame, html: str = "html") -> DataFrame:
    """The shape flags of ``crawl`` as booleans, without the extraction."""
    from ..functions.text import q
    keep = [f"`{c}`" for c in df.columns if c != html]
    s = df.selectExpr("*", f"{H.boilerplate_sql(H.preclean_sql(f'`{html}`'))} AS _boil")
    return s.selectExpr(*keep, "_boil.open AS residual_boilerplate",
                        f"NOT _boil.html RLIKE {q('(?is)<body' + H.END)} AS no_body_element")


def shape_report(flags: DataFrame) -> DataFrame:
    """One row: how many pages carry each flag (a global partial aggregate)."""
    return flags.selectExpr(
        "count(*) AS pages",
        "count_if(residual_boilerplate) AS residual_boilerplate",
        "count_if(no_body_element) AS no_body_element")
