"""Site-relative line deduplication, all in DataFrame functions.

A line is boilerplate of a host when the pages of that host that contain it
exceed a given share of the host's pages. Each page counts a line once, lines
are counted by 64-bit hash with partial aggregates, and only lines above the
ratio survive: since the shares of a host's lines add up to its mean lines per
page, at most (mean lines per page / ratio) of them, whatever the number of
pages. They are gathered into one array per host, staged, and joined to the
pages by host (broadcast by Spark when the table is small, otherwise a
sort-merge join whose hot hosts AQE splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import packed, staged, unpacked

# a line without its surrounding ASCII white space
_LINE = "btrim(l, ' \\t\\r\\f' || chr(11))"


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, drop): per host the hashes of its boilerplate lines. A null host is a host of its own."""
    p = pages.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    total = p.groupBy("_host").agg(F.count("*").alias("_total"))
    lines = p.select("_host", F.expr(
        f"explode(array_distinct(transform(split(_text, '\\n', -1), l -> IF({_LINE} = '', NULL, xxhash64({_LINE})))))"
    ).alias("_line")).where("_line IS NOT NULL")
    # two levels: whole-table counts of rare lines never reach the join
    count = lines.groupBy("_host", "_line").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    count = staged(count, "line-counts")
    found = (count.withColumn("_k", F.coalesce("_host", F.lit(""))).withColumn("_z", F.col("_host").isNull())
             .join(total.withColumn("_k", F.coalesce("_host", F.lit(""))).withColumn("_z", F.col("_host").isNull())
                   .drop("_host"), ["_k", "_z"])
             .where(F.col("_pages") > F.col("_total") * F.lit(ratio)))
    return found.groupBy("_k", "_z").agg(F.sort_array(F.collect_set("_line")).alias("_drop"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text",
                     ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``pages`` with ``text_col`` cleaned, all other columns and rows as they
    were, and ``n_lines`` (lines of the text) and ``n_dropped`` added or replaced.

    Lines are split at line feeds and compared without surrounding ASCII white
    space; blank lines always stay. A line goes when more than ``ratio`` of
    its host's pages, and at least ``min_pages`` of them, contain it. Null
    hosts form one host, a null text stays null with 0 lines, a text of which
    nothing is left becomes empty, an empty table stays empty. Repeated rows
    count as pages of their own.
    """
    drop = staged(boilerplate_lines(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    host, text = F.col("_row").getField(host_col), F.col("_row").getField(text_col)
    out = (packed(pages, "n_lines", "n_dropped").withColumn("_k", F.coalesce(host, F.lit(""))).withColumn("_z", host.isNull())
           .join(drop, ["_k", "_z"], "left").withColumn("_in", F.split(text, "\n", -1))
           .withColumn("_out", F.expr(f"IF(_drop IS NULL, _in, filter(_in, l -> NOT array_contains(_drop, xxhash64({_LINE}))))"))
           .withColumn("n_lines", F.greatest(F.size("_in"), F.lit(0)).cast("long"))
           .withColumn("n_dropped", F.greatest(F.size("_in") - F.size("_out"), F.lit(0)).cast("long")))
    return unpacked(out, "n_lines", "n_dropped",
                    **{text_col: F.when(F.col("n_dropped") == 0, text).otherwise(F.array_join("_out", "\n"))})
