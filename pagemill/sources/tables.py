"""Readers for the input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    """A driver table as its scan splits. ``spread_rows`` deals the rows to
    all cores first: for small tables of one split ahead of row-wise work, as
    the check queries ask for; a large table has splits enough."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if spread_rows else df


def read_pages(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """Fetched pages (page_id, url, html): the re-aimed page source."""
    return read_table(spark, sf_dir, "pages", spread_rows)
