"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of a prefix, then by the full
SHA-256; each step runs only on what the previous one left in groups of two or
more. Only the last one needs whole texts: a fixed-size bit filter on
(length, prefix hash) keeps the texts of settled rows out of its shuffle.

Groups are counted with partial aggregates and joined back, never collected,
so a group holding a third of all rows is a hot join key on one side only,
which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import BitFilter, lower_ascii, staged


def normalised(text: str = "text"):
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                     filter_bits: int = 1 << 22, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id`` (largest id of the equal
    texts), ``group_size``, ``kept`` and ``text_sha256`` (null for texts that
    an earlier step settled, unless ``digest_all``).

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty (so null and '' are one group). ``kept`` marks the row whose id is
    ``keep_id``; rows that repeat an id with the same text are all counted and
    share the mark, a null id is kept only where its whole group has null
    ids. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm")).select(
        "_id", F.octet_length("_norm").cast("long").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_pfx"), "_norm")
    # _pfx only refines groups: the decision is on the digest of the whole text
    keys = staged(rows.drop("_norm"), "exact-keys")
    lengths = keys.groupBy("_len").count().where("count > 1").select("_len")
    prefixes = staged(keys.join(lengths, "_len", "left_semi").groupBy("_len", "_pfx").count()
                      .where("count > 1").select("_len", "_pfx"), "exact-prefixes")
    sha = F.sha2("_norm", 256).alias("_sha")
    if digest_all:
        digests = staged(rows.select("_id", "_len", "_pfx", sha), "exact-digests")
        survivors = digests.join(prefixes, ["_len", "_pfx"], "left_semi")
        settled = digests.join(prefixes, ["_len", "_pfx"], "left_anti")
    else:
        digests = staged(BitFilter(prefixes, "_len", "_pfx", bits=filter_bits).keep(rows)
                         .select("_id", "_len", "_pfx", sha), "exact-digests")
        survivors = digests.join(prefixes, ["_len", "_pfx"], "left_semi")
        settled = keys.join(prefixes, ["_len", "_pfx"], "left_anti").withColumn("_sha", F.lit(None).cast("string"))
    groups = staged(survivors.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
                    .where("group_size > 1"), "exact-groups")
    found = survivors.join(groups, "_sha", "left").select(
        "_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "_sha")
    out = found.unionByName(settled.select("_id", F.col("_id").alias("keep_id"),
                                           F.lit(1).cast("long").alias("group_size"), "_sha"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
