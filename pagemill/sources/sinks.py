"""Sinks: the publishing outbox (O03), the result sink (O04) and the
outbox listing (O05).

The outbox is a table of batches. Each write is one whole-DataFrame job into a
folder of its own; a one-row manifest file, written last, commits it. Readers
take the batches that the manifest names, so a half-written one is never seen
and an earlier one never lost. Rows already committed are left out of a new
batch (an anti-join on their ids), so a repeated job adds nothing.

The outbox keeps every row with its ``success`` flag instead of filtering
before the write: a filter on a column derived through many projections is
pushed down by substituting every alias definition into the predicate,
which grows exponentially at planning time. After the storage boundary the
same filter is a cheap scan predicate.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

_ITEMS = ("row_id STRING, item_id STRING, kind STRING, success BOOLEAN, title STRING, author STRING, content STRING, digest STRING, "
          "show_cover_pic INT, thumb_media_id STRING, seq BIGINT, batch STRING, draft_only BOOLEAN")
_MANIFEST = "batch STRING, items BIGINT"


def outbox_rows(published: DataFrame, order_col: str | None = None) -> DataFrame:
    """One outbox row per article (payload + platform id + ``success``);
    ``order_col`` is carried as ``seq`` for listing."""
    seq = f"`{order_col}`" if order_col else "CAST(NULL AS BIGINT)"
    return published.selectExpr(
        "coalesce(publish_result.article_id, publish_result.draft_id) AS item_id",
        "'news' AS kind", "publish_result.success AS success", "draft_only", "payload.title AS title", "payload.author AS author",
        "payload.content AS content", "payload.digest AS digest",
        "payload.show_cover_pic AS show_cover_pic", "payload.thumb_media_id AS thumb_media_id",
        f"{seq} AS seq")


def _stored(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A folder of the outbox; one that was never written is empty."""
    try:
        return spark.read.schema(schema).format(fmt).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: ``batch`` and its number of ``items``."""
    return _stored(spark, f"{path}/manifest", _MANIFEST).dropDuplicates(["batch"])


def write_outbox(published: DataFrame, path: str, fmt: str = "parquet",
                 order_col: str | None = None, batch: str | None = None) -> int:
    """Append one batch of articles, split into draft / publish
    partitions; the number of rows it added.

    A row is known by its ``item_id``, a failed one (it has none) by a digest of
    its columns; rows that an earlier batch committed are not added again,
    repeated rows within one batch stay. ``batch`` names the batch (default: a
    new name); naming a committed one again adds nothing, naming one that broke
    off replaces what it left. One writer at a time: two that run at once don't
    see each other's rows.
    """
    spark = published.sparkSession
    batch = batch or os.urandom(8).hex()
    if not committed_batches(spark, path).where(F.col("batch") == batch).isEmpty():
        return 0
    rows = outbox_rows(published, order_col).withColumn("seq", F.col("seq").cast("bigint"))
    rows = rows.withColumn("row_id", F.coalesce("item_id", F.sha2(F.to_json(F.struct(*rows.columns)), 256)))
    known = read_outbox(spark, path, fmt, keep_ids=True).select("row_id")
    # published rows are derived from much: written once, then compared and counted from the table
    rows = stage(rows, "outbox-batch").join(known, "row_id", "left_anti")
    folder = f"{path}/items/batch=b-{batch}"
    rows.write.mode("overwrite").partitionBy("draft_only").format(fmt).save(folder)
    added = spark.read.schema(_ITEMS).format(fmt).load(folder).count()
    spark.createDataFrame([(batch, added)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return added


def read_outbox(spark: SparkSession, path: str, fmt: str = "parquet", keep_ids: bool = False) -> DataFrame:
    """The rows of all committed batches. ``keep_ids`` keeps ``row_id`` and
    ``batch``."""
    done = committed_batches(spark, path).select(F.concat(F.lit("b-"), F.col("batch")).alias("batch"))
    items = _stored(spark, f"{path}/items", _ITEMS, fmt).join(done, "batch", "left_semi")
    return items if keep_ids else items.drop("row_id", "batch")


def list_items(outbox: DataFrame, kind: str = "news", offset: int = 0, count: int = 20,
               after: tuple[int, str] | None = None) -> DataFrame:
    """One page of items of one kind, in a total order (newest
    ``seq`` first, then id) -- the remote API left the order implicit.
    A top-k with offset: Spark plans it as a bounded TakeOrderedAndProject,
    never a full sort to one task. Deep pages cost offset + count rows in that
    task; ``after``, the (seq, item_id) of the last item of the page before,
    makes the page start there and cost ``count`` rows however deep."""
    if after is not None:
        seq, item = after
        outbox = outbox.where((F.col("seq") < seq) | F.col("seq").isNull() | ((F.col("seq") == seq) & (F.col("item_id") > item))
                              if seq is not None else F.col("seq").isNull() & (F.col("item_id") > item))
    return (outbox.where(outbox["success"] & (outbox["kind"] == kind))
            .orderBy(outbox["seq"].desc_nulls_last(), outbox["item_id"])
            .offset(offset).limit(count))


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The nested workflow result, stored whole (parquet keeps the
    nesting; ``fmt='json'`` gives JSON lines)."""
    results.write.mode("overwrite").format(fmt).save(path)
