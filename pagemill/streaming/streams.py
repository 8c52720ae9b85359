"""Structured Streaming forms.

O80 is the crawl projection over a page stream: stateless, no watermark,
appended to a parquet table (exactly-once through the checkpoint).

O81 is the task-state aggregate over a task-event stream. The latest
``(ts, seq)`` per field wins, so late or out-of-order events are harmless
and no watermark is needed; the state store holds one row per task, spread
over the shuffle partitions by task id. In update mode each micro-batch
emits only the tasks whose state changed; they are appended to a change
table with their batch id, so a batch costs O(changed tasks), not O(all
tasks). The current state is the latest row per task (``read_task_state``),
and a replayed batch rewrites identical rows, so retries are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.crawl import crawl
from ..operators.tasks import events_from_log, latest_state
from ..session import scratch_path

EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")


def _glob(path: str) -> str:
    """File sources watch a directory or glob. A name that ends in
    ``.parquet`` may be a single file, which is read via a one-file glob (of a
    directory it matches the directory); other paths, also of remote stores,
    pass as they are."""
    if not path.endswith(".parquet") or any(ch in path for ch in "*?["):
        return path
    return path[:-1] + "[" + path[-1] + "]"


def crawl_stream(spark: SparkSession, pages_path: str, out_path: str, checkpoint: str,
                 **crawl_options) -> None:
    """Run the crawl over every page that has arrived, then stop
    (``availableNow``); later runs pick up only new files."""
    pages = spark.readStream.schema(schemas.PAGE_IN).parquet(_glob(pages_path))
    q = (crawl(pages, **crawl_options).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def task_state_stream(spark: SparkSession, events_path: str, out_path: str, checkpoint: str,
                      max_files_per_trigger: int | None = None) -> None:
    """Maintain the latest task state from an event stream."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(_glob(events_path))
    state = latest_state(events_from_log(events))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out_path)

    q = (state.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_task_state(spark: SparkSession, *paths: str) -> DataFrame:
    """Current task state from the change table (or a snapshot of
    ``compact_task_state`` and the batches since): the row of the latest batch
    per task (a partial aggregate, like the batch form)."""
    ch = spark.read.parquet(*paths)
    cols = [c for c in ch.columns if c not in ("task_id", "batch_id")]
    latest = F.expr("max_by(named_struct(" + ", ".join(f"'{c}', `{c}`" for c in cols) + "), batch_id)")
    return ch.groupBy("task_id").agg(latest.alias("s")).select("task_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def compact_task_state(spark: SparkSession, changes_path: str, snapshot_path: str) -> None:
    """Write the current state as a change table of one row per task. Start a
    new change table from it (copy or ``union`` it with newer batches): rows
    keep their batch id, so later changes still win."""
    ch = spark.read.parquet(changes_path)
    last = ch.groupBy("task_id").agg(F.max("batch_id").alias("batch_id"))
    ch.join(last, ["task_id", "batch_id"]).dropDuplicates(["task_id"]).write.mode("overwrite").parquet(snapshot_path)


def run_crawl_stream(spark: SparkSession, pages_path: str, **crawl_options) -> DataFrame:
    out, ck = scratch_path(spark, "crawl-stream"), scratch_path(spark, "crawl-stream-ckpt")
    crawl_stream(spark, pages_path, out, ck, **crawl_options)
    return spark.read.parquet(out)


def run_task_state_stream(spark: SparkSession, events_path: str) -> DataFrame:
    out, ck = scratch_path(spark, "task-state"), scratch_path(spark, "task-state-ckpt")
    task_state_stream(spark, events_path, out, ck)
    return read_task_state(spark, out)
