import os
import tempfile

from pagemill.operators.tasks import events_from_log, latest_state
from pagemill.streaming.streams import _glob, compact_task_state, read_task_state, task_state_stream


def test_task_state_over_many_batches_equals_batch(spark):
    """Events arrive as 4 files, one per micro-batch (late and early events
    mixed); the change table's latest rows equal the batch state."""
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    src = tempfile.mkdtemp(prefix="ev-")
    ev.selectExpr("*", "event_id % 4 AS part").repartition(1).write.partitionBy("part").parquet(
        os.path.join(src, "staged"))
    for p in range(4):
        spark.read.parquet(os.path.join(src, "staged", f"part={p}")).coalesce(1).write.parquet(
            os.path.join(src, "in", f"f{p}"))
    out, ck = tempfile.mkdtemp(prefix="st-"), tempfile.mkdtemp(prefix="ck-")
    task_state_stream(spark, os.path.join(src, "in", "*"), out, ck, max_files_per_trigger=1)
    changes = spark.read.parquet(out)
    assert changes.select("batch_id").distinct().count() == 4
    streamed = sorted(read_task_state(spark, out).collect())
    batch = sorted(latest_state(events_from_log(ev)).collect())
    assert streamed == batch
    # a snapshot of the first batches and the batches since give the same
    snap, early, late = (tempfile.mkdtemp(prefix=p) for p in ("snap-", "early-", "late-"))
    changes.where("batch_id < 2").write.mode("overwrite").parquet(early)
    changes.where("batch_id >= 2").write.mode("overwrite").parquet(late)
    compact_task_state(spark, early, snap)
    assert spark.read.parquet(snap).count() == changes.where("batch_id < 2").select("task_id").distinct().count()
    assert sorted(read_task_state(spark, snap, late).collect()) == batch


def test_remote_folders_pass_unchanged():
    for path in ("s3a://bucket/pages/", "hdfs://nn/pages", "/data/pages", "s3a://bucket/*.parquet"):
        assert _glob(path) == path
    assert _glob("/data/pages.parquet") == "/data/pages.parque[t]"
