"""Benchmark the headline jobs and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each job is materialised with the ``noop`` sink (every row and every column
of the job computed, nothing collected to the driver). A warm-up pass on the
smallest scale factor runs first so JIT and code generation are not timed.

``queries`` are the headline jobs, each the median of ``RUNS`` runs, whose times
add up to ``value``. ``more`` has
jobs that are not part of the sum: the whole workflow record, the prompts, a
sink, a stream, and the extraction over a replicated page table, large enough
that execution dominates (``html_mb_per_core_sec``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.checks.suite import o22_crawl  # noqa: E402
from pagemill.checks.suite_steps import o47_write  # noqa: E402
from pagemill.checks.suite_publish import o55_publish  # noqa: E402
from pagemill.checks.suite_tasks import o71_task_state_events  # noqa: E402
from pagemill.checks.suite_workflow import o60_url_to_article  # noqa: E402
from pagemill.checks.suite import pages_with  # noqa: E402
from pagemill.checks.suite_steps import docs  # noqa: E402
from pagemill.checks.suite_tasks import o81_task_state_stream  # noqa: E402
from pagemill.checks.suite_publish import o03_outbox_sink  # noqa: E402
from pagemill.checks.suite_workflow import _spark_article  # noqa: E402
from pagemill.operators.analyze import analysis_prompts  # noqa: E402
from pagemill.operators.crawl import crawl  # noqa: E402
from pagemill.operators.publish import to_html_sql  # noqa: E402
from pagemill.session import build_session  # noqa: E402
from pagemill.sources.tables import read_table  # noqa: E402


def o52_html(spark, sf):
    return read_table(spark, sf, "documents", spread_rows=True).selectExpr("doc_id", f"{to_html_sql('text')} AS html")


JOBS = {
    "crawl_pages": o22_crawl,            # O22: full extraction over pages
    "article_html": o52_html,            # O52: documents -> HTML payload content
    "url_to_article": o60_url_to_article,  # O60: crawl -> analyze -> write
    "analyze_write_docs": o47_write,      # O36+O47 over documents with reply join
    "publish_docs": o55_publish,          # O50-O55 over documents
    "task_state": o71_task_state_events,  # O71: latest state of the task log
}


COPIES = 20


def replicated_crawl(spark, sf):
    """Every column of the extraction over each page ``COPIES`` times."""
    pages = pages_with(spark, sf).selectExpr(f"explode(sequence(1, {COPIES})) AS copy", "*")
    return crawl(pages.repartition(64))


MORE = {
    "url_to_article_whole": _spark_article,   # O60 with images, links, metadata and the stored JSON
    "analysis_prompts": lambda spark, sf: analysis_prompts(docs(spark, sf)),
    "outbox_sink": o03_outbox_sink,           # O03: written and read back
    "task_state_stream": o81_task_state_stream,
    "crawl_replicated": replicated_crawl,
}


RUNS = 3


def run(spark, sf, fn) -> float:
    """Seconds to build, plan (once) and run the job."""
    t = time.time()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": "12g"})
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for fn in [*JOBS.values(), *MORE.values()]:
            run(spark, warm, fn)
    times = {name: round(statistics.median(run(spark, sf, fn) for _ in range(RUNS)), 3) for name, fn in JOBS.items()}
    more = {name: round(run(spark, sf, fn), 3) for name, fn in MORE.items()}
    html = read_table(spark, sf, "pages").selectExpr("count(*) AS n", "sum(octet_length(html)) AS b").first()
    out = {"metric": "total_job_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
           "cpus": cpus, "runs": RUNS, "more": more,
           "pages_per_sec_crawl": round(html.n / times["crawl_pages"], 1),
           "html_mb_per_core_sec": round(html.b * COPIES / 1e6 / more["crawl_replicated"] / cpus, 2)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
