import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "url", "title", "content", "content_length", "crawl_error"]
    rows = df.collect()
    assert len(rows) == 50 and all(r.crawl_error is None for r in rows)


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_stream_equals_batch(spark):
    from pagemill.checks.suite import o22_crawl
    from pagemill.checks.suite_tasks import o71_task_state_events, o80_crawl_stream, o81_task_state_stream
    sf = "/root/testdata/sf0.001"
    assert sorted(o80_crawl_stream(spark, sf).collect()) == sorted(o22_crawl(spark, sf).collect())
    assert sorted(o81_task_state_stream(spark, sf).collect()) == sorted(o71_task_state_events(spark, sf).collect())
